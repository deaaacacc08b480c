"""A log of what a run does, taken from its own passes.

`seen` puts a measurement into a plan: when the plan runs for whatever purpose, Spark also counts its rows, nulls and classes.  So a log costs no
pass of its own.  `lines` waits for what has run and gives one row a number.  A plan that did not run has no lines; one that ran
more than once is told by its first run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHAPE = "run string, at timestamp, step string, name string, n long"


@dataclass
class RunLog:
    """The steps of one run, in the order in which they were planned."""

    run: str
    steps: list[tuple[str, Observation, datetime]] = field(default_factory=list)

    def seen(self, rows: DataFrame, step: str, nulls: tuple[str, ...] = (), classes: dict[str, tuple] | None = None) -> DataFrame:
        """`rows`, measured as they pass: their number, nulls by column, and rows of each listed value of a column."""
        watched = Observation(f"{self.run}/{step}/{len(self.steps)}")
        counts: list[Column] = [F.count(F.lit(1)).alias("rows")]
        counts += [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in nulls]
        counts += [F.count_if(F.col(c) == v).alias(f"{c} = {v}") for c, values in (classes or {}).items() for v in values]
        self.steps.append((step, watched, datetime.now(UTC)))
        return rows.observe(watched, *counts)

    def lines(self, spark: SparkSession) -> DataFrame:
        """(run, at, step, name, n) of the steps that have run."""
        found = []
        for step, watched, at in self.steps:
            if watched._jo is not None and watched._jo.future().isCompleted():
                found += [(self.run, at, step, name, n) for name, n in watched.get.items()]
        return spark.createDataFrame(found, SHAPE)

    def write(self, spark: SparkSession, folder: str) -> None:
        """Append the lines to the log of all runs."""
        self.lines(spark).coalesce(1).write.mode("append").parquet(folder)
