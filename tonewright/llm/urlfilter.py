"""URL rules applied by a sort-merge range join.

A host reversed label by label ("www.example.com" -> "com.example.www.") makes a rule and all its
subdomains one prefix, and a prefix is an interval of keys: [p, p + the greatest character).  Two
intervals are nested or disjoint, so one pass over sorted keys keeps the open rules on a stack.  URLs are
range-partitioned on (key, path, page_id), so one host, or one URL, spreads over many tasks; each task
opens the rules that cover its first key and then sweeps.  A host's own rules stand together on the stack; their paths
are intervals too, so the one sought is the last that begins at or before the URL's path, or one of those that it is nested in.

Rules are (action, host, path) in a Python list, shipped with the tasks; `MAX_RULES` bounds them, and a
longer list is applied in blocks of that many, the longest rule over all blocks winning.

Defined results: urls of any length are read whole; a null url or one without `://` has empty host and path and fits no rule; among fitting
rules the longest (host and path characters) wins, ties go to the first listed; no rule: allow.
Empty tables give empty results; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Rules that are shipped to the tasks at once.
MAX_RULES = 100_000
DEFAULT = "allow"


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path, cut from `url` as the module says."""
    head = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(head, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", F.coalesce(lower, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def reversed_host(host: str) -> str:
    """com.example.www. for www.example.com; empty for an empty host."""
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Paths:
    """The path rules of one host: prefixes ascending, each with its rule's index and the place of the prefix it is nested in."""

    def __init__(self, key: str, size: int):
        self.key, self.size = key, size  # the reversed host and its characters
        self.paths: list[str] = []
        self.index: list[int] = []
        self.outer: list[int] = []

    def add(self, path: str, index: int) -> None:
        """Paths come ascending; of equal ones the first counts."""
        if self.paths and self.paths[-1] == path:
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.paths.append(path)
        self.index.append(index)
        self.outer.append(at)

    def fit(self, path: str) -> int:
        """The place of the longest prefix of `path`, or -1."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


class Sweep:
    """Hosts with their rules ascending by key prefix, met by keys in ascending order.

    The stack holds the hosts whose interval contains the current key, outermost first; each is pushed and popped once.
    """

    def __init__(self, hosts: list[Paths]):
        self.hosts, self.at, self.stack = hosts, 0, []

    def fit(self, key: str, path: str) -> int:
        """The index of the longest rule that fits, the first listed of ties, or -1."""
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        raw = key.encode()
        while self.at < len(self.hosts) and self.hosts[self.at].key.encode() <= raw:
            if key.startswith(self.hosts[self.at].key):
                self.stack.append(self.hosts[self.at])
            self.at += 1
        best = (0, -1)
        for host in self.stack:
            if (at := host.fit(path)) >= 0:
                size = host.size + len(host.paths[at])
                if best[1] < 0 or size > best[0] or (size == best[0] and host.index[at] < best[1]):
                    best = size, host.index[at]
        return best[1]


def _ordered(rules: list[tuple[str, str, str]]) -> list[Paths]:
    hosts: list[Paths] = []
    for key, path, index, size in sorted(((reversed_host(h.lower()), p, i, len(h)) for i, (_, h, p) in enumerate(rules)), key=lambda r: (r[0].encode(), r[1], r[2])):
        if not hosts or hosts[-1].key != key:
            hosts.append(Paths(key, size))
        hosts[-1].add(path, index)
    return hosts


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`."""
    spark = pages.sparkSession
    bounded_batches(spark)
    base = parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).drop("url")
    if not rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    turned = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = base.withColumn("key", turned).repartitionByRange(tasks, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")

    def apply(chosen: list[tuple[str, str, str]]):
        def run(batches):
            stack = Sweep(_ordered(chosen))
            for b in batches:
                found = [stack.fit(k, p) for k, p in zip(b.column("key").to_pylist(), b.column("path").to_pylist(), strict=True)]
                rule = [chosen[i][1] + chosen[i][2] if i >= 0 else None for i in found]
                action = [chosen[i][0] if i >= 0 else None for i in found]
                size = [len(r) if r is not None else -1 for r in rule]
                columns = [b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(action, pa.string()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "action", "size"])

        return run

    schema = "page_id long, host string, path string, rule string, action string, size int"
    swept = [keyed.mapInArrow(apply(rules[i : i + MAX_RULES]), schema) for i in range(0, len(rules), MAX_RULES)]
    out = swept[0]
    if len(swept) > 1:
        # One row a page and block of rules; max_by keeps the longest rule.  Repeated rows are told apart by their count.
        many = swept[0].withColumn("block", F.lit(0))
        for i, more in enumerate(swept[1:], 1):
            many = many.unionByName(more.withColumn("block", F.lit(i)))
        best = F.max_by(F.struct("rule", "action"), F.struct("size", -F.col("block"))).alias("best")
        copies = F.expr("count_if(block = 0)").cast("int").alias("copies")
        many = many.groupBy("page_id", "host", "path").agg(best, copies)
        out = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("page_id", "host", "path", "best.rule", "best.action")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(DEFAULT)).alias("verdict"))
