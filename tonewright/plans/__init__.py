"""Registered queries and their SQL twins."""

from . import datasets, drivers, extraction, features, language, markup, mentions, models, outputs, predict, sampling, scans, text  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
