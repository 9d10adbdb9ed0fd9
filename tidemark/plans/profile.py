"""Profile a dataset: statistics and all findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators.detect_dups import detect_cross_row
from ..operators.detect_rows import detect_row_level
from ..operators.stats import Stats, column_stats
from ..storage import keep


@dataclass
class Profile:
    stats: Stats
    findings: DataFrame


def profile_dataset(rows: DataFrame, headers: list[str], config: Config = DEFAULT) -> Profile:
    """Statistics of all columns, then row-level and cross-row findings; both are written tables."""
    stats = column_stats(rows, headers, config)
    found = detect_row_level(rows, headers, stats, config).unionByName(detect_cross_row(rows, headers, config))
    return Profile(stats, keep(found, "findings"))


def split_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved by a rule, ambiguous); every finding is in exactly one."""
    return findings.filter("not ambiguous"), findings.filter("ambiguous")


def rule_resolution_rate(findings: DataFrame) -> DataFrame:
    """rate: the share of findings with a suggestion; 1 without findings."""
    return findings.agg(F.coalesce(F.avg(F.when(~F.col("ambiguous"), 1.0).otherwise(0.0)), F.lit(1.0)).alias("rate"))
