"""The ledger of ingest runs as a table: rows are added when a run starts and completed when it ends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("keyword_raw", "creator_raw", "merged_total", "duplicates", "found_in_both", "inserted")
SCHEMA = "id string, status string, mode string, platforms string, " + ", ".join(f"{c} long" for c in COUNTS) + ", error string, started_at timestamp, finished_at timestamp"


def started(runs: DataFrame) -> DataFrame:
    """K9: ledger rows of runs (id, mode, platforms, started_at) that begin: running, with no counts yet."""
    return runs.select("id", F.lit("running").alias("status"), "mode", "platforms", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("error"), "started_at", F.lit(None).cast("timestamp").alias("finished_at"))


def finished(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """K9: the ledger after runs ended: ``results`` (id, counts..., error, finished_at), one row a run; an error means failure and leaves the counts at 0.

    Runs that the ledger does not know are not added.
    """
    r = results.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in (*COUNTS, "error", "finished_at")])
    rows = ledger.join(r, F.col("id") == F.col("_id"), "left")
    done, failed = F.col("_id").isNotNull(), F.col("_error").isNotNull()
    status = F.when(done & failed, "failed").when(done, "succeeded").otherwise(F.col("status")).alias("status")
    counts = [F.when(done & ~failed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in COUNTS]
    return rows.select("id", status, "mode", "platforms", *counts, F.coalesce("_error", "error").alias("error"), "started_at", F.coalesce("_finished_at", "finished_at").alias("finished_at"))


def recent(ledger: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` runs that started last, the larger id first when equal; the bound is the feature."""
    return ledger.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def ready(settings: Mapping[str, str], needed: Mapping[str, str]) -> dict[str, bool]:
    """Which providers have the setting that they need, present and not empty."""
    return {name: bool(settings.get(key)) for name, key in needed.items()}


def masked(settings: Mapping[str, str], secrets: tuple[str, ...]) -> dict[str, str]:
    """Settings with every secret shown as set or unset only."""
    return {**settings, **{k: "set" if settings.get(k) else "unset" for k in secrets}}
