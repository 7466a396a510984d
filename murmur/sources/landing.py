"""Readers of landed files: CSV lists, JSON lines, raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First cells that mark a header line (fixed values).
HEADERS = ("url", "urls", "profile", "profile_url", "profileurl", "handle", "handles", "link", "links", "creator", "creators", "username", "name", "twitter", "linkedin")


def first_cells(lines: DataFrame) -> DataFrame:
    """(n, cell): S15: the first cell of each line (n, value), without quotes; blank ones are left out, and the first that is not blank if it is a header."""
    cell = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.split("value", ",")[0], r"^\s+|\s+$", "")), r"^[\"']|[\"']$", ""))
    rows = lines.select("n", cell.alias("cell")).where("cell <> ''")
    first = rows.agg(F.min(F.struct("n", F.lower("cell").alias("word"))).alias("f"))  # one row
    return rows.crossJoin(first).where(~((F.col("n") == F.col("f.n")) & F.col("f.word").isin(*HEADERS))).select("n", "cell")


def draft_files(spark: SparkSession, folder: str) -> DataFrame:
    """(day, draft, archetype, text): S17: the drafts of dated files ``yyyy-MM-dd.json``; entries without all three texts are skipped.

    Of drafts with one id in a file one counts. A file that is not JSON or holds no list has no drafts.
    """
    files = spark.read.option("wholetext", "true").text(f"{folder}/*.json").select("value", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.json$", 1).try_cast("date").alias("day"))
    lists = F.try_variant_get(F.try_parse_json("value"), "$.drafts", "array<variant>")
    rows = files.where("day IS NOT NULL").select("day", F.explode(lists).alias("d"))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("d", f"$.{p}", "variant")) == "STRING", F.try_variant_get("d", f"$.{p}", "string"))
    return rows.select("day", text("id").alias("draft"), text("archetype").alias("archetype"), text("text").alias("text")).dropna().dropDuplicates(["day", "draft"])


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one text file with their number."""
    return spark.read.text(path).withColumn("n", F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON lines log; corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed source records, each line whole in ``raw``; mappers read the fields they know from it."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where(F.trim("raw") != "")
