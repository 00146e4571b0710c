"""Append-only checkpoints keyed by row_index: reading with last write wins, appending, and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TEXT = "row_index long, enhanced_description string"
IMAGE = "row_index long, persona_id string, image_path string"


def last_write(rows: DataFrame, order: list[str], key: str = "row_index") -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, fields …) of the JSON lines under ``path``; a missing path is an empty table, blank lines are skipped.

    A line that is no object with all fields (persona_id may be null) fails the job with its file and number. Each file
    is read whole and cut into lines, so its order is known; a file holds a chunk of results.
    """
    names = [p.split()[0] for p in schema.split(",")]
    try:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "file string, line_no long, " + schema)
        raise
    lines = files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r", -1)).alias("at", "line")).where("trim(line) <> ''")
    parsed = lines.select("file", (F.col("at") + 1).cast("long").alias("line_no"), F.from_json("line", schema).alias("r"))
    whole = F.col("r").isNotNull()
    for n in set(names) - {"persona_id"}:
        whole &= F.col(f"r.{n}").isNotNull()
    checked = F.when(whole, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("malformed checkpoint line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"))))
    return parsed.select("file", "line_no", checked.alias("r")).select("file", "line_no", "r.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, enhanced_description), later lines and later shards win."""
    return last_write(read_lines(spark, path, TEXT), ["file", "line_no"])


def read_images(spark: SparkSession, path: str, images: str) -> DataFrame:
    """(row_index, persona_id, image_path) of the lines whose image is among the files under ``images``; later lines win."""
    lines = read_lines(spark, path, IMAGE)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(images).select(F.regexp_replace("path", "^file:/+", "/").alias("image_path"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], IMAGE)
        raise
    return last_write(lines.join(files, "image_path", "left_semi").select(*lines.columns), ["file", "line_no"])


def append(rows: DataFrame, path: str) -> None:
    """Adds ``rows`` as JSON lines, in files after those that are there. Runs write their chunks themselves, see streaming.resume."""
    rows.write.mode("append").json(path)


def pending(rows: DataFrame, done: DataFrame, key: str = "row_index") -> DataFrame:
    """The rows that aren't done yet."""
    return rows.join(done.select(key), key, "left_anti")


def missing(rows: DataFrame, done: DataFrame, preview: int = 20, key: str = "row_index") -> DataFrame:
    """(n_missing, first): how many rows have no result, and the first of them."""
    lost = pending(rows, done, key)
    first = lost.orderBy(key).limit(preview).agg(F.array_sort(F.collect_list(key)).alias("first"))
    return lost.agg(F.count(F.lit(1)).alias("n_missing")).select("n_missing", first.scalar().alias("first"))


def merge(rows: DataFrame, done: DataFrame, key: str = "row_index") -> DataFrame:
    """``rows`` with the results of ``done``; a ValueError names the first missing rows if any has none."""
    m = missing(rows, done, key=key).first()
    if m["n_missing"]:
        raise ValueError(f"Missing {m['n_missing']} rows, first {m['first']}")
    return rows.join(done, key)


def missing_shards(rows: DataFrame, done: DataFrame, shards: int, key: str = "row_index") -> list[int]:
    """The shards that have rows but not one result, in order; at most ``shards`` numbers."""
    of = lambda df: df.select(F.pmod(F.col(key), F.lit(shards)).alias("shard")).distinct()
    return sorted(r["shard"] for r in of(rows).join(of(done), "shard", "left_anti").collect())
