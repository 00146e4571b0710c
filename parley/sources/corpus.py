"""Reading and writing corpora: tables by split, required columns, limits in source order, archives and digests."""

from __future__ import annotations

import hashlib
import os
import tarfile
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import resolve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or a ValueError that lists the missing and the available columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def existing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Columns whose names contain ``part`` in any case."""
    return [n for n in df.columns if part.lower() in n.lower()]


def config_path(path: str, config: str | None) -> str:
    """The folder of a named configuration of a corpus, or of the corpus itself."""
    return path if config is None else f"{path}/{config}"


def read_split(spark: SparkSession, path: str, schema: StructType | str, split: str | None = None, required: list[str] = (), limit: int | None = None, config: str | None = None) -> DataFrame:
    """A corpus directory partitioned by split, or one split of it; the partition filter prunes files. ``config`` names one of several corpora under ``path``."""
    df = spark.read.schema(schema).parquet(config_path(path, config))
    return head(require_columns(df.where(F.col("split") == split) if split is not None else df, list(required)), limit)


def head(df: DataFrame, limit: int | None, index: str = "row_index") -> DataFrame:
    """The first rows in source order: all for None, none for 0."""
    return df if limit is None else df.where(F.col(index) < limit)


def write_corpus(df: DataFrame, path: str, by: str = "split", config: str | None = None) -> None:
    """Replaces the corpus at ``path`` (its configuration ``config``), one directory per split."""
    df.write.mode("overwrite").partitionBy(by).parquet(config_path(path, config))


def write_single(df: DataFrame, path: str, order: str = "row_index") -> None:
    """Replaces ``path`` by one sorted parquet file, for a target that wants one; the last step goes through one task."""
    df.orderBy(order).coalesce(1).write.mode("overwrite").parquet(path)


def read_back(df: DataFrame, path: str, config: str | None = None) -> list[str]:
    """What differs between ``df`` and the corpus written to ``path``: columns, types, rows by split. Empty if nothing does."""
    again = df.sparkSession.read.parquet(config_path(path, config))
    out = []
    types = lambda x: {f.name: f.dataType.simpleString() for f in x.schema}
    if types(df) != types(again):
        out.append(f"schema: {types(df)} and {types(again)}")
    if "split" in df.columns:
        a, b = (dict(x.groupBy("split").count().collect()) for x in (df, again))  # a row per split
        if a != b:
            out.append(f"rows by split: {a} and {b}")
    elif df.count() != again.count():
        out.append("rows")
    return out


def stage_for_review(df: DataFrame, staging: str, target: str, message: str) -> None:
    """Writes ``df`` and a row about where it should go to a staging path; nothing is ever published from here."""
    df.write.mode("overwrite").parquet(f"{staging}/data")
    df.sparkSession.createDataFrame([(target, message)], "target string, message string").write.mode("overwrite").json(f"{staging}/request")


def with_row_index(df: DataFrame, order: list[str], parts: int = 64) -> DataFrame:
    """``df`` with a dense 0-based row_index in the given order, which must be total.

    Rows are range-partitioned and numbered within their partition; a partition's rows are shifted by the counts of the
    partitions before it, so no task sees more than its range. Written once: both steps must see the same ranges.
    """
    from ..session import cut

    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("row_index", F.col("_before") + within).drop("_at", "_part", "_before")


def file_digest(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def fetch_archive(fetch: Callable[[], Iterator[bytes]], target: str | Path, sha256: str) -> Path:
    """The archive at ``target``: the file there if its digest fits, else what ``fetch`` yields, moved there only once its digest fits.

    A partial or wrong download is deleted, and a ValueError tells of a wrong digest.
    """
    target = Path(target)
    if target.exists() and file_digest(target) == sha256:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            for block in fetch():
                f.write(block)
        if file_digest(name) != sha256:
            raise ValueError(f"digest of {target.name} is not {sha256}")
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return target


def tar_members(spark: SparkSession, path: str, members: dict[str, str]) -> DataFrame:
    """(split, text) of the named UTF-8 members (split -> name) of the gzipped tar archives under ``path``; a missing member is an error.

    Archives are read as streams where they lie, each by one task; only the wanted members are held.
    """
    bare = lambda name: name[2:] if name.startswith("./") else name
    split_of = {bare(name): split for split, name in members.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for where in (w for b in batches for w in b["path"]):
            system, at = resolve(where)
            seen = set()
            with system.open_input_stream(at, compression=None) as source, tarfile.open(fileobj=source, mode="r|gz") as archive:
                for member in archive:
                    name = bare(member.name)
                    if name in split_of and member.isfile():
                        seen.add(name)
                        yield pd.DataFrame({"split": [split_of[name]], "text": [archive.extractfile(member).read().decode("utf-8")]})
            if len(seen) < len(split_of):
                raise ValueError(f"archive lacks {sorted(split_of.keys() - seen)}")

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "split string, text string")
