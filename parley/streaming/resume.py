"""Resumable runs of a model over a column: shards, pending rows, results written in small chunks, and what a failed row becomes.

Results are keyed by row_index alone, so another number of shards goes on where the last run stopped. Workers write
their results themselves while they run, a file for each chunk: a crash loses the rows of the open chunks, at most
FLUSH - 1 for each task, and nothing that was written. The folder must be one that all executors share.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import rgb_png
from ..functions.text import clean_text
from ..functions.udfs import model
from ..sources import checkpoints, files
from ..sources.corpus import head, require_columns

#: Fixed value: rows of a text stage's chunk.
FLUSH = 50
log = logging.getLogger(__name__)


def shard(df: DataFrame, shards: int, index: int, key: str = "row_index") -> DataFrame:
    """The rows of one shard; a ValueError for fewer than one shard or an index out of range."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError(f"shard {index} of {shards}")
    return df.where(shard_of(F.col(key), shards) == index)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(key, F.lit(shards))


def fanned_out(df: DataFrame, shards: int, key: str = "row_index") -> DataFrame:
    """``df`` with one partition for each shard, so that a task runs a shard; the scheduler gives each task its device."""
    return df.repartitionById(shards, shard_of(F.col(key), shards).cast("int"))


def enhanced(df: DataFrame, prompt: Column, build: Callable[[], Callable[[str], str]], clean: Callable[[Column], Column]) -> DataFrame:
    """(row_index, enhanced_description, error): the cleaned answer, or the prompt itself where the model failed (the row is done)."""
    d = df.select("row_index", prompt.alias("prompt")).withColumn("r", model(build)(F.col("prompt")))
    return d.select("row_index", F.coalesce(clean(F.col("r.value")), F.col("prompt")).alias("enhanced_description"), F.col("r.error").alias("error"))


def _tally(work: DataFrame) -> dict[str, int]:
    """Runs ``work`` (row_index, error) and counts rows done and failed; failures are logged, the first of them by name."""
    r = work.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.min(F.when(F.col("error").isNotNull(), F.struct("row_index", "error"))).alias("first")).first()
    if r["failed"]:
        log.warning("%d of %d rows failed, first row %s: %s", r["failed"], r["n"], r["first"]["row_index"], r["first"]["error"])
    return {"rows": r["n"], "failed": r["failed"]}


def write_texts(todo: DataFrame, prompt: Column, build: Callable[[], Callable[[str], str]], path: str, clean: Callable[[str], str] = clean_text, flush: int = FLUSH) -> dict[str, int]:
    """Answers for all rows of ``todo``, written to the checkpoint folder ``path`` every ``flush`` rows and at the end of a task.

    A row whose call fails is logged and gets its prompt as the answer, so it is done. Returns the rows and the failed ones.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict, chunk = build(), []
        for b in batches:
            errors = []
            for i, text in zip(b["row_index"], b["prompt"]):
                try:
                    answer, error = clean(predict(text)), None
                except Exception as e:  # any failure of a row is that row's result
                    answer, error = text, f"{type(e).__name__}: {e}"
                    log.warning("row %s failed: %s", i, error)
                errors.append(error)
                chunk.append({"row_index": int(i), "enhanced_description": answer})
                if len(chunk) >= flush:
                    files.write_lines(path, chunk)
                    chunk = []
            yield pd.DataFrame({"row_index": b["row_index"], "error": pd.Series(errors, dtype="object")})
        files.write_lines(path, chunk)

    return _tally(todo.select("row_index", prompt.alias("prompt")).mapInPandas(work, "row_index long, error string"))


def run_text(df: DataFrame, column: str, prompt: Callable[[Column], Column], build: Callable[[], Callable[[str], str]], path: str, limit: int | None = None, shards: int = 1, index: int | None = 0, force: bool = False, flush: int = FLUSH) -> dict[str, int]:
    """Answers for the pending rows of one shard, or of all shards at once (index None), into the checkpoint at ``path``; ``force`` deletes it first."""
    spark = df.sparkSession
    if force:
        files.delete(spark, path)
    rows = head(require_columns(df, ["row_index", column]), limit)
    rows = fanned_out(rows, shards) if index is None else shard(rows, shards, index)
    todo = checkpoints.pending(rows, checkpoints.read_text(spark, path))
    return write_texts(fanned_out(todo, shards) if index is None else todo, prompt(F.col(column)), build, path, flush=flush)


def image_folders(folder: str) -> tuple[str, str]:
    return f"{folder}/images", f"{folder}/checkpoint"


def _image_rows(df: DataFrame, id_column: str, prompt: Column, folder: str, force: bool) -> DataFrame:
    """(row_index, persona_id, prompt) of the rows without an image; ``force`` empties the folder first."""
    images, log_folder = image_folders(folder)
    if force:
        files.delete(df.sparkSession, folder)
    todo = checkpoints.pending(df, checkpoints.read_images(df.sparkSession, log_folder, images))
    return todo.select("row_index", F.col(f"`{id_column}`").alias("persona_id"), prompt.alias("prompt"))


def _keep(folder: str, row_index: int, persona_id: Any, result: Any) -> None:
    """Writes an image as RGB PNG and then its line in the checkpoint."""
    images, log_folder = image_folders(folder)
    path = f"{images}/{row_index:09d}.png"
    files.write_whole(path, rgb_png(result))
    files.write_lines(log_folder, [{"row_index": row_index, "persona_id": None if persona_id is None else str(persona_id), "image_path": path}])


def run_images(df: DataFrame, id_column: str, prompt: Column, build: Callable[[], Callable[[str], Any]], folder: str, force: bool = False) -> dict[str, int]:
    """An image for each pending row, written with its checkpoint line at once; failed rows are logged, skipped and stay pending."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = build()
        for b in batches:
            errors = []
            for i, who, text in zip(b["row_index"], b["persona_id"], b["prompt"]):
                error = None
                try:
                    _keep(folder, int(i), who, generate(text))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                    log.warning("row %s failed: %s", i, error)
                errors.append(error)
            yield pd.DataFrame({"row_index": b["row_index"], "error": pd.Series(errors, dtype="object")})

    return _tally(_image_rows(df, id_column, prompt, folder, force).mapInPandas(draw, "row_index long, error string"))


def request_position(request_id: Any) -> int:
    """The number before the first underscore of a request id; a ValueError for anything else."""
    head_, _, _ = str(request_id).partition("_")
    if not head_.isdecimal():
        raise ValueError(f"request id {request_id!r} has no position")
    return int(head_)


def in_request_order(results: list, n: int) -> list:
    """The results of ``n`` requests in the order of their requests, by ``request_id`` where they have one; a ValueError if any is missing, repeated or too many."""
    if len(results) != n:
        raise ValueError(f"{len(results)} results of {n} requests")
    if not any(hasattr(r, "request_id") for r in results):
        return list(results)
    at = {request_position(getattr(r, "request_id", None)): r for r in results}
    if sorted(at) != list(range(n)):
        raise ValueError(f"results of the requests {sorted(at)}, not of 0 to {n - 1}")
    return [at[k] for k in range(n)]


def run_batches(df: DataFrame, id_column: str, prompt: Column, build: Callable[[], Callable[[list[str]], list]], folder: str, batch: int, force: bool = False) -> dict[str, int]:
    """As run_images() with a model that takes ``batch`` prompts at once, as many as it has replicas.

    Every batch has to come back as a whole. A failure ends the run; what was written stays, and the next run goes on.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = build()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                results = in_request_order(generate(part["prompt"].tolist()), len(part))
                for i, who, r in zip(part["row_index"], part["persona_id"], results):
                    _keep(folder, int(i), who, r)
            yield pd.DataFrame({"row_index": b["row_index"], "error": pd.Series([None] * len(b), dtype="object")})

    return _tally(_image_rows(df, id_column, prompt, folder, force).mapInPandas(draw, "row_index long, error string"))


def merge_text(df: DataFrame, path: str, limit: int | None = None, name: str = "enhanced_persona_revised", shards: int = 1) -> DataFrame:
    """The rows with their answers; a ValueError names shards without any answer, or counts and names missing rows."""
    rows, done = head(df, limit), checkpoints.read_text(df.sparkSession, path)
    lost = checkpoints.missing_shards(rows, done, shards)
    if lost:
        raise ValueError(f"Missing checkpoint for shards: {lost}")
    return checkpoints.merge(rows, done.withColumnRenamed("enhanced_description", name))


def merge_images(df: DataFrame, folder: str, limit: int | None = None, name: str = "persona-image", shards: int = 1) -> DataFrame:
    """The rows with the paths and bytes of their images as struct ``name``; errors as in merge_text()."""
    images, log_folder = image_folders(folder)
    rows, done = head(df, limit), checkpoints.read_images(df.sparkSession, log_folder, images)
    lost = checkpoints.missing_shards(rows, done, shards)
    if lost:
        raise ValueError(f"Missing checkpoint for shards: {lost}")
    content = df.sparkSession.read.format("binaryFile").load(images).select(F.regexp_replace("path", "^file:/+", "/").alias("image_path"), "content")
    whole = checkpoints.merge(rows, done.select("row_index", "image_path")).join(content, "image_path")
    return whole.withColumn(name, F.struct(F.col("content").alias("bytes"), F.col("image_path").alias("path"))).drop("content", "image_path")


def stream_text(spark: SparkSession, source: str, schema: str, prompt: Callable[[Column], Column], column: str, build: Callable[[], Callable[[str], str]], path: str, state: str):
    """The same as a stream over parquet files that arrive in ``source``; started with all files there, it ends when they are done.

    Files are tracked by the stream's own checkpoint in ``state``; rows that the text checkpoint already has are skipped.
    """

    def batch(df: DataFrame, _: int) -> None:
        write_texts(checkpoints.pending(df, checkpoints.read_text(spark, path)), prompt(F.col(column)), build, path)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
