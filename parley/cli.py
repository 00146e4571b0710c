"""Command lines: the text stage, the image stage and the job matrix.

    python -m parley.cli text run --gpus 0,1 --input corpus.parquet --column persona --model package.module:build
    python -m parley.cli images run-shard --num-shards 4 --shard-index 1 --input … --column … --model …
    python -m parley.cli matrix --config jobs.yaml --gpus 0,1 --data folder --model package.module:build

A model is named as module:function; the function takes keyword options (model path and device for texts, the job's
parameters for images) and gives the callable that answers a prompt, in each worker. Nothing is published: with
--push-pr the merged table and a request are written to a staging folder beside the output.
"""

from __future__ import annotations

import argparse
import functools
import importlib
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .plans import jobs
from .session import local_session, ship
from .sources import corpus
from .streaming import resume

log = logging.getLogger(__name__)


def loaded(name: str) -> Callable[..., Any]:
    """The function of "module:function"; a ValueError if there is none."""
    module, _, function = name.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no model {name!r}: {e}") from e


def _built(name: str, options: dict[str, Any]) -> Any:
    return loaded(name)(**options)


def builder(name: str, **options: Any) -> Callable[[], Any]:
    """A function that workers call once; it finds the model there by its name."""
    return functools.partial(_built, name, {k: v for k, v in options.items() if v is not None})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parley")
    stages = p.add_subparsers(dest="stage", required=True)
    for stage in ("text", "images"):
        commands = stages.add_parser(stage).add_subparsers(dest="command", required=True)
        for command in ("run", "run-shard", "merge"):
            c = commands.add_parser(command)
            c.add_argument("--input", required=True, help="parquet table with row_index")
            c.add_argument("--output-dir", default="outputs")
            c.add_argument("--limit", type=jobs.non_negative)
            if command == "run":
                c.add_argument("--gpus", type=jobs.id_list, required=True)
            else:
                c.add_argument("--num-shards", type=int, required=True)
            if command == "run-shard":
                c.add_argument("--shard-index", type=int, required=True)
                if stage == "text":
                    c.add_argument("--device")
            if command != "merge":
                c.add_argument("--column", required=True, help="column of the prompt's text")
                c.add_argument("--id-column", default="persona-id")
                c.add_argument("--model", required=True, help="module:function")
                c.add_argument("--force", action="store_true")
                if stage == "text":
                    c.add_argument("--model-path")
            if command != "run-shard":
                c.add_argument("--final-output-dir", default="outputs/final")
                c.add_argument("--target-repo-id", default="")
                c.add_argument("--push-pr", action="store_true")
    m = stages.add_parser("matrix")
    m.add_argument("--config", required=True)
    m.add_argument("--gpus", type=jobs.id_list, required=True)
    m.add_argument("--data", required=True, help="folder of the datasets, by their names")
    m.add_argument("--model", required=True, help="module:function")
    m.add_argument("--limit", type=jobs.non_negative)
    m.add_argument("--push-pr", action="store_true")
    m.add_argument("--force", action="store_true")
    return p


def save(merged: DataFrame, folder: str, target: str, push: bool) -> None:
    """The merged table, also as a single parquet file, and with ``push`` a request for review in a staging folder."""
    merged.write.mode("overwrite").parquet(f"{folder}/dataset")
    corpus.write_single(merged, f"{folder}/single")
    if push:
        corpus.stage_for_review(merged, f"{folder}/review", target, "Add generated column")


def run_stage(spark: SparkSession, a: argparse.Namespace) -> None:
    shards = len(a.gpus) if a.command == "run" else a.num_shards
    if shards < 1:
        raise ValueError(f"{shards} shards")
    df = spark.read.parquet(a.input)
    if a.command != "merge":
        index = None if a.command == "run" else a.shard_index
        if a.stage == "text":
            build = builder(a.model, model_path=a.model_path, device=getattr(a, "device", None))
            done = resume.run_text(df, a.column, text.text_prompt, build, f"{a.output_dir}/checkpoint", a.limit, shards, index, a.force)
        else:
            rows = corpus.head(corpus.require_columns(df, ["row_index", a.column, a.id_column]), a.limit)
            rows = resume.fanned_out(rows, shards) if index is None else resume.shard(rows, shards, index)
            done = resume.run_images(rows, a.id_column, text.image_prompt(F.col(f"`{a.column}`")), builder(a.model), a.output_dir, a.force)
        log.info("%d rows, %d of them failed", done["rows"], done["failed"])
    if a.command != "run-shard":
        merge = resume.merge_text(df, f"{a.output_dir}/checkpoint", a.limit, shards=shards) if a.stage == "text" else resume.merge_images(df, a.output_dir, a.limit, shards=shards)
        save(merge, a.final_output_dir, a.target_repo_id, a.push_pr)


def run_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    """All jobs; a dataset is the parquet table in the data folder that has the last part of its name."""
    table = jobs.job_table(spark, jobs.load_config(a.config))

    def run(engine: Callable[[], Any], job: Any, force: bool) -> None:
        df = corpus.head(spark.read.parquet(f"{a.data}/{job['source'].rpartition('/')[2]}.parquet"), a.limit)
        folder = job["output"].rpartition("/")[0]
        prompt = text.image_prompt(F.col(f"`{job['prompt_column']}`"), F.lit(job["variant"]))
        resume.run_batches(df, job["id_column"], prompt, engine, folder, len(a.gpus), force)
        save(resume.merge_images(df, folder, None, job["image_column"]), f"{folder}/final", job["target"], a.push_pr)

    # workers build the model; the engine of the driver is what they need for that
    jobs.run_all(table.orderBy("ordinal").collect(), lambda job: builder(a.model, model=job["model"], params=jobs.parameters(job)), run, a.force)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    a = parser().parse_args(argv)
    spark = spark or local_session()
    ship(spark)
    run_matrix(spark, a) if a.stage == "matrix" else run_stage(spark, a)


if __name__ == "__main__":
    main()
