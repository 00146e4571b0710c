"""Files of a folder that all executors share, through the file system that its path names."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import SparkSession


def resolve(path: str) -> tuple[Any, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_whole(path: str, content: bytes) -> None:
    """Writes a file that is there as a whole or not at all: under a hidden name first, then moved."""
    system, at = resolve(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, at)


def write_lines(folder: str, rows: Iterable[dict]) -> None:
    """One JSON-lines file of ``rows`` in ``folder``. Its name begins with the time, so later files come later in order."""
    body = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    if body:
        write_whole(f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", body.encode("utf-8"))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder if it is there, on whatever file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
