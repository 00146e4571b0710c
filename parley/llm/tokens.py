"""Sizes of texts in tokens of a public tokenizer, from a vocabulary file whose folder is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def byte_bpe(folder: str = FOLDER):
    """The byte-level BPE; once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def piece_bpe(folder: str = FOLDER):
    """The BPE with byte fallback; once per Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECES))


def sizes(rows: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``rows`` (…, text) with ``tokens`` in place of the text; null and empty texts have 0."""
    kept = [c for c in rows.columns if c != "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(folder).encode_ordinary
        for batch in it:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), n], [*kept, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", tokens long"
    return rows.select(*kept, "text").mapInArrow(run, schema)
