"""Repetition inside a document (problem 10): tokenizer fertility first, then the exact share.

A public vocabulary with byte fallback measures each document's characters per token, share of byte tokens and token
entropy. Repetition lowers the entropy, and how far it must is known: where ``share`` of n words stand in repeated
runs, each of them has an equal word at a place that isn't in a repeated run, so at most t - share * n of the document's
t tokens are distinct and its token entropy is at most log2(t - share * n). Documents above that band are rejected
unread; the rest are measured exactly. Words are encoded one by one, so equal words have equal tokens.

The entropy alone can't give the exact share, hence the second step; characters per token and byte tokens are reported
with bands for each language and script.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles, tokens
from .corpora import load

RUN, SHARE = 8, 0.3
#: Words whose tokens a worker remembers.
MEMO = 1 << 18
#: Width of the bands of a language, in standard deviations.
BAND = 3.0


def repeated(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(repeated words, words) of each text: words in a run of ``run`` words that began earlier in the same text."""
    flat, counts = shingles.words(texts)
    h, row = shingles.grams(flat, counts, run)
    within = np.concatenate([np.arange(max(0, c - run + 1)) for c in counts]) if len(counts) else np.empty(0, np.int64)
    order = np.lexsort((within, h, row))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    start = (np.cumsum(counts) - counts)[row[again]] + within[again]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + run, -1)
    inside = np.cumsum(cover)[:-1] > 0
    sums = np.concatenate([[0], np.cumsum(inside)])
    end = np.cumsum(counts)
    return sums[end] - sums[end - counts], counts


class Fertility:
    """Counts of tokens by words, remembered by word."""

    def __init__(self, folder: str):
        self.encode = tokens.piece_bpe(folder).encode
        sp = tokens.piece_bpe(folder)
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
        self.memo: dict[str, list[int]] = {}

    def measure(self, text: str | None) -> tuple[int, int, int, int, float]:
        """(words, characters in words, tokens, byte tokens, entropy in bits)."""
        words = Counter(shingles.WORD.findall((text or "").lower()))
        new = [w for w in words if w not in self.memo]
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = list(words)
            self.memo.update(zip(new, self.encode(new)))
        count: Counter = Counter()
        for w, n in words.items():
            for t in self.memo[w]:
                count[t] += n
        if not count:
            return 0, 0, 0, 0, 0.0
        ids, n = np.fromiter(count.keys(), np.int64), np.fromiter(count.values(), np.float64)
        total = n.sum()
        entropy = float(np.log2(total) - (n * np.log2(n)).sum() / total)
        return sum(words.values()), sum(len(w) * k for w, k in words.items()), int(total), int(n[self.is_byte[ids]].sum()), entropy


def fertility(rows: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """(doc_id, lang, words, chars, tokens, byte_tokens, entropy) of (doc_id, lang, text); texts without words have zeros."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fertility(folder)
        for batch in it:
            m = [f.measure(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*m)) if m else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()]))], ["doc_id", "lang", "words", "chars", "tokens", "byte_tokens", "entropy"])

    return rows.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, words long, chars long, tokens long, byte_tokens long, entropy double")


def language(c: Column) -> Column:
    """The two-letter language in lower case, without a region; null stays null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), "^([a-z]{2})(?:[-_].*)?$", 1), F.lit(""))


def shares(rows: DataFrame) -> DataFrame:
    """(doc_id, words, repeated_words, share) of every document of (doc_id, text); 0 for texts without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for s in shingles.batches([len(t or "") for t in texts], 2 << 20):
                r, n = repeated(texts[s])
                yield pa.RecordBatch.from_arrays([ids.slice(s.start, s.stop - s.start), pa.array(n), pa.array(r), pa.array(r / np.maximum(1, n))], ["doc_id", "words", "repeated_words", "share"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, words long, repeated_words long, share double")


def repetitive(rows: DataFrame, share: float = SHARE, folder: str = tokens.FOLDER) -> DataFrame:
    """(doc_id) of documents of (doc_id, text) with at least ``share`` repeated words.

    Both steps run on the same batch, so no text is moved. Null, empty and short texts (fewer than RUN + 1 words)
    repeat nothing; equal documents are judged alike.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fertility(folder)
        for batch in it:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            band = []
            for k, t in enumerate(texts):
                words, _, total, _, entropy = f.measure(t)
                if words > RUN and entropy <= np.log2(max(1.0, total - share * words)) + 1e-9:
                    band.append(k)
            for s in shingles.batches([len(texts[k] or "") for k in band], 2 << 20):
                r, n = repeated([texts[k] for k in band[s]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(band[s])[r >= share * n - 1e-9]])], ["doc_id"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_found: (doc_id) of documents where at least 0.3 of the words are repeated."""
    return repetitive(load(spark, sf_dir, "documents"))


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_repetition: (doc_id, words, repeated_words, share) of every document."""
    return shares(load(spark, sf_dir, "documents"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p10_fertility: every document's fertility, and whether each figure is outside its language's band (mean and deviations)."""
    d = load(spark, sf_dir, "documents").select("doc_id", language(F.col("lang")).alias("lang"), "text")
    f = fertility(d).withColumns({"chars_per_token": F.try_divide("chars", "tokens"), "byte_share": F.try_divide("byte_tokens", "tokens"), "evenness": F.try_divide("entropy", F.log2(F.greatest(F.col("tokens"), F.lit(2))))})
    names = ("chars_per_token", "byte_share", "evenness")
    stats = f.where("tokens > 0").groupBy("lang").agg(*(g(n).alias(f"{n}_{k}") for n in names for k, g in (("mean", F.avg), ("dev", F.stddev_pop))))
    s = stats.withColumnRenamed("lang", "of")
    out = f.join(s, f["lang"].eqNullSafe(s["of"]), "left")
    return out.select("doc_id", "lang", "words", "tokens", "entropy", *names, *((F.abs(F.col(n) - F.col(f"{n}_mean")) > BAND * F.col(f"{n}_dev") + 1e-12).alias(f"{n}_outside") for n in names))
