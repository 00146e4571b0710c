"""Near-duplicate records by HyperMinHash (problem 5).

Each record is a set of word triples. Per bucket of a hash function the register keeps the number of leading zeros of
the smallest hash and its next mantissa bits. Bands of registers propose pairs, the registers of a pair give a
Jaccard estimate corrected for chance collisions of registers, and what passes is verified on the triples themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import corpora, shingles

REGISTERS, BAND = 256, 4
#: Registers of the short signature, by which most chance candidates go before whole signatures are moved.
SHORT = 32
BUCKETS = 16
MANTISSA = 10
#: Sets up to SMALL use one bucket per hash function; sets beyond LARGE use BUCKETS. Sets between have both kinds of
#: bands, and two sets with a similarity of LARGE / SMALL or more always have a kind in common.
LARGE, SMALL = 32, 64
#: Standard deviations of the estimate (over REGISTERS) by which a pair may miss the threshold before verification.
MARGIN = 5.0


def triples(texts: list[str | None], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    return shingles.distinct(*shingles.grams(*shingles.words(texts), k))


def registers(h: np.ndarray, row: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """An n x REGISTERS matrix of 16-bit registers; 0 is an empty bucket.

    A register is 1 + (leading zeros << MANTISSA | inverted mantissa) of the bucket's least hash.
    """
    bits = buckets.bit_length() - 1
    out = np.empty((n, REGISTERS), np.uint16)
    for f in range(REGISTERS // buckets):
        x = shingles.mix(h, 100 + f)
        least = np.full(n * buckets, 2**64 - 1, np.uint64)
        at = row * buckets + (x >> np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)).astype(np.int64)
        np.minimum.at(least, at, (x << np.uint64(bits)) | np.uint64(1) if bits else x | np.uint64(1))
        zeros = 63 - np.floor(np.log2(least.astype(np.float64))).astype(np.int64).clip(0, 63)
        shifted = least << np.minimum(zeros + 1, 63).astype(np.uint64)
        reg = 1 + ((zeros.clip(0, 62) << MANTISSA) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64))
        out[:, f * buckets : (f + 1) * buckets] = np.where(least == np.uint64(2**64 - 1), 0, reg).reshape(n, buckets)
    return out


def _banded(rid: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    """(band, rid): the keys of the bands of each text."""
    h, row = triples(texts)
    size = np.bincount(row, minlength=len(texts))
    keys, owners = [], []
    for buckets, chosen in ((1, (size > 0) & (size <= SMALL)), (BUCKETS, size > LARGE)):
        if not chosen.any():
            continue
        number = np.cumsum(chosen) - 1
        mine = chosen[row]
        reg = registers(h[mine], number[row[mine]], int(chosen.sum()), buckets).reshape(-1, REGISTERS // BAND, BAND)
        key = np.broadcast_to(np.arange(REGISTERS // BAND, dtype=np.uint64) + np.uint64(1000 * buckets), reg.shape[:2]).copy()
        key = shingles.mix(key * np.uint64(2) + (rid[chosen] & 1).astype(np.uint64)[:, None])
        for j in range(BAND):
            key = shingles.mix(key ^ reg[:, :, j], j)
        full = reg.any(axis=2)
        keys.append(key[full])
        owners.append(np.repeat(rid[chosen], full.sum(axis=1)))
    if not keys:
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["band", "rid"])


def _signed(rid: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    """(rid, n, short, sig): the size of each set and its registers, with one bucket per function for small sets."""
    h, row = triples(texts)
    size = np.bincount(row, minlength=len(texts))
    sig = np.zeros((len(texts), REGISTERS), np.uint16)
    for buckets, chosen in ((1, size <= LARGE), (BUCKETS, size > LARGE)):
        if chosen.any():
            number, mine = np.cumsum(chosen) - 1, chosen[row]
            sig[chosen] = registers(h[mine], number[row[mine]], int(chosen.sum()), buckets)
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(size.astype(np.int32)), pa.array([s[:SHORT].tobytes() for s in sig], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["rid", "n", "short", "sig"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register matrices, corrected for registers that agree by chance.

    Two different sets agree in a register with the chance that their least hashes share the leading zeros and the
    mantissa: about the sum over exponents of 2^-(2z + 2) / 2^MANTISSA, i.e. 1 / (3 * 2^MANTISSA).
    """
    some = (a > 0) | (b > 0)
    agree = ((a == b) & some).sum(axis=1) / np.maximum(1, some.sum(axis=1))
    chance = 1 / (3 * 2**MANTISSA)
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def _estimated(threshold: float, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose estimate from ``width`` registers is within MARGIN deviations of the threshold."""
    least = threshold - MARGIN * (threshold * (1 - threshold) / width) ** 0.5

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, width) for c in ("sa", "sb"))
            kept = (estimate(a, b) >= least) | ((na <= LARGE) != (nb <= LARGE))  # registers of two kinds say nothing
            kept &= np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
            yield batch.filter(pa.array(kept)).select(["a", "b"])

    return run


def _sets(rid: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    h, row = triples(texts)
    return pa.RecordBatch.from_arrays([pa.array(rid), corpora.list_array(h, row, len(texts))], ["rid", "grams"])


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b), a < b: texts with an equal band, each pair once. Nothing is capped; a crowded band is split by AQE.

    Both sides of the join read the same exchange, so bands are computed and shuffled once.
    """
    bands = reps.select("rid", "talk").mapInArrow(corpora.by_batches(_banded), "band long, rid long")
    left, right = bands.select("band", F.col("rid").alias("a")), bands.select("band", F.col("rid").alias("b"))
    return left.join(right, "band").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"))


def attach(pairs: DataFrame, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """``pairs`` with the columns of ``values`` (by rid) for a and for b. ``values`` are read twice, so they should be written."""
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("rid").alias(side), *(F.col(c).alias(f"{short}{side}") for c, short in names.items())), side)
    return pairs


def involved(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows that are in a pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    return rows.join(ids, "rid", "left_semi")


def similar(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of ``rows`` (rid, side, talk): pairs (a, b, jaccard) of representatives, and (rid, rep) of exact copies.

    Null, empty and unparsable talks and talks of fewer than three words are in no pair. Ties and repeated rows are
    copies of the smallest rid. An empty table gives empty results.
    """
    members = corpora.copies(rows)
    reps = rows.join(corpora.small(members), "rid", "left_anti")
    pairs = cut(candidates(reps).select("a", "b"))
    likely = pairs
    for column, width in (("short", SHORT), ("sig", REGISTERS)):
        signed = involved(reps, likely).select("rid", "talk").mapInArrow(corpora.by_batches(_signed), "rid long, n int, short binary, sig binary")
        likely = cut(attach(likely, cut(signed.select("rid", "n", column)), {"n": "n", column: "s"}).mapInArrow(_estimated(threshold, width), "a long, b long"))
    sets = cut(involved(reps, likely).select("rid", "talk").mapInArrow(corpora.by_batches(_sets), "rid long, grams array<long>"))
    both = attach(likely, sets, {"grams": "g"})
    shared = F.size(F.array_intersect("ga", "gb"))
    exact = both.select("a", "b", (shared / (F.size("ga") + F.size("gb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
    return cut(exact), members


def found(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    """p5_found: (corpus, row_a, row_b) of one corpus whose triples share at least ``threshold`` of their union."""
    rows = corpora.talks(spark, sf_dir).withColumn("side", F.lit(0))
    pairs, members = similar(rows, threshold)
    return corpora.named(corpora.expand(pairs.select("a", "b"), members).unionByName(corpora.among(members)))


def classes(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    """p5_classes: (corpus, row_index, class_row, group_row, links), one row per record that has a talk.

    class_row is the smallest row with the same words, links the number of similar other texts, and group_row the
    smallest row of the group: all records that are linked through similar ones. Unparsable talks are groups of their own.
    """
    rows = corpora.talks(spark, sf_dir).withColumn("side", F.lit(0))
    pairs, members = similar(rows, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    facts = links.join(corpora.components(pairs).select(F.col("rid").alias("rep"), "root"), "rep")
    out = rows.select("rid").join(members, "rid", "left").withColumn("rep", F.coalesce("rep", "rid")).join(facts, "rep", "left")
    name = F.when(F.col("rid") % 2 == 0, corpora.CORPORA[0]).otherwise(corpora.CORPORA[1]).alias("corpus")
    return out.select(name, F.shiftright("rid", 1).alias("row_index"), F.shiftright("rep", 1).alias("class_row"), F.shiftright(F.coalesce("root", "rep"), 1).alias("group_row"), F.coalesce("links", F.lit(0)).alias("links"))
