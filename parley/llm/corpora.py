"""The dialogue corpora as rows of one shape, and exact copies collapsed before any comparison.

``rid`` numbers a row of either corpus: row_index * 2 + (0 for convai2, 1 for personachat).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import shingles

CORPORA = ("convai2", "personachat")
#: Most rows that are ever broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def split_name(c: Column) -> Column:
    """train, validation or test; the short form valid means validation; null when blank."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("valid", "val", "dev"), "validation").otherwise(F.nullif(s, F.lit("")))


def talk_of_turns(c: Column) -> Column:
    """Utterances in order, joined by spaces."""
    return F.concat_ws(" ", F.flatten(F.transform(c, lambda t: F.array(t["text"], t["response"]))))


def utterances_of_json(dialog: str | None) -> list[str] | None:
    """text, response, text, … of a JSON list of turns; None if it is null, unparsable, empty or no list of objects."""
    try:
        turns = json.loads(dialog or "")
        return [u for t in turns for u in (t.get("text") or "", t.get("response") or "")] or None
    except (ValueError, AttributeError, TypeError):
        return None


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, split, persona, talk): usable rows of both corpora.

    ``talk`` is plain text for convai2 and the JSON dialog for personachat, which only the Python stages parse. Rows
    with null or empty turns are left out here, unparsable JSON in those stages. ``persona`` is null for personachat.
    """
    c = load(spark, sf_dir, "convai2_conversations").where(F.size("turns") > 0)
    c = c.select((F.col("row_index") * 2).alias("rid"), split_name(F.col("source_split")).alias("split"), F.col("your_persona").alias("persona"), talk_of_turns(F.col("turns")).alias("talk"))
    p = load(spark, sf_dir, "personachat_dialogs").where(F.col("dialog").isNotNull())
    return c.unionByName(p.select((F.col("row_index") * 2 + 1).alias("rid"), split_name(F.col("split")).alias("split"), F.lit(None).cast("array<string>").alias("persona"), F.col("dialog").alias("talk")))


def plain(rid: list[int], talk: list[str | None]) -> list[str | None]:
    """The talks as plain text; None where the JSON has none."""
    return [(" ".join(u) if (u := utterances_of_json(t)) else None) if r & 1 else t for r, t in zip(rid, talk)]


def by_batches(fn: Callable[[np.ndarray, list[str | None]], pa.RecordBatch], chars: int = 2 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one of (rid, texts), fed with some ``chars`` of text at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            texts = batch.column("talk").to_pylist()
            for s in shingles.batches([len(t or "") for t in texts], chars):
                r = rid[s]
                yield fn(r, plain(r.tolist(), texts[s]))

    return run


def list_array(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """One list of values for each of ``n`` rows; ``row`` ascends."""
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


#: Rows of one run that a worker holds; of a longer run it gives parts of the result beforehand.
HELD_ROWS = 4_000_000


def by_runs(names: list[str], scan: Callable[..., pa.RecordBatch], overflow: Callable[..., tuple[pa.RecordBatch, dict]] | None = None, most: int = HELD_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one of whole runs of rows, sorted by the first of the columns ``names``.

    The last run of a batch may go on in the next and waits for it. When more than ``most`` rows of one run are waiting,
    ``overflow`` takes them and gives what they come to so far, and the rows that stand for them from there on.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list = []
        for batch in it:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if rest[0].column(names[0])[0].as_py() == batch.column(names[0])[batch.num_rows - 1].as_py():
                if overflow is not None and sum(b.num_rows for b in rest) > most:  # one run so far
                    table = pa.Table.from_batches(rest)
                    out, kept = overflow(*(table.column(n) for n in names))
                    yield out
                    rest = pa.table({n: kept[n] for n in batch.schema.names}, schema=batch.schema).to_batches()
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            key = table.column(names[0]).to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            yield scan(*(table.column(n).slice(0, whole) for n in names))
            rest = table.slice(whole).to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield scan(*(table.column(n) for n in names))

    return run


def _keys(rid: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
    """The hash of each text's sequence of words, in 128 bits; texts without words are left out."""
    flat, counts = shingles.words(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    some = counts > 0
    both = []
    for salt in (1, 2):
        x = shingles.mix(flat + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), salt)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        end = np.cumsum(counts)
        both.append(shingles.mix(sums[end] - sums[end - counts], salt))
    return pa.RecordBatch.from_arrays([pa.array(rid[some]), *(pa.array(b[some].view(np.int64)) for b in both)], ["rid", "k1", "k2"])


def copies(rows: DataFrame) -> DataFrame:
    """(rid, rep): rows whose words in order equal those of an earlier row with the same ``side`` and corpus; rep is the smallest.

    Only hashes are shuffled; the grouping is partial before the shuffle, so a class that holds a third of all rows is
    no hot spot. Texts are hashed once; members are written, since several stages read them.
    """
    keys = rows.select("rid", "side", "talk").mapInArrow(_with_side(by_batches(_keys)), "rid long, side int, k1 long, k2 long")
    keys = cut(keys.withColumn("corpus", F.col("rid") % 2))
    on = ["corpus", "side", "k1", "k2"]
    classes = keys.groupBy(*on).agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cut(keys.join(small(cut(classes)), on).where("rid <> rep").select("rid", "rep"))


def _with_side(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def outer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rid, side = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("side").to_numpy(zero_copy_only=False)
            order = np.argsort(rid, kind="stable")
            for out in run(iter([batch])):
                at = order[np.searchsorted(rid[order], out.column("rid").to_numpy(zero_copy_only=False))]
                yield pa.RecordBatch.from_arrays([out.column("rid"), pa.array(side[at].astype(np.int32)), out.column("k1"), out.column("k2")], ["rid", "side", "k1", "k2"])

    return outer


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are at most ``limit``, else as it is. ``df`` must be written already."""
    return F.broadcast(df) if df.count() <= limit else df


def class_sizes(members: DataFrame) -> DataFrame:
    """(rep, n): the number of rows of each class with copies."""
    return members.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("n"))


def expand(pairs: DataFrame, *sides: DataFrame) -> DataFrame:
    """Pairs (a, b, …) over all rows from pairs over representatives, each row pair once; other columns go along.

    ``sides`` are the members (rid, rep) of a's and of b's classes, without the representatives; one for both will do.
    Every copy of one class is paired with every copy of the other; AQE splits a class that is much larger than others.
    """
    for side, members in zip("ab", sides * 2 if len(sides) == 1 else sides):
        m = members.select(F.col("rep").alias(side), F.col("rid").alias("_rid"))
        copies_ = pairs.join(m, side).drop(side).withColumnRenamed("_rid", side)
        pairs = pairs.unionByName(copies_.select(*pairs.columns))
    return pairs


def among(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of all pairs of rows of each class."""
    m = members.select("rep", F.col("rid").alias("b"))
    inner = members.join(m, "rep").where("rid < b").select(F.col("rid").alias("a"), "b")
    return members.select(F.col("rep").alias("a"), F.col("rid").alias("b")).unionByName(inner)


def components(pairs: DataFrame) -> DataFrame:
    """(rid, root): for every row in a pair (a, b) the smallest row that it is linked with, directly or through others.

    Alternating stars: every node tells its larger neighbours, then its smaller ones, of the smallest among them, until
    nothing changes; the rounds grow with the logarithm of the longest chain. Edges are shuffled, never collected.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small_)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("rid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("rid"), F.col("v").alias("root")).distinct())


def named(pairs: DataFrame) -> DataFrame:
    """(corpus, row_a, row_b) of pairs (a, b) of rids of one corpus, the smaller row first."""
    a, b = F.shiftright("a", 1), F.shiftright("b", 1)
    return pairs.select(F.when(F.col("a") % 2 == 0, CORPORA[0]).otherwise(CORPORA[1]).alias("corpus"), F.least(a, b).alias("row_a"), F.greatest(a, b).alias("row_b"))
