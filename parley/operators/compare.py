"""Comparing two corpora: overlaps of key sets, progressive matching, presence of dialogues, agreement and likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import both, hash64, list_hash
from ..functions.numbers import rounded
from ..functions.udfs import ratio_from
from ..session import cut


def _overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Overlap statistics of the distinct keys k of both sides, one row for each combination of ``by``.

    One shuffle of keys: both sides are marked, united and grouped, partly before the shuffle. Null keys are no keys.
    """
    mark = lambda df, x, y: df.where("k is not null").select(*by, "k", F.lit(x).alias("a"), F.lit(y).alias("b"))
    g = mark(a, 1, 0).unionByName(mark(b, 0, 1)).groupBy(*by, "k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = [F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(n) for n, e in (("size_a", F.col("a")), ("size_b", F.col("b")), ("size_both", F.col("a") * F.col("b")))]
    s = g.groupBy(*by).agg(*sums) if by else g.agg(*sums)
    union = F.col("size_a") + F.col("size_b") - F.col("size_both")
    return s.select(*by, "size_a", "size_b", "size_both", (F.col("size_a") - F.col("size_both")).alias("only_a"), (F.col("size_b") - F.col("size_both")).alias("only_b"), union.alias("size_union"), F.coalesce(rounded(F.try_divide("size_both", union), 4), F.lit(0.0)).alias("jaccard"))


def overlap(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """(size_a, size_b, size_both, only_a, only_b, size_union, jaccard) of the distinct keys; jaccard has four decimals and is 0 for two empty sets."""
    return _overlaps(*(df.select(F.col(key).alias("k")) for df in (a, b)), [])


def staged(a: DataFrame, b: DataFrame, stages: dict, column: str = "persona") -> DataFrame:
    """overlap() of the distinct forms of ``column`` at each stage (name -> Column rule), with the coverage of each side.

    All stages in one pass and one shuffle of 128-bit hashes of the forms. Coverage is in percent with two decimals, null for an empty side; a stage
    without any form has no row.
    """
    form = lambda n, rule: F.struct(F.lit(n).alias("stage"), F.struct(*both(list_hash, rule(F.col(column)))).alias("k"))
    sides = (df.where(F.col(column).isNotNull()).select(F.explode(F.array(*(form(n, r) for n, r in stages.items()))).alias("x")).select("x.*") for df in (a, b))
    out = _overlaps(*sides, ["stage"])
    coverage = lambda n: rounded(F.try_divide(F.col("size_both") * 100.0, n), 2)
    return out.select("*", coverage("size_a").alias("coverage_a"), coverage("size_b").alias("coverage_b"))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_except(a: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        a = a.subtract(o)
    return a


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """The share in percent, rounded; 0 where there is no whole."""
    return F.coalesce(rounded(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def presence(corpora: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """(corpus, split, n_keys, n_present, share): per split of each of two corpora its distinct keys and those that the other has anywhere.

    Both are marked and grouped by key once; a key keeps the set of its splits, of which there are few.
    """
    marked = None
    for name, df in corpora.items():
        d = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("corpus"), "split", F.col(key).alias("k"))
        marked = d if marked is None else marked.unionByName(d)
    places = marked.groupBy("k").agg(F.collect_set(F.struct("corpus", F.coalesce("split", F.lit("")).alias("s"), F.col("split").isNull().alias("none"))).alias("at"))
    one = places.select(F.explode("at").alias("x"), F.size(F.array_distinct(F.transform("at", lambda p: p["corpus"]))).alias("n"))
    split = F.when(~F.col("x.none"), F.col("x.s"))
    g = one.groupBy("x.corpus", split.alias("split")).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_present"))
    return g.withColumn("share", percent(F.col("n_present"), F.col("n_keys")))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shared, same, swapped, different): rows of ``a`` whose dialogue ``b`` has, by how the personas agree.

    Both have dialog, one, two (keys). Rows of both sides meet by dialogue and unordered pair of personas, with the
    order as a flag, so nothing is joined and the pairs of a dialogue are never collected.
    """
    swap = F.col("one") > F.col("two")
    mark = lambda df, n, there: df.where("dialog is not null").select("dialog", F.least("one", "two").alias("lo"), F.greatest("one", "two").alias("hi"), swap.alias("swap"), F.lit(n).alias("n"), F.lit(there).alias("there"))
    of = lambda flag, c: F.coalesce(F.sum(F.when(F.col("swap") == flag, F.col(c))), F.lit(0))
    g = mark(a, 1, 0).unionByName(mark(b, 0, 1)).groupBy("dialog", "lo", "hi").agg(*(of(flag, c).alias(f"{c}_{k}") for k, flag in enumerate((False, True)) for c in ("n", "there")))
    has = lambda k: F.col(f"there_{k}") > 0
    when = lambda c, k: F.when(c, F.col(f"n_{k}")).otherwise(0)
    same, swapped = when(has(0), 0) + when(has(1), 1), when(~has(0) & has(1), 0) + when(~has(1) & has(0), 1)
    d = g.groupBy("dialog").agg(F.sum(F.col("n_0") + F.col("n_1")).alias("shared"), F.sum(same).alias("same"), F.sum(swapped).alias("swapped"), F.max(has(0) | has(1)).alias("known")).where("known")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return d.agg(total("shared").alias("shared"), total("same").alias("same"), total("swapped").alias("swapped"), total(F.col("shared") - F.col("same") - F.col("swapped")).alias("different"))


#: Likeness buckets in order: label and least ratio.
BUCKETS = (("exact", None), (">=0.99", 0.99), (">=0.95", 0.95), (">=0.9", 0.9), (">=0.8", 0.8), ("<0.8", 0.0), ("no counterpart", None))


def likeness_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(bucket, n, share): rows of ``a`` by the likeness of their best counterpart in ``b``; all buckets, empty ones too.

    Both have id, dialog (key), text, one, two. A row whose dialogue ``b`` has is exact and compared no further; the
    others are compared with the distinct texts of the rows of the same two personas in either order. Both are written
    once, since each is read several times. Pairs whose lengths or letters alone rule out the lowest bound are never
    aligned: they count as below it, which is all that their bucket says. The share has one decimal.
    """
    a, b = (cut(x.select("id", "dialog", "text", "one", "two")) for x in (a, b))
    exact = b.where("dialog is not null").select("dialog").distinct()
    rest = a.join(exact, "dialog", "left_anti")
    block = hash64(1, F.least("one", "two"), F.greatest("one", "two"))
    there = b.where("text is not null").select(block.alias("block"), F.col("text").alias("other")).distinct()
    mine = rest.select("id", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    least = BUCKETS[4][1]
    bound = F.coalesce(F.try_divide(2.0 * F.least(F.length("text"), F.length("other")), F.length("text") + F.length("other")), F.lit(1.0))
    met = mine.select("block", "text").distinct().join(there, "block").withColumn("bound", bound)
    judged = met.where(F.col("bound") >= least).select("block", "text", ratio_from(least)("text", "other").alias("r")).unionByName(met.where(F.col("bound") < least).select("block", "text", F.lit(0.0).alias("r")))
    best = mine.join(judged.groupBy("block", "text").agg(F.max("r").alias("best")), ["block", "text"], "left").select("best")
    bucket = F.when(F.col("best").isNull(), "no counterpart")
    for label, low in BUCKETS[1:6]:
        bucket = bucket.when(F.col("best") >= low, label)
    n_exact = a.join(exact, "dialog", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("exact").alias("bucket"), "n")
    counts = best.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).unionByName(n_exact)
    labels = a.sparkSession.createDataFrame([(x,) for x, _ in BUCKETS], "bucket string")
    n = F.coalesce("n", F.lit(0))
    return labels.join(counts, "bucket", "left").select("bucket", n.alias("n"), percent(n, a.agg(F.count(F.lit(1)).alias("total")).scalar()).alias("share"))


def pairs_with_shared_dialogs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_pairs, n_share, n_differ): persona pairs of both corpora, and whether they have a dialogue in common there.

    Both have pair and dialog (keys).
    """
    pa, pb = (x.where("pair is not null").select("pair", "dialog").distinct() for x in (a, b))
    both = pa.select("pair").distinct().join(pb.select("pair").distinct(), "pair", "left_semi")
    shared = pa.where("dialog is not null").join(pb, ["pair", "dialog"], "left_semi").select("pair").distinct().withColumn("s", F.lit(1))
    g = both.join(shared, "pair", "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("s").alias("n_share"))
    return g.withColumn("n_differ", F.col("n_pairs") - F.col("n_share"))


def first_occurrence(rows: DataFrame, key: str, order: list[Column], value: Column) -> DataFrame:
    """(key, first): the value of the first row of each key in the given order."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("first"))


def smallest(rows: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The k smallest distinct values; only k rows of each task leave it."""
    return rows.select(column).distinct().orderBy(column).limit(k)
