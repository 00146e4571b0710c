"""Duplicates hidden by formatting (problem 4): dictionary-encoded columns and compact integer tuples.

Every distinct persona value as it stands is canonicalised once; its canonical form gets an integer identifier; records
are rewritten as tuples of identifiers in ascending order, and only those tuples are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import list_hash
from ..session import cut
from .corpora import load


def canonical(sentences: Column) -> Column:
    """The sentences as letters and digits in lower case, sorted, each as often as it occurs; blank ones don't count."""
    bare = F.transform(sentences, lambda s: F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", ""))
    return F.array_sort(F.filter(bare, lambda s: s != ""))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, row, one, two): personas as arrays of sentences; a persona given as text has a sentence a line."""
    c = load(spark, sf_dir, "convai2_conversations").select(F.lit("convai2").alias("corpus"), F.col("row_index").alias("row"), F.col("your_persona").alias("one"), F.col("partner_persona").alias("two"))
    lines = lambda name: F.split(F.col(name), r"\r\n|[\n\r\x0B\x0C\x85  ]")
    s = load(spark, sf_dir, "synthetic_chats").select(F.lit("synthetic").alias("corpus"), F.col("row_index").alias("row"), lines("`user 1 personas`").alias("one"), lines("`user 2 personas`").alias("two"))
    return c.unionByName(s)


def dictionary(cells: DataFrame) -> DataFrame:
    """(k1, k2, id): identifier of the canonical form of each distinct value; null where nothing is left of the value.

    ``cells`` is (value) with one row per record and side. Distinct values are found by their 128-bit hashes, partly
    before the shuffle, so a value that recurs in a third of all rows is one row from there on. Identifiers are dense:
    a task's rows are numbered in their partition and shifted by the counts of the partitions before it, of which
    there are as many as shuffle partitions.
    """
    values = cells.where("value is not null").groupBy(*(list_hash(k, F.col("value")).alias(f"k{k}") for k in (1, 2))).agg(F.first("value").alias("value"))
    forms = values.select("k1", "k2", canonical(F.col("value")).alias("form"))
    forms = forms.where(F.size("form") > 0).select("k1", "k2", *(list_hash(k, F.col("form")).alias(f"f{k}") for k in (1, 2)))
    distinct = cut(forms.select("f1", "f2").distinct().withColumn("row", F.monotonically_increasing_id()))
    part = distinct.select("f1", "f2", F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = sorted((r["part"], r["n"]) for r in part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    offset, starts = 0, {}
    for p, n in counts:
        starts[p], offset = offset, offset + n
    start = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("part")) if starts else F.lit(0)
    ids = part.select("f1", "f2", (start + F.col("at")).cast("long").alias("id"))
    return forms.join(ids, ["f1", "f2"]).select("k1", "k2", "id")


def encode(rows: DataFrame) -> DataFrame:
    """(corpus, row, lo, hi): the records as integer tuples; those with a null or empty persona are left out."""
    cells = rows.select(F.explode(F.array("one", "two")).alias("value"))
    ids = cut(dictionary(cells))
    out = rows.select("corpus", "row", *(list_hash(k, F.col(c)).alias(f"{c}{k}") for c in ("one", "two") for k in (1, 2)))
    for c in ("one", "two"):
        out = out.join(ids.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), F.col("id").alias(c)), [f"{c}1", f"{c}2"])
    return out.select("corpus", "row", F.least("one", "two").alias("lo"), F.greatest("one", "two").alias("hi"))


def groups(encoded: DataFrame) -> DataFrame:
    """(corpus, lo, hi, row_a, copies): one row per distinct record, its smallest row and its number of copies."""
    return encoded.groupBy("corpus", "lo", "hi").agg(F.min("row").alias("row_a"), F.count(F.lit(1)).alias("copies"))


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_groups: (corpus, row_a, copies), one row per distinct persona pair."""
    return groups(encode(records(spark, sf_dir))).select("corpus", "row_a", "copies")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: (corpus, row_a, row_b), row_a the smallest row of a group of equal persona pairs, row_b each other row.

    Repeated rows are copies like any other; rows with a null, empty or blank persona are in no group; the two personas
    may trade places. Empty tables give an empty result.
    """
    encoded = cut(encode(records(spark, sf_dir)))
    several = groups(encoded).where("copies > 1").drop("copies")
    return encoded.join(several, ["corpus", "lo", "hi"]).where("row <> row_a").select("corpus", "row_a", F.col("row").alias("row_b"))
