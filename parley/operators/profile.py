"""Profiles of a table: schema, sizes, uniqueness, functional dependencies and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import both, hash64
from ..functions.text import strip


def schema_listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column, type) of each table, read from the schemas only."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "dataset string, column string, type string")


def split_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, split, n) of tables with a split column; split is null in the total of each dataset and of all."""
    out = None
    for name, df in tables.items():
        d = df.select(F.lit(name).alias("dataset"), F.coalesce("split", F.lit("(none)")).alias("split")).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))
        out = d if out is None else out.unionByName(d)
    return out.rollup("dataset", "split").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def pair_uniqueness(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(one, two, n_rows, n_distinct, n_repeated, is_unique) of column pairs, nested values compared in depth, nulls as values.

    All pairs in one pass: each row gives a hash per pair and the pairs' hashes are counted together.
    """
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.to_json(F.struct(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")), {"ignoreNullFields": "false"}).alias("v")) for a, b in pairs)))
    g = df.select(each.alias("p")).select("p.one", "p.two", *both(hash64, F.col("p.v"))).groupBy("one", "two", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    s = g.groupBy("one", "two").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return s.select("*", (F.col("n_rows") - F.col("n_distinct")).alias("n_repeated"), (F.col("n_rows") == F.col("n_distinct")).alias("is_unique"))


def _dependents(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, n): each key (null is one) with its distinct values (null is one); partial distinct before the shuffle."""
    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{value}`").alias("v")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def functional_dependency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, value, n_keys, n_conflicting, most_values, holds): whether each key has one value; holds is true for no rows."""
    out = None
    for k, v in pairs:
        row = _dependents(df, k, v).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_conflicting"), F.coalesce(F.max("n"), F.lit(0)).alias("most_values"), F.coalesce(F.bool_and(F.col("n") <= 1), F.lit(True)).alias("holds"))
        row = row.select(F.lit(k).alias("key"), F.lit(v).alias("value"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def dependency_conflicts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(dependency, k, v): the distinct rows of keys that have several values."""
    out = None
    for k, v in pairs:
        distinct = df.select(F.col(f"`{k}`").alias("k"), F.col(f"`{v}`").alias("v")).distinct()
        bad = distinct.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("bad"))
        rows = distinct.join(bad, F.col("k").eqNullSafe(F.col("bad")), "left_semi").select(F.lit(f"{k} -> {v}").alias("dependency"), F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, blank text or the text [], an empty array or map, or NaN."""
    c, t = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(t, T.StringType):
        return c.isNull() | strip(c).isin("", "[]")
    if isinstance(t, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_filled, n_missing, all_filled) in one pass over the table."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(columns)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(columns))))
    return sums.select("_n", each.alias("x")).select("x.column", (F.col("_n") - F.col("x.n_missing")).alias("n_filled"), "x.n_missing", (F.col("x.n_missing") == 0).alias("all_filled"))


def invalid_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns, values): rows with missing values, their columns and what stands there."""
    parts = F.filter(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), is_missing(df, c).alias("missing")) for c in columns)), lambda x: x["missing"])
    rows = df.select(key, parts.alias("p")).where(F.size("p") > 0)
    return rows.select(key, F.transform("p", lambda x: x["column"]).alias("columns"), F.map_from_entries(F.transform("p", lambda x: F.struct(x["column"], x["value"]))).alias("values"))


def empty_personas(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """(kept columns, column): where a normalised persona (name -> array expression) is empty."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.size(e).alias("size")) for n, e in columns.items())))
    return df.select(*keep, each.alias("x")).where("x.size = 0").select(*keep, "x.column")
