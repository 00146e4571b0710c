"""Persona ids for a corpus, the mapping from id to text, and the checks that both are sound.

An id is the hash of the canonical text, so it is computed where the row is; a join with the mapping gives the same and
is only needed to prove that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash64
from ..functions.personas import id_of
from ..sources.corpus import with_row_index

HEX = r"\A[0-9a-f]{64}\z"


def enrich(df: DataFrame, text_of: Callable[[Column], Column], columns: dict[str, str]) -> DataFrame:
    """``df`` with an id column (new name -> persona column) from each persona's canonical text; null where it has none."""
    return df.select("*", *(id_of(text_of(F.col(f"`{c}`"))).alias(name) for name, c in columns.items()))


def texts(df: DataFrame, text_of: Callable[[Column], Column], columns: list[str]) -> DataFrame:
    """(text): canonical texts of all persona columns, each column scanned once."""
    return df.select(F.explode(F.array(*(text_of(F.col(f"`{c}`")) for c in columns))).alias("text")).where("text is not null")


def mapping(df: DataFrame, text_of: Callable[[Column], Column], columns: list[str], name: str = "persona_revised") -> DataFrame:
    """(persona-id, text): one row per distinct persona, in no order; in_order() gives the order of the texts."""
    return texts(df, text_of, columns).distinct().select(id_of(F.col("text")).alias("persona-id"), F.col("text").alias(name))


def paired_mapping(df: DataFrame, text_of: Callable[[Column], Column], columns: list[tuple[str, str]]) -> DataFrame:
    """(persona-id, persona_original, persona_revised) from pairs of an original and a revised column; ids are of the original.

    An original with several revised texts keeps the smallest; conflicts() lists them.
    """
    both = df.select(F.explode(F.array(*(F.struct(text_of(F.col(f"`{o}`")).alias("o"), text_of(F.col(f"`{r}`")).alias("r")) for o, r in columns))).alias("p")).select("p.*")
    return both.where("o is not null").groupBy("o").agg(F.min("r").alias("r")).select(id_of(F.col("o")).alias("persona-id"), F.col("o").alias("persona_original"), F.col("r").alias("persona_revised"))


def conflicts(df: DataFrame, text_of: Callable[[Column], Column], columns: list[tuple[str, str]]) -> DataFrame:
    """(persona_original, n_revised, one, other): originals with more than one revised text, with the first and the last."""
    both = df.select(F.explode(F.array(*(F.struct(text_of(F.col(f"`{o}`")).alias("o"), text_of(F.col(f"`{r}`")).alias("r")) for o, r in columns))).alias("p")).select("p.*")
    g = both.where("o is not null and r is not null").groupBy("o").agg(F.count_distinct("r").alias("n_revised"), F.min("r").alias("one"), F.max("r").alias("other"))
    return g.where("n_revised > 1").withColumnRenamed("o", "persona_original")


def in_order(table: DataFrame, name: str = "persona_revised") -> DataFrame:
    """``table`` with a dense 0-based ``row_index`` in code-point order of its distinct texts, by a distributed sort."""
    return with_row_index(table, [name], int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write_mapping(table: DataFrame, path: str, name: str = "persona_revised") -> None:
    """Replaces ``path`` by the mapping in total order of its texts, as parquet files that follow each other by name."""
    table.orderBy(name).write.mode("overwrite").parquet(path)


def enrich_by_join(df: DataFrame, text_of: Callable[[Column], Column], columns: dict[str, str], table: DataFrame, name: str = "persona_revised", must: bool = True) -> DataFrame:
    """As enrich(), by looking each text up in the mapping ``table``.

    A text that the mapping lacks fails the job and is named, or gives a null id without ``must``. Rows without a text
    have a null id.
    """
    for new, c in columns.items():
        look = table.select(F.col(f"`{name}`").alias("_text"), F.col("`persona-id`").alias("_id"))
        found = df.withColumn("_key", text_of(F.col(f"`{c}`"))).join(look, F.col("_key") == F.col("_text"), "left")
        lost = F.col("_key").isNotNull() & F.col("_id").isNull()
        known = F.when(lost, F.raise_error(F.concat(F.lit(f"{c} is not in the mapping: "), F.col("_key")))).otherwise(F.col("_id")) if must else F.col("_id")
        df = found.withColumn(new, known).drop("_key", "_text", "_id")
    return df


def unresolved(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    """(id): ids in the columns that the mapping ``table`` lacks."""
    ids = df.select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("id")).where("id is not null").distinct()
    return ids.join(table.select(F.col("`persona-id`").alias("id")), "id", "left_anti")


def integrity(source: DataFrame, enriched: DataFrame, columns: dict[str, str], table: DataFrame, text_of: Callable[[Column], Column], name: str = "persona_revised") -> DataFrame:
    """(check, violations): each check of an enriched corpus and its mapping; all zero if they are sound."""
    pid = F.col("`persona-id`")
    ids = F.explode(F.array(*(F.col(f"`{c}`") for c in columns)))
    checks = {
        "row count changed": source.agg(F.count(F.lit(1)).alias("n")).unionByName(enriched.agg((-F.count(F.lit(1))).alias("n"))).agg(F.abs(F.sum("n")).alias("v")),
        "id malformed": enriched.select(ids.alias("id")).agg(F.count_if(~F.col("id").rlike(HEX)).alias("v")),
        "id not recomputable": enriched.agg(F.count_if(F.lit(False) if not columns else ~_all_equal(columns, text_of)).alias("v")),
        "id not in mapping": unresolved(enriched, list(columns), table).agg(F.count(F.lit(1)).alias("v")),
        "mapping id repeated": table.groupBy(pid.alias("id")).count().where("count > 1").agg(F.count(F.lit(1)).alias("v")),
        "mapping id of another text": table.agg(F.count_if(~pid.eqNullSafe(id_of(F.col(f"`{name}`")))).alias("v")),
        "mapping size differs": table.agg(F.count(F.lit(1)).alias("n")).unionByName(texts(source, text_of, list(columns.values())).agg((-F.count_distinct("text")).alias("n"))).agg(F.abs(F.sum("n")).alias("v")),
    }
    out = None
    for check, df in checks.items():
        row = df.select(F.lit(check).alias("check"), F.col("v").cast("long").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def _all_equal(columns: dict[str, str], text_of: Callable[[Column], Column]) -> Column:
    same = F.lit(True)
    for new, c in columns.items():
        same &= F.col(f"`{new}`").eqNullSafe(id_of(text_of(F.col(f"`{c}`"))))
    return same


def unchanged(source: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """(key): rows whose original columns differ between both, or that only one of them has."""
    digest = lambda df: df.select(key, hash64(1, F.to_json(F.struct(*sorted(source.columns)), {"ignoreNullFields": "false"})).alias("h"))
    a, b = digest(source).alias("a"), digest(enriched).alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").where(~F.col("a.h").eqNullSafe(F.col("b.h")))
    return out.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key))


def collisions(texts_and_forms: DataFrame) -> DataFrame:
    """(distinct_forms, distinct_texts, distinct_ids) of (form, text): equal numbers mean that nothing collides."""
    return texts_and_forms.agg(F.count_distinct("form").alias("distinct_forms"), F.count_distinct("text").alias("distinct_texts"), F.count_distinct(id_of(F.col("text"))).alias("distinct_ids"))


def coverage(df: DataFrame, columns: list[str], table: DataFrame, preview: int = 20) -> DataFrame:
    """(n_ids, n_missing, first_missing): how many referenced ids the mapping lacks, and the first of them in order."""
    ids = df.select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("id")).where("id is not null").distinct()
    marked = ids.join(table.select(F.col("`persona-id`").alias("id")).distinct().withColumn("there", F.lit(True)), "id", "left")
    lost = marked.where("there is null").orderBy("id").limit(preview).agg(F.array_sort(F.collect_list("id")).alias("first_missing"))
    return marked.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("there").isNull()).alias("n_missing")).select("n_ids", "n_missing", lost.scalar().alias("first_missing"))


def attach_problems(mapping_table: DataFrame, values: DataFrame, key: str = "persona-id") -> DataFrame:
    """(side, null_ids, repeated_ids, unmatched_ids) of attaching ``values`` to a mapping by id."""
    k = F.col(f"`{key}`")
    one = lambda df: df.where(k.isNotNull()).groupBy(k.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for side, df, other in (("mapping", mapping_table, values), ("values", values, mapping_table)):
        counted = one(df).join(one(other).select("id", F.lit(True).alias("there")), "id", "left").agg(F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(F.col("there").isNull()).alias("unmatched_ids"))
        row = counted.select(F.lit(side).alias("side"), df.agg(F.count_if(k.isNull()).alias("n")).scalar().alias("null_ids"), "repeated_ids", "unmatched_ids")
        out = row if out is None else out.unionByName(row)
    return out


def attach(mapping_table: DataFrame, values: DataFrame, column: str, key: str = "persona-id") -> DataFrame:
    """The mapping with ``column`` of ``values`` by id; a ValueError if ids are null, repeated or lack a value."""
    bad = [r.asDict() for r in attach_problems(mapping_table, values, key).collect() if r["null_ids"] or r["repeated_ids"] or r["side"] == "mapping" and r["unmatched_ids"]]
    if bad:
        raise ValueError(f"cannot attach by {key}: {bad}")
    return mapping_table.join(values.select(key, column), key, "left")
