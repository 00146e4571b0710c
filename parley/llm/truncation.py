"""Values that stop too early (problem 6): a self-join by prefix, and endings where no longer copy exists.

A value or list item that is a strict prefix of a longer one elsewhere was cut, if the longer one goes on inside the
same sentence or item. Distinct texts are sorted over all tasks: a strict prefix stands directly before a text that
begins with it, so every text is compared with its successor only, and no prefix, however common, is a hot key. A value
without a longer copy is judged by its last sentence, or by its last item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import both, hash64
from ..session import cut
from . import endings
from .corpora import load, small

FIELDS = ("your_enhanced_persona_revised", "partner_enhanced_persona_revised")
#: Different lists that must end alike before an ending that no list has inside counts as complete.
ENDINGS = 2


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, row_index, field, enhancer): every value of the two fields."""
    d = load(spark, sf_dir, "personachat_dialogs")
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text"), F.lit(k).alias("k")) for k, f in enumerate(FIELDS))))
    return d.select("row_index", "enhancer", cells.alias("c")).select((F.col("row_index") * 2 + F.col("c.k")).alias("id"), "c.text", "row_index", "c.field", "enhancer")


def looked(rows: DataFrame) -> DataFrame:
    """(id, kind, core, finished, last, inner) of (id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            e = [endings.look(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x.kind for x in e]), pa.array([x.core for x in e]), pa.array([x.finished for x in e]), pa.array([x.last for x in e]), pa.array([x.inner for x in e], pa.list_(pa.string()))],
                ["id", "kind", "core", "finished", "last", "inner"],
            )

    return rows.select("id", "text").mapInArrow(run, "id long, kind string, core string, finished boolean, last string, inner array<string>")


def continued(texts: DataFrame) -> DataFrame:
    """(text, rest): the distinct texts of ``texts`` (text) that are strict prefixes of another, and how a longer one goes on.

    ``rest`` is the next in sorted order without the common part. Copies fall together before the sort, partly before
    the shuffle. The last text of a range is compared with the first of the next range that has any: two texts for each
    task. Null and the empty text are no prefixes.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.where("text <> ''").select("text").distinct().repartitionByRange(parts, "text").sortWithinPartitions("text")

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], ["text", "rest", "part", "first"])
        part, first, last = TaskContext.get().partitionId(), None, []
        for batch in it:
            run = last + batch.column("text").to_pylist()
            first = run[0] if first is None and run else first
            yield out([(a, b[len(a) :], None, None) for a, b in zip(run, run[1:]) if b.startswith(a)])
            last = run[-1:]
        yield out([(x, None, part, first) for x in last])

    seen = cut(ranged.mapInArrow(walk, "text string, rest string, part int, first string"))
    ends = seen.where("part is not null").select("text", F.lead("first").over(Window.orderBy("part")).alias("next"))  # a row for each task
    across = ends.where(F.startswith("next", "text")).select("text", F.expr("substring(next, length(text) + 1)").alias("rest"))
    return seen.where("part is null").select("text", "rest").unionByName(across)


def complete_items(seen: DataFrame) -> DataFrame:
    """(last): list endings that are complete items.

    Complete is what stands inside a list somewhere, and what several different lists end in without being a strict
    prefix of a longer item anywhere. Copies of a list count once.
    """
    lists = seen.where("kind = 'list' and last <> ''")
    inner = lists.select(F.explode("inner").alias("text")).distinct()
    last = lists.groupBy(F.col("last").alias("text")).agg(F.count_distinct(F.xxhash64("inner")).alias("n"))
    whole = last.join(inner, "text", "left_semi").select("text")
    common = last.where(F.col("n") >= ENDINGS).select("text").join(inner, "text", "left_anti")
    common = common.join(continued(inner.union(last.select("text"))).select("text"), "text", "left_anti")
    return whole.unionByName(common).select(F.col("text").alias("last"))


def judged(rows: DataFrame) -> DataFrame:
    """(id, kind, stopped, has_longer_copy) of (id, text).

    Null, empty and marked-up nothing are not stopped. Where the prefix join finds a longer copy, it decides: a list is
    stopped unless the longer one goes on with a comma, prose if the longer one goes on inside a word or the last
    sentence has no end. The rest is stopped if the last sentence is incomplete (no end, an end that is an
    abbreviation's, an open quote or bracket), or, for a list, if its last item is. Repeated values are judged alike.
    """
    seen = cut(looked(rows))
    texts = seen.where("kind <> 'none'").select(F.col("core").alias("text"))
    inside = F.ltrim("rest").startswith(",")
    longer = continued(texts).select(*both(hash64, F.col("text")), inside.alias("next_item"), F.col("rest").rlike(r"^[\p{L}\p{N}]").alias("in_word"))
    hashed = seen.select("id", "kind", "finished", F.col("core").rlike(r"[\p{L}\p{N}]\z").alias("open_word"), *both(hash64, F.col("core")), "last")
    lists = hashed.where("kind = 'list'").join(complete_items(seen).withColumn("known", F.lit(True)), "last", "left")
    rest = hashed.where("kind <> 'list'").withColumn("known", F.lit(None).cast("boolean"))  # no item, so no part in that join
    out = lists.unionByName(rest).join(small(cut(longer)), ["h1", "h2"], "left")
    has = F.col("next_item").isNotNull()
    in_list = F.when(has, ~F.col("next_item")).otherwise(F.col("known").isNull())
    in_prose = ~F.col("finished") | (has & F.coalesce(F.col("in_word") & F.col("open_word"), F.lit(False)))
    stopped = F.when(F.col("kind") == "none", False).when(F.col("kind") == "list", in_list).otherwise(in_prose)
    return out.select("id", "kind", stopped.alias("stopped"), (has & (F.col("kind") != "none")).alias("has_longer_copy"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: (row_index, field) of the values that stop before their last sentence or list item is complete."""
    ids = judged(values(spark, sf_dir)).where("stopped").select("id")
    return ids.select(F.shiftright("id", 1).alias("row_index"), F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("id") % 2 + 1).cast("int")).alias("field"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_rates: per enhancer (null is a group) its values, the stopped ones and their share."""
    rows = values(spark, sf_dir)
    out = judged(rows).where("kind <> 'none'").join(rows.select("id", "enhancer"), "id")
    return out.groupBy("enhancer").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("stopped").alias("n_stopped"), F.count_if("has_longer_copy").alias("n_with_longer_copy"), F.avg(F.col("stopped").cast("double")).alias("share_stopped"))
