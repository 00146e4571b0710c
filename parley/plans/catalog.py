"""queries() and oracle_sql() of the core operators, over whole tables.

Corpora: convai2_conversations (cv), personachat_dialogs (pc), synthetic_chats (sy) and the mapping persona_mapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialogs, hashing, personas, text
from ..operators import compare, mapping, profile
from ..session import scratch
from ..sources import checkpoints, numbered
from ..sources.corpus import columns_like, existing_columns, read_back, read_split, table, with_row_index, write_corpus
from ..streaming import resume
from . import jobs, sql

CV, PC, SY, PM = "convai2_conversations", "personachat_dialogs", "synthetic_chats", "persona_mapping"
CV_IDS = {"your_persona_id": "your_persona", "partner_persona_id": "partner_persona"}
PC_IDS = {"your_persona_id": "your_persona_original", "partner_persona_id": "partner_persona_original"}
SY_IDS = {"persona-1-id": "user 1 personas", "persona-2-id": "user 2 personas"}
PC_PAIRS = [("your_persona_original", "your_persona_revised"), ("partner_persona_original", "partner_persona_revised")]
SHARDS = 7
#: Rows that a limited run takes, in source order.
LIMIT = 200
#: Splits in their usual order.
SPLITS = ("train", "validation", "test")

#: An invented matrix of jobs for the query over it: two models, four sets, among them two that can't run.
CONFIG = {
    "output_root": "/shared/pictures", "split": "all", "persona_id_column": "pid", "image_column": "picture",
    "generation_params": {"width": 640, "guidance_scale": 2.5, "negative_prompt": "text, frames"},
    "models": {"sketch": {"repo_id": "lab/sketch", "dataset_suffix": "S1", "generation_params": {"seed": 11, "num_inference_steps": 8, "palette": "gray"}}, "oil": {"repo_id": "lab/oil", "dataset_suffix": "O2"}},
    "datasets": {
        "letters": {"repo_id": "archive/letters", "columns": {"original": "self_text", "enhanced": "self_text_long"}},
        "diaries": {"repo_id": "archive/old/diaries", "columns": {"original": "entry", "enhanced": "entry_long"}},
        "loose": {"repo_id": "loose", "columns": {"original": "entry", "enhanced": "entry_long"}},
        "half": {"repo_id": "archive/half", "columns": {"original": "entry"}},
    },
}


def split_name(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s == "valid", "validation").otherwise(s)


def cv(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, CV)
    return t.select("row_index", split_name(F.col("source_split")).alias("split"), F.col("your_persona").alias("one"), F.col("partner_persona").alias("two"), dialogs.turns_of(F.col("turns")).alias("turns"))


def pc(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, PC)
    return t.select("row_index", "split", personas.lenient_list(F.col("your_persona_revised")).alias("one"), personas.lenient_list(F.col("partner_persona_revised")).alias("two"), dialogs.turns_of_json(F.col("dialog")).alias("turns"))


def both_personas(df: DataFrame) -> DataFrame:
    return df.select("split", "row_index", F.explode(F.array("one", "two")).alias("persona"))


def keys(df: DataFrame) -> DataFrame:
    return both_personas(df).select(personas.comparable_key(F.col("persona")).alias("key"))


def sentences(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.flatten(F.array(F.coalesce("one", F.array()), F.coalesce("two", F.array())))).alias("sentence")).select(text.strip(F.col("sentence")).alias("sentence")).where("sentence <> ''")


def dialog_rows(df: DataFrame, expanded: bool = True) -> DataFrame:
    """(id, split, dialog, one, two, text): keys of a corpus' rows, and the dialogue's text that is hashed; unused columns are pruned."""
    text_of = dialogs.expanded_text if expanded else dialogs.raw_text
    key = lambda c: personas.comparable_key(F.col(c)).alias(c)
    rows = df.select(F.col("row_index").alias("id"), "split", key("one"), key("two"), text_of(F.col("turns")).alias("text"))
    return rows.withColumn("dialog", personas.id_of(F.col("text")))


# ---- sizes and schema ----------------------------------------------------------------------------------------------


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_sizes({"convai2": cv(spark, d), "personachat": pc(spark, d), "synthetic": table(spark, d, SY)})


def schema_listing(spark: SparkSession, d: str) -> DataFrame:
    return profile.schema_listing(spark, {n: table(spark, d, n) for n in (CV, PC, SY, PM)})


def column_discovery(spark: SparkSession, d: str) -> DataFrame:
    """The persona columns of every table, whatever their case, and whether the enhanced text is among them."""
    rows = []
    for n in (CV, PC, SY, PM):
        t = table(spark, d, n)
        rows += [(n, c, bool(existing_columns(t, ["enhanced_persona_revised"]))) for c in columns_like(t, "PERSONA")]
    return spark.createDataFrame(rows, "dataset string, column string, has_enhanced boolean")


def corpus_read_back(spark: SparkSession, d: str) -> DataFrame:
    """One split of convai2, read from where it was written by split as a named configuration, its columns and rows checked against the source; the first LIMIT rows."""
    c = table(spark, d, CV).select("row_index", "conversation_id", F.col("your_persona"), split_name(F.col("source_split")).alias("split"))
    where = scratch(spark, "corpus")
    write_corpus(c, where, config="plain")
    differences = read_back(c, where, "plain")
    if differences:
        raise ValueError(f"read back otherwise: {differences}")
    again = read_split(spark, where, c.schema, "train", ["row_index", "conversation_id"], LIMIT, "plain")
    return again.select("row_index", "conversation_id", F.array_join("your_persona", "|").alias("your_persona"), "split")


# ---- identities, mappings, checks ----------------------------------------------------------------------------------


def persona_ids_flat(spark: SparkSession, d: str) -> DataFrame:
    return mapping.enrich(table(spark, d, SY), personas.flat_text, SY_IDS).select("row_index", F.col("`persona-1-id`").alias("one_id"), F.col("`persona-2-id`").alias("two_id"))


def persona_ids_ordered(spark: SparkSession, d: str) -> DataFrame:
    return mapping.enrich(table(spark, d, PC), personas.ordered_text, PC_IDS).select("row_index", *PC_IDS)


def persona_ids_canonical(spark: SparkSession, d: str) -> DataFrame:
    return mapping.enrich(table(spark, d, CV), personas.canonical_text, CV_IDS).select("row_index", *CV_IDS)


def persona_ids_comparable(spark: SparkSession, d: str) -> DataFrame:
    return pc(spark, d).select("row_index", personas.comparable_key(F.col("one")).alias("one_key"), personas.comparable_key(F.col("two")).alias("two_key"))


def persona_mapping(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapping(table(spark, d, CV), personas.canonical_text, list(CV_IDS.values())).withColumnRenamed("persona-id", "persona_id")


def persona_mapping_flat(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapping(table(spark, d, SY), personas.flat_text, list(SY_IDS.values()), "description").withColumnRenamed("persona-id", "persona_id")


def persona_mapping_paired(spark: SparkSession, d: str) -> DataFrame:
    return mapping.paired_mapping(table(spark, d, PC), personas.ordered_text, PC_PAIRS).withColumnRenamed("persona-id", "persona_id")


def mapping_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return mapping.conflicts(table(spark, d, PC), personas.ordered_text, PC_PAIRS)


def persona_mapping_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The mapping with the place of each row in the total order of its texts."""
    return mapping.in_order(persona_mapping(spark, d))


def enriched_via_join(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, CV)
    m = mapping.mapping(t, personas.canonical_text, list(CV_IDS.values()))
    return mapping.enrich_by_join(t, personas.canonical_text, CV_IDS, m).select("row_index", *CV_IDS)


def enrichment_integrity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, CV)
    e = mapping.enrich(t, personas.canonical_text, CV_IDS)
    m = mapping.mapping(t, personas.canonical_text, list(CV_IDS.values()))
    return mapping.integrity(t, e, CV_IDS, m, personas.canonical_text)


def identity_collisions(spark: SparkSession, d: str) -> DataFrame:
    p = both_personas(cv(spark, d)).select(personas.canonical(F.col("persona")).alias("form")).where("form is not null")
    return mapping.collisions(p.select("form", F.array_join("form", " ").alias("text")))


def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = mapping.enrich(table(spark, d, PC), personas.ordered_text, PC_IDS)
    out = mapping.coverage(e, list(PC_IDS), table(spark, d, PM))
    return out.select("n_ids", "n_missing", F.array_join("first_missing", ",").alias("first_missing"))


def attach_problems(spark: SparkSession, d: str) -> DataFrame:
    m = mapping.paired_mapping(table(spark, d, PC), personas.ordered_text, PC_PAIRS)
    return mapping.attach_problems(m, table(spark, d, PM))


def attached_answers(spark: SparkSession, d: str) -> DataFrame:
    """The latest answer of each id, attached to the ids of personachat's mapping that have one; the others keep null."""
    m = mapping.paired_mapping(table(spark, d, PC), personas.ordered_text, PC_PAIRS)
    v = checkpoints.last_write(table(spark, d, PM).where("`persona-id` is not null").select(F.col("`persona-id`").alias("persona-id"), "row_index", "enhanced_persona_revised"), ["row_index"], "persona-id")
    some = mapping.attach(m.join(v, "persona-id", "left_semi"), v, "enhanced_persona_revised")
    none = m.join(v, "persona-id", "left_anti").withColumn("enhanced_persona_revised", F.lit(None).cast("string"))
    return some.unionByName(none).select(F.col("persona-id").alias("persona_id"), "enhanced_persona_revised")


def persona_violations(spark: SparkSession, d: str) -> DataFrame:
    """Where a strict reader of convai2's personas would stop."""
    p = table(spark, d, CV).select("row_index", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in CV_IDS.values()))).alias("p"))
    v = F.col("p.v")
    kind = F.when(v.isNull(), "no list").when(F.size(v) == 0, "empty list").when(F.exists(v, lambda s: s.isNull()), "null sentence").when(F.exists(v, lambda s: text.strip(s) == ""), "blank sentence")
    return p.select("row_index", "p.column", kind.alias("kind")).where("kind is not null")


# ---- comparison ------------------------------------------------------------------------------------------------------


def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    return compare.overlap(keys(cv(spark, d)), keys(pc(spark, d)))


def _sy_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c: F.split(F.col(f"`{c}`"), r"\r\n|\r|\n")
    return keys(table(spark, d, SY).select("split", "row_index", lines("user 1 personas").alias("one"), lines("user 2 personas").alias("two")))


def three_way_difference(spark: SparkSession, d: str) -> DataFrame:
    return compare.set_except(keys(cv(spark, d)), keys(pc(spark, d)), _sy_keys(spark, d))


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return compare.set_intersect(sentences(cv(spark, d)), sentences(pc(spark, d)))


def set_except(spark: SparkSession, d: str) -> DataFrame:
    return compare.set_except(sentences(cv(spark, d)), sentences(pc(spark, d)))


def set_union(spark: SparkSession, d: str) -> DataFrame:
    return compare.set_union(sentences(cv(spark, d)), sentences(pc(spark, d)))


def _match_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    strict = lambda c: personas.strict_list(F.col(c))
    b = table(spark, d, PC).select(F.explode(F.array(strict("your_persona_revised"), strict("partner_persona_revised"))).alias("persona"))
    return tuple(x.where(personas.usable(F.col("persona"))).select("persona") for x in (both_personas(cv(spark, d)), b))


def staged_match(spark: SparkSession, d: str) -> DataFrame:
    return compare.staged(*_match_sides(spark, d), personas.STAGES)


def staged_match_relaxed(spark: SparkSession, d: str) -> DataFrame:
    """The stage with compatibility forms: each distinct sentence goes through the UDF once, and lists are put together again."""
    sides = []
    for side in _match_sides(spark, d):
        lists = side.distinct().select(*hashing.both(hashing.list_hash, F.col("persona")), F.explode("persona").alias("s"))
        forms = lists.select("s").distinct().withColumn("form", personas.relaxed(F.col("s")))
        sides.append(lists.join(forms, "s").groupBy("h1", "h2").agg(F.array_sort(F.collect_list("form")).alias("persona")))
    return compare.staged(*sides, {"relaxed": lambda p: p})


def staged_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three smallest personas that only one corpus has, as bulleted text."""
    a, b = (s.select(F.array_sort(personas.stripped(F.col("persona"))).alias("p")) for s in _match_sides(spark, d))
    only = compare.smallest(a.subtract(b).select(text.bullets(F.col("p")).alias("persona")), "persona").withColumn("side", F.lit("convai2"))
    return only.unionByName(compare.smallest(b.subtract(a).select(text.bullets(F.col("p")).alias("persona")), "persona").withColumn("side", F.lit("personachat")))


def dialog_key_raw(spark: SparkSession, d: str) -> DataFrame:
    return pc(spark, d).select("row_index", dialogs.raw_key(F.col("turns")).alias("dialog_key"))


def dialog_key_expanded(spark: SparkSession, d: str) -> DataFrame:
    return cv(spark, d).select("row_index", dialogs.expanded_key(F.col("turns")).alias("dialog_key"))


def contraction_expand(spark: SparkSession, d: str) -> DataFrame:
    return conversation_turns_exploded(spark, d).select("row_index", "turn_id", text.expand_contractions(F.col("text")).alias("text"), text.expand_contractions(F.col("response")).alias("response"))


def _presence(spark: SparkSession, d: str, expanded: bool) -> DataFrame:
    return compare.presence({n: dialog_rows(f(spark, d), expanded).select("split", F.col("dialog").alias("key")) for n, f in (("convai2", cv), ("personachat", pc))})


def dialog_presence(spark: SparkSession, d: str) -> DataFrame:
    return _presence(spark, d, False)


def dialog_presence_expanded(spark: SparkSession, d: str) -> DataFrame:
    return _presence(spark, d, True)


def dialog_overlap_validation(spark: SparkSession, d: str) -> DataFrame:
    return compare.overlap(*(dialog_rows(f(spark, d), False).where("split = 'validation'").withColumnRenamed("dialog", "key") for f in (cv, pc)))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(dialog_rows(f(spark, d)).select(personas.pair_key(F.col("one"), F.col("two")).alias("pair"), "dialog") for f in (cv, pc))


def pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compare.overlap(*_pairs(spark, d), key="pair")


def pair_dialog_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compare.pairs_with_shared_dialogs(*_pairs(spark, d))


def persona_agreement(spark: SparkSession, d: str) -> DataFrame:
    return compare.agreement(dialog_rows(pc(spark, d)), dialog_rows(cv(spark, d)))


def fuzzy_buckets(spark: SparkSession, d: str) -> DataFrame:
    return compare.likeness_buckets(dialog_rows(pc(spark, d)), dialog_rows(cv(spark, d)))


def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """Where each dialogue of each corpus stands first: splits in their usual order, then rows."""
    rows = None
    for n, f in (("convai2", cv), ("personachat", pc)):
        r = dialog_rows(f(spark, d)).select(F.lit(n).alias("corpus"), "split", "id", "dialog")
        rows = r if rows is None else rows.unionByName(r)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")), F.lit(0)), F.lit(len(SPLITS) + 1))
    key = F.when(F.col("dialog").isNotNull(), F.struct("corpus", "dialog"))
    first = compare.first_occurrence(rows.withColumn("key", key), "key", [rank, F.col("id")], F.struct("split", "id"))
    return first.select("key.corpus", "key.dialog", "first.split", F.col("first.id").alias("first"))


def top_examples(spark: SparkSession, d: str) -> DataFrame:
    return compare.smallest(compare.set_intersect(sentences(cv(spark, d)), sentences(pc(spark, d))), "sentence")


def first_turns(spark: SparkSession, d: str) -> DataFrame:
    return cv(spark, d).where(F.size("turns") > 0).select("row_index", F.to_json(F.transform(F.slice("turns", 1, 2), lambda t: F.struct(t["text"].alias("text"), t["response"].alias("response"))), {"ignoreNullFields": "false"}).alias("preview"))


# ---- dialogues and numbered text -------------------------------------------------------------------------------------


def conversation_turns_exploded(spark: SparkSession, d: str) -> DataFrame:
    return cv(spark, d).select("row_index", F.posexplode("turns").alias("turn_id", "t")).select("row_index", "turn_id", "t.text", "t.response")


def message_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns from message rows: a user's message and the assistant's that follows it directly, in any spelling of the roles, without system rows.

    Messages go by number, then time, then arrival; of one number the message that arrived first counts. The order
    is one distributed sort, and a message finds the next by its place, so a long conversation is no single task.
    """
    m = table(spark, d, "chat_messages").where("conversation_id is not null and text is not null").select("conversation_id", "message_id", "turn_id", "sent_at", dialogs.role_of(F.col("role")).alias("role"), "text")
    once = m.withColumn("slot", F.when(F.col("turn_id").isNull(), F.col("message_id"))).groupBy("conversation_id", "turn_id", "slot").agg(F.min_by(F.struct("message_id", "sent_at", "role", "text"), "message_id").alias("m")).select("conversation_id", "turn_id", "m.*")
    order = ["conversation_id", "turn_id", "sent_at", "message_id"]
    placed = with_row_index(once.where("role is null or role <> 'system'"), order, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, b = placed.where("role = 'user'").alias("a"), placed.where("role = 'assistant'").alias("b")
    follows = (F.col("a.row_index") + 1 == F.col("b.row_index")) & (F.col("a.conversation_id") == F.col("b.conversation_id"))
    return a.join(b, follows).select("a.conversation_id", "a.message_id", "a.turn_id", "a.text", F.col("b.text").alias("response"))


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """convai2 as it would be written as numbered text: white space that a line can't hold replaced, nulls empty, the split none where it is null."""
    clean = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[\t\r\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", " ")
    c = cv(spark, d)
    return c.select(F.coalesce("split", F.lit("none")).alias("split"), "row_index", F.transform("one", clean).alias("your_persona"), F.transform("two", clean).alias("partner_persona"), F.transform("turns", lambda t: F.struct(clean(t["text"]).alias("text"), clean(t["response"]).alias("response"))).alias("turns"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """All of convai2 as numbered lines, broken conversations too."""
    return numbered.write_lines(_conversations(spark, d), "row_index")


#: Lines put behind every tenth conversation, by the last digit of its row, so that a parser has something to refuse; {n} is the number due.
DAMAGE = {1: "{n} your persona: too late", 2: "{n} only one field", 3: "{n} a\tb\tc", 4: "{n} My Persona: x\ty", 5: "no number", 6: " ", 7: "99 late\tline", 8: "{n} \tonly a response", 9: "{n} partner's persona:  "}


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    """The lines with those of DAMAGE."""
    line = F.element_at(F.create_map(*(F.lit(x) for kv in DAMAGE.items() for x in kv)), (F.col("row_index") % 10).cast("int"))
    return numbered.write_lines(_conversations(spark, d), "row_index", line)


def line_numbered_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = numbered.parse(_lines(spark, d), "both_revised_no_cands")
    return p.select("source_split", "conversation_id", F.array_join("your_persona", "|").alias("your_persona"), F.array_join("partner_persona", "|").alias("partner_persona"), F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat_ws("~", t["turn_id"].cast("string"), t["text"], t["response"])), "|").alias("turns"))


def line_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return numbered.line_kinds(_lines(spark, d))


def parse_violations(spark: SparkSession, d: str) -> DataFrame:
    return numbered.violations(_damaged(spark, d)).select("split", "line_no", "kind")


def first_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The first conversation of each split as it stands in the numbered text."""
    return numbered.first_episode(_damaged(spark, d))


# ---- profile -----------------------------------------------------------------------------------------------------------

UNIQUE = [("your_persona_original", "partner_persona_original"), ("your_persona_revised", "partner_persona_revised"), ("your_persona_revised", "dialog"), ("dialog", "enhancer")]
DEPENDENT = [("persona-id", "persona_revised"), ("persona_original", "persona_revised"), ("persona-id", "enhancer"), ("persona-id", "row_index")]


def pair_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return profile.pair_uniqueness(table(spark, d, PC), UNIQUE)


def functional_dependency(spark: SparkSession, d: str) -> DataFrame:
    return profile.functional_dependency(table(spark, d, PM), DEPENDENT)


def fd_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return profile.dependency_conflicts(table(spark, d, PM), DEPENDENT)


def missingness(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, PC)
    return profile.missingness(t, columns_like(t, "persona"))


def missingness_nested(spark: SparkSession, d: str) -> DataFrame:
    return profile.missingness(table(spark, d, CV), ["your_persona", "partner_persona", "turns", "source_split"])


def invalid_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, PC)
    return profile.invalid_rows(t, "row_index", columns_like(t, "persona")).select("row_index", F.array_join("columns", ",").alias("columns"), F.array_join(F.transform("columns", lambda c: F.coalesce(F.element_at("values", c), F.lit("(null)"))), "|").alias("values"))


def empty_personas(spark: SparkSession, d: str) -> DataFrame:
    p = pc(spark, d)
    return profile.empty_personas(p, {"one": personas.comparable(F.col("one")), "two": personas.comparable(F.col("two"))}, ["split", "row_index"])


# ---- shards, checkpoints, prompts ------------------------------------------------------------------------------------


def shard_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PM).groupBy(resume.shard_of(F.col("row_index"), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows with their shard, in one scan."""
    return table(spark, d, PM).select(resume.shard_of(F.col("row_index"), SHARDS).cast("int").alias("shard"), "row_index", F.col("`persona-id`").alias("persona_id"))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint as a run would have left it: every answered row once, reruns again in a later shard, rows without answer not at all."""
    t = table(spark, d, PM).where("enhanced_persona_revised is not null")
    once = t.select("row_index", F.lit(0).alias("shard"), F.col("row_index").alias("line_no"), F.col("enhanced_persona_revised").alias("value"))
    again = t.where("enhancer = 'pe-7b-rerun'").select("row_index", F.lit(1).alias("shard"), F.col("row_index").alias("line_no"), F.concat(F.lit("again: "), F.col("enhanced_persona_revised")).alias("value"))
    return once.unionByName(again)


def checkpoint_last_write(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.last_write(_written(spark, d), ["shard", "line_no"])


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.pending(table(spark, d, PM).select("row_index"), checkpoint_last_write(spark, d))


def missing_rows_preview(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints.missing(table(spark, d, PM).select("row_index"), checkpoint_last_write(spark, d)).select("n_missing", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


def merge_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, PM).where("enhanced_persona_revised is not null").select("row_index", F.col("`persona-id`").alias("persona_id"))
    return checkpoints.merge(rows, checkpoint_last_write(spark, d))


def prompt_template(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PM).select("row_index", text.text_prompt(F.col("persona_revised")).alias("prompt"))


def prompt_variant(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, PM).select("row_index", F.explode(F.array(F.struct(F.lit("original").alias("variant"), F.col("persona_revised").alias("text")), F.struct(F.lit("enhanced").alias("variant"), F.col("enhanced_persona_revised").alias("text")))).alias("v"))
    return t.select("row_index", "v.variant", text.image_prompt(F.col("v.text"), F.col("v.variant")).alias("prompt"), text.image_prompt(F.col("v.text")).alias("always_prefixed"))


def clean_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PM).select("row_index", text.clean_output(F.col("enhanced_persona_revised")).alias("cleaned"))


def _stub() -> Callable[[str], str]:
    def predict(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError("stub failure")
        return f"<answer>{prompt} <think>well</think></answer>"

    return predict


def stub_enhance(spark: SparkSession, d: str) -> DataFrame:
    """The text stage with a stub model that fails on prompts whose length is a multiple of seven."""
    out = resume.enhanced(table(spark, d, PM), text.text_prompt(F.col("persona_original")), _stub, text.clean_output)
    return out.select("row_index", "enhanced_description", F.col("error").isNotNull().alias("failed"))


def text_run(spark: SparkSession, d: str) -> DataFrame:
    """The text stage with the stub model, stopped and resumed: a limited run, then one shard, then all; merged from the written chunks."""
    t, where = table(spark, d, PM), scratch(spark, "text")
    for limit, shards, index in ((LIMIT, 1, 0), (None, SHARDS, 3), (None, SHARDS, None)):
        resume.run_text(t, "persona_original", text.text_prompt, _stub, where, limit, shards, index)
    return resume.merge_text(t.select("row_index", F.col("`persona-id`").alias("persona_id")), where, name="enhanced", shards=SHARDS)


def _pictures() -> Callable[[str], bytes]:
    from ..functions.images import encode_png

    def draw(prompt: str) -> bytes:
        import numpy as np

        if len(prompt) % 7 == 0:
            raise ValueError("stub failure")
        return encode_png(np.full((1, 1, 3), len(prompt) % 7 * 30, np.uint8))

    return draw


def image_run(spark: SparkSession, d: str) -> DataFrame:
    """The image stage with a stub model that draws one pixel by the prompt's length and fails as the text stub does; failed rows stay pending."""
    t, where = table(spark, d, PM), scratch(spark, "images")
    prompt = text.image_prompt(F.col("persona_original"))
    resume.run_images(t.where(F.col("row_index") % 2 == 0), "persona-id", prompt, _pictures, where, force=True)
    resume.run_images(t, "persona-id", prompt, _pictures, where)
    images, log = resume.image_folders(where)
    done = checkpoints.read_images(spark, log, images)
    pixels = spark.read.format("binaryFile").load(images).select(F.regexp_replace("path", "^file:/+", "/").alias("image_path"), F.sha2("content", 256).alias("digest"))
    return done.join(pixels, "image_path").select("row_index", "persona_id", F.regexp_extract("image_path", "(images/[^/]*)$", 1).alias("image_path"), "digest")


def request_positions(spark: SparkSession, d: str) -> DataFrame:
    """Results of requests that name their place in a batch, brought back into order by it; a batch is whole if its places are 0 to n - 1."""
    t = table(spark, d, PM).select(F.floor(F.col("row_index") / 8).alias("batch"), F.concat((F.col("row_index") % 8).cast("string"), F.lit("_"), F.coalesce("persona-id", F.lit("x"))).alias("request_id"), "row_index")
    at = t.withColumn("position", text.request_position(F.col("request_id")))
    g = at.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("position", "row_index"))).alias("r"))  # eight rows at most
    return g.select("batch", F.array_join(F.transform("r", lambda x: x["row_index"].cast("string")), ",").alias("rows"), (F.transform("r", lambda x: x["position"]) == F.sequence(F.lit(0), F.size("r") - 1).cast("array<bigint>")).alias("whole"))


def image_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PM).select("row_index", text.image_name(F.col("row_index")).alias("image_path"), text.shard_name(SHARDS, resume.shard_of(F.col("row_index"), SHARDS)).alias("shard_dir"))


def job_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All jobs of CONFIG with every sampling parameter."""
    j = jobs.with_sampling(jobs.job_table(spark, CONFIG))
    extra = F.array_join(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return j.select("ordinal", "source", "target", "split", "id_column", "prompt_column", "image_column", "variant", "model", *jobs.SAMPLING, "negative_prompt", extra.alias("extra"), "output", "problem")


def json_persona_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("partner_persona_revised")
    return table(spark, d, PC).select("row_index", F.array_join(personas.strict_list(c), "|", "None").alias("strict"), F.array_join(personas.lenient_list(c), "|").alias("lenient"))


QUERIES = (
    overlap_stats, split_counts, schema_listing, persona_ids_flat, persona_ids_ordered, persona_ids_canonical, persona_ids_comparable, persona_mapping, persona_mapping_flat, persona_mapping_paired, persona_mapping_ordered,
    mapping_conflicts, enriched_via_join, enrichment_integrity, identity_collisions, mapping_coverage, attach_problems, attached_answers, persona_violations, three_way_difference, set_intersect, set_except,
    set_union, staged_match, staged_match_relaxed, staged_examples, dialog_key_raw, dialog_key_expanded, contraction_expand, dialog_presence, dialog_presence_expanded, dialog_overlap_validation, pair_overlap,
    pair_dialog_overlap, persona_agreement, fuzzy_buckets, first_occurrence, top_examples, first_turns, conversation_turns_exploded, message_turns, line_numbered_roundtrip, line_kind_counts, parse_violations,
    pair_uniqueness, functional_dependency, fd_conflicts, missingness, missingness_nested, invalid_rows, empty_personas, shard_balance, shard_rows, checkpoint_last_write, resume_pending, missing_rows_preview,
    merge_complete, prompt_template, prompt_variant, clean_output, stub_enhance, image_paths, job_matrix, json_persona_parse, column_discovery, corpus_read_back, text_run, image_run, request_positions, first_episodes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle()
