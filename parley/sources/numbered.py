"""Line-numbered dialogue text: parsing into nested conversations, violations by line, and writing it.

A line is "<n> <payload>"; the numbering restarts at 1 with each conversation. A payload is a persona sentence behind its
prefix or a turn, text and response with a tab between. Sums over preceding lines are taken in blocks of lines and then
over the blocks, so one file may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.personas import id_of
from ..functions.text import strip

#: Prefixes of persona lines, and the line ends that Python's splitlines knows.
YOURS, PARTNERS = "your persona: ", "partner's persona: "
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: Lines of a block of running sums.
BLOCK = 65_536


def lines_of(texts: DataFrame) -> DataFrame:
    """(split, line_no, value) of (split, text); line numbers from 1, no line after a final line end."""
    body = F.regexp_replace("text", f"(?:{LINE_END})\\z", "")
    return texts.where("text <> ''").select("split", F.posexplode(F.split(body, LINE_END, -1)).alias("at", "value")).select("split", (F.col("at") + 1).cast("long").alias("line_no"), "value")


def running(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """``df`` (split, line_no, …) with the sum of ``flag`` over the lines up to and with each line of its split."""
    d = df.withColumn("_f", flag.cast("long")).withColumn("_b", F.floor(F.col("line_no") / BLOCK))
    sums = d.groupBy("split", "_b").agg(F.sum("_f").alias("_s"))
    before = sums.select("split", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("split").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_f").over(Window.partitionBy("split", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_within", within).join(before, ["split", "_b"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_f", "_b", "_before", "_within")


def marked(lines: DataFrame) -> DataFrame:
    """(split, line_no, value, n, payload, kind, sentence, fields, episode): kind is your, partner or turn; episode from 1."""
    head = F.split("value", " ", 2)
    n = F.regexp_extract(head[0], r"\A[+]?\d+(?:_\d+)*\z", 0)
    number = F.when(n != "", F.regexp_replace(n, "[+_]", "").try_cast("long"))
    payload = F.get(head, 1)
    kind = F.when(payload.startswith(YOURS), "your").when(payload.startswith(PARTNERS), "partner").otherwise("turn")
    d = lines.select("split", "line_no", "value", number.alias("n"), payload.alias("payload"), kind.alias("kind"))
    d = d.withColumns({"sentence": F.when(F.col("kind") != "turn", strip(F.expr(f"substring(payload, if(kind = 'your', {len(YOURS)}, {len(PARTNERS)}) + 1)"))), "fields": F.when(F.col("kind") == "turn", F.split("payload", "\t", -1))})
    return running(d, F.coalesce(F.col("n") == 1, F.lit(False)), "episode")


def parse(lines: DataFrame, config: str) -> DataFrame:
    """(conversation_id, your_persona, partner_persona, turns, source_split), one row per conversation without a violation.

    ``lines`` is (split, line_no, value). Use violations() to see, or refuse, what is left out. A conversation is one
    group; an empty table gives an empty result.
    """
    d = marked(lines)
    bad = violations(lines).where("episode is not null").select("split", "episode").distinct()
    good = d.join(bad, ["split", "episode"], "left_anti")
    inside = lambda kind, value: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("line_no", "kind", value.alias("v"))), lambda x: x["kind"] == kind)), lambda x: x["v"])
    out = good.groupBy("split", "episode").agg(
        inside("your", F.col("sentence")).alias("your_persona"),
        inside("partner", F.col("sentence")).alias("partner_persona"),
        inside("turn", F.col("fields")).alias("_turns"),
    )
    turns = F.transform("_turns", lambda f, i: F.struct(i.cast("int").alias("turn_id"), strip(f[0]).alias("text"), strip(f[1]).alias("response")))
    return out.select(conversation_id(config, F.col("split"), F.col("episode") - 1).alias("conversation_id"), "your_persona", "partner_persona", turns.alias("turns"), F.col("split").alias("source_split"))


def conversation_id(config: str, split: Column, index: Column) -> Column:
    return id_of(F.concat_ws("\u0000", F.lit(config), split, index.cast("string")))


def violations(lines: DataFrame) -> DataFrame:
    """(split, line_no, episode, kind) of everything a strict parser refuses; the first by line_no is where it would stop."""
    d = marked(lines)
    at = Window.partitionBy("split", "episode").orderBy("line_no")
    d = d.withColumn("expected", F.row_number().over(at)).withColumn("spoken", F.max((F.col("kind") == "turn").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    blank_field = F.exists("fields", lambda f: strip(f) == "")
    kind = (
        F.when(strip(F.col("value")) == "", "blank line")
        .when(F.col("n").isNull() | F.col("payload").isNull(), "no line number")
        .when(F.col("n") != F.col("expected"), "numbering gap")
        .when((F.col("kind") != "turn") & (F.col("sentence") == ""), "blank persona")
        .when((F.col("kind") != "turn") & (F.col("spoken") == 1), "persona after turn")
        .when((F.col("kind") == "turn") & F.contains(F.lower("payload"), F.lit("persona:")), "unknown persona prefix")
        .when((F.col("kind") == "turn") & (F.size("fields") != 2), "not two fields")
        .when((F.col("kind") == "turn") & blank_field, "blank field")
    )
    by_line = d.select("split", "line_no", "episode", kind.alias("kind")).where("kind is not null")
    whole = d.groupBy("split", "episode").agg(F.max("line_no").alias("line_no"), F.count_if(F.col("kind") == "your").alias("y"), F.count_if(F.col("kind") == "partner").alias("p"), F.count_if(F.col("kind") == "turn").alias("t"))
    lacking = F.when(F.col("y") == 0, "no your persona").when(F.col("p") == 0, "no partner persona").when(F.col("t") == 0, "no turns")
    return by_line.unionByName(whole.select("split", "line_no", "episode", lacking.alias("kind")).where("kind is not null"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """Per split: lines, conversations, lines of each kind, and the first of each kind."""
    head = F.split("value", " ", 2)
    payload = F.coalesce(F.get(head, 1), F.lit(""))
    kind = F.when(payload.startswith(YOURS), "your").when(payload.startswith(PARTNERS), "partner").otherwise("turn")
    d = lines.select("split", "line_no", "value", head[0].alias("n"), kind.alias("kind"))
    first = lambda k: F.min_by("value", F.when(F.col("kind") == k, F.col("line_no"))).alias(f"first_{k}")
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("n") == "1").alias("episodes"), *(F.count_if(F.col("kind") == k).alias(f"{k}_lines") for k in ("your", "partner", "turn")), *(first(k) for k in ("your", "partner", "turn")))


def first_episode(lines: DataFrame) -> DataFrame:
    """The lines of the first conversation of each split."""
    return marked(lines).where("episode = 1").select("split", "line_no", "value")


def write_lines(conversations: DataFrame, order: str, after: Column | None = None) -> DataFrame:
    """(split, line_no, value): the lines of conversations (your_persona, partner_persona, turns, split).

    ``line_no`` counts from 1 within a split, in the order of the column ``order`` (integers). Null lists count as
    empty; a conversation without anything has no line. ``after`` is a line behind a conversation, as it stands but for
    the number that would be due in place of {n}; null for none. Lines are counted by conversation, then in blocks of
    conversations and over the blocks, so no split is brought together.
    """
    some = lambda lines: F.coalesce(lines, F.array().cast("array<string>"))
    said = some(F.transform("turns", lambda t: F.concat(t["text"], F.lit("\t"), t["response"])))
    told = lambda c, prefix: some(F.transform(c, lambda s: F.concat(F.lit(prefix), s)))
    body = F.concat(told("your_persona", YOURS), told("partner_persona", PARTNERS), said)
    extra = F.lit(None).cast("string") if after is None else after
    c = conversations.select("split", F.col(order).alias("order"), body.alias("body"), extra.alias("extra")).where(F.size("body") > 0)
    lines = F.concat(F.transform("body", lambda p, i: F.concat((i + 1).cast("string"), F.lit(" "), p)), F.array_compact(F.array(F.replace("extra", F.lit("{n}"), (F.size("body") + 1).cast("string")))))
    c = c.select("split", "order", lines.alias("lines"), F.floor(F.col("order") / BLOCK).alias("block"))
    blocks = c.groupBy("split", "block").agg(F.sum(F.size("lines")).alias("n"))
    earlier = Window.partitionBy("split").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("split", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("split", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = c.withColumn("within", F.coalesce(F.sum(F.size("lines")).over(within), F.lit(0))).join(before, ["split", "block"])
    return placed.select("split", (F.col("before") + F.col("within") + 1).alias("start"), F.posexplode("lines").alias("at", "value")).select("split", (F.col("start") + F.col("at")).alias("line_no"), "value")
