"""Conversations rebuilt from message rows (problem 1) by assembling overlapping fragments.

A conversation's messages are exported in fragments of STEP + 1 places: each begins with the message that ends the one
before. A message is known by a hash of its place, role and text, so redeliveries fall together before fragments are
formed. A fragment is sound if its places follow each other without a gap or a fork and its roles take turns. Its prefix
is its first message's hash, its suffix the last one's; where the suffix of one fragment is the prefix of another, the
overlap graph of the conversation has an edge, if neither end has a second partner. A conversation is rebuilt if all
of it is one unambiguous path of sound fragments, as many edges as fragments less one, with a proper beginning and end.
A missing message leaves a fragment unsound or two fragments without an edge, and the conversation is dropped.

A fragment holds at most STEP + 1 places and only sums, extremes and flags of it are kept, so one conversation may hold
any share of the rows. Where there are no numbers, places are ranks in a distributed sort by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialogs import role_of
from ..functions.hashing import hash64
from ..functions.text import strip
from ..session import cut
from ..sources.corpus import with_row_index
from .corpora import load

#: Places by which a fragment begins after the one before.
STEP = 8


def placed(messages: DataFrame) -> DataFrame:
    """(conversation_id, place, role, hash, message_id, numbered): the distinct messages of each conversation at their places.

    ``place`` is the number, or the rank by time from 0 where the message has none; null where it has neither. Ranks
    come from one range-partitioned sort of the unnumbered messages, shifted by each conversation's least.
    """
    body = strip(F.col("text"))
    m = messages.where("conversation_id is not null").select(
        "conversation_id",
        "message_id",
        F.col("turn_id").cast("long").alias("turn"),
        F.when(F.col("turn_id").isNull(), F.unix_micros(F.col("sent_at").cast("timestamp"))).alias("time"),
        role_of(F.col("role")).alias("role"),
        F.when(body != "", hash64(1, body)).alias("hash"),
    )
    nodes = cut(m.groupBy("conversation_id", "turn", "time", "role", "hash").agg(F.min("message_id").alias("message_id")))
    kept = ["conversation_id", "role", "hash", "message_id"]
    numbered = nodes.where("turn is not null or time is null").select(*kept, F.col("turn").alias("place"), F.col("turn").isNotNull().alias("numbered"))
    ranked = with_row_index(nodes.where("turn is null and time is not null").select(*kept, "time"), ["conversation_id", "time", "message_id"], int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = ranked.groupBy("conversation_id", "time").agg(F.min("row_index").alias("row_index"), F.count(F.lit(1)).alias("n"))
    least = at.groupBy("conversation_id").agg(F.min("row_index").alias("least"), F.max("n").alias("most"))
    rank = F.when(F.col("most") == 1, F.col("row_index") - F.col("least"))  # two messages at one time have no order, hence no place
    timed = ranked.join(least, "conversation_id").select(*kept, rank.alias("place"), F.lit(False).alias("numbered"))
    return numbered.unionByName(timed)


def fragments(places: DataFrame) -> DataFrame:
    """(conversation_id, fragment, …) one row for each fragment with its prefix, its suffix and whether it is sound.

    A message whose place is a multiple of STEP belongs to two fragments, the overlap. Messages without a place make
    one unsound fragment per conversation.
    """
    block = F.floor(F.col("place") / STEP)
    before = F.when((F.col("place") % STEP == 0) & (F.col("place") > 0), block - 1)
    d = places.withColumn("fragment", F.explode(F.array_distinct(F.array(block, F.coalesce(before, block)))))
    ident = hash64(2, F.col("place"), F.col("role"), F.col("hash"))
    speaker = F.col("role").isin("user", "assistant")
    beat = F.when(speaker, F.pmod(F.col("place") + (F.col("role") == "assistant").cast("int"), F.lit(2)))
    return d.groupBy("conversation_id", "fragment").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.min_by(ident, "place").alias("prefix"),
        F.max_by(ident, "place").alias("suffix"),
        F.max_by("role", "place").alias("ends"),
        F.min(beat).alias("beat_least"),
        F.max(beat).alias("beat_most"),
        F.max(F.when(~speaker, F.col("place"))).alias("system"),
        F.min(F.when(speaker, F.struct("place", "role"))).alias("speaks"),
        F.max(F.col("role").isNull() | F.col("hash").isNull() | F.col("place").isNull()).alias("bad"),
        F.min("numbered").alias("all_numbered"),
        F.max("numbered").alias("any_numbered"),
    )


def paths(pieces: DataFrame) -> DataFrame:
    """(conversation_id, first) of the conversations whose fragments merge into one unambiguous path.

    Only a first message at the fragment's own beginning can be another's last, and the other way round; a fragment
    that is nothing but an overlap ends the path. Prefixes and suffixes meet by (conversation, hash); both ends and the
    fragments' own facts are then summed by conversation, partly before the shuffle.
    """
    prefix = F.when((F.col("first") == F.col("fragment") * STEP) & (F.col("fragment") > 0), F.col("prefix"))
    suffix = F.when(F.col("last") == (F.col("fragment") + 1) * STEP, F.col("suffix"))
    both = F.array(F.struct(prefix.alias("h"), F.lit(1).alias("head"), F.lit(0).alias("tail")), F.struct(suffix.alias("h"), F.lit(0).alias("head"), F.lit(1).alias("tail")))
    ends = pieces.select("conversation_id", F.explode(both).alias("e")).select("conversation_id", "e.*").where("h is not null")
    met = ends.groupBy("conversation_id", "h").agg(F.sum("head").alias("heads"), F.sum("tail").alias("tails"))
    edges = met.where("heads = 1 and tails = 1").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("edges"))
    sound = ~F.col("bad") & (F.col("n") == F.col("last") - F.col("first") + 1)
    whole = pieces.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.min(sound).alias("sound"),
        F.min("first").alias("first"),
        F.max_by("ends", "last").alias("ends"),
        F.min("beat_least").alias("beat_least"),
        F.max("beat_most").alias("beat_most"),
        F.max("system").alias("system"),
        F.min("speaks").alias("speaks"),
        F.min("all_numbered").alias("all_numbered"),
        F.max("any_numbered").alias("any_numbered"),
    )
    linked = whole.join(edges, "conversation_id", "left")
    return linked.where(
        (F.coalesce("edges", F.lit(0)) == F.col("nodes") - 1) & F.col("sound") & (F.col("all_numbered") == F.col("any_numbered")) & F.col("first").isin(0, 1)
        & (F.col("beat_least") == F.col("beat_most")) & (F.col("speaks.role") == "user") & F.coalesce(F.col("system") == F.col("first"), F.lit(True)) & (F.col("ends") == "assistant")
    ).select("conversation_id", "first")


def assemble(messages: DataFrame) -> DataFrame:
    """(conversation_id, seq, role, message_id) of every message of each usable conversation.

    ``messages`` has message_id, conversation_id, turn_id, role, text and sent_at; other columns are ignored. Rows with
    a null conversation_id belong to no conversation. Of messages with the same place (turn_id, or sent_at without
    it), role and text apart from outer white space the smallest message_id stays. A conversation is dropped if a role
    or text is missing, if only some messages are numbered, if a time is null or shared where numbers are missing, or
    if the messages are no path system? (user assistant)+ without a gap. An empty table gives an empty result.
    """
    places = cut(placed(messages))
    usable = paths(cut(fragments(places)))
    return places.join(usable, "conversation_id").select("conversation_id", (F.col("place") - F.col("first")).cast("int").alias("seq"), "role", "message_id")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: (conversation_id, seq, role, message_id) of all usable conversations."""
    return assemble(load(spark, sf_dir, "chat_messages"))
