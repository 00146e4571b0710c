"""Dialogues as arrays of turns, and their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .personas import id_of
from .text import expand_contractions, fold

RECORD, UNIT = "\u001e", "\u001f"
TURNS = "array<struct<text:string,response:string>>"
#: Spellings of the roles, without case, punctuation and white space.
ROLES = {
    "user": ("user", "human", "usr", "customer", "person", "client", "enduser", "prompter", "questioner"),
    "assistant": ("assistant", "asst", "gpt", "chatgpt", "bot", "chatbot", "ai", "aiassistant", "model", "agent", "llm", "machine"),
    "system": ("system", "sys", "systemprompt", "developer"),
}


def role_of(c: Column) -> Column:
    """user, assistant or system; null for a role that means none of them."""
    bare = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.coalesce(*(F.when(bare.isin(*names), role) for role, names in ROLES.items()))


def turns_of_json(c: Column) -> Column:
    """The turns of a JSON list of objects; null if it is null or no valid list. Other fields, such as offered replies, are left out.

    A field that an object lacks is empty, one that is null stays null.
    """
    v = F.try_parse_json(c)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    parsed = F.from_json(c, "array<map<string,string>>")
    get = lambda t, k: F.when(F.array_contains(F.map_keys(t), k), F.element_at(t, k)).otherwise(F.lit(""))
    turns = F.transform(parsed, lambda t: F.struct(get(t, "text").alias("text"), get(t, "response").alias("response")))
    return F.when(F.coalesce(is_list, F.lit(False)), turns)


def turns_of(c: Column) -> Column:
    """The turns of an array of structs with text and response."""
    return F.transform(c, lambda t: F.struct(t["text"].alias("text"), t["response"].alias("response")))


def raw_text(turns: Column) -> Column:
    """Folded utterances, a unit separator within a turn and a record separator between turns; null without turns."""
    one = lambda t: F.concat(fold(t["text"]), F.lit(UNIT), fold(t["response"]))
    return F.when(F.size(turns) > 0, F.array_join(F.transform(turns, one), RECORD))


def expanded_text(turns: Column) -> Column:
    """As raw_text with contractions expanded and a space on each side of the separators."""
    one = lambda t: F.concat(expand_contractions(t["text"]), F.lit(f" {UNIT} "), expand_contractions(t["response"]))
    return F.when(F.size(turns) > 0, F.array_join(F.transform(turns, one), f" {RECORD} "))


def raw_key(turns: Column) -> Column:
    return id_of(raw_text(turns))


def expanded_key(turns: Column) -> Column:
    return id_of(expanded_text(turns))
