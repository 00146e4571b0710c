"""Persona identities: what makes two lists of sentences the same persona, and their keys.

Five rules that must not be mixed up: flat (one text), ordered (a JSON list as it stands), canonical (a native list,
sorted, strict), comparable (anything, sorted, lenient) and the stages of progressive matching.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, strip
from .udfs import nfkc_casefold

UNIT = "\u001f"


def strict_list(c: Column) -> Column:
    """The strings of a JSON list; null unless the text is a list of strings only and nothing else."""
    is_list = F.schema_of_variant(F.try_parse_json(c)).isin("ARRAY<STRING>", "ARRAY<VOID>")
    parsed = F.from_json(c, "array<string>")
    return F.when(is_list & ~F.exists(parsed, lambda s: s.isNull()), parsed)


def lenient_list(c: Column) -> Column:
    """The elements of a JSON list as texts, null as the word None; any other text is a list of one; null is empty."""
    is_list = F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.coalesce(is_list, F.lit(False)), none_as_word(F.from_json(c, "array<string>"))).otherwise(F.array(c))


def none_as_word(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.coalesce(s, F.lit("None")))


def stripped(sentences: Column) -> Column:
    return F.transform(sentences, strip)


def not_blank(sentences: Column) -> Column:
    return F.filter(sentences, lambda s: s != "")


def id_of(text: Column) -> Column:
    """SHA-256 in hex; null stays null."""
    return F.sha2(text, 256)


def flat_text(c: Column) -> Column:
    """The stripped text; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def ordered_text(c: Column) -> Column:
    """Sentences of a JSON list, stripped, blank ones dropped, in their order; null for anything else or nothing."""
    kept = not_blank(stripped(strict_list(c)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def canonical(sentences: Column) -> Column:
    """Stripped sentences in order of their bytes; null for a null or empty list and if a sentence is null or blank."""
    s = stripped(sentences)
    bad = F.exists(s, lambda x: x.isNull() | (x == ""))
    return F.when((F.size(sentences) > 0) & ~F.coalesce(bad, F.lit(True)), F.array_sort(s))


def canonical_text(sentences: Column) -> Column:
    return F.array_join(canonical(sentences), " ")


def comparable(sentences: Column) -> Column:
    """Stripped sentences without blank ones, sorted; null sentences are the word None, a null list is empty."""
    return F.array_sort(not_blank(stripped(none_as_word(F.coalesce(sentences, F.array().cast("array<string>"))))))


def comparable_key(sentences: Column) -> Column:
    """The key of comparable(); every empty persona has the same one."""
    return id_of(F.array_join(comparable(sentences), UNIT))


def pair_key(one: Column, two: Column) -> Column:
    """The key of an ordered pair of keys."""
    return id_of(F.concat_ws("\u0000", one, two))


#: The stages of progressive matching: name -> rule of equality over a list of sentences.
STAGES = {
    "exact": lambda s: s,
    "strip": stripped,
    "unordered": lambda s: F.array_sort(stripped(s)),
}


def relaxed(text: Column) -> Column:
    """A sentence in compatibility form, case folded and collapsed (an Arrow UDF; lists are exploded around it)."""
    return nfkc_casefold(text)


def usable(sentences: Column) -> Column:
    """A list that matching accepts: not null, not empty, no null or blank sentence."""
    return F.coalesce((F.size(sentences) > 0) & ~F.exists(sentences, lambda x: x.isNull() | (collapse(x) == "")), F.lit(False))
