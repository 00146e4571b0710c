"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's str.strip and str.split treat as white space.
WS = r"[\u0009-\u000D\u001C- \u0085   -     　]"

#: Contractions and their expansions; of two that fit at one place the earlier counts.
CONTRACTIONS = {
    "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would",
    "you're": "you are", "you've": "you have", "you'll": "you will", "you'd": "you would",
    "he's": "he is", "she's": "she is", "it's": "it is",
    "we're": "we are", "we've": "we have", "we'll": "we will", "we'd": "we would",
    "they're": "they are", "they've": "they have", "they'll": "they will", "they'd": "they would",
    "that's": "that is", "there's": "there is", "here's": "here is",
    "what's": "what is", "who's": "who is", "how's": "how is",
    "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "can't": "cannot", "won't": "will not", "wouldn't": "would not",
    "shouldn't": "should not", "couldn't": "could not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "hasn't": "has not", "haven't": "have not", "hadn't": "had not",
    "would've": "would have", "could've": "could have", "should've": "should have",
    "let's": "let us",
}
#: What the text and image stages put before a description.
TEXT_PROMPT = "Generate a photo of a person with the following self-description:\n"
IMAGE_PROMPT = "Generate an image of this person's description: "


def strip(c: Column) -> Column:
    """Without outer Unicode white space; null stays null."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def collapse(c: Column) -> Column:
    """Inner runs of white space as one space, outer ones removed."""
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), r"^ | \z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def fold(c: Column) -> Column:
    """Lower case with collapsed white space; null counts as the word none."""
    return collapse(F.lower(F.coalesce(c, F.lit("none"))))


def expand_contractions(c: Column) -> Column:
    """Lower case, straight apostrophes, contractions expanded in one pass, white space collapsed; null counts as none.

    The text is cut at the contractions and put together again, so an expansion is never expanded further.
    """
    text = F.replace(F.lower(F.coalesce(c, F.lit("none"))), F.lit("\u2019"), F.lit("'"))
    any_of = r"(?U)\b(?:" + "|".join(CONTRACTIONS) + r")\b"
    table = F.create_map(*(F.lit(x) for kv in CONTRACTIONS.items() for x in kv))
    parts = F.split(text, any_of, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(any_of), 0), lambda m: F.element_at(table, m))
    joined = F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return collapse(F.when(F.contains(text, F.lit("'")), joined).otherwise(text))


#: What is taken out of a model's output, in this order.
ANSWER_TAG = "</?answer>"
THINKING = r"<think>[\s\S]*?</think>"
THINK_TAG = "</?think>"
IDEOGRAPHS = r"[\u3400-\u4dbf\u4e00-\u9fff]"


def clean_output(c: Column) -> Column:
    """A model's output without answer tags, thinking and CJK ideographs, white space collapsed."""
    for pattern in (ANSWER_TAG, THINKING, THINK_TAG):
        c = F.regexp_replace(c, f"(?iu){pattern}", "")
    return collapse(F.regexp_replace(c, IDEOGRAPHS, ""))


def clean_text(s: str) -> str:
    """clean_output() of a plain text, for workers that write their results themselves."""
    for pattern in (ANSWER_TAG, THINKING, THINK_TAG):
        s = re.sub(pattern, "", s, flags=re.I)
    return " ".join(re.sub(IDEOGRAPHS, "", s).split())


def text_prompt(c: Column) -> Column:
    """The prompt of the text stage; null counts as the word None."""
    return F.concat(F.lit(TEXT_PROMPT), strip(F.coalesce(c, F.lit("None"))))


def image_prompt(c: Column, variant: Column | None = None) -> Column:
    """The prompt of the image stage: always prefixed, or only for the variant ``original`` where one is given."""
    bare = strip(F.coalesce(c, F.lit("None")))
    prefixed = F.concat(F.lit(IMAGE_PROMPT), bare)
    return prefixed if variant is None else F.when(variant == "original", prefixed).otherwise(bare)


def image_name(row_index: Column) -> Column:
    return F.format_string("images/%09d.png", row_index)


def shard_name(shards: int, shard: Column) -> Column:
    return F.format_string(f"num_shards-{shards}/shard-%05d", shard)


def target_name(repo: Column, suffix: Column, variant: Column) -> Column:
    """namespace/name-suffix-variant of a repository name, split at its last slash."""
    part = lambda k: F.regexp_extract(repo, r"^(.*)/([^/]*)$", k)
    return F.concat(part(1), F.lit("/"), part(2), F.lit("-"), suffix, F.lit("-"), variant)


def request_position(c: Column) -> Column:
    """The number before the first underscore of a request id; null if there is none."""
    return F.substring_index(c, "_", 1).try_cast("long")


def bullets(sentences: Column) -> Column:
    """One sentence a line, each after a dash."""
    return F.concat(F.lit("- "), F.array_join(sentences, "\n- "))
