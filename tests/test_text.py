"""Text functions against Python's own."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import text
from parley.functions.udfs import model, nfkc_casefold, sequence_ratio

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", " ", " ", " ", " ", " ", " ", "　"]
SAMPLES = ["", " ", "a", *(f"{w}a{w}{w}b{w}" for w in SPACES), "​x​", "İ", "ẞ x", "Σς", None]


def column(spark, values, *exprs):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *exprs).orderBy("i").drop("i").collect()]


def test_strip_and_collapse_are_pythons(spark):
    got = column(spark, SAMPLES, text.strip(F.col("v")), text.collapse(F.col("v")), text.is_blank(F.col("v")))
    assert got == [(None, None, True) if v is None else (v.strip(), " ".join(v.split()), not v.strip()) for v in SAMPLES]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from([*SPACES, "a", "B", "'"]), max_size=12), min_size=1, max_size=20))
def test_strip_property(spark, values):
    assert [r[0] for r in column(spark, values, text.strip(F.col("v")))] == [v.strip() for v in values]


def expand(s):
    pattern = re.compile(r"\b(?:" + "|".join(text.CONTRACTIONS) + r")\b")
    s = str(s).lower().replace("’", "'")
    return " ".join(pattern.sub(lambda m: text.CONTRACTIONS[m[0]], s).split())


def test_contractions_in_one_pass(spark):
    values = ["I’m  sure i'd've said don't", "it's what's; that's", "theirs i'm", "won't can't", "", "no contraction", "he'd", "i'm", None]
    assert [r[0] for r in column(spark, values, text.expand_contractions(F.col("v")))] == [expand("none" if v is None else v) for v in values]


def test_clean_output(spark):
    values = ["<answer> a <think>x\ny</think> 漢 b </ANSWER>", "<think>open", None, "  ", "a\n\tb"]
    assert [r[0] for r in column(spark, values, text.clean_output(F.col("v")))] == ["a b", "open", None, "", "a b"]


def test_prompts_and_names(spark):
    got = column(spark, [" x {y} ", None], text.text_prompt(F.col("v")), text.image_prompt(F.col("v")), text.image_prompt(F.col("v"), F.lit("enhanced")), text.image_name(F.lit(42)), text.shard_name(4, F.lit(2)), text.target_name(F.lit("a/b/c"), F.lit("S"), F.lit("original")))
    assert got[0] == (text.TEXT_PROMPT + "x {y}", text.IMAGE_PROMPT + "x {y}", "x {y}", "images/000000042.png", "num_shards-4/shard-00002", "a/b/c-S-original")
    assert got[1][0] == text.TEXT_PROMPT + "None"


def test_udfs(spark):
    values = ["ﬁne  Straße", "x", None]
    got = column(spark, values, nfkc_casefold(F.col("v")), sequence_ratio(F.lit("tide"), F.lit("diet")))
    assert got == [(" ".join(unicodedata.normalize("NFKC", v).casefold().split()) if v else None, 0.25) for v in values]


def test_model_failure_is_the_rows_result(spark):
    def build():
        return lambda x: 1 / 0 if x == "bad" else x.upper()

    got = column(spark, ["ok", "bad", None], model(build)(F.col("v")).alias("r"))
    assert got[0][0]["value"] == "OK" and got[1][0]["value"] is None and "ZeroDivisionError" in got[1][0]["error"] and got[2][0]["value"] is None


@pytest.mark.parametrize("value", ["a", "é ü", "漢"])
def test_sha(spark, value):
    from parley.functions.personas import id_of

    assert column(spark, [value], id_of(F.col("v")))[0][0] == hashlib.sha256(value.encode()).hexdigest()
