import hashlib

from pyspark.sql import functions as F

from parley.functions import dialogs, personas
from parley.operators import mapping

LISTS = [["b ", " a"], ["a", "b"], [], None, ["a", None], ["a", " "], ["b", "a", "a"]]


def lists(spark, values=LISTS):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p array<string>")


def test_canonical_is_strict_and_ignores_order(spark):
    got = [r[0] for r in lists(spark).orderBy("i").select(personas.canonical(F.col("p"))).collect()]
    assert got == [["a", "b"], ["a", "b"], None, None, None, None, ["a", "a", "b"]]


def test_comparable_is_lenient(spark):
    got = [r[0] for r in lists(spark).orderBy("i").select(personas.comparable_key(F.col("p"))).collect()]
    key = lambda p: hashlib.sha256("\x1f".join(sorted(s for s in (str(x).strip() for x in p or []) if s)).encode()).hexdigest()
    assert got == [key(p) for p in LISTS]


def test_json_lists(spark):
    values = ['["a", "b"]', '["a", 1]', '["a"', "plain", "[]", None, '{"a": 1}', '["x", null]', '[" ", "c "]']
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    strict, lenient, ordered = zip(*(tuple(r) for r in d.select(personas.strict_list(F.col("v")), personas.lenient_list(F.col("v")), personas.ordered_text(F.col("v"))).collect()))
    assert strict == (["a", "b"], None, None, None, [], None, None, None, [" ", "c "])
    assert lenient == (["a", "b"], ["a", "1"], ['["a"'], ["plain"], [], [], ['{"a": 1}'], ["x", "None"], [" ", "c "])
    assert ordered == ("a b", None, None, None, None, None, None, None, "c")


def test_enrich_equals_join_and_is_sound(spark):
    d = lists(spark).withColumn("other", F.col("p")).withColumn("persona-id", F.lit("clash"))
    ids = {"one_id": "p"}
    m = mapping.mapping(d, personas.canonical_text, ["p"])
    a = mapping.enrich(d, personas.canonical_text, ids)
    b = mapping.enrich_by_join(d.drop("persona-id"), personas.canonical_text, ids, m)
    assert sorted(map(str, a.select("i", "one_id").collect())) == sorted(map(str, b.select("i", "one_id").collect()))
    assert m.count() == 2
    assert all(r["violations"] == 0 for r in mapping.integrity(d, a, ids, m, personas.canonical_text).collect())
    assert mapping.unchanged(lists(spark), a, "i").count() == 0
    wrong = m.withColumn("persona_revised", F.concat("persona_revised", F.lit("!")))
    bad = {r["check"]: r["violations"] for r in mapping.integrity(d, a, ids, wrong, personas.canonical_text).collect()}
    assert bad["mapping id of another text"] == 2


def test_empty_table(spark):
    d = lists(spark).limit(0)
    assert mapping.mapping(d, personas.canonical_text, ["p"]).count() == 0
    assert all(r["violations"] == 0 for r in mapping.integrity(d, mapping.enrich(d, personas.canonical_text, {"x": "p"}), {"x": "p"}, mapping.mapping(d, personas.canonical_text, ["p"]), personas.canonical_text).collect())


def test_attach_checks(spark):
    m = spark.createDataFrame([("a",), ("b",)], "`persona-id` string")
    v = spark.createDataFrame([("a", 1), ("b", 2)], "`persona-id` string, x int")
    assert sorted(tuple(r) for r in mapping.attach(m, v, "x").collect()) == [("a", 1), ("b", 2)]
    import pytest

    for bad in ([("a", 1)], [("a", 1), ("b", 2), ("b", 3)], [(None, 1), ("a", 1), ("b", 2)]):
        with pytest.raises(ValueError):
            mapping.attach(m, spark.createDataFrame(bad, "`persona-id` string, x int"), "x")


def test_dialog_texts(spark):
    values = ['[{"text": " Hi ", "response": "I\'m  ok", "candidates": ["x"]}]', '[{"text": null}]', "[]", "[1", None, '{"text": "a"}']
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    t = dialogs.turns_of_json(F.col("v"))
    got = [tuple(r) for r in d.select(dialogs.raw_text(t), dialogs.expanded_text(t)).collect()]
    assert got == [("hi\x1fi'm ok", "hi \x1f i am ok"), ("none\x1f", "none \x1f "), (None, None), (None, None), (None, None), (None, None)]
