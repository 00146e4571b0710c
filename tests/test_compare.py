import difflib

from pyspark.sql import functions as F

from parley.functions import personas
from parley.functions.hashing import both, hash64, list_hash
from parley.functions.numbers import rounded
from parley.functions.udfs import ratio_from
from parley.operators import compare, profile


def ks(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_overlap(spark):
    r = compare.overlap(ks(spark, ["a", "a", "b", None]), ks(spark, ["b", "c"])).first()
    assert tuple(r) == (2, 2, 1, 1, 1, 3, 0.3333)
    assert tuple(compare.overlap(ks(spark, []), ks(spark, [])).first()) == (0, 0, 0, 0, 0, 0, 0.0)


def test_staged(spark):
    p = lambda v: spark.createDataFrame([(x,) for x in v], "persona array<string>")
    got = {r["stage"]: (r["size_both"], r["coverage_a"]) for r in compare.staged(p([["a ", "b"], ["x"]]), p([["b", "a"], ["x"]]), personas.STAGES).collect()}
    assert got == {"exact": (1, 50.0), "strip": (1, 50.0), "unordered": (2, 100.0)}
    assert compare.staged(p([]), p([["x"]]), {"exact": lambda s: s}).first()["coverage_a"] is None


def rows(spark, values):
    return spark.createDataFrame(values, "id long, dialog string, text string, one string, two string")


def test_agreement_and_likeness(spark):
    b = rows(spark, [(1, "d1", "abcdef", "p", "q"), (2, "d2", "hello there", "r", "s"), (3, None, None, "x", "y")])
    a = rows(spark, [(1, "d1", "abcdef", "p", "q"), (2, "d1", "abcdef", "q", "p"), (3, "d1", "abcdef", "z", "z"), (4, "d9", "hello thera", "s", "r"), (5, "d8", "zzz", "u", "v"), (6, None, None, "x", "y")])
    assert tuple(compare.agreement(a, b).first()) == (3, 1, 1, 1)
    got = {r["bucket"]: r["n"] for r in compare.likeness_buckets(a, b).collect()}
    assert difflib.SequenceMatcher(None, "hello thera", "hello there").ratio() > 0.9
    assert got == {"exact": 3, ">=0.99": 0, ">=0.95": 0, ">=0.9": 1, ">=0.8": 0, "<0.8": 0, "no counterpart": 2}


def test_presence_and_pairs(spark):
    a = spark.createDataFrame([("t", "k1"), ("t", "k1"), ("t", "k2"), ("v", None)], "split string, key string")
    b = spark.createDataFrame([("x", "k1"), (None, "k3")], "split string, key string")
    assert sorted(map(str, (tuple(r) for r in compare.presence({"a": a, "b": b}).collect()))) == sorted(map(str, [("a", "t", 2, 1, 50.0), ("b", "x", 1, 1, 100.0), ("b", None, 1, 0, 0.0)]))
    p = lambda v: spark.createDataFrame(v, "pair string, dialog string")
    assert tuple(compare.pairs_with_shared_dialogs(p([("a", "1"), ("b", "2"), ("c", None)]), p([("a", "1"), ("b", "3"), ("c", None)])).first()) == (3, 1, 2)


def test_agreement_in_both_orders(spark):
    a = rows(spark, [(1, "d", "t", "p", "q"), (2, "d", "t", "q", "p"), (3, "d", "t", "p", "p"), (4, "e", "t", "q", "p"), (5, "f", "t", "p", "q"), (6, "none", "t", "p", "q")])
    b = rows(spark, [(1, "d", "t", "p", "q"), (2, "d", "t", "p", "p"), (3, "e", "t", "p", "q"), (4, "f", "t", "p", "q"), (5, "f", "t", "q", "p")])
    assert tuple(compare.agreement(a, b).first()) == (5, 3, 2, 0)
    assert tuple(compare.agreement(a.limit(0), b).first()) == (0, 0, 0, 0)


def test_rounding_is_pythons(spark):
    values = [2.675, 0.125, 36.685, 1.005, 0.5, 1.5, 2.5, 0.0, 0.00015, 66.66666666666667, 12.25, 0.3333333333333333, 87.65, 99.95, 1 / 7, 5e-5, 123456.785]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        assert [r[0] for r in d.select(rounded(F.col("v"), digits)).collect()] == [round(v, digits) for v in values]
    assert d.select(rounded(F.lit(None), 2)).first()[0] is None


def test_hash_halves_are_independent_and_lists_have_bounds(spark):
    same = spark.range(1000).select(*both(hash64, F.col("id")), F.xxhash64(F.col("id"), F.lit(1)).alias("chained"))
    assert same.select("h1").distinct().count() == same.select("h2").distinct().count() == 1000
    # the bits of one half say nothing of the other's
    agree = same.agg(F.avg((F.shiftright("h1", 63) == F.shiftright("h2", 63)).cast("double"))).first()[0]
    assert 0.4 < agree < 0.6
    lists = [["a", None], ["a"], [None, "a"], [], None, ["", "a"], ["a", ""]]
    d = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    for k in (1, 2):
        assert d.select(list_hash(k, F.col("l"))).distinct().count() == len(lists)


def test_likeness_bounds_change_no_bucket(spark):
    texts = ["hello there my friend", "hello there my fried", "something else entirely", "hi", "hello there", None]
    d = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for r in d.select("x", "y", ratio_from(0.8)("x", "y").alias("r")).collect():
        if r["x"] is None or r["y"] is None:
            assert r["r"] is None
        else:
            exact = difflib.SequenceMatcher(None, r["x"], r["y"]).ratio()
            assert r["r"] == exact if exact >= 0.8 else r["r"] < 0.8


def test_first_and_smallest(spark):
    d = spark.createDataFrame([("k", 3), ("k", 1), (None, 0), ("l", 2)], "key string, i int")
    assert sorted(map(tuple, compare.first_occurrence(d, "key", [F.col("i")], F.col("i")).collect())) == [("k", 1), ("l", 2)]
    assert [r[0] for r in compare.smallest(d, "i", 2).collect()] == [0, 1]


def test_profiles(spark):
    d = spark.createDataFrame([(1, "a", "x", ["s"]), (2, "a", None, []), (3, None, " ", None), (4, "a", "x", ["s"])], "row_index long, k string, v string, l array<string>")
    r = profile.functional_dependency(d, [("k", "v")]).first()
    assert (r["n_keys"], r["n_conflicting"], r["most_values"], r["holds"]) == (2, 1, 2, False)
    assert sorted((x["k"], str(x["v"])) for x in profile.dependency_conflicts(d, [("k", "v")]).collect()) == [("a", "None"), ("a", "x")]
    assert {x["column"]: x["n_missing"] for x in profile.missingness(d, ["k", "v", "l"]).collect()} == {"k": 1, "v": 2, "l": 2}
    assert {x["row_index"]: x["columns"] for x in profile.invalid_rows(d, "row_index", ["k", "v", "l"]).collect()} == {2: ["v", "l"], 3: ["k", "v", "l"]}
    u = profile.pair_uniqueness(d, [("k", "v"), ("v", "l")]).collect()
    assert {(x["one"], x["n_distinct"], x["is_unique"]) for x in u} == {("k", 3, False), ("v", 3, False)}
    assert profile.functional_dependency(d.limit(0), [("k", "v")]).first()["holds"] is True
    assert {x["type"] for x in profile.schema_listing(spark, {"d": d}).collect()} == {"bigint", "string", "array<string>"}
    sizes = {(x["dataset"], x["split"]): x["n"] for x in profile.split_sizes({"d": d.select(F.col("k").alias("split"))}).collect()}
    assert sizes == {("d", "a"): 3, ("d", "(none)"): 1, ("d", None): 4, (None, None): 4}
