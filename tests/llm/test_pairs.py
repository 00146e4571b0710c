"""Problems 3, 5 and 7 against brute force on small tables."""

import json
import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import corpora, crosssplit, matching, neardup, shingles

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall((t or "").lower())


def triples(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_word_hashes_are_words(monkeypatch):
    texts = ["Hello, world_x 12 é ação", "hello world", None, "", "WORLD x", "a" * 50, "漢字 kana", "x\ny\tz"]
    monkeypatch.setattr(shingles, "PIECE", 16)
    flat, counts = shingles.words(texts)
    plain = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts] and len(flat) == len(plain)
    seen = {}
    for h, w in zip(flat.tolist(), plain):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_within_a_text():
    flat, counts = shingles.words(["a b c", "d", "e f g h", ""])
    h, row = shingles.grams(flat, counts, 3)
    assert row.tolist() == [0, 2, 2] and len(set(h.tolist())) == 3
    assert len(shingles.grams(*shingles.words([]), 3)[0]) == 0


VOCABULARY = [f"w{i}" for i in range(400)]


def edited(rng, w, rate):
    return [rng.choice(VOCABULARY) if rng.random() < rate else x for x in w]


def corpus(seed=1, n=60):
    """Texts with near copies at many rates, exact copies, copies in other formatting, short and empty ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([5, 8, 20, 40, 70, 150]))]
        out.append(base)
        for rate in (0, 0.01, 0.03, 0.06):
            if rng.random() < 0.5:
                out.append(edited(rng, base, rate))
    texts = [" ".join(w) for w in out]
    texts += [texts[0].upper() + "!", texts[3].replace(" ", " , "), "", None, "one two", "one two three", "one two three", "one two three four"]
    rng.shuffle(texts)
    return texts


def tables(spark, tmp_path, texts, splits):
    """The two corpora with the same texts: as a single utterance in convai2, as JSON in personachat."""
    turn = lambda t: None if t is None else [(0, t, "")]
    cv = [(i, f"c{i}", ["some persona here."] if i % 9 else None, None, turn(t), s) for i, (t, s) in enumerate(zip(texts, splits))]
    spark.createDataFrame(cv, "row_index long, conversation_id string, your_persona array<string>, partner_persona array<string>, turns array<struct<turn_id:int,text:string,response:string>>, source_split string").write.parquet(f"{tmp_path}/convai2_conversations.parquet")
    pc = [(i, None if t is None else json.dumps([{"text": t, "response": "", "candidates": ["no"]}]) if i % 7 else json.dumps([{"response": "", "text": t}], indent=1), s) for i, (t, s) in enumerate(zip(texts, splits))]
    pc.append((9999, '[{"text": "cut', "train"))
    spark.createDataFrame(pc, "row_index long, dialog string, split string").write.parquet(f"{tmp_path}/personachat_dialogs.parquet")
    return str(tmp_path)


def test_similar_pairs_are_all_found(spark, tmp_path):
    texts = corpus()
    d = tables(spark, tmp_path, texts, ["train"] * len(texts))
    sets = [triples(t) for t in texts]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]) - 1e-9:
                want |= {("convai2", i, j), ("personachat", i, j)}
    got = [tuple(r) for r in neardup.found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_estimate_is_near_jaccard():
    rng = np.random.default_rng(0)
    for size, share in ((200, 0.7), (60, 0.5)):
        common = rng.integers(0, 2**63, int(size * share)).astype(np.uint64)
        regs = []
        for _ in range(2):
            h = np.unique(np.concatenate([common, rng.integers(0, 2**63, size - len(common)).astype(np.uint64)]))
            regs.append(neardup.registers(h, np.zeros(len(h), np.int64), 1, neardup.BUCKETS))
        jaccard = len(common) / (2 * size - len(common))
        assert abs(neardup.estimate(*regs)[0] - jaccard) < 0.15


@pytest.mark.parametrize("rare, keys, chunk", [(crosssplit.RARE, crosssplit.KEYS, crosssplit.LIST), (1, 0, 2), (0, 10**9, 3)])
def test_cross_split_pairs_are_all_found(spark, tmp_path, monkeypatch, rare, keys, chunk):
    """What is rare, what is broadcast and how lists are cut changes no pair."""
    for name, value in (("RARE", rare), ("KEYS", keys), ("LIST", chunk)):
        monkeypatch.setattr(crosssplit, name, value)
    rng = random.Random(5)
    texts = corpus(7)
    splits = [rng.choice(["train", "Train", "valid", "validation", "test", None]) for _ in texts]
    d = tables(spark, tmp_path, texts, splits)
    held = lambda s: None if s is None else s.lower() != "train"
    want = set()
    for name, prefix in (("convai2", "some persona here. "), ("personachat", "")):
        ok = [t is not None and (name != "convai2" or i % 9) for i, t in enumerate(texts)]
        sets = [triples(prefix + (t or "")) if u else set() for t, u in zip(texts, ok)]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if held(splits[i]) and held(splits[j]) is False and a and len(a & b) >= 0.7 * len(a) - 1e-9:
                    want.add((name, min(i, j), max(i, j)))
    got = [tuple(r) for r in crosssplit.found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    report = crosssplit.report(spark, d).collect()
    assert sum(r["pairs"] for r in report) == len(want)


def test_cross_split_pairs_of_any_edit(spark, tmp_path):
    """Insertions, deletions and moved parts lose more runs of words than substitutions do at the same share of triples."""
    rng = random.Random(11)
    texts, splits = [], []
    for k in range(24):
        base = [f"t{k}x{i}" for i in range(102)]
        copy = list(base)
        if k % 3 == 0:
            for i in range(15):
                copy.insert(6 + 7 * i, f"new{k}x{i}")  # each loses two triples and four runs of five
        elif k % 3 == 1:
            copy = [w for i, w in enumerate(base) if i % 10 != 5]
        else:
            parts = [base[i : i + 8] for i in range(0, len(base), 8)]
            rng.shuffle(parts)
            copy = [w for part in parts for w in part]
        texts += [" ".join(base), " ".join(copy)]
        splits += ["test", "train"]
    d = tables(spark, tmp_path, texts, splits)
    sets = [triples(t) for t in texts]
    want = {(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.7 * len(sets[i]) - 1e-9}
    got = {(r["row_a"], r["row_b"]) for r in crosssplit.found(spark, d).where("corpus = 'personachat'").collect()}
    assert got == want and len(want) >= 20


def shuffled(spark):
    """The bytes that have been shuffled in this session."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_common_intervals_are_not_multiplied_out(spark):
    """Where all triples are common, what is shuffled grows as the rows, not as their square."""
    rng = random.Random(9)
    lines = [" ".join(f"l{i}w{k}" for k in range(8)) for i in range(60)]
    moved = []
    for n in (500, 2000):
        talks = [" ".join(rng.sample(lines, 10)) for _ in range(n)]
        rows = [(2 * i, i % 2, ["p q r"], t) for i, t in enumerate(talks)]
        rows += [(2 * n + 2, 1, ["p q r"], " ".join(reversed(talks[0].split(" l")))), (2 * n + 4, 1, ["p q r"], talks[2] + " and more")]
        before = shuffled(spark)
        pairs, _ = crosssplit.overlaps(spark.createDataFrame(rows, "rid long, held int, persona array<string>, talk string"), 0.7)
        got = {(r["a"], r["b"]) for r in pairs.collect()}
        moved.append(shuffled(spark) - before)
        sets = [triples("p q r " + r[3]) for r in rows]
        want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) if rows[i][1] for j in range(len(rows)) if not rows[j][1] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i]) - 1e-9}
        assert got == want and (2 * n + 4, 4) in got
    assert moved[1] < 6 * moved[0]


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [], [])
    assert neardup.found(spark, d).count() == 0 and crosssplit.found(spark, d).count() == 0


def conversation(rng, k):
    return [f"{rng.choice(VOCABULARY)} {rng.choice(VOCABULARY)} says {rng.choice(VOCABULARY)} i'm number {rng.randrange(99)} {rng.choice(VOCABULARY)}" for _ in range(k)]


def test_matching(spark):
    rng = random.Random(3)
    persona = lambda: [f"i like {rng.choice(VOCABULARY)} and don't like {rng.choice(VOCABULARY)}." for _ in range(4)]
    turns = lambda u: json.dumps([{"text": a, "response": b} for a, b in zip(u[::2], u[1::2])])
    rows, want = [], set()

    def put(i, corpus_, one, two, talk):
        rows.append((i * 2 + corpus_, None if one is None else json.dumps(one), None if two is None else json.dumps(two), talk))

    for i in range(60):
        one, two, u = persona(), persona(), conversation(rng, 12)
        put(i, 0, one, two, turns(u))
        kind = i % 6
        if kind == 0:  # the same
            put(i, 1, one, two, turns(u))
        elif kind == 1:  # the other side, sentences in another order, contractions expanded
            put(i, 1, two[::-1], one, turns([x.replace("i'm", "I am").upper() for x in u[1:-1]]))
        elif kind == 2:  # edits here and there
            put(i, 1, [one[0] + " x", *one[1:]], two, turns([x if rng.random() < 0.7 else x.replace("says", "sais") for x in u]))
        elif kind == 3:  # no talk, the same personas
            put(i, 1, one, two, None if i % 4 else "[broken")
        elif kind == 4:  # the same personas, another talk
            put(i, 1, one, two, turns(conversation(rng, 12)))
        else:  # an equal opening between other personas
            put(i, 1, persona(), persona(), turns(u[:4] + conversation(rng, 8)))
        if kind < 4:
            want.add((i, i))
    put(900, 0, None, None, None)
    put(900, 1, [], None, "[]")
    df = spark.createDataFrame(rows, "rid long, yours string, partners string, talk string").selectExpr("*", "1 as extra", "'clash' as key")
    got = matching.matches(df).collect()
    assert {(r["convai2_row"], r["personachat_row"]) for r in got} == want
    assert all(0 < r["confidence"] < 1 for r in got) and len({r["rule"] for r in got}) >= 3
    assert matching.matches(df.limit(0)).count() == 0
    every = matching.matches(df, exhaustive=True).collect()
    assert {(r["convai2_row"], r["personachat_row"]) for r in every} == want
    labels = spark.createDataFrame([(i * 2, i * 2 + 1, i % 2 == 0) for i in range(60)], "a long, b long, match boolean")
    assert {r["confidence"] for r in matching.matches(df, labels).collect()} != {r["confidence"] for r in got}


def test_matching_with_one_persona(spark):
    """One persona is missing or quite another, a sentence of the other is dropped, and no two utterances in a row are left after the opening."""
    rng = random.Random(8)
    rows = []
    for i in range(6):
        one, two = ([f"i like {rng.choice(VOCABULARY)} and {rng.choice(VOCABULARY)} on day {n}." for n in range(i * 9, i * 9 + 4)] for _ in range(2))
        u = conversation(rng, 12)
        noisy = [x if k % 2 else x + " oh" for k, x in enumerate(u)]
        other = (None, [], ["my cat sleeps.", "my dog runs.", "my car is red."])[i % 3]
        for c, (p, q, talk) in enumerate(((one, two, u), (other, one[1:], noisy) if i < 3 else (one[1:], other, noisy))):
            rows.append((i * 2 + c, json.dumps(p), None if q is None else json.dumps(q), json.dumps([{"text": a, "response": b} for a, b in zip(talk[::2], talk[1::2])])))
    got = matching.matches(spark.createDataFrame(rows, "rid long, yours string, partners string, talk string")).collect()
    assert {(r["convai2_row"], r["personachat_row"]) for r in got} == {(i, i) for i in range(6)} and all(r["rule"] in matching.RULES[2:5] for r in got)


@pytest.mark.parametrize("hot, sample", [(matching.HOT, matching.HOT_SAMPLE), (5, 1.0)])
def test_common_values_are_matched_in_combination(spark, monkeypatch, hot, sample):
    """No utterance is rare, so pairs come from two common ones, with a sentence where those are common as well."""
    for name, value in (("RARE", 3), ("HOT", hot), ("HOT_SAMPLE", sample)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(4)
    lines = [f"common line number {i} of the talk" for i in range(14)]
    rows, want = [], set()
    for i in range(40):
        one, two = ([f"i like {rng.choice(VOCABULARY)} and {rng.choice(VOCABULARY)}." for _ in range(4)] for _ in range(2))
        u = rng.sample(lines, 8)
        talk = json.dumps([{"text": a, "response": b} for a, b in zip(u[::2], u[1::2])])
        rows += [(i * 2, json.dumps(one), json.dumps(two), talk), (i * 2 + 1, json.dumps(one[1:] + ["new"]), json.dumps(two), talk)]
        want.add((i, i))
    df = spark.createDataFrame(rows, "rid long, yours string, partners string, talk string")
    got = matching.matches(df).collect()
    assert {(r["convai2_row"], r["personachat_row"]) for r in got} == want and {r["rule"] for r in got} == {matching.RULES[3]}


@pytest.mark.parametrize("rare", [0, matching.RARE])
def test_common_values_lose_no_pair(spark, monkeypatch, rare):
    """One utterance, or none, is equal word for word, and all that is equal may be common; a long talk has many common utterances."""
    monkeypatch.setattr(matching, "RARE", rare)
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(16):
        one, two = ([f"i like {rng.choice(VOCABULARY)} and {rng.choice(VOCABULARY)} on day {n}." for n in range(i * 9, i * 9 + 4)] for _ in range(2))
        u = conversation(rng, 12)
        noisy = [x + " oh" for x in u]
        if i % 4 == 0:  # one utterance, three sentences
            p, q, v = [*one[:3], "new."], ["my cat sleeps.", "my dog runs."], [u[0], *noisy[1:]]
        elif i % 4 == 1:  # both personas
            p, q, v = one, two, noisy
        elif i % 4 == 2:  # one persona and a sentence
            p, q, v = one, [two[0], "my cat sleeps.", "my dog runs.", "my car is red."], noisy
        else:  # two utterances of very many, others between them
            u = conversation(rng, 200)
            p, q, v = [*one[:3], "new."], two[:3], [x if k in (40, 160) else x + " oh" for k, x in enumerate(u)]
            p, u, v = p, [*u, *(f"yes {k}" for k in range(200))], [*v, *(f"no {k}" for k in range(200))]
        for c, (x, y, talk) in enumerate(((one, two, u), (p, q, v))):
            rows.append((i * 2 + c, json.dumps(x), json.dumps(y), json.dumps([{"text": a, "response": b} for a, b in zip(talk[::2], talk[1::2])])))
        want.add((i, i))
    got = matching.matches(spark.createDataFrame(rows, "rid long, yours string, partners string, talk string")).collect()
    assert {(r["convai2_row"], r["personachat_row"]) for r in got} == want


def shuffled(spark):
    """Bytes of shuffle that the session's stages have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()))
    return sum(s.shuffleWriteBytes() for s in stages)


def test_talks_are_not_shuffled(spark):
    """Few rows are in a pair; the talks of the others are not written, and those of unlike pairs but as sketches."""
    rng = random.Random(21)
    noise = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789      ", k=k))
    rows, want = [], set()
    for i in range(300):
        one, two = (json.dumps([f"i like {noise(20)}." for _ in range(4)]) for _ in range(2))
        for c in (0, 1):
            rows.append((i * 2 + c, one if i < 30 else json.dumps([noise(20)]), two if i < 30 else json.dumps([noise(20)]), json.dumps([{"text": noise(3000), "response": noise(3000)}])))
        if i < 6:
            rows[-1] = (*rows[-1][:3], rows[-2][3][:-3] + ' oh"}]')
            want.add((i, i))
    df = spark.createDataFrame(rows, "rid long, yours string, partners string, talk string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, small = shuffled(spark), spark.conf.get(name)
    spark.conf.set(name, -1)  # nothing is small, as in large tables
    try:
        got = matching.matches(df).collect()
    finally:
        spark.conf.set(name, small)
    assert {(r["convai2_row"], r["personachat_row"]) for r in got} == want
    assert shuffled(spark) - before < 0.5 * sum(len(r[3]) for r in rows)


@pytest.mark.parametrize("words", [0, matching.WORDS])
def test_rows_in_pairs_are_found(spark, monkeypatch, words):
    monkeypatch.setattr(matching, "WORDS", words)
    rids = [0, 1, 62, 63, 64, 127, 128, 2**40 + 63, -1, -64, -65]
    rows = spark.createDataFrame([(r, "clash") for k in rids for r in (k, k + 3)], "rid long, word string").distinct()
    pairs = spark.createDataFrame([(a, b) for a in rids for b in rids[:2]], "a long, b long")
    assert sorted(r["rid"] for r in matching._paired(rows, pairs).collect()) == sorted(rids)


def test_sketches_lose_no_talk(spark):
    """Talks short and long, with any share of their triples in common."""
    rng = random.Random(22)
    texts = []
    for n in (1, 2, 3, 4, 5, 9, 30, 200, 1500, 6000):
        w = [f"{rng.choice(VOCABULARY)}{rng.randrange(400)}" for _ in range(n)]
        texts += [w, w[: n // 2], w[n // 2 :] + w[: n // 3], [*w[: int(n * 0.46)], *(f"new{i}" for i in range(n))], [x if rng.random() < 0.8 else "other" for x in w]]
    talk = [json.dumps([{"text": " ".join(w), "response": None}]) for w in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(talk)), pa.int64()), pa.array(talk)], ["rid", "talk"])
    (out,) = matching._talks(iter([batch]))
    sets = [set(g) for g in out.column("grams").to_pylist()]
    assert out.column("n").to_pylist() == [len(g) for g in sets] and {len(k) for k in out.column("sketch").to_pylist()} == {matching.SKETCH}
    known = list(zip(*(out.column(c).to_pylist() for c in ("rid", "n", "sketch"))))
    a, b = (spark.createDataFrame(known, f"{x} long, n{x} long, k{x} array<long>") for x in "ab")
    kept = {(r["a"], r["b"]) for r in a.crossJoin(b).where(matching._may_share()).select("a", "b").collect()}
    alike = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len(x & y) / min(len(x), len(y)) >= matching.TALK}
    assert alike <= kept and len(kept) < len(sets) ** 2 * 0.8


def test_long_runs_are_given_in_parts():
    """What is found of a run does not depend on how much of it is held."""
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 12, 400))
    rid = np.arange(400)
    batches = lambda names, cols, n: iter([pa.RecordBatch.from_arrays([pa.array(c[i : i + n]) for c in cols], names) for i in range(0, 400, n)])
    want = {(int(k), int(r)) for k, r in zip(key, rid)}
    for most in (10**6, 20):
        run = corpora.by_runs(["key", "rid"], partial(matching._met, 4), matching._met_open, most)
        out = pa.Table.from_batches(run(batches(["key", "rid"], (key, rid), 7))).to_pydict()
        assert set(zip(out["key"], out["a"])) == want and set(out["b"]) == {-1}
    # suffixes: training and held-out records of each key, held-out ones first
    kind = rng.integers(0, 2, 400)
    who = rid * 4 + kind
    order = np.lexsort((who, -kind, key))
    pairs = {(int(a), int(b)) for k in range(12) for a in rid[(key == k) & (kind == 1)] for b in rid[(key == k) & (kind == 0)]}
    for most in (10**6, 15):
        run = corpora.by_runs(["key", "who"], partial(crosssplit._listed, 3), partial(crosssplit._listed_open, 3), most)
        got = [(r["a"], b) for r in pa.Table.from_batches(run(batches(["key", "who"], (key[order], who[order]), 7))).to_pylist() for b in r["pairs"]]
        assert len(got) == len(pairs) and set(got) == pairs
    run = corpora.by_runs(["key", "who"], partial(crosssplit._scan, 16), crosssplit._scan_open, 15)
    out = pa.Table.from_batches(run(batches(["key", "who"], (key[order], who[order]), 7))).to_pylist()
    assert sorted((r["a"], r["key"]) for r in out if r["b"] == crosssplit.COMMON) == sorted((int(r), int(k)) for r, k in zip(rid[kind == 1], key[kind == 1]))


def test_class_hashes_have_bounds(spark):
    """Lists with their elements elsewhere are no copies."""
    rows = [(1, [], [7], [5]), (3, [7], [], [5]), (5, [7], [5], []), (7, [], [7], [5])]
    assert [tuple(r) for r in matching.classes(spark.createDataFrame(rows, matching.ATTRIBUTES)).collect()] == [(7, 1)]


def test_bare_text_hides_contractions():
    assert matching.bare("I’m sure it's what I don't want, won't") == matching.bare("i am sure it is what i do not want, will not") == "i sure it what i do want".split()
    assert matching.bare("I can't, she'll") == matching.bare("i cannot she will")
    assert matching.sentences("[1") == [] and matching.sentences(None) == [] and matching.sentences('["a", 1]') == ["a"]


def test_copies_are_multiplied_out(spark):
    members = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (21, 2), (22, 2)], "rid long, rep long")
    pairs = spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a long, b long")
    one, two = {1, 10, 11}, {2, 20, 21, 22}
    full = {(a, b) for a in one | {3} for b in two} | {(3, 4)}
    got = [(r["a"], r["b"]) for r in corpora.expand(pairs, members).collect()]
    assert len(got) == len(full) and set(got) == full
    inner = [tuple(r) for r in corpora.among(members).collect()]
    assert set(inner) == {(a, b) for s in (one, two) for a in s for b in s if a < b} and len(inner) == 9


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + k) for k in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(5, 5), (9, 8)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    while any(root[a] != root[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = [tuple(r) for r in corpora.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert corpora.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_copies_are_all_paired(spark, tmp_path):
    """Classes of copies with more than 10,000 row pairs, beside a near copy and a row on its own."""
    base = " ".join(VOCABULARY[:40])
    texts = [base] * 240 + [base + " more words here", "quite another text about nothing at all", None]
    splits = ["train"] * 120 + ["test"] * 119 + ["valid"] + ["train"] + ["test"] * 2
    d = tables(spark, tmp_path, texts, splits)
    ok = {"convai2": [i for i in range(241) if i % 9], "personachat": list(range(241))}
    held = {c: [i for i in rows if splits[i] != "train"] for c, rows in ok.items()}
    train = {c: [i for i in rows if splits[i] == "train"] for c, rows in ok.items()}
    want = {(c, min(i, j), max(i, j)) for c in ok for i in held[c] for j in train[c]}
    got = [tuple(r) for r in crosssplit.found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = {(r["corpus"], r["split"]): (r["rows"], r["rows_in_train"], r["pairs"]) for r in crosssplit.report(spark, d).collect()}
    n = lambda c, s: sum(splits[i] == s for i in held[c])
    assert report == {(c, name): (sum(x == s and t is not None for x, t in zip(splits, texts)), n(c, s), n(c, s) * len(train[c])) for c in ok for name, s in (("test", "test"), ("validation", "valid"))}
    got = [tuple(r) for r in neardup.found(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, i, j) for c in ok for i in range(241) for j in range(i + 1, 241)}
    talk = json.dumps([{"text": "hello there my dear friend", "response": "well hello to you too"}])
    rows = [(i, json.dumps(["i like tea."]), json.dumps(["i like jam."]), talk) for i in range(2 * 110)]
    assert matching.matches(spark.createDataFrame(rows, "rid long, yours string, partners string, talk string")).count() == 110**2


def test_classes(spark, tmp_path):
    w = [f"w{i}" for i in range(20)]
    second = w[:17] + ["x", "y", "z"]
    texts = [" ".join(w), ", ".join(w).upper(), " ".join(second), "q r s t u v", None, " ".join(["k", "l", "m", *second[3:]]), "z"]
    d = tables(spark, tmp_path, texts, ["train"] * 7)
    got = {(r["corpus"], r["row_index"]): (r["class_row"], r["group_row"], r["links"]) for r in neardup.classes(spark, d).collect()}
    assert got[("convai2", 0)] == got[("convai2", 1)] == (0, 0, 1) and got[("convai2", 2)] == (2, 0, 2) and got[("convai2", 3)] == (3, 3, 0)
    assert got[("convai2", 5)] == (5, 0, 1) and got[("convai2", 6)] == (6, 6, 0) and ("convai2", 4) not in got  # the last is only linked through the second
