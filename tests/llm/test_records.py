"""Problems 1, 2, 4, 6, 8, 9 and 10 on small tables."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from parley.llm import collapse, conversations, defects, endings, mixing, packing, repetition, tokens, truncation

NOON = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)


def messages(spark, rows):
    """rows: (conversation, turn, role, text, minutes)."""
    data = [(i, c, t, r, x, None if m is None else NOON + timedelta(minutes=m), NOON, None) for i, (c, t, r, x, m) in enumerate(rows)]
    return spark.createDataFrame(data, "message_id long, conversation_id string, turn_id int, role string, text string, sent_at timestamp, ingested_at timestamp, worker_id string")


def test_assembly(spark):
    ua = lambda c, n, start=0, t0=0: [(c, start + i if start is not None else None, "user" if i % 2 == 0 else "GPT ", f"m{i}", t0 + i) for i in range(n)]
    timed = [("timed", None, "user" if i % 2 == 0 else "bot", f"m{i}", 31 * i) for i in range(8)]
    rows = [
        *ua("ok", 4),
        ("ok", 2, "human", " m2 ", 99),  # redelivered, other spelling and white space
        *[("one", t, r, x, 0) for t, r, x in ((3, "user", "c"), (1, "SYS", "s"), (4, "model", "d"), (2, "assistant", "b"))],  # out of turn: system, assistant, user
        *[("sys", t, r, x, 0) for t, r, x in ((3, "assistant", "c"), (1, "SYS", "s"), (2, "usr", "b"))],
        *reversed(timed),
        *[(c if c != "ok" else "gap", t if t != 2 else 9, r, x, m) for c, t, r, x, m in ua("ok", 4)],
        *ua("fork", 4), ("fork", 1, "assistant", "other", 5),
        *ua("odd", 3), *ua("two", 4, start=2), *ua("none", 2), ("none", 2, "tool", "x", 9), ("none", 3, "assistant", "y", 10),
        *ua("blank", 2), ("blank", 2, "user", " ", 9), ("blank", 3, "assistant", "y", 10),
        *ua("mixed", 2), ("mixed", None, "user", "x", 9), ("mixed", None, "assistant", "y", 10),
        ("tie", None, "user", "x", 1), ("tie", None, "assistant", "y", 1), ("when", None, "user", "x", None), ("when", None, "assistant", "y", 2),
        ("lone", 0, "user", "x", 1), (None, 0, "user", "x", 1), (None, 1, "assistant", "y", 1), ("system", 0, "system", "x", 1),
    ]
    got = defaultdict(list)
    for r in conversations.assemble(messages(spark, rows)).collect():
        got[r["conversation_id"]].append((r["seq"], r["role"], rows[r["message_id"]][3]))
    assert set(got) == {"ok", "sys", "timed"}
    assert sorted(got["ok"]) == [(0, "user", "m0"), (1, "assistant", "m1"), (2, "user", "m2"), (3, "assistant", "m3")]
    assert sorted(got["sys"]) == [(0, "system", "s"), (1, "user", "b"), (2, "assistant", "c")]
    assert [x[2] for x in sorted(got["timed"])] == [f"m{i}" for i in range(8)]
    assert conversations.assemble(messages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("timed", [False, True])
def test_gaps_at_the_seams_of_fragments(spark, timed):
    """One message is missing at every place in turn, doubled or spoken by the other side; only the whole conversation is rebuilt."""
    n = 4 * conversations.STEP + 2
    rows = []
    for lost in [None, *range(n)]:
        for kind in ("lost", "double", "role") if lost is not None else ("whole",):
            name = f"{kind} {lost}"
            for i in range(n):
                if kind == "lost" and i == lost:
                    continue
                role = ("user", "assistant")[(i + (kind == "role" and i == lost)) % 2]
                rows.append((name, None if timed else i, role, f"m{i}", i))
                if kind == "double" and i == lost:
                    rows.append((name, None if timed else i, role, "other", i))
    got = Counter(r["conversation_id"] for r in conversations.assemble(messages(spark, rows)).collect())
    assert set(got) == {"whole None"} and got["whole None"] == n


def test_lengths_around_the_step(spark):
    lengths = [n for k in (1, 2, 3) for n in range(2 * (k * conversations.STEP // 2) - 2, 2 * (k * conversations.STEP // 2) + 4, 2) if n > 0]
    rows = [(f"{start} {n}", start + i, "user" if i % 2 == 0 else "bot", "same", 0) for start in (0, 1) for n in lengths for i in range(n)]
    got = Counter(r["conversation_id"] for r in conversations.assemble(messages(spark, rows)).collect())
    assert got == {f"{start} {n}": n for start in (0, 1) for n in lengths}


def test_one_long_conversation(spark):
    n = 3000
    rows = [("big", None, "user" if i % 2 == 0 else "assistant", "same text", i) for i in range(n)]
    got = conversations.assemble(messages(spark, rows)).collect()
    assert sorted(r["seq"] for r in got) == list(range(n)) and all(r["seq"] == r["message_id"] for r in got)


def test_collapse(spark):
    rows = [
        ("convai2", 0, ["I ski.", "i  COOK"], ["b"]), ("convai2", 1, ["b!"], ["i cook", " ", "i ski"]), ("convai2", 2, ["i ski", "i ski", "i cook"], ["b"]),
        ("convai2", 3, None, ["b"]), ("convai2", 4, ["b"], [" ", None]), ("synthetic", 5, ["i ski", "i cook"], ["b"]), ("convai2", 6, ["i ski", "i cook"], ["B"]), ("convai2", 7, ["x"], ["x"]),
    ]
    d = spark.createDataFrame(rows, "corpus string, row long, one array<string>, two array<string>").selectExpr("*", "5 as id", "'x' as lo")
    g = {(r["corpus"], r["row_a"]): r["copies"] for r in collapse.groups(collapse.encode(d)).collect()}
    assert g == {("convai2", 0): 3, ("convai2", 2): 1, ("synthetic", 5): 1, ("convai2", 7): 1}
    assert collapse.encode(d.limit(0)).count() == 0


STOPPED = ["A man in a", "A man. He wears", "A man, as Mr.", "Lighting follows approx.", 'He says "stop.', "He waits (see the card.", "A man in a hat… ", "A cup of tea [...]", "A man. The over</answer>", "A man wears a (cut"]
WHOLE = ["A man waits.", 'He says "stop."', "He waits (see the card.)", "All glows! ✨", "Is it? </answer>", "<answer>He waits.</answer>\n", "一位木匠站在烛光中。", "It is St. Mary, as Mr. X said."]


@pytest.mark.parametrize("text", STOPPED)
def test_stopped_prose(text):
    e = endings.look(text)
    assert e.kind == "prose" and not e.finished


@pytest.mark.parametrize("text", WHOLE)
def test_whole_prose(text):
    assert endings.look(text).finished


def test_nothing_is_no_case():
    assert {endings.look(t).kind for t in (None, "", " ", "<answer></answer>", "...", "<think>x y z</think>", "[]")} == {"none"}


def test_stopped_values(spark):
    lists = ["red hat, long coat, sharp focus", "long coat, red hat, sharp focus", "blue sky, red hat, long co", "red hat, long coat, sh", "sharp focus, blue sky"]
    rows = list(enumerate([*lists, *STOPPED, *WHOLE, None, "", "A man waits. He smiles.", "A man waits. He sm"]))
    d = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as kind", "'x' as last")
    got = {r["id"]: r for r in truncation.judged(d).collect()}
    want = {i for i, t in rows if t in STOPPED or t in (lists[2], lists[3], "A man waits. He sm")}
    assert {i for i, r in got.items() if r["stopped"]} == want and len(got) == len(rows)
    assert got[rows[-1][0]]["has_longer_copy"] and not got[rows[-2][0]]["has_longer_copy"]
    assert truncation.judged(d.limit(0)).count() == 0


def test_short_fragments_are_stopped(spark):
    """Fragments of one to three letters are stopped however often they recur, and copies of a list prove nothing."""
    whole = ["red hat, long coat, sharp focus", "long coat, red hat, sharp focus", "red hat, blue sky, 3d", "blue sky, long coat, 3d", "long coat, pearl ring, red hat"]
    cut_off = ["red hat, long coat, s", "blue sky, red hat, s", "red hat, long coat, pe", "blue sky, red hat, pe", "long coat, red hat, blu", "red hat, long coat, blu", "red hat, blue sky, odd thing", "Red hat,  blue sky, odd thing"]
    d = spark.createDataFrame(list(enumerate(whole + cut_off)), "id long, text string")
    got = {r["id"] for r in truncation.judged(d).collect() if r["stopped"]}
    assert got == set(range(len(whole), len(whole) + len(cut_off)))


def test_prefixes_of_any_length(spark):
    d = spark.createDataFrame([(t,) for t in ("a", "ab", "abc", "abd", "b", "", "bcd")], "text string")
    assert {r[0] for r in truncation.continued(d).collect()} == {"a", "ab", "b"}


def test_strict_prefixes(spark):
    rng = random.Random(1)
    texts = {"".join(rng.choice("ab ") for _ in range(rng.randrange(4, 12))) for _ in range(200)} | {"x" * 5000, "x" * 4999, "abcd"}
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {t for t in texts if any(y != t and y.startswith(t) for y in texts)}
    assert {r[0] for r in truncation.continued(d).collect()} == want
    assert all(r["text"] + r["rest"] in texts and r["rest"] for r in truncation.continued(d).collect())


PROMPT = "i ski on friday and i like the snow. my cat is old and my dog is young."
ANSWERS = {
    "empty": [None, " ", "<answer></answer>", "N/A", "null", "...", "<think>short</think>", "[]"],
    "refusal": ["I'm sorry, but I can't help with describing this person.", "As an AI model I am not able to depict real people.", "I cannot create a portrait of this person."],
    "copy": ["My cat is old and my dog is young.\nI SKI ON FRIDAY and i like the snow", "Sure! i ski on friday and i like the snow. my cat is old and my dog is young."],
    "other_language": ["O gato está na mesa e o homem não quer sair de casa com a chuva.", "Лицо спокойное, взгляд направлен в сторону.", "Le chat est sur la table et je ne suis pas dans la maison avec lui."],
    "truncated": ["A man stands in the hall and wears a long coat. Behind him the sh", "A woman with a red hat waits near the door of the"],
    None: ["A man stands in the hall and wears a long coat.", '"I\'m sorry, we are closed," reads the sign near the door of the shop.', "A woman who can't help smiling waits in the hall.", "red hat, long coat, sharp focus", "long coat, blue sky, sharp focus"],
}


def test_defects(spark):
    rows, want = [], {}
    for k in range(12):  # the model needs some of each
        for defect, answers in ANSWERS.items():
            for a in answers:
                for _ in range(8 if defect is None else 1):
                    want[len(rows)] = defect
                    rows.append((len(rows), PROMPT, a))
    for a in ("A man stands in the hall and wears a long coat.", "Le chat est sur la table et je ne suis pas dans la maison."):
        want[len(rows)] = None
        rows.append((len(rows), " ", a))  # without a prompt
    d = spark.createDataFrame(rows, "id long, prompt string, answer string").selectExpr("*", "1 as defect", "2 as pattern")
    got = defaultdict(set)
    for r in defects.label(d).collect():
        got[r["id"]].add(r["defect"])
        assert 0.5 <= r["posterior"] <= 1
    first = {i: next((x for x in defects.DEFECTS if x in got[i]), None) for i in want}
    assert {i: (rows[i][2], first[i], w) for i, w in want.items() if first[i] != w} == {}
    assert defects.label(d.limit(0)).count() == 0


def test_late_refusal_is_voted():
    answer = "The persona says: " + "a man waits in the hall with a red hat. " * 12 + "I cannot create a description of this person."
    assert len(answer) > 450 and defects.votes(PROMPT, answer)["refusal"][1] == "1"


def test_cutoffs_are_validated_on_labelled_rows():
    assert defects.cutoff(np.array([0.99, 0.9, 0.8, 0.6, 0.1]), np.array([1, 1, 1, 0, 0.0])) == pytest.approx(0.7)
    assert defects.cutoff(np.array([0.9, 0.9, 0.7]), np.array([1, 0, 1.0])) == 0.5 and defects.cutoff(np.zeros(0), np.zeros(0)) == 0.5
    sound = [(PROMPT, ANSWERS[None][0] + " He smiles at the old dog and the cat."), ("Eu gosto de andar na praia com o meu cão e não de ficar em casa.", "Uma mulher está na praia com um cão e o mar por perto. Ela sorri.")]
    rows = defects.constructed(sound)
    assert {d for _, _, d in rows} == {None, *defects.DEFECTS} and defects.constructed(sound) == rows
    for prompt, answer, defect in rows:
        if defect is not None:
            assert "1" in defects.votes(prompt, answer)[defect], (answer, defect)


def test_likeliest_defect_is_reported(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "copy", 0.7), (1, "truncated", 0.9), (2, "truncated", 0.99999), (2, "empty", 0.99996)], "row_index long, defect string, posterior double")
    monkeypatch.setattr(defects, "labels", lambda spark, d: rows)
    assert {r["row_index"]: r["defect"] for r in defects.found(spark, "").collect()} == {1: "truncated", 2: "empty"}


def test_label_model_weighs_votes():
    patterns, counts = ["111", "000", "100", "011", "---"], np.array([50, 900, 30, 10, 10.0])
    q = defects.fit(patterns, counts)
    assert q[0] > 0.95 and q[1] < 0.01 and q[2] < 0.5 < q[3]
    assert len(defects.fit([], np.zeros(0))) == 0


def test_repeated_words():
    rng = random.Random(2)
    texts = [None, "", "a " * 9, "a " * 8, " ".join(rng.choice("abc") for _ in range(300)), " ".join(f"w{i}" for i in range(40)) * 1, "one two three four five six seven eight nine " * 3]
    for t, r, n in zip(texts, *repetition.repeated(texts)):
        w = (t or "").split()
        seen, cover = set(), set()
        for i in range(len(w) - 7):
            g = tuple(w[i : i + 8])
            if g in seen:
                cover |= set(range(i, i + 8))
            seen.add(g)
        assert (r, n) == (len(cover), len(w))


def test_entropy_band_loses_nothing(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(300):
        base = [f"word{rng.randrange(60)}" if rng.random() < 0.7 else "é漢" for _ in range(rng.randrange(5, 120))]
        cut = base[: rng.randrange(1, len(base))]
        texts.append(" ".join(base + cut * rng.randrange(0, 3)))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, texts[0])]
    d = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string").selectExpr("*", "1 as share", "2 as words")
    exact = {r["doc_id"] for r in repetition.shares(d).collect() if r["share"] >= 0.3 - 1e-9 and r["words"]}
    assert {r["doc_id"] for r in repetition.repetitive(d).collect()} == exact and 20 < len(exact) < 290
    f = {r["doc_id"]: r for r in repetition.fertility(d).collect()}
    assert f[900]["tokens"] == 0 and f[0]["tokens"] >= f[0]["words"] and f[0]["byte_tokens"] >= 0


def test_packing_plan():
    rng = random.Random(1)
    for capacity, top in ((50, 50), (100, 60), (64, 20)):
        h = Counter(rng.randint(1, top) for _ in range(500))
        fills = packing.plan(dict(h), capacity)
        used, placed = sum(t for t, _ in fills), Counter()
        for times, fill in fills:
            assert sum(fill) <= capacity and times > 0
            for s in fill:
                placed[s] += times
        bound = -(-sum(s * n for s, n in h.items()) // capacity)
        assert placed == h and used <= bound * 1.03 + 1
    assert packing.plan({}, 10) == [] and packing.plan({10: 3}, 10) == [(3, [10])]
    assert sum(t for t, _ in packing.plan({6: 2, 4: 2, 5: 2}, 10)) == 3


def brute_force(items, capacity):
    """The fewest containers, by trying every container for every item."""
    best = len(items)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                put(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best


def test_search_to_the_end_is_optimal():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(10, 40)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        fills = packing.plan(dict(Counter(items)), capacity, None)
        assert sum(t for t, _ in fills) == brute_force(items, capacity) and packing.lower_bound(Counter(items), capacity) <= brute_force(items, capacity)
        placed = Counter()
        for times, fill in fills:
            assert sum(fill) <= capacity
            for x in fill:
                placed[x] += times
        assert placed == Counter(items)


@pytest.mark.parametrize("seed", range(4))
def test_triplets_are_packed_without_waste(seed):
    """Three items fill each container exactly: best fit needs a fifth more containers, the search none."""
    rng, capacity, items = random.Random(seed), 1000, []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(250, max(251, (capacity - a) // 2))
        items += [a, b, capacity - a - b]
    counts = dict(Counter(items))
    assert sum(t for t, _ in packing.plan(counts, capacity)) == 20 < sum(t for t, _ in packing.best_fit(counts, capacity))


def test_search_does_not_depend_on_the_number_of_items():
    """A packing that the search finds for a few items is also found for very many of the same sizes."""
    sizes, capacity = {44: 1, 24: 2, 28: 2, 22: 3, 21: 2, 17: 1, 8: 5, 6: 4}, 100
    for times in (1, 3, 20_000):
        counts = {s: n * times for s, n in sizes.items()}
        best = [(n, [s]) for s, n in counts.items()]  # an incumbent that is easily bettered
        fills = packing.branch(counts, capacity, packing.lower_bound(counts, capacity), best, 100_000)
        placed = Counter()
        for n, fill in fills:
            assert sum(fill) <= capacity
            for x in fill:
                placed[x] += n
        assert placed == counts and sum(n for n, _ in fills) < 1.1 * packing.lower_bound(counts, capacity) + 1


def test_fillings_are_undominated():
    counts = Counter([5, 4, 3, 3, 2])
    found = packing.completions(sorted(counts), counts, 7, 7)
    assert found[0] == [5, 2] and all(sum(c) <= 7 for c in found) and [3] not in found and [2] not in found
    assert [4, 3] in found and [5, 2] in found and len(found) == len(set(map(tuple, found)))


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 3, 3, 3, 7, 7, 10, 11, 25, 20, 4, 4, 1])] + [(2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, tokens long").selectExpr("*", "'c' as container", "1 as salt")
    out = packing.pack(d, [("ten", 10), ("big", 100), (None, 5)]).collect()
    for name, capacity in (("ten", 10), ("big", 100)):
        mine = [r for r in out if r["container"] == name]
        load, size = Counter(), Counter()
        for r in mine:
            size[r["doc_id"]] += r["tokens"]
            if r["container_no"] is not None:
                load[r["container_no"]] += r["tokens"]
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert {i: size[i] for i, _ in rows} == {i: sum(n or 0 for j, n in rows if j == i) for i, _ in rows}
        assert [r["container_no"] for r in mine if r["tokens"] == 0] == [None, None]
        whole = {i for i, n in rows if n and n <= capacity}
        assert all(c == sum(1 for j, n in rows if j == i) for i, c in Counter(r["doc_id"] for r in mine if r["doc_id"] in whole).items())
    assert packing.pack(d.limit(0), [("ten", 10)]).count() == 0 and packing.pack(d, []).count() == 0


def test_raking():
    available = {("a", "en", "x"): 1000.0, ("a", "pt", "x"): 200.0, ("b", "en", "y"): 300.0, ("b", "pt", "y"): 300.0, ("c", "en", "x"): 50.0}
    wanted = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.3, 2), mixing.Target("c", 0.1, 4), mixing.Target("d", 0.1, 3)]
    w = mixing.rake(available, wanted)
    got = Counter()
    for c, x in w.items():
        got[c[0]] += x * available[c]
        assert 0 <= x <= {t.source: t.repeats for t in wanted}[c[0]] + 1e-9
    total = sum(got.values())
    assert abs(got["a"] / total - 5 / 9) < 1e-6 and abs(got["b"] / total - 3 / 9) < 1e-6 and abs(got["c"] / total - 1 / 9) < 1e-6
    assert abs(total - 50 * 4 * 9) < 1e-6  # the smallest source is used as often as it may be
    assert mixing.rake({}, wanted) == {} and mixing.rake(available, []) == {}


def test_topics_are_clusters(spark):
    rng = random.Random(6)
    themes = [[f"{t}{i}" for i in range(30)] for t in "abc"]
    texts = [" ".join(rng.choice(themes[k % 3]) for _ in range(40)) for k in range(90)] + [None, ""]
    v = mixing.vectors(texts)
    assert v.shape == (92, mixing.TERMS) and not v[90:].any()
    weights, centres = mixing.fit_topics(v, 3)
    of = ((v[:90] * weights) @ centres.T).argmax(axis=1)
    assert all(len(set(of[k::3].tolist())) == 1 for k in range(3)) and len(set(of.tolist())) == 3
    assert len(mixing.fit_topics(v[90:], 3)[1]) == 0 and len(mixing.fit_topics(np.repeat(v[:1], 5, axis=0), 3)[1]) == 1
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert mixing.sampled(d).shape == (91, mixing.TERMS) and mixing.sampled(d.limit(0)).shape == (0, mixing.TERMS)


def test_topics_come_from_all_documents(spark, tmp_path, monkeypatch):
    """Topics don't change with the size of a sample, long texts count, and the fit is that of all vectors at once."""
    rng = random.Random(8)
    themes = [[f"{t}{i}" for i in range(30)] for t in "abc"]
    texts = [" ".join(rng.choice(themes[k % 3]) for _ in range(40)) for k in range(120)] + [" ".join(f"long{i}" for i in range(9)) * 400, None, ""]
    docs = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.5, 1)]
    topics = lambda: {r["doc_id"]: r["topic"] for r in mixing.pool(spark, str(tmp_path), wanted).collect()}
    every = topics()
    monkeypatch.setattr(mixing, "SAMPLE", 2)
    assert topics() == every and every[121] == every[122] == "none" and len(set(every.values())) == mixing.TOPICS + 1
    v = mixing.vectors(texts).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, b) for i, b in enumerate(mixing.packed(v).to_pylist())], "doc_id long, v binary").repartition(3)
    for one, two in zip(mixing.fit_all(table, 3), mixing.fit_topics(v, 3)):
        assert np.allclose(one, two, atol=1e-4)
    assert mixing.fit_all(table.limit(0), 3)[1].shape == (0, mixing.TERMS)


def test_shares_name_what_can_be_reached(spark, tmp_path):
    docs = [(i, f"word{i} and some more text {i}", "en", "ab"[i % 2]) for i in range(200)] + [(900, None, None, "a"), (901, "", "en", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 3), ("none", 0.2, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in mixing.shares(spark, str(tmp_path)).collect()}
    assert got["a"]["reachable_share"] == pytest.approx(0.375) and got["none"]["reachable_share"] == 0 == got["none"]["actual_share"]
    assert abs(got["a"]["actual_share"] - 0.375) < 0.02 and got["b"]["most_uses"] <= 3


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice("aab"), rng.choice(["en", "pt"]), rng.choice(["card", "tags"]), rng.randrange(0, 50), rng.randrange(mixing.BINS**2)) for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, tokens long, h int").selectExpr("*", "1 as n", "2 as bin")
    wanted = [mixing.Target("a", 0.4, 1), mixing.Target("b", 0.5, 3), mixing.Target("z", 0.1, 1)]
    out = mixing.mix(d, wanted).collect()
    used = Counter()
    for r in out:
        assert 0 <= r["uses"] <= {"a": 1, "b": 3}[r["source"]] and (r["tokens"] or not r["uses"])
        used[r["source"]] += r["uses"] * r["tokens"]
    assert len(out) == len(docs) and abs(used["b"] / sum(used.values()) - 5 / 9) < 0.01
    assert mixing.mix(d.limit(0), wanted).count() == 0
    assert {r["uses"] for r in mixing.mix(d, []).collect()} == {0}


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.sizes(d).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 0
