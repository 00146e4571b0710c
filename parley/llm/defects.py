"""Broken prompt and answer pairs (problem 2): noisy labelling functions combined by an expectation-maximization label model.

Each defect has a few labelling functions that vote 1 (defective), 0 (sound) or - (no opinion). What a vote is worth is
not set by hand: a model of each defect, in which the votes are independent given the true state, is fitted by
expectation-maximization to the counts of vote patterns over all rows. A defect is retained where its posterior reaches
the defect's cutoff, validated on labelled rows beside those of the fit: a bounded sample of sound rows (LABELLED), each
as it is and with every defect built in (see constructed()); the cutoff is the one of the greatest F1 there. A row can
retain several defects; where one is asked for, the one of the greatest posterior counts, of equal ones the first of
DEFECTS.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash64
from ..session import cut
from . import endings, truncation
from .corpora import load
from .shingles import WORD

DEFECTS = ("empty", "refusal", "other_language", "copy", "truncated")
ROUNDS, SMOOTH = 60, 0.5
#: Pairs from which labelled rows are built for the cutoffs, and characters of one at most.
LABELLED, LONGEST = 1000, 20_000

#: Words that stand for nothing.
STAND_INS = set("null none nil nan na n/a undefined empty missing blank tbd todo unknown placeholder noanswer nodescription notavailable notapplicable novalue nodata noresponse nothing untitled nodescriptionavailable noanswerprovided".split())
#: Common words of each language.
COMMON = {
    "en": "the a an of and is in on at to with for by from that this my his her its are as near who i you it was were some into where while above one can me any over so be or there no have has out like every up six seven been all",
    "pt": "o a os as um uma de do da dos das em no na nos nas com por para que não e mas eu meu minha seu sua ao se ele ela enquanto quando nunca perto há um uns sob",
    "es": "el la los las un una de del en con por para que no y pero yo mi su al se mientras cuando nunca cerca hay me le está bajo",
    "fr": "le la les un une des de du en dans avec par pour que ne pas et mais je mon ma mes son sa est se au aux qui quand près jamais il elle sur à suis",
    "de": "der die das ein eine einen einem einer und ist im mit für von zu den dem nicht ich mein meine er sie auf am bei wenn neben nie aber des sich liegt in",
    "it": "il lo la i gli le un una di del della nel nella in con per che non e ma io mio mia è al sono quando mai vicino si sul sulla",
    "nl": "de het een en is in op met voor van te niet ik mijn hij zij aan bij als naast nooit maar zich er",
}
_SPEAKS: dict[str, tuple[str, ...]] = {w: tuple(k for k, v in COMMON.items() if w in v.split()) for v in COMMON.values() for w in v.split()}
#: Letters that only some of the languages have.
LETTERS = {"ã": "pt", "õ": "pt", "ñ": "es", "¿": "es", "¡": "es", "ß": "de", "ä": "de", "œ": "fr", "è": "fr it", "ê": "fr pt", "ù": "fr it", "î": "fr"}

_ABLE = r"(?:can(?:no|['’])t|can not|could(?:n['’]t| not)|unable to|not able to|won['’]t(?: be able to)?|will not|not (?:be )?(?:comfortable|permitted|allowed)(?: to)?|must (?:decline|refuse)(?: to)?|(?:have|need) to decline|decline to|refuse to)"
_DO = r"(?:help (?:you )?(?:with|to)|assist|describ|creat|generat|rewrit|fulfil|produc|depict|provid|offer|comply|complet|do (?:that|this)|continue|writ|discuss|enhanc|expand|answer|process|support|respond)"
_CANNOT = re.compile(rf"\b(?:i|we)\b[^.!?\"“”]{{0,40}}{_ABLE}[^.!?\"“”]{{0,25}}{_DO}|{_ABLE}[^.!?\"“”]{{0,12}}\b(?:help|assist|comply)\b(?! \w+ing)[^.!?]*|not possible for (?:me|us)|(?:isn['’]t|is not|not) something (?:i|we) can|beyond (?:my|what i)|against my (?:guidelines|polic)|i (?:must|have to) (?:decline|refuse|pass)|(?:don['’]t|do not) feel comfortable|(?:keep|prevent|stop|bar)s? me from|off the table|limits to what (?:i|we)|request declined|(?:policy|rules|guidelines) (?:does|do) not allow|no (?:description|image|prompt|portrait|answer|output|text) (?:will|can|could) be|breaks? the [a-z ]*rules|against the [a-z ]*rules|have no way to|rather not|leave (?:this|it) (?:blank|empty)|outside (?:of )?(?:what|my)|not permitted|not allowed|\b(?:não posso|no puedo|je ne peux pas|kann ich (?:leider )?nicht|lo siento|desculpe|désolé|tut mir leid)\b", re.I)
#: Parts of which every match of _CANNOT has at least one; a text without any is not searched.
_HINTS = ("cannot", "can't", "can’t", "can not", "could", "unable", "not able", "won't", "won’t", "will not", "comfortable", "permitted", "allow", "decline", "refuse", "possible for", "something", "beyond", "against", "to pass", "must pass", "me from", "off the table", "limits to what", "will be", "can be", "rules", "no way", "rather not", "leave", "outside", "posso", "puedo", "peux", "kann ich", "siento", "desculpe", "désolé", "mir leid")
_SORRY = re.compile(r"^\W*(?:(?:i['’]?m|i am|we['’]?re|we are)?\s*(?:very |so |really )?(?:sorry|afraid)\b|unfortunately|apologies|my apologies|i apologi[sz]e|regrettably|(?:as|being) an? (?:ai|language model|assistant)|thank you for [^.!?]*[.!?] (?:however|but|unfortunately))", re.I)
#: Words by which an answer speaks of the task instead of the person, and of itself.
_TASK = re.compile(r"\b(?:requests?|persona|descriptions?|describing|prompts?|guidelines|instructions|polic(?:y|ies)|content|ai|language model|(?:this|that) text|these sentences|individuals|private people|permitted|comfortable|rewrit\w+|generat\w+|fulfil\w*|assist(?! to)|enhanc\w+|sensitive|creat(?:e|ing)|picture|reveal|limits|draw)\b", re.I)
_SELF = re.compile(r"\b(?:i|i['’]m|i['’]d|me|my|we|us)\b", re.I)


_LETTER, _NOT_WORD = re.compile("[A-Za-z]"), re.compile(r"[\W_]+")


def languages(text: str) -> tuple[str | None, dict[str, float]]:
    """The language by its common words, or None if there are too few; and the share of each language's common words."""
    w = WORD.findall(text.lower())
    n = Counter(k for x in w if x in _SPEAKS for k in _SPEAKS[x])
    share = {k: n[k] / max(1, len(w)) for k in COMMON}
    best = sorted(share, key=share.get, reverse=True)
    clear = len(w) >= 4 and share[best[0]] >= 0.08 and share[best[0]] > 1.2 * share[best[1]]
    return (best[0] if clear else None), share


def script(text: str) -> str | None:
    """The script of most letters: latin, other (by Unicode block start), or None without letters."""
    if text.isascii():
        return "latin" if _LETTER.search(text) else None
    letters = [ch for ch in text if ch.isalpha()]
    latin = sum(ch < "ɐ" or "Ḁ" <= ch <= "ỿ" for ch in letters)
    return None if not letters else "latin" if 2 * latin >= len(letters) else "other"


def bare(text: str) -> str:
    """Letters and digits in lower case."""
    return _NOT_WORD.sub("", text.lower())


def leftover(prompt: str, answer: str) -> tuple[int, int, int]:
    """Letters and digits of the answer before the prompt's first sentence in it, those after that aren't the prompt's, and those that are."""
    a = bare(answer)
    own = sorted({k for k in map(bare, re.split(r"[.!?;\n。]+", prompt)) if len(k) >= 4}, key=len, reverse=True)
    mark = "\x00"
    for k in own:
        a = a.replace(k, mark * len(k))
    taken = a.count(mark)
    if not taken:
        return len(a), 0, 0
    at = a.index(mark)
    return at, len(a) - at - taken, taken


def votes(prompt: str | None, answer: str | None, end: endings.Ending | None = None) -> dict[str, str]:
    """The votes of each defect's labelling functions; '?' is what the dictionary of list items decides."""
    out = {}
    text = endings.unwrap(answer)
    plain = bare(text)
    end = end or endings.look(answer)
    words = WORD.findall(text.lower())
    vote = lambda *v: "".join("-" if x is None else str(int(x)) for x in v)

    stand_in = plain in STAND_INS or re.fullmatch(r"n\W?a", text.strip(" \"'()[]<>.").lower()) is not None
    out["empty"] = vote(True if not plain else None if stand_in else False, stand_in or not plain, len(plain) < 12, True if not (answer or "").strip() else None)

    low = text.lower()
    able, sorry = any(h in low for h in _HINTS) and bool(_CANNOT.search(text)), bool(_SORRY.search(text))
    quoted = text[:1] in "\"“”'‘«" and not sorry or bool(re.match(r"[\"“”][^\"“”]*[\"“”]", text))
    out["refusal"] = vote(sorry and not quoted, able and not quoted, None if len(words) <= 45 else False, bool(_TASK.search(text)) and (bool(_SELF.search(text)) or sorry or able) and not quoted, False if quoted or not words else None)

    said, shares = languages(text)
    asked, asked_shares = languages(prompt or "")
    scripts = script(prompt or ""), script(text)
    known = bool((prompt or "").strip()) and len(plain) >= 4
    foreign = [] if text.isascii() else [LETTERS[c].split() for c in text.lower() if c in LETTERS]
    odd = asked is not None and sum(asked not in x for x in foreign) >= 2 and not any(c in LETTERS and asked in LETTERS[c] for c in text.lower())
    out["other_language"] = vote(
        None if not known or None in scripts else scripts[0] != scripts[1] or (False if said == asked or said is None or asked is None else True),
        None if not known or not (said and asked) else said != asked,
        True if known and odd else None,
        None if not known or asked is None or len(words) < 6 and scripts[0] == scripts[1] else False if shares[asked] >= 0.6 * max(shares.values()) and scripts[0] == scripts[1] else True,
    )

    if (prompt or "").strip() and plain:
        before, after, taken = leftover(prompt, text)
        whole = taken >= 8 and after <= 0.03 * taken and before <= max(40, 0.3 * taken)
        mine = set(WORD.findall(prompt.lower()))
        inside = sum(w in mine for w in words) / max(1, len(words))
        out["copy"] = vote(whole, None if 0.6 < inside < 0.85 else inside >= 0.85, None if 0.3 < taken / len(plain) < 0.75 else taken / len(plain) >= 0.75)
    else:
        out["copy"] = "0--"

    tail = end.core[-1:]
    if end.kind == "none":
        out["truncated"] = "00--"
    elif end.kind == "list":
        out["truncated"] = "??" + vote(None, True if tail == "," else None)
    else:
        open_ = len(endings._QUOTES.findall(end.core)) % 2 == 1 or end.core.count("(") > end.core.count(")")
        out["truncated"] = vote(not end.finished, tail.isalnum() or tail in ",;:-(" or not end.finished, True if open_ else None, True if end.marked and not end.finished else None)
    return out


def voted(rows: DataFrame) -> DataFrame:
    """(id, defect, pattern): the vote pattern of every row of (id, prompt, answer) for every defect."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prompts, answers = batch.column("prompt").to_pylist(), batch.column("answer").to_pylist()
            e = [endings.look(a) for a in answers]
            v = [votes(*x) for x in zip(prompts, answers, e)]
            arrays = [batch.column("id"), *(pa.array([x[d] for x in v]) for d in DEFECTS), pa.array([x.kind for x in e]), pa.array([x.last for x in e]), pa.array([x.inner for x in e], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *DEFECTS, "kind", "last", "inner"])

    schema = "id long, " + ", ".join(f"{d} string" for d in DEFECTS) + ", kind string, last string, inner array<string>"
    seen = cut(rows.select("id", "prompt", "answer").mapInArrow(run, schema))
    lists = seen.where("kind = 'list'").join(truncation.complete_items(seen).withColumn("known", F.lit(True)), "last", "left")
    seen = lists.unionByName(seen.where("kind <> 'list'").withColumn("known", F.lit(None).cast("boolean")))  # no item, so no part in that join
    decided = F.regexp_replace("truncated", r"\?", F.when(F.col("known"), "0").otherwise("1"))
    patterns = F.array(*(F.struct(F.lit(d).alias("defect"), (decided if d == "truncated" else F.col(d)).alias("pattern")) for d in DEFECTS))
    return seen.select("id", F.explode(patterns).alias("p")).select("id", "p.defect", "p.pattern")


def fit(patterns: list[str], counts: np.ndarray) -> np.ndarray:
    """Posterior of each pattern's defect by expectation-maximization over pattern counts.

    It starts from the share of votes 1 among the votes cast; no opinion is no evidence. An empty input gives an empty
    result.
    """
    if not patterns:
        return np.zeros(0)
    code = np.array([["-01".index(c) for c in p] for p in patterns])
    cast = (code > 0).sum(axis=1)
    q = np.clip((code == 2).sum(axis=1) / np.maximum(cast, 1), 0.02, 0.98)
    q = np.where(cast == 0, 0.02, q**2)
    for _ in range(ROUNDS):
        prior = np.clip((counts @ q + SMOOTH) / (counts.sum() + 2 * SMOOTH), 1e-6, 0.5)
        logit = np.full(len(patterns), np.log(prior / (1 - prior)))
        for f in range(code.shape[1]):
            some = code[:, f] > 0
            for v in (1, 2):
                on = code[:, f] == v
                yes = (counts[on] @ q[on] + SMOOTH) / (counts[some] @ q[some] + 2 * SMOOTH)
                no = (counts[on] @ (1 - q[on]) + SMOOTH) / (counts[some] @ (1 - q[some]) + 2 * SMOOTH)
                logit[on] += np.log(yes / no)
        q = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    return q


def cutoff(posterior: np.ndarray, defective: np.ndarray) -> float:
    """The posterior from which retaining has the greatest F1 on labelled rows, 0.5 at least; in the middle of the gap below the rows it retains."""
    order = np.argsort(-posterior, kind="stable")
    p, hit = posterior[order], np.cumsum(defective[order])
    if not len(p) or not hit[-1]:
        return 0.5
    last = np.concatenate([p[1:] < p[:-1], [True]])  # rows of equal posterior are retained together
    f1 = np.where(last, 2 * hit / (np.arange(1, len(p) + 1) + hit[-1]), -1)
    at = int(np.argmax(f1))
    below = p[at + 1] if at + 1 < len(p) else 0.0
    return max(0.5, float(p[at] + below) / 2)


#: Refusals for the labelled rows, with and without a word for the task.
_REFUSALS = ("I'm sorry, but I can't help with describing this person.", "I cannot create a description for this persona.", "Unfortunately I am not able to rewrite this text.", "As an AI model, I must decline this request.", "We are unable to generate a portrait of this person.")


def constructed(sample: list[tuple[str, str]], seed: int = 17) -> list[tuple[str, str, str | None]]:
    """Labelled (prompt, answer, defect) of sound pairs: each as it is (None) and with every defect that can be built into it.

    empty: a stand-in for nothing; refusal: one of a few sentences; other_language: the answer of a pair whose prompt is
    in another language; copy: the prompt's sentences in another order; truncated: a prose answer cut inside a sentence.
    """
    rng = random.Random(seed)
    by_language: dict[str, list[str]] = {}
    for prompt, answer in sample:
        said = languages(prompt)[0]
        if said and said == languages(answer)[0]:
            by_language.setdefault(said, []).append(answer)
    nothing = sorted(STAND_INS)
    out: list[tuple[str, str, str | None]] = []
    for prompt, answer in sample:
        out.append((prompt, answer, None))
        out.append((prompt, rng.choice(["", "  ", "<answer></answer>", "...", rng.choice(nothing)]), "empty"))
        out.append((prompt, rng.choice(_REFUSALS), "refusal"))
        asked = languages(prompt)[0]
        others = [k for k in sorted(by_language) if asked and k != asked]
        if others:
            out.append((prompt, rng.choice(by_language[rng.choice(others)]), "other_language"))
        parts = [p.strip() for p in re.split(r"(?<=[.!?;])\s+", prompt) if p.strip()]
        rng.shuffle(parts)
        if len(bare(prompt)) >= 12:
            out.append((prompt, " ".join(parts), "copy"))
        words = answer.split()
        if endings.look(answer).kind == "prose" and len(words) > 8:
            cut_off = " ".join(words[: rng.randrange(5, len(words) - 2)])
            cut_off = cut_off[: len(cut_off) - rng.randrange(0, 2)].rstrip(".,!?;:\"”'")
            out.append((prompt, cut_off, "truncated"))
    return out


def labelled(rows: DataFrame, n: int) -> list[tuple[str, str, str | None]]:
    """Labelled rows for the cutoffs, from at most ``n`` pairs, those with the least hashes among the pairs no function finds fault with.

    Only pairs of at most LONGEST characters are taken, so the driver's part is bounded. The defects built in are in no fit.
    """
    short = rows.where((F.length("prompt") > 0) & (F.length("answer") > 0) & (F.length("prompt") + F.length("answer") <= LONGEST))
    some = short.select("prompt", "answer", hash64(3, F.col("prompt"), F.col("answer")).alias("h")).distinct().orderBy("h", "prompt", "answer").limit(n).collect()
    sound = [(r["prompt"], r["answer"]) for r in some if not any("1" in p for p in votes(r["prompt"], r["answer"]).values())]
    return constructed(sound)


def cutoffs(rows: list[tuple[str, str, str | None]], posteriors: dict[tuple[str, str], float]) -> dict[str, float]:
    """The cutoff of each defect from labelled rows and the posteriors of (defect, pattern); a pattern that the fit has not seen is left out."""
    seen: dict[str, list[tuple[float, bool]]] = {d: [] for d in DEFECTS}
    for prompt, answer, defect in rows:
        for d, pattern in votes(prompt, answer).items():
            q = posteriors.get((d, pattern.replace("?", "0")))
            if q is not None and (defect in (None, d)):
                seen[d].append((q, defect == d))
    return {d: cutoff(np.array([q for q, _ in x]), np.array([y for _, y in x], float)) for d, x in seen.items()}


def label(rows: DataFrame, n_labelled: int = LABELLED) -> DataFrame:
    """(id, defect, posterior): the retained defects of rows (id, prompt, answer).

    Null and blank answers are empty; without a prompt no answer is a copy or in another language. Repeated rows are
    labelled alike, empty tables have no labels.
    """
    seen = cut(voted(rows))
    # at most 3 ** 5 patterns for each defect
    table = seen.groupBy("defect", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    posteriors: dict[tuple[str, str], float] = {}
    for d in DEFECTS:
        mine = sorted((r for r in table if r["defect"] == d), key=lambda r: r["pattern"])
        q = fit([r["pattern"] for r in mine], np.array([r["n"] for r in mine], float))
        posteriors |= {(d, r["pattern"]): float(x) for r, x in zip(mine, q)}
    least = cutoffs(labelled(rows, n_labelled), posteriors)
    scored = [(d, p, q) for (d, p), q in posteriors.items() if q >= least[d]]
    schema = T.StructType([T.StructField("defect", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("posterior", T.DoubleType())])
    kept = rows.sparkSession.createDataFrame(scored, schema)
    return seen.join(F.broadcast(kept), ["defect", "pattern"]).select("id", "defect", "posterior")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "persona_mapping").select(F.col("row_index").alias("id"), F.col("persona_revised").alias("prompt"), F.col("enhanced_persona_revised").alias("answer"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_labels: (row_index, defect, posterior), every retained defect."""
    return label(pairs(spark, sf_dir)).withColumnRenamed("id", "row_index")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: (row_index, defect), one defect per defective row: the likeliest, of those alike to three digits the first of DEFECTS."""
    order = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return labels(spark, sf_dir).groupBy("row_index").agg(F.min_by("defect", F.struct(-F.round("posterior", 3), order)).alias("defect"))
