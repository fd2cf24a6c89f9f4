"""Span search, Viterbi against all paths, and scores of documents that were not learned from."""

import time

import numpy as np

from lapstream.llm import toxicity
from lapstream.llm.language import LETTERS


def test_spans():
    text = "plain words, y0u and 1diot, i d 1 o t. stuuupid no 42 x y id10ts a_b a$$ shi7 great!! i  d  i  o  t, s.t.u.p.1.d iddiot"
    want = ["y0u", "1diot", "i d 1 o t", "stuuupid", "id10ts", "a$$", "shi7", "i  d  i  o  t", "s.t.u.p.1.d", "iddiot"]
    assert [m[0] for m in toxicity.SUSPECT_ASCII.finditer(text)] == want
    assert [m[0] for m in toxicity.SUSPECT.finditer(text + " ççé é t é")] == [*want, "ççé", "é t é"]


def test_long_texts_take_linear_time():
    lm = np.ones((LETTERS, LETTERS, LETTERS), np.float32)
    for unit in ("!", "|", "$ ", "ab", "a1", "é"):
        begin = time.time()
        for pattern in (toxicity.SUSPECT, toxicity.SUSPECT_ASCII):
            for _ in pattern.finditer(unit * (1_000_000 // len(unit))):
                pass
        assert time.time() - begin < 2
    assert len(toxicity.restore("x y " * 20_000, lm, {})) > 20_000


def all_paths(span, lm):
    """The cheapest restored text, by trying every choice for every sign."""
    signs, spaced = toxicity.lattice(span)
    best = [float("inf"), ""]

    def walk(i, a, b, cost, text):
        if i == len(signs):
            cost += float(lm[a, b, 0])
            if cost < best[0] - 1e-9:
                best[:] = [cost, text]
            return
        for x, n, fee in signs[i]:
            if n and n == b:
                walk(i + 1, a, b, cost + fee + toxicity.REPEATED, text)
            if n or b:
                walk(i + 1, b, n, cost + fee + float(lm[a, b, n]), text + x)
            else:
                walk(i + 1, a, b, cost + fee, text)
            if spaced and b and n:
                walk(i + 1, 0, n, cost + toxicity.LOST_BLANK + fee + float(lm[a, b, 0]) + float(lm[0, 0, n]), text + " " + x)

    walk(0, 0, 0, 0.0, "")
    return best[1]


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(5)
    for k in range(60):
        lm = rng.gamma(2.0, 2.0, (LETTERS, LETTERS, LETTERS)).astype(np.float32)
        span = "".join(rng.choice(list("aabi1l0s$5!t|"), rng.integers(3, 8)))
        span = " ".join(span) if k % 3 == 0 else span
        body = span.rstrip("!")
        if any(c.isalpha() for c in body) and body.strip() == body:
            assert toxicity.decode(span, lm) == all_paths(body, lm) + span[len(body) :]


def test_restoring_in_one_lattice(spark):
    prose = "the idiot was a loser and the moron went to the trash of stupid pathetic people"
    df = spark.createDataFrame([(i, prose) for i in range(5)], "doc_id long, text string")
    lm = toxicity.language_model(df)
    for bad, good in [("idi07", "idiot"), ("tra$h", "trash"), ("i d 1 0 t", "idiot"), ("l 0 s e r", "loser"), ("m o r 0 n", "moron"), ("i  d  i  o  t", "idiot"), ("iddiot", "idiot"), ("s.t.u.p.1.d", "stupid")]:
        assert toxicity.restore(f"so {bad} there", lm, {}) == f"so {good} there"
    assert toxicity.restore("a plain text, no more!!", lm, {}) == "a plain text, no more!!"


def test_scores_of_unseen_documents(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "tel", "min", "sok") for c in ("", "da", "vi")]
    bad = [["idiot", "1diot", "id10t", "i d i o t", "idiooot"], ["moron", "m0ron", "mor0n", "m o r o n", "mooron"]]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choice(words, 40).tolist()
        if toxic:
            for form in bad:
                text.insert(int(rng.integers(40)), form[0] if i % 2 else form[int(rng.integers(len(form)))])
        rows.append((i, " ".join(text)))
        if i % 5:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    unseen = sorted((r["score"], r["doc_id"] % 3 == 0, r["predicted"]) for r in got if r["doc_id"] % 5 == 0)
    hits = np.cumsum([t for _, t, _ in reversed(unseen)])
    precision = [h / (k + 1) for k, (h, (_, t, _)) in enumerate(zip(hits, reversed(unseen), strict=True)) if t]
    assert np.mean(precision) >= 0.95
    assert np.mean([p == t for _, t, p in unseen]) >= 0.95
