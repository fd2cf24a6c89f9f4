"""Language predictions held against vectors that are bound letter by letter and bundled one trigram at a time."""

import numpy as np

from lapstream.llm import language as L

ROWS = [(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, "the dog and the cat", None), (4, "die Katze", None), (5, "", None), (6, None, "en"), (7, "123 !!", None), (8, "Ünd", "de"), (8, "and", None)]


def bundle(text):
    out = np.zeros(L.DIMENSION)
    codes = L._codes()
    for word in "".join(c if c.isalpha() else " " for c in text or "").split():
        numbers = [0, *(int(codes[ord(c)]) for c in word), 0]
        for a, b, c in zip(numbers, numbers[1:], numbers[2:]):
            out += np.roll(L._V[a], 2).astype(float) * np.roll(L._V[b], 1) * L._V[c]
    return out


def test_same_as_bundles_by_hand(spark):
    known = {}
    for _, text, lang in ROWS:
        if lang and text:
            known[lang] = known.get(lang, 0) + bundle(text)
    want = []
    for i, text, _ in ROWS:
        v = bundle(text)
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in known.items()} if v.any() else {}
        best = max(cosines, key=cosines.get) if cosines else "und"
        want.append((i, best, round(max(0.0, cosines.get(best, 0.0)), 4)))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in L.identify(docs).collect()]
    assert sorted(got) == sorted(want)
