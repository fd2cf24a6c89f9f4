"""Licence scans against brute force: base phrases exactly, notices by share and key phrases."""

import random
import re

from conftest import rows_of
from lapstream.llm import licences as L

SCHEMA = "doc_id long, text string, words int, hits int, starts int, n0 int, b0 int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(rows):
    texts = [words(t) for _, t in rows]
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts):
        base = [(i, label) for phrase, label in L.BASE for i in range(len(t)) if t[i : i + len(phrase.split())] == phrase.split()]
        labels, score = {b for _, b in base}, 1.0 if base else 0.0
        for label, notice, keys in L.NOTICES:
            n = notice.split()
            index = sorted(range(len(n)), key=lambda i: (df.get(n[i], 0), i))[: L.DEPTH]
            for p in range(-len(n), len(t)):
                at = lambda i, p=p: t[p + i] if 0 <= p + i < len(t) else None
                share = sum(at(i) == n[i] for i in index) / len(index)
                held = all(any(n[f : f + len(k)] == k and all(at(f + j) == w for j, w in enumerate(k)) for f in range(len(n))) for k in (key.split() for key in keys))
                if share >= L.SHARE and held:
                    labels.add(label)
                    score = max(score, share)
        starts = [i for i, _ in base]
        out.append((",".join(sorted({b for _, b in base})), doc_id, min(starts, default=None), ",".join(sorted(labels)), max(starts, default=None), len(base), len(t), score))
    return rows_of(list("abcdefgh"), out)


def test_by_hand(spark):
    rng = random.Random(3)
    pool = [*{w for p, _ in L.BASE for w in p.split()}, *{w for _, n, _ in L.NOTICES for w in n.split()}, "x", "y", "été"]
    rows = [(1, None), (2, ""), (None, "All RIGHTS reserved -- all rights, reserved"), (3, "CC-BY CC BY cc  by"), (3, "CC-BY CC BY cc  by"), (4, "general public license " * 2000), (5, "Kind İs ccİ by"), (6, "MIT License"), (7, "rights reserved all")]
    for i in range(60):
        n = list(rng.choice(L.NOTICES)[1].split() + rng.choice(L.BASE)[0].split())
        for _ in range(rng.randrange(4)):
            n[rng.randrange(len(n))] = rng.choice(pool)
        rows.append((10 + i, rng.choice([" ", ", ", "-"]).join(rng.choices(pool, k=rng.randrange(20)) + n[rng.randrange(5) :] + rng.choices(pool, k=5)).upper()))
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    out = L.scan_licences(df, L.BASE, L.NOTICES)
    assert rows_of(out.columns, out.collect()) == by_hand(rows)
    assert L.scan_licences(df.where("false"), L.BASE, L.NOTICES).collect() == []
