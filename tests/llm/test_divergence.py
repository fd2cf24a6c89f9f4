"""Source divergence against brute force: odd rows, several levels, blocks and tiles, a sieve that lets everything pass."""

import random
import re
from collections import Counter, defaultdict

import pytest

from conftest import rows_of
from lapstream.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n int, p int, terms string, prefix int"


def by_hand(rows, least, top):
    counts, rows_with, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        g = (lang or "", source or "")
        groups.add(g)
        counts[g].update(t)
        rows_with[g[0]].update(set(t))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in rows_with[lang].items() if n >= least)
        own = sorted(g[1] for g in groups if g[0] == lang)
        cell = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        total = {t: sum(cell[s][t] for s in own) for t in kept}
        p = lambda c: {t: 1 + D.SCALE * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, ps = p(total), {s: p(cell[s]) for s in own}
        for s in own:
            pair = [(sum(f(ps[s][t], ps[h][t]) for t in kept), h) for h in own if h != s]
            term = [(f(ps[s][t], q[t]), t) for t in kept if cell[s][t] and ps[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(item, lang, part, i + 1, s, v) for i, (v, item) in enumerate(found[:most])]
    return rows_of(list("abcdef"), out)


def check(spark, rows, least=3, top=4):
    out = D.divergence(spark.createDataFrame([(1, *r, 1, 2, "x", 3) for r in rows], SCHEMA), least, top)
    assert rows_of(out.columns, out.collect()) == by_hand(rows, least, top)


def test_odd_rows(spark):
    long = "é" * 700 + " " + "b" * 129 + " B" + "b" * 128
    rows = [(None, None, None), ("", "en", ""), ("12 !", "en", "s"), *[(long, "en", "a")] * 3, *[("Öl öl ÖL a", "de", None)] * 4, ("a", "de", "x"), ("word\x00word word", "fr", "only")] + [("ab abc abcd abcde ab", "en", f"s{i}") for i in range(5)]
    check(spark, rows)
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_blocks_and_tiles(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "BLOCK_TERMS", 8)
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D.sieve_of, "__defaults__", (bits,))
    rng = random.Random(bits)
    pool = ["".join(rng.choices("abü", k=rng.randrange(1, 9))) for _ in range(120)]
    rows = [(" ".join(rng.choices(pool, k=rng.randrange(40))).upper(), rng.choice(["en", "de"]), rng.choice("pqrstu")) for _ in range(200)]
    check(spark, rows)
