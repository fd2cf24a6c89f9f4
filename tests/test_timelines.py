"""Rolling windows and slices over one long timeline, dealt over many ranges, against one pass in order."""

import random

from lapstream.operators import evaluation as E


def test_rolling_agreement_crosses_ranges(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(2), rng.choice([0, 1, 1, None])) for g, n in (("a", 1000), ("b", 30), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "model string, i int, target_y int, pred int")
    got = {(r["model"], r["i"]): (r["n"], r["accuracy"], r["kappa"]) for r in E.rolling_agreement(df, "model", ["i"], 300, 20).collect()}
    want = {}
    for g, i, *_ in rows:
        part = [(y, p) for h, j, y, p in rows if h == g and i - 300 < j <= i and p is not None]
        n = len(part)
        if n >= 20:
            acc, ty, tp = sum(y == p for y, p in part) / n, sum(y for y, _ in part) / n, sum(p for _, p in part) / n
            chance = ty * tp + (1 - ty) * (1 - tp)
            want[g, i] = (n, round(acc, 6), round((acc - chance) / (1 - chance), 6) if chance != 1 else None)
    assert got.keys() == want.keys()
    assert all(a == b or max(abs(x - y) for x, y in zip(a, b)) < 2e-6 for a, b in ((got[k], want[k]) for k in got))


def test_slices(spark):
    df = spark.createDataFrame([("a", i) for i in range(103)] + [("b", i) for i in range(7)] + [("c", 0)], "model string, i int")
    got = {(r["model"], r["i"]): r["window"] for r in E.chronological_windows(df, "model", ["i"], 4, 2).collect()}
    want = {("a", i): i * 4 // 103 for i in range(103)} | {("b", i): i * 4 // 7 for i in range(7) if i != 99} | {("c", 0): 0}
    want = {k: v for k, v in want.items() if k[0] != "b" or sum(j * 4 // 7 == v for j in range(7)) >= 2}
    assert got == want
