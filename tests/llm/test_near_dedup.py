"""Near-duplicates among templated pages, rows that share ids, and counts of shared items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapstream.llm import minhash

SCHEMA = "doc_id long, text string, row string, key int, comp int, n int, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, 3, "b") for r in rows], SCHEMA).repartition(4)


def brute(rows, words, percent):
    """Component labels by all pairs, through lists of the documents that hold each shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    where = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            where.setdefault(x, []).append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((d is None, d or 0), len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in df.collect())


def templated(n, share, options):
    """Pages of a common part and three paragraphs out of so many."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(share)]
    paragraphs = [[f"p{j}_{k}" for k in range((200 - share) // 3)] for j in range(options)]
    return [(i, " ".join([*common, *(w for j in sorted(rng.choice(options, 3, replace=False)) for w in paragraphs[j])])) for i in range(n)]


@pytest.mark.parametrize("share", [150, 172])
def test_templated_pages(spark, share):
    # Pages with two paragraphs in common are at 0.8 or above, with one or none just below: buckets are full of both.
    rows = templated(700, share, 14)
    assert result(minhash.near_duplicates(frame(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_many_templated_pages_below_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join([f"c{k}" for k in range(160)] + [f"u{rng.integers(60)}x{k}" for k in range(14)])) for i in range(5000)]
    got = minhash.near_duplicates(frame(spark, rows), 3, 85).collect()
    sets = {r["n_shingles"] for r in got}
    assert len(got) == 5000 and max(sets) <= 172
    want = brute(rows[:400], 3, 85)
    assert result(minhash.near_duplicates(frame(spark, rows[:400]), 3, 85)) == want


def test_rows_that_share_an_id(spark):
    w = [f"w{k}" for k in range(60)]
    a, b = " ".join(w), " ".join(reversed(w))
    rows = [(7, a), (7, b), (3, a), (9, b), (None, a), (None, "lone text here"), (7, a), (5, ""), (5, ""), (6, None)]
    df = frame(spark, rows)
    assert result(minhash.near_duplicates(df)) == brute(rows, 5, 80)
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == sorted([(3, a), (7, b), (0, "lone text here")])
    assert kept.where("text = ''").count() == 2 and kept.where("text is null").count() == 1


def test_equal_rows_leave_one(spark):
    w = " ".join(f"w{k}" for k in range(60))
    df = frame(spark, [(1, w), (1, w), (None, "a b c d e f g"), (None, "a b c d e f g")])
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(df).collect()) == [0, 1]
    assert minhash.deduplicated(df.where("false")).collect() == []


@pytest.mark.parametrize("groups", [1, 3])
def test_counts_of_shared_items(spark, groups):
    rng = np.random.default_rng(groups)
    pool = minhash.seeded(3000, 77)
    sets = {i: np.unique(rng.choice(pool, 200)) for i in range(60)}
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "rep long, items binary").repartition(5)
    got = {r["rep"]: (r["core"], sum(r["cells"])) for r in minhash._cores(df, df.select("rep"), groups).collect()}
    token, often = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    shared = set(token[often > 1].tolist())
    assert got == {i: (n, n) for i, s in sets.items() if (n := len(shared & set(s.tolist())))}


def test_overlaps():
    rng = np.random.default_rng(1)
    pool = minhash.seeded(9000, 3)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 5, 3000, 8000, 6000)]
    assert minhash.overlaps(sets, sets[::-1]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
