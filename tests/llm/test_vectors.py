"""Near-duplicates and neighbours of vectors through several cells and parts, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from lapstream.llm import vectors
from lapstream.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, v int, cell int, q boolean, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, True, 3) for r in rows], SCHEMA).repartition(4)


def brute_links(rows, least):
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= least) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    np.fill_diagonal(link, False)
    comp = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == comp).all():
            return sorted((r[0], int(n), int(c), r[0] == c) for r, n, c in zip(rows, link.sum(axis=1), comp, strict=True))
        comp = new


def test_links_across_cells(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(i, (base[i % 300] + rng.normal(size=16) * 0.12).tolist(), i % 3) for i in range(900)]
    # A path over the sphere crosses cells link by link.
    path = [np.array([np.cos(t), np.sin(t), *[0.0] * 14]) for t in np.linspace(0, 3, 60)]
    rows += [(2000 - i, v.tolist(), 0) for i, v in enumerate(path)]
    got = vectors.near_duplicate_vectors(frame(spark, rows), per_cell=16)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows, 0.98)


def test_one_id_with_two_vectors(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (7, [0.0, 1.0], 0), (3, [1.0, 0.001], 0)]
    got = vectors.near_duplicate_vectors(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 1, 5), (7, 1, 5)]


def test_vectors_of_the_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_embedding_near_dedup"](spark, DATA).collect()) == brute_links(rows, 0.98)


def brute_nearest(rows, queries, k):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in queries:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        yield q, [int(i) for i in ids[order] if i != q][:k]


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(4)
    clusters = rng.normal(size=(40, 32))
    for scale in (0.5, 30.0):
        rows = [(i, (clusters[i % 40] * (1 + i % 3) + rng.normal(size=32) * scale).tolist(), 0) for i in range(4000)]
        got = vectors.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, per_part=100).collect()
        mine = {}
        for r in got:
            mine.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = dict(brute_nearest(rows, range(0, 4000, 100), 10))
        assert all(len(x) == 10 for x in mine.values()) and len(mine) == 40
        assert sum(len(mine[q] & set(w)) for q, w in want.items()) / 400 >= 0.9


def test_small_parts_give_all_candidates(spark):
    rows = [(i, [float(i % 5), 1.0], 0) for i in range(9)]
    got = vectors.nearest(frame(spark, rows), F.col("vec_id") == 0, per_part=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == brute_nearest(rows, [0], 10).__next__()[1]


def test_rows_that_share_an_id_all_take_part(spark):
    rows = [(100, [0.0, 1.0]), (1, [5.0, 5.0]), (1, [0.0, 2.0]), (200, [9.0, 9.0]), (200, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect()
    of = lambda q: sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in got if r["query_id"] == q)
    far = lambda a: sorted((round(sum((x - y) ** 2 for x, y in zip(a, v)) ** 0.5, 6), i) for i, v in rows if v != a)
    assert of(100) == [(k + 1, i, d) for k, (d, i) in enumerate(far([0.0, 1.0]))]
    assert of(200) == sorted((k + 1, i, d) for a in ([9.0, 9.0], [0.0, 3.0]) for k, (d, i) in enumerate(far(a)))
