"""Chains of links in order of id, and in random order, are one group each."""

import random

import numpy as np
import pytest

from lapstream.llm import minhash, vectors
from lapstream.llm.components import components


def test_random_chains_and_graphs(spark):
    r = random.Random(3)
    links, want = [], {}
    for n in (10, 100, 100, 300, 1000):
        order = list(range(len(want), len(want) + n))
        links += list(zip(order, order[1:])) if n == 300 else []
        first = order[0]
        r.shuffle(order)
        links += list(zip(order, order[1:])) if n != 300 else []
        want |= dict.fromkeys(order, first)
    nodes = spark.createDataFrame([(i,) for i in want], "node long")
    whole = spark.createDataFrame(links, "a long, b long")
    assert {x["node"]: x["comp"] for x in components(nodes, whole).collect()} == want
    # In two steps, the second from the labels of the first.
    half = components(nodes, spark.createDataFrame(links[::2], "a long, b long"))
    assert {x["node"]: x["comp"] for x in components(None, whole, half).collect()} == want


@pytest.mark.parametrize("n", [10, 100, 1000])
def test_chain_of_vectors(spark, n):
    # Ten degrees from each vector to the next, out of one axis and into another: no others link.
    at = np.arange(n)
    v = np.zeros((n, n // 9 + 2))
    v[at, at // 9] = np.cos(np.pi / 18 * (at % 9))
    v[at, at // 9 + 1] = np.sin(np.pi / 18 * (at % 9))
    got = vectors.near_duplicate_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (2 - (i in (0, n - 1)), 0) for i in range(n)}


@pytest.mark.parametrize("n", [10, 100, 1000])
def test_chain_of_documents(spark, n):
    # Of 198 shingles a text shares 188 with the next one (0.90), 178 with the one after that (0.82).
    rows = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 200))) for i in range(n)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict.fromkeys(range(n), 0)
