"""A passage after a long run of one word, and again after a shorter one."""

import random

import pytest

from lapstream.llm import repeats
from test_llm import brute_repeats, docs


@pytest.mark.parametrize("runs", [(20, 8), (13, 12), (40, 3), (60, 34)])
def test_passage_after_runs(spark, runs):
    r = random.Random(sum(runs))
    rows = []
    for k in range(20):
        passage = [f"p{r.randrange(10**6)}" for _ in range(27)]
        rows += [(3 * k + i, " ".join([f"a{k}_{i}", *["-"] * n, *passage, f"b{k}_{i}"]), "en", "a") for i, n in enumerate(runs)]
        rows += [(1000 + 3 * k + i, " ".join([f"c{k}_{i}", *passage[::-1], *["-"] * n, f"d{k}_{i}"]), "en", "a") for i, n in enumerate(runs)]
    got = [(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in repeats.remove_repeats(docs(spark, rows), 35, chunks=5).collect()]
    assert sorted(got) == sorted(brute_repeats([(x[0], x[1].encode().split()) for x in rows], 35))
