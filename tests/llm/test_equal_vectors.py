"""Nearest neighbours where many vectors are equally near, or nearer to each other than rough distances tell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapstream.llm import vectors


@pytest.mark.parametrize("copies", [100, 1500])
def test_ties_go_to_smaller_ids(spark, copies):
    rng = np.random.default_rng(copies)
    # Far from the origin, so that rough distances of the near copies are rounding alone.
    base = rng.normal(size=8) * 1e3
    m = [base] * copies + [base + rng.normal(size=8) * 1e-6 for _ in range(100)] + list(rng.normal(size=(200, 8)))
    ids = rng.permutation(len(m)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<double>")
    asks = [*ids[:3], *ids[copies : copies + 3], ids[-1]]
    got = vectors.nearest(df, F.col("vec_id").isin(asks), k=10).collect()
    for q in asks:
        d = np.sqrt(((np.array(m) - m[ids.index(q)]) ** 2).sum(axis=1))
        want = sorted((x, i) for x, i in zip(d.tolist(), ids, strict=True) if i != q)[:10]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]
