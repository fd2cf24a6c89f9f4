"""Counts of kept terms are dealt as blocks: few rows are shuffled, and blocks put together many times give the same counts."""

import random

from test_divergence import SCHEMA, check
from lapstream.llm import divergence as D


def rows():
    rng = random.Random(7)
    pool = ["".join(rng.choices("abü", k=rng.randrange(1, 9))) for _ in range(90)]
    return [(" ".join(rng.choices(pool, k=rng.randrange(40))), rng.choice(["en", None]), rng.choice("pqrst")) for _ in range(150)]


def test_put_together_many_times(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_TERMS", 8)
    monkeypatch.setattr(D, "TILE", 2)
    monkeypatch.setattr(D, "MERGED", 5)
    monkeypatch.setattr(D, "CHUNK_TERMS", 60)
    check(spark, rows())


def test_no_row_for_each_count_is_shuffled(spark):
    chunks = D.term_chunks(spark.createDataFrame([(1, *r, 1, 2, "x", 3) for r in rows()], SCHEMA))
    kept, groups = D.kept_terms(chunks, 3), chunks.selectExpr("lang", "explode(sources) as source").distinct()
    plan = D.term_counts(chunks, kept, groups)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lang" not in plan and "RepartitionByExpression [lang" in plan
