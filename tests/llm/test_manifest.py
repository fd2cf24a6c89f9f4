"""The Merkle manifest against a tree built by hand, over groups of many sizes and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lapstream.llm import manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, node string, idx long, keep int, total int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def by_hand(rows):
    """{(doc_id, leaf): (subroot, root, siblings)} of (doc_id, lang, leaf)."""

    def build(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, i):
        out = []
        for k, level in enumerate(levels[:-1]):
            at = i // 8**k
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            out += run[: at % 8] + run[at % 8 + 1 :]
        return out

    langs = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in langs:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = own, build([r[2] for r in own])
    crown = build([trees[g][1][-1][0] for g in langs])
    for k, g in enumerate(langs):
        own, levels = trees[g]
        for i, r in enumerate(own):
            out.append((r[0], r[2], levels[-1][0], crown[-1][0], h("".join(siblings(levels, i) + siblings(crown, k)))))
    return sorted(out, key=str)


def leaf(doc_id, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def manifest(df):
    return M.manifest(df, F.col("lang"), ["doc_id"], M.leaf_of([F.col(c) for c in M.FIELDS]), [F.col("doc_id")])


def got(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["p"]) for r in manifest(df).withColumn("p", M.proof(F.col("segments"))).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9, "b": 1, None: 8, "": 2}, {"a": 600, "b": 513, "c": 512, "d": 64}, {f"l{i}": 3 for i in range(70)}])
def test_by_hand(spark, sizes):
    rows = [(i if i % 7 else None, f"t{i % 50}", g, None if i % 3 else "sé", i) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "g", "n", 1, 2, 3) for r in rows], SCHEMA)
    assert got(df) == by_hand([(r[0], r[2], leaf(*r)) for r in rows])


def test_floors(spark, monkeypatch):
    """Blocks of eight leaves: several floors of blocks, groups that end on different ones."""
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = [(i, "t", g, None, 1) for g, n in {"a": 700, "b": 65, "c": 8, "d": 1, "e": 9}.items() for i in range(n)]
    df = spark.createDataFrame([(*r, "g", "n", 1, 2, 3) for r in rows], SCHEMA)
    assert got(df) == by_hand([(r[0], r[2], leaf(*r)) for r in rows])


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, long texts; tampering is found, and an untouched row leads to the root."""
    rows = [(None, None, None, None, None)] * 3 + [(5, "", "en", "", 0), (5, "", "en", "", 0), (6, "x" * 300_000, "en", "s", 1), (-7, "y", "en", "s", None)]
    df = spark.createDataFrame([(*r, "g", "n", 1, 2, 3) for r in rows], SCHEMA)
    assert got(df) == by_hand([(r[0], r[2], leaf(*r)) for r in rows])
    folded = manifest(df).select("root", M.fold(F.col("leaf"), F.col("segments")).alias("own"), M.fold(M.digest(F.lit("other")), F.col("segments")).alias("other")).collect()
    assert all(r["own"] == r["root"] != r["other"] for r in folded)
    assert manifest(df.where("false")).collect() == []
