"""Each stage of the pipeline and all of them on odd rows, by what a stage must keep, drop and change."""

import re

import corpus_pipeline as P
from lapstream.llm import language, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the river runs through a quiet valley where people walk and talk about the weather every evening".split(),
    "de": "der fluss zieht durch ein stilles tal und die leute gehen dort jeden abend spazieren über wiesen".split(),
}


def odd_rows():
    rows = [(i, " ".join(WORDS[g][(i * 7 + k * (i % 5 + 1)) % 17] for k in range(60 + i)), g, f"s{i % 3}" if i % 4 else None) for i, g in enumerate(["en", "de"] * 20)]
    rows += [(100, rows[3][1], "de", "s1"), (100, rows[3][1], "de", "s1"), (None, rows[4][1] + " more", "en", None), (101, None, None, None), (102, "", "en", "s0"), (103, "12 !", "de", "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = P.language_id(spark, docs, "")
    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    comps = {(r["doc_id"]): r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    one = P.near_dedup(spark, docs, "")
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({comps[i] for i in comps if i is not None and comps[i] is not None and i not in (101, 102)} | {101, 102})
    masked = P.secret_scan(spark, docs, "")
    assert sorted(map(str, map(tuple, masked.collect()))) == sorted(map(str, [(*r[:4], len(r[1]) if r[1] is not None else None) for r in rows]))
    mixed = P.mix(spark, docs, "").collect()
    size = lambda rs: {s: sum(len((r["text"] or "").split()) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}}
    have, got = size(docs.collect()), size(mixed)
    assert all(got[s] <= 2 * have[s] for s in got) and abs(sum(got.values()) - 1.5 * sum(have.values())) <= len(have)
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    pieces = P.pack(spark, docs, "").collect()
    assert all(r["length"] <= 1024 for r in pieces) and sum(1 for r in pieces if r["doc_id"] == 100 and r["start"] == 0) == 2
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), "").collect() == []


def test_run(spark, tmp_path):
    """What comes out is made of the documents that language, near-duplicates and the mix leave."""
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in P.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
    out = P.run(spark, str(tmp_path)).collect()
    left = step.collect()
    assert sorted({str(r["doc_id"]) for r in out}) == sorted({str(r["doc_id"]) for r in left})
    assert sum(r["start"] == 0 for r in out) == len(left)
    assert language.UNKNOWN not in {r["lang_pred"] for r in language.identify(step).collect()}
