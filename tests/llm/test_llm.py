"""Operators on text and vectors against brute force on small tables, with nulls, ties and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows_of
from lapstream.llm import language, minhash, mixing, packing, repeats, secrets, toxicity, urls, vectors
from lapstream.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, size int, row string"


def docs(spark, rows):
    """(doc_id, text, lang, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], DOCS)


W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", None), (None, "one", "en", "b"), (5, " ".join(W * 40), "en", "a"), (6, " ".join(W * 40), "en", "a"), (6, " ".join(W * 40), "en", "a"), (7, "One", "de", "b"), (8, "x " * 30_000, "fr", "c")]


def all_ops(df):
    labels = df.sparkSession.createDataFrame([(1, 0), (5, 1), (5, 1)], "doc_id long, toxic int")
    return {
        "minhash": lambda: minhash.near_duplicates(df), "repeats": lambda: repeats.remove_repeats(df, 35), "mix": lambda: mixing.mix_sources(df), "mixed": lambda: mixing.mixed(df), "pack": lambda: packing.packed(df),
        "language": lambda: language.identify(df), "toxicity": lambda: toxicity.score_toxicity(df, labels), "secrets": lambda: secrets.scan_secrets(df), "redacted": lambda: secrets.redacted(df),
    }


def test_odd_and_empty_tables(spark):
    df = docs(spark, ODD)
    got = {k: f().collect() for k, f in all_ops(df).items()}
    for k in ("minhash", "repeats", "mix", "language", "toxicity", "redacted"):
        assert len(got[k]) == len(ODD), k
    comp = {r["doc_id"]: r["component_id"] for r in got["minhash"]}
    assert comp[5] == comp[6] == 5 and comp[4] == comp[7] == comp[None] == 4 and comp[2] == 2
    assert {r["doc_id"] for r in got["language"] if r["lang_pred"] == "und"} == {1, 2, 3}
    for k, f in all_ops(df.where("false")).items():
        assert f().collect() == [], k


def test_near_duplicates(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    sets, up = {}, {}
    for r in df.select("doc_id", "text").collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x.decode()) for x in (r["text"] or "").encode().split()]
        sets[r["doc_id"]] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}
        up[r["doc_id"]] = r["doc_id"]

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op1_minhash_near_dedup"](spark, DATA).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_a_chain_of_copies_is_one_group(spark):
    rows = []
    for i in range(60):
        w = [f"w{j}" for j in range(200)]
        for j in range(i % 6):
            w[(i * 37 + j * 31) % 200] = f"e{i}_{j}"
        rows.append((i, " ".join(w), "en", "a"))
    want = {}
    sets = {r[0]: {tuple(r[1].split()[k : k + 3]) for k in range(198)} for r in rows}
    up = {i: i for i in sets}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    want = {i: top(i) for i in sets}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()}
    assert got == want


def brute_repeats(texts, n):
    seen = collections.Counter(tuple(t[k : k + n]) for _, t in texts for k in range(len(t) - n + 1))
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if seen[tuple(t[k : k + n])] > 1:
                gone[k : k + n] = True
        yield i, len(t), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()


def test_repeats(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(90)), "en", "a") for i in range(20)]
    shared = " ".join(f"s{k}" for k in range(40))
    rows += [(100 + i, f"p{i} {shared} q{i}", "en", "a") for i in range(5)] + [(200, "a " * 36, "en", "a"), (201, "a " * 35, "en", "a"), (202, "b " * 35, "en", "a"), (203, "c d " * 40, "en", "a")]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs(spark, rows), 35, chunks=5).collect()]
    assert sorted(got) == sorted(brute_repeats([(r[0], r[1].encode().split()) for r in rows], 35))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_mixed_words(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = mixing.mix_sources(df).agg(F.sum("taken")).first()[0]
    assert mixing.mixed(df).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == plan


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()} | {-1: "a<|endoftext|>b", -2: "tab wide ١٢  x"}
    df = docs(spark, [(k, v, "en", "a") for k, v in rows.items()])
    ids = {k: np.array([*t.encode(v, add_special_tokens=False).ids, 0], "<u4") for k, v in rows.items()}
    out = packing.packed(df).collect()
    for r in out:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in out) == sum(map(len, ids.values()))
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes.append(at)
    assert max(sizes) <= 1024
    assert sum(0 if s & (s - 1) == 0 else 1024 - s for s in sizes) <= 0.02 * sum(sizes)


def test_cuts_are_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))]))
        cost = rng.integers(0, 5, len(at)).astype(float)
        got = packing.cheapest_cuts(at, cost, 16)
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + pad(int(at[j] - at[i])) + cost[j] for i in range(j) if at[j] - at[i] <= 16))
        total = sum(pad(int(b - a)) + cost[np.searchsorted(at, b)] for a, b in zip(got[:-1], got[1:], strict=True))
        assert total == best[-1]


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    r = QUERIES["op6_language_id"](spark, DATA).join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.95


def test_restoring(spark):
    lm = toxicity.language_model(docs(spark, [(i, "the idiot was a loser and the moron went to the trash of stupid pathetic people", "en", "a") for i in range(5)]))
    for bad, good in [("1d10t", "idiot"), ("l0s3r", "loser"), ("m o r o n", "moron"), ("stuuupid", "stupid"), ("tr@sh", "trash")]:
        assert toxicity.restore(f"so {bad} there", lm, {}) == f"so {good} there"
    assert toxicity.restore("a plain text, no more", lm, {}) == "a plain text, no more"


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=8) * 0.05 * (i % 3)], int(i % 2)) for i in range(160)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, rows[0][1], None), (1004, rows[0][1], 0), (1004, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    good = [r for r in rows if r[0] < 1000 or r[0] == 1004]
    m = np.array([r[1] for r in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.98) & np.equal.outer([r[2] for r in good], [r[2] for r in good])
    n = collections.defaultdict(set)
    for r, k in zip(good, link.sum(1) - 1, strict=True):
        n[r[0]].add(int(k))
    assert all(r["n_links"] in n.get(r["vec_id"], {0}) for r in got)
    near = vectors.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    for q in {r["query_id"] for r in near}:
        mine = [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])]
        v = np.array(dict((r[0], r[1]) for r in rows)[q])
        want = sorted((float(np.sqrt(((np.array(r[1]) - v) ** 2).sum())), r[0]) for r in {r[0]: r for r in rows if r[0] != q and r[0] not in (1000, 1001, 1002)}.values())[:5]
        assert mine == [i for _, i in want]
    none = df.where("false")
    assert vectors.near_duplicate_vectors(none).collect() == [] and vectors.nearest(none, F.lit(True)).collect() == []


def test_urls(spark):
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "https://WWW.Example.com/en/x"), (2, "http://example.com/en/"), (3, "http://a.b.com"), (4, None), (5, "x"), (6, "http://notexample.com/en/?q"), (7, "http://net/fr/1#a"), (7, "http://y.net/de/")], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in urls.judge_urls(pages, rules).collect())
    assert got == [(1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "", "allow"), (4, "", "allow"), (5, "", "allow"), (6, "com/", "allow"), (7, "", "allow"), (7, "net/fr/", "block")]
    assert urls.judge_urls(pages, rules.where("false")).count() == 8 and urls.judge_urls(pages.where("false"), rules).collect() == []


def test_many_nested_url_rules(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ab/"), n))
    hosts = ["x", "a.x", "b.a.x", "c.x", "y", "a.y", "xx"]
    rules = sorted({(str(rng.choice(hosts)), "/" + word(int(rng.integers(0, 4))), "block" if i % 2 else "allow") for i in range(60)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = [(i, f"http://{rng.choice([*hosts, 'z', 'w.b.a.x'])}{'/' + word(5) if i % 9 else ''}") for i in range(500)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in pages:
        host, _, path = url.removeprefix("http://").partition("/")
        path = "/" + path if url.count("/") > 2 else ""
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        assert got[i] == (max(fit)[2:] if fit else (None, urls.DEFAULT))


def test_pipeline_keeps_ids(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = stages["near_dedup"](spark, d, DATA)
    want = minhash.near_duplicates(d).where("kept").select("doc_id")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in want.collect()) and kept.columns == d.columns
