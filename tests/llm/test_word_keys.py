"""Keys of words: words that sums over letters confuse are told apart, in near-duplicates and in repeats."""

import numpy as np

from lapstream.llm import common, minhash, repeats


def keys(words, **kw):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = common.word_spans(raw, np.array([0, len(raw)]))
    return common.word_keys(raw, starts, ends, **kw).tolist()


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_are_told_apart():
    pool = ["a", "b", "ab", "ba", "abcdefgh", "abcdefgi", "abcdefghi", "abcdefghj", "x" * 255, "x" * 256, "x" * 257, "x" * 258, thue_morse(1024), thue_morse(1024, "ba"), thue_morse(256), thue_morse(256, "ba"), "é", "è"]
    for again in (False, True):
        got = keys(pool * 2, again=again)
        assert got[: len(pool)] == got[len(pool) :] and len(set(got)) == len(pool)
    assert not set(keys(pool)) & set(keys(pool, again=True))
    assert keys(["ABCdef", "É" + "Q" * 300], lower=True) == keys(["abcdef", "É" + "q" * 300])


def test_operators(spark):
    around = [f"w{i}" for i in range(20)]
    texts = [" ".join([*around, thue_morse(1024, x), *[f"v{i}" for i in range(20)]]) for x in ("ab", "ba")]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.remove_repeats(df, 35).collect()] == [0, 0]
    one = spark.createDataFrame([(1, thue_morse(1024)), (2, thue_morse(1024, "ba")), (3, thue_morse(1024).upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(one).collect()} == {1: 1, 2: 2, 3: 1}
