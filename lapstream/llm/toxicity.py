"""Toxicity of texts after noisy-channel deobfuscation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import slices, table, word_hashes
from .language import LETTERS, held_out, trigrams

#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Costs (negative logarithms) of the channel: a stand-in, a symbol that is no letter, a repeated letter, a blank that was lost.
STAND_IN, NO_LETTER, REPEATED, LOST_BLANK = 0.7, 7.0, 1.0, 6.0
FEATURE_BITS = 18
#: Folds of the labelled documents that calibrate the scores.
FOLDS = 5
#: Labelled documents that the weights are fitted on: those whose ids hash lowest, at most so many.
TRAIN_DOCS = 20_000
#: Of a bucket against the labels; below it a bucket has no weight. Hundreds of thousands of buckets are tried.
CHI_SQUARE = 30.0
#: Log odds below which a bucket is left out: twelve times likelier in one class.
LEAST_WEIGHT = 2.5
_SYMBOLS = "0-9@$!|+€"
_BETWEEN = r"[ ._\-*]"


def _suspects(letter: str, sign: str) -> re.Pattern:
    """Spans of lower-case text whose lattices have more than one path, sought only where a run of letters and signs
    begins, and never twice in one run: the time grows with the text's length.

    Single letters or stand-ins, three or more, with one to three separators between them; runs in which letters and
    stand-ins meet (letters before nothing but ``!`` are plain); and runs of letters with a letter doubled.
    """
    lone = rf"(?:{sign}|[@$!|+€])(?!{sign}|[@$!|+€])"
    return re.compile(
        r"(?<![\w@$!|+€])(?:"
        rf"{lone}(?:{_BETWEEN}{{1,3}}+{lone}){{2,}}+"
        rf"|(?:{letter}++(?!!++(?![\w@$|+€]))[{_SYMBOLS}]|[{_SYMBOLS}]++{letter}|{letter}*?({letter})\1)[\w@$!|+€]*+)"
    )


SUSPECT = _suspects(r"[^\W\d_]", r"[^\W_]")
#: The same for texts of ASCII alone.
SUSPECT_ASCII = _suspects("[a-z]", "[a-z0-9]")
_SPACED = re.compile(rf"(?:[^\W_]|[@$!|+€])(?:{_BETWEEN}{{1,3}}(?:[^\W_]|[@$!|+€]))+")


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities of letters after two letters, from the trigrams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(LETTERS**3, dtype=np.int64)
        for batch in batches:
            held: list[np.ndarray] = []
            for text in batch.column("text"):
                held.append(trigrams(text.as_py()))
            if held:
                count += np.bincount(np.concatenate(held), minlength=LETTERS**3)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    count = np.full(LETTERS**3, 0.05)
    count[rows.column("gram").to_numpy()] += rows.column("n").to_numpy()
    count = count.reshape(-1, LETTERS)
    return (-np.log(count / count.sum(axis=1, keepdims=True))).astype(np.float32).reshape(LETTERS, LETTERS, LETTERS)


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else int(trigrams(c)[0]) // LETTERS % LETTERS if c.isalpha() else 0


def lattice(span: str) -> tuple[list[list[tuple[str, int, float]]], bool]:
    """For each sign of a span what it may be: (letter or blank, its number, cost); and whether blanks may be lost."""
    spaced = _SPACED.fullmatch(span) is not None
    out = []
    for c in span:
        if spaced and c in " ._-*":
            continue
        may = [(c, 0.0)] if c.isalpha() else [(x, STAND_IN) for x in LEET.get(c, "")] + [(" ", NO_LETTER)]
        out.append([(x, _letter(x), fee) for x, fee in may])
    return out, spaced


def decode(span: str, lm: np.ndarray) -> str:
    """The likeliest text behind a suspect span: Viterbi over the two last letters of what is restored, all of them.

    A span without a letter or a stand-in for one is left as it is. ``!`` at the end of a run stays punctuation."""
    body = span.rstrip("!")
    tail = span[len(body) :]
    if not any(c.isalpha() for c in body):
        return span
    signs, spaced = lattice(body)
    # state: the last two letters; value: cost, and the restored text as a linked list.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in signs:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(key, cost, text, new=new):
            if key not in new or cost < new[key][0]:
                new[key] = (cost, text)

        for (a, b), (cost, text) in states.items():
            for x, n, fee in choices:
                if n and n == b:
                    put((a, b), cost + fee + REPEATED, text)
                if n or b:
                    put((b, n), cost + fee + float(lm[a, b, n]), (text, x))
                else:
                    put((a, b), cost + fee, text)
                if spaced and b and n:
                    put((0, n), cost + LOST_BLANK + fee + float(lm[a, b, 0]) + float(lm[0, 0, n]), (text, " " + x))
        states = new
    best = min(((cost + float(lm[a, b, 0]), (a, b)) for (a, b), (cost, _) in states.items()))[1]
    node, back = states[best][1], []
    while node is not None:
        node, x = node
        back.append(x)
    return "".join(reversed(back)) + tail


def restore(text: str, lm: np.ndarray, cache: dict[str, str]) -> str:
    """The lower-cased text with its suspect spans decoded."""

    def one(m: re.Match) -> str:
        s = m[0]
        got = cache.get(s)
        if got is None:
            got = decode(s, lm)
            if len(s) <= 64:
                if len(cache) > 50_000:
                    cache.clear()
                cache[s] = got
        return got

    text = text.lower()
    return (SUSPECT_ASCII if text.isascii() else SUSPECT).sub(one, text)


_NO_WORD = np.ones(256, dtype=bool)
_NO_WORD[65:91] = _NO_WORD[97:123] = False
_NO_WORD[128:] = False


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the distinct buckets of its words and of their first four and five bytes."""
    for _, _, raw, offsets in slices(pa.array(texts, pa.string())):
        starts, ends, first = common.word_spans(raw, offsets, _NO_WORD)
        hashes = [word_hashes(raw, starts, np.minimum(ends, starts + n) if n else ends, lower=True) * np.uint64(2 * n + 1) >> np.uint64(64 - FEATURE_BITS) for n in (0, 4, 5)]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([h[i:j] for h in hashes])).astype(np.int64)


def weights_of(count: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from its document frequencies in the two classes (2 x buckets, the last one all
    documents), for buckets that tell the classes apart well beyond chance."""
    total = count[:, -1:]
    p = (count + 0.5) / (total + 1.0)
    weight = np.log(p[1] / p[0])
    n, both = total.sum(), count.sum(axis=0)
    cross = count[1] * (total[0, 0] - count[0]) - count[0] * (total[1, 0] - count[1])
    chance = np.maximum(total[0, 0] * total[1, 0] * both * (n - both), 1.0)
    weight[(np.abs(weight) < LEAST_WEIGHT) | (n * cross**2 / chance < CHI_SQUARE)] = 0.0
    return weight[:-1].astype(np.float32)


def learned(docs: DataFrame, labels: DataFrame, lm: np.ndarray, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float, float]:
    """Weights of the feature buckets, and slope and base of the score, from at most ``most`` labelled documents.

    The curve from evidence to score is fitted on evidence of documents that the weights behind it have not seen:
    each of ``FOLDS`` folds is weighed by the others. The weights returned are those of all folds together."""
    some = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((FOLDS, 2, (1 << FEATURE_BITS) + 1), dtype=np.int32)
        cache: dict[str, str] = {}
        for batch in batches:
            texts = [restore(x or "", lm, cache) for x in batch.column("text").to_pylist()]
            for f, y, k in zip(features(texts), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                count[k, int(y > 0), f] += 1
                count[k, int(y > 0), -1] += 1
        fold, used = np.nonzero(count.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(used, pa.int32()), pa.array(count[fold, 0, used], pa.int64()), pa.array(count[fold, 1, used], pa.int64())], names=["fold", "bucket", "clean", "toxic"])

    got = rows.mapInArrow(run, "fold int, bucket int, clean long, toxic long").groupBy("fold", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    count = np.zeros((FOLDS, 2, (1 << FEATURE_BITS) + 1))
    fold, bucket = got.column("fold").to_numpy(), got.column("bucket").to_numpy()
    count[fold, 0, bucket] = got.column("clean").to_numpy()
    count[fold, 1, bucket] = got.column("toxic").to_numpy()
    whole = count.sum(axis=0)
    unseen = [weights_of(whole - c) for c in count]
    kept = [(np.flatnonzero(w), w[w != 0]) for w in unseen]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        weight = np.zeros((FOLDS, 1 << FEATURE_BITS), np.float32)
        for k, (at, w) in enumerate(kept):
            weight[k, at] = w
        for batch in batches:
            texts = [restore(x or "", lm, cache) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(weight[k, f].sum()) for f, k in zip(features(texts), batch.column("fold").to_pylist(), strict=True)], pa.float64()), batch.column("toxic")], names=["x", "toxic"])

    sample = rows.mapInArrow(evidence, "x double, toxic int").toArrow()
    return weights_of(whole), *_platt(sample.column("x").to_numpy(), (sample.column("toxic").to_numpy() > 0).astype(float))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve from evidence to label; lightly held to slope 1."""
    slope, base = 1.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -40, 40)))
        v = p * (1 - p)
        g = np.array([((y - p) * x).sum() - (slope - 1), (y - p).sum()])
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, base = slope + step[0], base + step[1]
    return float(slope), float(base)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) for every text of ``docs`` (doc_id, text), learned from
    ``labels`` (doc_id, toxic).

    Suspect spans of each whole text (letters that meet stand-ins, spaced-out letters and stand-ins, doubled letters)
    are restored by Viterbi decoding of their lattices under a letter model of all texts; any other word has one path
    and stays. Very long texts and very long spans cost time in proportion to their length. Weights of the restored words and word beginnings are fitted on at most ``TRAIN_DOCS``
    labelled documents. Null and empty texts get the score of a text without evidence; rows repeated with one doc_id
    are scored each; of labels repeated with one doc_id the higher counts; without labels every score is 0.5.
    """
    lm = language_model(docs)
    weight, slope, base = learned(docs, labels, lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            out = np.zeros(batch.num_rows)
            column = batch.column("text")
            for i in range(0, batch.num_rows, 256):
                texts = [restore(x or "", lm, cache) for x in column.slice(i, 256).to_pylist()]
                out[i : i + len(texts)] = [weight[f].sum() for f in features(texts)]
            score = 1 / (1 + np.exp(-np.clip(slope * out + base, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 5, 0))
    return score_toxicity(docs, labels).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
