"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeded, table

#: Length of the hypervectors.
DIMENSION = 512
#: Letters: 0 for what stands between words, 1-26 for a-z, the rest for other letters by a fixed rule on the code point.
LETTERS = 96
UNKNOWN = "und"


def _letter_vectors() -> np.ndarray:
    bits = seeded(LETTERS * DIMENSION, 41).reshape(LETTERS, DIMENSION) & np.uint64(1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


_V = _letter_vectors()
_FIRST, _SECOND, _THIRD = np.roll(_V, 2, axis=1), np.roll(_V, 1, axis=1), _V


def bound(grams: np.ndarray) -> np.ndarray:
    """Letter trigrams as vectors: the letters' vectors, shifted by their places, bound by multiplication."""
    return (_FIRST[grams // (LETTERS * LETTERS)] * _SECOND[grams // LETTERS % LETTERS] * _THIRD[grams % LETTERS]).astype(np.float32)


def _codes() -> np.ndarray:
    """Letter number of each code point of the basic plane; small letters stand for capitals."""
    out = np.zeros(1 << 16, dtype=np.int32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            o = ord(low) if len(low) == 1 else ord(low[0])
            out[c] = o - 96 if 97 <= o <= 122 else 27 + (o * 40503 >> 4) % (LETTERS - 27)
    return out


_CODES: list[np.ndarray] = []


def trigrams(text: str | None) -> np.ndarray:
    """Numbers of all letter trigrams of a whole text, words padded by one blank on each side; none without a letter."""
    if not text:
        return np.zeros(0, np.int32)
    if not _CODES:
        _CODES.append(_codes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = points >= 1 << 16
    c = _CODES[0][np.where(high, 0, points)]
    if high.any():
        for i in np.flatnonzero(high).tolist():
            if chr(points[i]).isalpha():
                c[i] = 27 + int(points[i]) % (LETTERS - 27)
    if not c.any():
        return np.zeros(0, np.int32)
    c = np.concatenate([np.zeros(1, np.int32), c, np.zeros(1, np.int32)])
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    grams = c[:-2] * (LETTERS * LETTERS) + c[1:-1] * LETTERS + c[2:]
    return grams[c[1:-1] != 0]


def profiles(docs: DataFrame, learn) -> dict[str, np.ndarray]:
    """A prototype for each language: the bundle of all trigram vectors of its documents where ``learn`` holds.

    Bundling is addition, so each task counts trigrams by language and sends one vector a language; Spark adds
    them by place. What comes to the driver is one vector for each language value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle() -> None:
            for lang, c in counts.items():
                used = np.flatnonzero(c)
                for i in range(0, len(used), 4096):
                    g = used[i : i + 4096]
                    sums[lang] = sums.get(lang, np.zeros(DIMENSION)) + c[g] @ bound(g)
            counts.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                held: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(some.column("lang").to_pylist(), some.column("text"), strict=True):
                    held.setdefault(lang, []).append(trigrams(text.as_py()))
                for lang, grams in held.items():
                    if len(counts) >= 8 and lang not in counts:
                        bundle()
                    counts.setdefault(lang, np.zeros(LETTERS**3, np.float64))
                    counts[lang] += np.bincount(np.concatenate(grams), minlength=LETTERS**3)
        bundle()
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([x for x in names for _ in range(DIMENSION)], pa.string()), pa.array(list(range(DIMENSION)) * len(names), pa.int32()), pa.array(np.concatenate([np.zeros(0), *(sums[x] for x in names)]), pa.float64())], names=["lang", "place", "value"])

    taught = docs.where(learn).where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = taught.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSION))[r["place"]] = r["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, learn=None, keep: bool = False) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text; lang only to learn from).

    ``learn`` says which rows the profiles are learned from (all rows by default; null languages and texts never
    count). Returns doc_id, lang_pred and score, the cosine between the document's bundle and the prototype, cut
    at 0; with ``keep`` the input's columns under ``row`` instead of doc_id. A text that is null or has no letter,
    and any text if nothing could be learned, gets ``und`` and 0. Rows with a null or repeated doc_id are rows like
    others; an empty table gives an empty result.
    """
    known = profiles(docs, F.lit(True) if learn is None else learn)
    names = np.array([*known, UNKNOWN], dtype=object)
    matrix = np.array([known[k] for k in known], dtype=np.float32).reshape(-1, DIMENSION).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = np.zeros((0, DIMENSION), np.float32)
        place = np.full(LETTERS**3, -1, dtype=np.int32)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                g = trigrams(text.as_py())
                best, score = len(names) - 1, 0.0
                if len(g) and matrix.shape[1]:
                    used, count = np.unique(g, return_counts=True)
                    new = used[place[used] < 0]
                    if len(new):
                        if len(cache) > 20_000:
                            cache = cache[:0]
                            place[:] = -1
                            new = used
                        place[new] = np.arange(len(cache), len(cache) + len(new))
                        cache = np.concatenate([cache, bound(new)])
                    v = count.astype(np.float32) @ cache[place[used]]
                    cosine = v @ matrix / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(np.argmax(cosine))
                    score = min(1.0, max(0.0, float(cosine[best])))
                langs.append(names[best])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[first, "lang_pred", "score"])

    first = "row" if keep else "doc_id"
    head = F.struct("*").alias("row") if keep else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(head, F.col("text").cast("string").alias("text"))
    kind = rows.schema[first].dataType.simpleString()
    return rows.mapInArrow(run, f"{first} {kind}, lang_pred string, score double")


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, learn=~held_out("doc_id", 4, 2))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
