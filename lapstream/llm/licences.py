"""Licence scans with a positional index of each template's rarest words; native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Base phrases: every place of theirs counts. Fixed values.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: (label, notice, mandatory key phrases). Sentences of public licence notices. Fixed values.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["free of charge", "any person obtaining"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("warranty", "the software is provided as is without warranty of any kind express or implied", ["without warranty of any kind"]),
]
#: Rarest words of a notice that the index holds, and the share of them that a place must match.
DEPTH, SHARE = 4, 0.5
#: A-Z are lower-cased in front of it, so letters here are small ones and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Added to the place of a notice in a document, which is negative where the document begins within the notice.
_SHIFT = 1 << 20


def words_of(text: Column) -> Column:
    """Words, A-Z lower-cased. The Kelvin sign and the dotted capital I, whose small letters hold ASCII ones, are put
    out of lower()'s reach; no word boundary moves by it, and words that are not ASCII are in no notice."""
    kept = F.replace(F.replace(text.cast("string"), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß"))
    return F.coalesce(F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def rare_words(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of the vocabulary stands: one row for each word comes to the driver."""
    own = F.array_intersect(words_of(F.col("text")), F.lit(vocabulary))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counts.collect()}


def index_of(notice: str, texts: dict[str, int], depth: int) -> list[tuple[str, int]]:
    """(word, position) of the ``depth`` words of the highest IDF, that is in the fewest texts; ties go to the first."""
    words = notice.split(" ")
    return sorted(((w, i) for i, w in enumerate(words)), key=lambda p: (texts[p[0]], p[1]))[:depth]


def _places(hits: Column, index: list[tuple[str, int]]) -> Column:
    """Where the notice would begin by each hit, once each; shifted so that none is negative."""

    def begins(word: str, position: int) -> Column:
        return F.transform(F.filter(hits, lambda h: h["w"] == word), lambda h: h["i"] - position + _SHIFT)

    return F.array_distinct(F.flatten(F.array(*(begins(w, i) for w, i in index))))


def _at(words: Column, place: Column) -> Column:
    """The word at a shifted place, null outside."""
    return F.when(place >= _SHIFT, F.get(words, place - _SHIFT))


def _share(words: Column, place: Column, index: list[tuple[str, int]]) -> Column:
    matched = sum((F.coalesce(_at(words, place + i) == w, F.lit(False)).cast("int") for w, i in index), F.lit(0))
    return matched / F.lit(float(len(index)))


def _first(notice: str, phrase: str) -> int:
    words, key = notice.split(" "), phrase.split(" ")
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _verified(words: Column, hits: Column, index: list[tuple[str, int]], notice: str, keys: list[str]) -> Column:
    """The places of a notice at which all words of its key phrases stand where the notice has them."""
    needed = sorted({(_first(notice, key) + i, w) for key in keys for i, w in enumerate(key.split(" "))})

    def holds(place: Column) -> Column:
        out = F.lit(True)
        for i, w in needed:
            out = out & F.coalesce(_at(words, place + i) == w, F.lit(False))
        return out

    return F.filter(_places(hits, index), holds)


def _best(words: Column, places: Column, index: list[tuple[str, int]], share: float) -> Column:
    """The best share at a place, 0 if none reaches ``share``."""
    best = F.array_max(F.transform(places, lambda place: _share(words, place, index)))
    return F.when(best >= share, best).otherwise(F.lit(0.0))


def scan_licences(docs: DataFrame, base: list[tuple[str, str]], notices: list[tuple[str, str, list[str]]], depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """Licence labels of each row of ``docs`` (doc_id, text).

    The index holds, for each base phrase its rarest word, for each notice its ``depth`` rarest words by the texts that
    they stand in. Every hit of an indexed word in a text says where the notice would begin; a place counts if
    ``share`` of the indexed words stand where they should and all key phrases of the notice stand there whole. A
    phrase's key is the phrase, so its places are exactly those where its words stand consecutively.

    Returns doc_id, n_words, n_base (places of all phrases), first_word and last_word (smallest and largest start, from
    0; null without any), base_labels, labels (with those of the notices; both distinct, sorted, joined by commas) and
    score (1 for a phrase, else the best share of a notice that counts, 0 without). Null texts are empty; null and
    repeated doc_ids are rows like others; other columns are not read; an empty table gives an empty result.

    Texts are read twice, once for the word counts, and nothing is shuffled but these counts. What is looked up grows
    with the notices' length, what is found with the text: a text of a million hits takes a million look-ups.
    """
    vocabulary = sorted({w for phrase, _ in base for w in phrase.split(" ")} | {w for _, notice, _ in notices for w in notice.split(" ")})
    texts = rare_words(docs, vocabulary)
    phrases = [(label, phrase, index_of(phrase, texts, 1)) for phrase, label in base]
    longer = [(label, notice, keys, index_of(notice, texts, depth)) for label, notice, keys in notices]
    indexed = sorted({w for *_, index in [*phrases, *longer] for w, _ in index})
    words, hits = F.col("words"), F.col("hits")
    out = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    out = out.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(indexed)))
    found = [_verified(words, hits, index, phrase, [phrase]).alias(f"b{k}") for k, (_, phrase, index) in enumerate(phrases)]
    found += [_best(words, _verified(words, hits, index, notice, keys), index, share).alias(f"n{k}") for k, (_, notice, keys, index) in enumerate(longer)]
    out = out.select("doc_id", F.size("words").cast("long").alias("n_words"), *found)
    starts = F.transform(F.flatten(F.array(*(F.col(f"b{k}") for k in range(len(phrases))))), lambda p: (p - _SHIFT).cast("long"))
    own = [F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, (label, *_) in enumerate(phrases)]
    more = [F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (label, *_) in enumerate(longer)]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return out.withColumn("starts", starts).select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        joined(own).alias("base_labels"),
        joined([*own, *more]).alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), *(F.col(f"n{k}") for k in range(len(longer))))).alias("score"),
    )


def op12(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"), BASE, NOTICES)


def _rows(rows: list[tuple]) -> str:
    said = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows)


SQL = rf"""
WITH phrase(label, notice) AS (VALUES {_rows([(label, phrase) for phrase, label in BASE])}),
notice(label, notice) AS (VALUES {_rows([(label, n) for label, n, _ in NOTICES])}),
must(label, words, at_) AS (SELECT label, string_split(key, ' '), first FROM (VALUES {_rows([(label, key, _first(n, key)) for label, n, keys in NOTICES for key in keys])}) AS v(label, key, first)),
d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
w AS (SELECT r, UNNEST(ws) AS w, UNNEST(range(len(ws))) AS i FROM d),
df AS (SELECT w, COUNT(DISTINCT r) AS n FROM w GROUP BY w),
idx AS (SELECT label, w, i, COUNT(*) OVER (PARTITION BY label) AS m
        FROM (SELECT label, v.w, v.i, ROW_NUMBER() OVER (PARTITION BY label ORDER BY COALESCE(df.n, 0), v.i) AS k
              FROM (SELECT label, UNNEST(string_split(notice, ' ')) AS w, UNNEST(range(len(string_split(notice, ' ')))) AS i FROM notice) v LEFT JOIN df ON df.w = v.w)
        WHERE k <= {DEPTH}),
votes AS (SELECT r, label, w.i - idx.i AS p, COUNT(*) / ANY_VALUE(m)::DOUBLE AS share FROM w JOIN idx ON w.w = idx.w GROUP BY ALL),
ok AS (SELECT r, label, MAX(share) AS share
       FROM (SELECT v.r, v.label, v.p, v.share FROM votes v JOIN d USING (r) JOIN must USING (label)
             WHERE share >= {SHARE} GROUP BY v.r, v.label, v.p, v.share HAVING bool_and(p + at_ >= 0 AND list_slice(ws, p + at_ + 1, p + at_ + len(words)) = words))
       GROUP BY r, label),
b AS (SELECT d.r, label, w.i FROM phrase, d JOIN w ON w.r = d.r WHERE w.w = string_split(notice, ' ')[1] AND list_slice(ws, w.i + 1, w.i + len(string_split(notice, ' '))) = string_split(notice, ' ')),
bs AS (SELECT r, COUNT(*) AS n, MIN(i) AS lo, MAX(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM ok) GROUP BY r),
sc AS (SELECT r, MAX(share) AS s FROM ok GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(bs.n, 0)::BIGINT AS n_base, bs.lo::BIGINT AS first_word, bs.hi::BIGINT AS last_word, COALESCE(bs.ls, '') AS base_labels,
       COALESCE(al.ls, '') AS labels, CASE WHEN bs.n > 0 THEN 1.0::DOUBLE ELSE COALESCE(sc.s, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""
