"""Removal of long word sequences that occur again, found by recompression.

Recompression rewrites every text in rounds. The first round names runs of one word, each later round names
pairs of neighbours whose left symbol is in the round's left class and whose right symbol is in its right
class. A name is a hash of what it stands for, so all tasks give equal substrings equal symbols without
exchanging a dictionary. Beside each symbol goes its context: the stretch of words that alone decides that
the symbol is there. A symbol whose context lies inside a window occurs in every copy of that window.

Spark counts the top symbols over the whole corpus. Only a window all of whose inner symbols are shared can
occur twice; those windows are then counted by 128 bits, two hashes with keys and bases of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, seeded, slices, table, word_keys, word_spans

PAIR_ROUNDS = 6
#: No symbol gets longer than this, so that a window of a few dozen words always holds some.
LONGEST = 12
#: Bytes of text in a chunk on average; a longer text is in a chunk with the others that its hash deals there.
CHUNK_BYTES = 2 << 20
_U = np.uint64
_CLASS = seeded(64, 23)
_RUN, _LEFT, _RIGHT = (int(x) | 1 for x in seeded(3, 29))


def recompress(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Top symbols of a stretch of documents: names, first words, and context from and to (word numbers).

    h: word hashes; doc: the document of each word. Symbols never cross documents. A context that needs the
    word beyond a document's edge reaches one word past it, so no window inside the document holds it.
    """
    n = len(h)
    if n == 0:
        z = np.zeros(0, np.int64)
        return h, z, z, z
    # Runs of one word within one document; long runs stay single words.
    new = np.ones(n, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    long, runs = size > LONGEST, size
    if long.any():
        new[np.repeat(long, size)] = True
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
    name = np.where(size > 1, mix(h[at] * _U(_RUN) + size.astype(_U)), h[at])
    c0, c1 = at - 1, at + size + 1
    if long.any():
        # A word of a long run stands alone wherever LONGEST + 1 of the run's words are in sight: those around it.
        i = np.flatnonzero(np.repeat(long, runs)[at])
        begin = np.repeat(np.cumsum(runs) - runs, runs)[at[i]]
        c0[i] = np.clip(at[i] - LONGEST // 2, begin, begin + np.repeat(runs, runs)[at[i]] - LONGEST - 1)
        c1[i] = c0[i] + LONGEST + 1
    own = doc[at]
    for k in range(PAIR_ROUNDS):
        left = (mix(name ^ _CLASS[k]) & _U(1)) == 0
        fits = (own[1:] == own[:-1]) & left[:-1] & ~left[1:]
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = fits & (size[:-1] + size[1:] <= LONGEST)
        # What stays alone was decided by the neighbour on the side that its class looks to, if short enough to grow.
        grows = (size < LONGEST) & ~pair
        grows[1:] &= ~pair[:-1]
        end = np.append(own[1:] != own[:-1], True)
        begin = np.append(True, own[1:] != own[:-1])
        n0, n1 = c0.copy(), c1.copy()
        i = np.flatnonzero(grows & left)
        n1[i] = np.where(end[i], at[i] + size[i] + 1, np.maximum(c1[i], c1[np.minimum(i + 1, len(c1) - 1)]))
        n0[i] = np.where(end[i], c0[i], np.minimum(c0[i], c0[np.minimum(i + 1, len(c0) - 1)]))
        i = np.flatnonzero(grows & ~left)
        n0[i] = np.where(begin[i], at[i] - 1, np.minimum(c0[i], c0[i - 1]))
        n1[i] = np.where(begin[i], c1[i], np.maximum(c1[i], c1[i - 1]))
        p = np.flatnonzero(pair)
        name = name.copy()
        name[p] = mix(name[p] * _U(_LEFT) + mix(name[p + 1] * _U(_RIGHT)))
        n0[p] = np.minimum(c0[p], c0[p + 1])
        n1[p] = np.maximum(c1[p], c1[p + 1])
        size = size.copy()
        size[p] += size[p + 1]
        keep = np.ones(len(name), dtype=bool)
        keep[p + 1] = False
        name, at, size, c0, c1, own = name[keep], at[keep], size[keep], n0[keep], n1[keep], own[keep]
    return name, at, c0, c1


def parsed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """Word hashes, each row's first word, the top symbols, and second word hashes on demand, for consecutive rows."""
    for _, _, raw, offsets in slices(column, 1 << 19):
        starts, ends, first = word_spans(raw, offsets)
        h = word_keys(raw, starts, ends)
        yield h, first, recompress(h, np.repeat(np.arange(len(first) - 1), np.diff(first))), partial(word_keys, raw, starts, ends, again=True)


def window_starts(first: np.ndarray, words: int) -> np.ndarray:
    """Which words start a window inside their document."""
    ok = np.zeros(first[-1] if len(first) else 0, dtype=bool)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words:
            ok[lo : hi - words + 1] = True
    return ok


def window_hashes(h: np.ndarray, again: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start at ``at``, from two keys of their words and with two bases: windows
    of other words agree in both by chance only. Words themselves are not compared, so texts made against these
    fixed hashes could be taken for equal."""
    out = []
    for x, other in ((h, False), (again, True)):
        sums = np.zeros(len(x) + 1, dtype=_U)
        np.cumsum(mix(x) * powers(len(x), again=other), out=sums[1:])
        out.append(mix((sums[at + words] - sums[at]) * powers(len(h), inverse=True, again=other)[at]))
    return out[0], out[1]


def _flags(masks: pa.Table, kind: int) -> dict[int, np.ndarray]:
    """bucket -> flags of this chunk's names there."""
    return {b: np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8)).astype(bool) for k, b, m in zip(masks.column("kind").to_pylist(), masks.column("bucket").to_pylist(), masks.column("mask"), strict=True) if k == kind}


def _deal(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names fall into buckets by their leading bits: the cuts between them."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=_U)
    return np.searchsorted(names, edges), np.arange(buckets)


_FRAGMENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("names", pa.binary()), ("more", pa.binary()), ("twice", pa.binary())])
FRAGMENT = "chunk long, bucket int, kind int, names binary, more binary, twice binary"
_MASK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("mask", pa.binary())])
MASK = "chunk long, bucket int, kind int, mask binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _fragments(chunk: int, kind: int, names: np.ndarray, more: np.ndarray | None, twice: np.ndarray, buckets: int) -> pa.Table:
    cuts = np.append(_deal(names, buckets)[0], len(names))
    rows = [(chunk, b, kind, names[i:j].tobytes(), more[i:j].tobytes() if more is not None else b"", np.packbits(twice[i:j]).tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _FRAGMENT, strict=True)], schema=_FRAGMENT)


def _shared(group: pa.Table) -> pa.Table:
    """Which names of one bucket occur twice or more, told to each chunk for its own names, in its own order."""
    lists = [np.frombuffer(x.as_buffer(), _U) for x in group.column("names")]
    names = np.concatenate(lists)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))[: len(n)] for x, n in zip(group.column("twice"), lists, strict=True)]).astype(bool)
    more = [np.frombuffer(x.as_buffer(), _U) for x in group.column("more")]
    key = np.concatenate(more) if sum(map(len, more)) else None
    order = np.argsort(names, kind="stable") if key is None else np.lexsort((key, names))
    s = names[order]
    same = s[1:] == s[:-1]
    if key is not None:
        same &= key[order][1:] == key[order][:-1]
    hit = np.zeros(len(names), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    # A group of equal names is hit as well where one chunk holds the name twice.
    flags = np.empty(len(names), dtype=bool)
    flags[order] = hit | twice[order]
    masks, i = [], 0
    for n in lists:
        masks.append(np.packbits(flags[i : i + len(n)]).tobytes())
        i += len(n)
    return pa.Table.from_arrays([group.column("chunk"), group.column("bucket"), group.column("kind"), pa.array(masks, pa.binary())], schema=_MASK)


def _together(names: np.ndarray, flags: dict[int, np.ndarray], buckets: int) -> np.ndarray:
    """The flags that the buckets sent back, in the order of the sorted names."""
    cuts = np.append(_deal(names, buckets)[0], len(names)).tolist()
    return np.concatenate([np.zeros(0, bool), *(flags[b][: j - i] for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i)])


def _candidates(texts: pa.Table, shared: np.ndarray, names: np.ndarray, words: int):
    """For each stretch of rows: word hashes (and second ones), first words, and the starts of windows that may occur twice."""
    for h, first, (sym, _, c0, c1), again in parsed(texts.column("text")):
        alone = ~shared[np.searchsorted(names, sym)] if len(sym) else np.zeros(0, bool)
        # A window from p holds symbol s for sure if c1 - words <= p <= c0; one unshared symbol rules it out.
        gone = np.zeros(len(h) + 2, dtype=np.int64)
        lo, hi = np.maximum(c1[alone] - words, 0), c0[alone]
        ok = lo <= hi
        np.add.at(gone, lo[ok], 1)
        np.add.at(gone, hi[ok] + 1, -1)
        yield h, again, first, np.flatnonzero((np.cumsum(gone)[: len(h)] == 0) & window_starts(first, words))


def _windows(texts: pa.Table, masks: pa.Table, words: int, buckets: int):
    """(stretches with their candidates, sorted window hashes, their second hashes, how often each)."""
    names = np.unique(np.concatenate([np.zeros(0, _U), *(x[2][0] for x in parsed(texts.column("text")))]))
    shared = _together(names, _flags(masks, 0), buckets)
    parts, a, b = [], [], []
    for h, again, first, at in _candidates(texts, shared, names, words):
        x, y = window_hashes(h, again(), at, words) if len(at) else (np.zeros(0, _U), np.zeros(0, _U))
        parts.append((first, at, x, y))
        a.append(x)
        b.append(y)
    x, y = np.concatenate([np.zeros(0, _U), *a]), np.concatenate([np.zeros(0, _U), *b])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    return parts, x[at], y[at], np.diff(np.append(at, len(x)))


def remove_repeats(docs: DataFrame, words: int = 50, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """Drops from each text the words of every window of ``words`` words that starts anywhere else as well.

    Over ``docs`` (doc_id, text) returns one row per input row: doc_id, n_words, n_removed and kept_sha256, the
    SHA-256 of the kept words joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A null or blank
    text has no words (the digest is that of the empty string); a text shorter than a window keeps all. Rows
    repeated with one doc_id are texts of their own. Columns besides doc_id and text are not read.

    Rows are dealt into chunks by a hash, so that a chunk is a bounded piece of work that a lost executor can
    redo. What leaves a chunk is the sorted list of its distinct symbols, cut into buckets: a passage that a
    third of all documents share is one entry for each chunk, never one for each document.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    if chunks is None:
        size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        chunks = max(1, -(-size // CHUNK_BYTES))
    if buckets is None:
        buckets = max(4, chunks // 4)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200), F.length("text")), F.lit(chunks)).cast("long"))

    def symbols(group: pa.Table) -> pa.Table:
        names, count = np.unique(np.concatenate([np.zeros(0, _U), *(x[2][0] for x in parsed(group.column("text")))]), return_counts=True)
        return _fragments(group.column("chunk")[0].as_py(), 0, names, None, count > 1, buckets)

    def candidates(texts: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(texts):
            return _FRAGMENT.empty_table()
        _, x, y, count = _windows(texts, masks, words, buckets)
        return _fragments(texts.column("chunk")[0].as_py(), 1, x, y, count > 1, buckets)

    def cut(texts: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(texts):
            return _RESULT.empty_table()
        parts, x, y, _ = _windows(texts, masks, words, buckets)
        hit = _together(x, _flags(masks, 1), buckets)
        x, y = x[hit], y[hit]
        total, gone, sha = [], [], []
        row = 0
        column = texts.column("text")
        for first, at, wx, wy in parts:
            # Equal first hashes with other second ones are neighbours in x: look at each place of the run.
            i, j = np.searchsorted(x, wx), np.searchsorted(x, wx, side="right")
            found = np.zeros(len(at), dtype=bool)
            while (i < j).any():
                live = i < j
                found[live] |= y[i[live]] == wy[live]
                i = i + live
            cover = np.zeros(first[-1] + 1, dtype=np.int64)
            np.add.at(cover, at[found], 1)
            np.add.at(cover, at[found] + words, -1)
            covered = np.cumsum(cover)[:-1] > 0
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                bare = column[row].as_py()
                tokens = bare.encode().split() if bare else []
                drop = covered[lo:hi]
                if drop.any():
                    tokens = [t for t, d in zip(tokens, drop.tolist(), strict=True) if not d]
                total.append(hi - lo)
                gone.append(int(drop.sum()))
                sha.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
                row += 1
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], schema=_RESULT)

    by_chunk = chunked.groupBy("chunk")
    masks = by_chunk.applyInArrow(symbols, FRAGMENT).groupBy("bucket").applyInArrow(_shared, MASK)
    windows = by_chunk.cogroup(masks.groupBy("chunk")).applyInArrow(candidates, FRAGMENT)
    verdicts = masks.unionByName(windows.groupBy("bucket").applyInArrow(_shared, MASK))
    return by_chunk.cogroup(verdicts.groupBy("chunk")).applyInArrow(cut, RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def op3(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), words=35)
