"""Packing documents into windows of tokens, in order, by dynamic programming over possible cuts."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 1024
#: Costs in padding tokens: of a cut inside a sentence, of one between two sentences of a document, and of a window.
INSIDE, BETWEEN, EACH = 14.0, 2.0, 4.0
BLOCK_TOKENS = 1 << 20
#: Cuts between sentences: at most one in so many tokens, the last there.
GRAIN = 32
# Beyond these characters the two tokenizer libraries might class a character otherwise: such texts go the slow way.
_ODD = re.compile("[^\x00-\x7fÀ-ɏ]")
_LOADED: dict[tuple[str, str], tuple] = {}


def _tokenizer(ranks_path: str, json_path: str) -> tuple:
    """(fast encoder, token ids that end a sentence, function that encodes any text)."""
    if (ranks_path, json_path) not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": 50256}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        ends = np.zeros(1 << 17, dtype=bool)
        ends[[i for token, i in ranks.items() if re.search(rb"[.!?][\"')\]]?$|\n", token)]] = True
        slow: list = []

        def encode(text: str) -> np.ndarray:
            if not _ODD.search(text):
                return fast.encode_to_numpy(text, allowed_special="all")
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _LOADED[ranks_path, json_path] = (ends, encode)
    return _LOADED[ranks_path, json_path]


def cheapest_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """The cheapest choice among the cuts ``at`` (rising, the first is 0, the last the end and always taken).

    A window from cut i to cut j costs its padding, window - (at[j] - at[i]), or none at a power of two, besides
    cost[j]. Padding makes best[i] + at[i] the only part that depends on i, so the best i of the last ``window``
    tokens is the front of a monotone queue. No two neighbours may be more than a window apart.
    """
    m = len(at)
    pairs = []
    power = 1
    while power < window:
        i = np.searchsorted(at, at - power)
        j = np.flatnonzero(at[np.minimum(i, m - 1)] == at - power)
        pairs.append((j, i[j]))
        power *= 2
    js, xs = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.argsort(js, kind="stable")
    xs = xs[order].tolist()
    ends = np.searchsorted(js[order], np.arange(m), side="right").tolist()
    pos, fee = at.tolist(), cost.tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    k = ends[0]
    for j in range(1, m):
        p = pos[j]
        least = p - window
        while queue[0][1] < least:
            queue.popleft()
        head = queue[0]
        c, i = head[0] - least, head[2]
        e = ends[j]
        while k < e:
            x = xs[k]
            if best[x] < c:
                c, i = best[x], x
            k += 1
        c += fee[j]
        best[j], back[j] = c, i
        c += p
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, p, j))
    out = [m - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return at[out[::-1]]


def _block(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of consecutive documents: document, start in it, length, window, offset in it, first token."""
    n = len(ids)
    doc_end = np.cumsum(sizes)
    soft = np.flatnonzero(ends[ids]) + 1
    soft = soft[np.append(soft[1:] // GRAIN != soft[:-1] // GRAIN, True)] if len(soft) else soft
    grid = np.arange(window, n, window)
    tail = n - n // window * window
    bits = [1 << b for b in range(window.bit_length(), -1, -1) if tail >> b & 1]
    ladder = n - tail + np.cumsum(bits) if bits else np.zeros(0, np.int64)
    at = np.unique(np.concatenate([[0], doc_end, soft, grid, ladder]).astype(np.int64))
    cost = np.full(len(at), INSIDE)
    cost[np.searchsorted(at, soft)] = BETWEEN
    cost[np.searchsorted(at, doc_end)] = 0.0
    cuts = cheapest_cuts(at, cost + EACH, window)
    starts = np.unique(np.concatenate([cuts[:-1], doc_end[:-1]]))
    length = np.diff(np.append(starts, n))
    doc = np.searchsorted(doc_end, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right") - 1
    return doc, starts - (doc_end - sizes)[doc], length, seq, starts - cuts[seq], starts


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def pack(docs: DataFrame, ranks_path: str, json_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents of ``docs`` (doc_id, text) in windows of at most ``window`` tokens.

    A document is its tokens and a closing id 0; a null text has only that. Documents stay in the order of the
    table's partitions and are packed in blocks of about ``BLOCK_TOKENS``, each document whole in one block. Cuts
    lie at ends of documents (free), at ends of sentences, or, dearer, at multiples of the window, where any text
    can be cut; the dynamic programme weighs them against padding.

    One row for each piece: doc_id, start (tokens of its document before it), length, ids_crc32 (of its ids as
    little-endian 32-bit numbers), doc_tokens, sequence_id (the partition in the upper bits), offset. Special
    tokens' strings in a text become those tokens. Null and repeated doc_ids are rows like others. Columns besides
    doc_id and text are not read. Without documents there are no pieces. The rows of a partition must come in the
    same order when a task is run again, as they do from files; sort the partitions of anything else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, encode = _tokenizer(ranks_path, json_path)
        base = TaskContext.get().partitionId() << 36
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            ids = np.concatenate(parts)
            doc, start, length, seq, offset, first = _block(ids, sizes, ends, window)
            crc = [zlib.crc32(ids[i : i + n]) for i, n in zip(first.tolist(), length.tolist(), strict=True)]
            owner = pa.array(names, pa.int64()).take(pa.array(doc))
            out = pa.RecordBatch.from_arrays([owner, *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[doc], seq + base, offset))], schema=_SCHEMA)
            base += int(seq[-1]) + 1
            names.clear()
            parts.clear()
            held = 0
            return out

        zero = np.zeros(1, dtype="<u4")
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                bare = text.as_py()
                tokens = np.concatenate([encode(bare), zero]) if bare else zero
                names.append(name)
                parts.append(tokens)
                held += len(tokens)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if parts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op5(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
