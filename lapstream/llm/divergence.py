"""How far the sources of a language are from each other: kept terms by iceberg prefix refinement, exact divergences."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: A term's bytes: A-Z as a-z, a-z and whatever is not ASCII; all others stand between terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of the first level's prefixes; each level doubles them.
FIRST_WIDTH = 3
#: Bits of the sieve that each level sends to the tasks of the next: 1 MB, whatever the data.
SIEVE_BITS = 1 << 23
#: Terms of a block and sources of a tile, of which a task compares two.
BLOCK_TERMS, TILE = 512, 64
SCALE = 1_000_000_000
#: Different terms of rows, one by one, that make a chunk: some thousand rows, or one long one.
CHUNK_TERMS = 400_000
#: Counts of chunks that a task puts together before it hands them on, and rows of chunks sent to Python at a time.
MERGED, CHUNKS_AT_A_TIME = 1_000_000, 4
CHUNK = "lang string, terms array<binary>, ends array<int>, docs array<int>, sources array<string>, of array<int>, source array<int>, n array<long>"


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values (neither negative). Both are sorted as one number where that
    fits, which is several times faster than sorting places."""
    if not len(keys):
        return keys, values
    most = int(values.max()) + 1
    if (int(keys.max()) + 1) * most < 1 << 63:
        both = np.sort(keys * most + values)
        keys, values = both // most, both % most
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(values, at)


def _chunk(lang: list[str], source: list[str], terms: list[bytes], counts: list[int], sizes: list[int]) -> pa.RecordBatch:
    """For each language of some rows: its terms in order with the rows that have them (``docs`` up to ``ends``), and
    how often each stands in each source (term ``of``, number of the source, ``n``)."""
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy(zero_copy_only=False)]
    distinct = coded.dictionary.take(pa.array(order))
    row, n = np.repeat(np.arange(len(sizes)), sizes), np.array(counts, dtype=np.int64)
    names, code = np.unique(np.array(source, dtype=object), return_inverse=True)
    known, of_row = np.unique(np.array(lang, dtype=object), return_inverse=True)
    out = []
    for g, name in enumerate(known):
        pick = np.flatnonzero((of_row == g)[row])
        pairs = np.sort(term[pick] * len(sizes) + row[pick])
        own, seen = np.unique(pairs // len(sizes), return_counts=True)
        key, total = summed(term[pick] * len(names) + code[row[pick]], n[pick])
        here = np.unique(code[of_row == g])
        out.append((name, distinct.take(pa.array(own)), np.cumsum(seen), pairs % len(sizes), names[here], np.searchsorted(own, key // len(names)), np.searchsorted(here, key % len(names)), total))
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) for c in col)]), pa.int32()), pa.concat_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(kind) for c in col])) for col, kind in zip(list(zip(*out))[1:], kinds)]
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *lists], ["lang", "terms", "ends", "docs", "sources", "of", "source", "n"])


def term_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of rows, one for each of their languages, with the terms of whole texts: what all levels read. Nulls are
    read as ''. Written to the shared folder; a chunk is one row, so no task sees half of one."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ([], [], [], [], [])
        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                found = Counter(text.as_py().translate(_TERM_BYTES).split())
                for part, more in zip(held, ([lang.as_py()], [source.as_py()], found.keys(), found.values(), [len(found)])):
                    part.extend(more)
                if len(held[2]) >= CHUNK_TERMS:
                    yield _chunk(*held)
                    held = ([], [], [], [], [])
        if held[0]:
            yield _chunk(*held)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return written(docs.select(*named).withColumn("text", F.col("text").cast("binary")).mapInArrow(split, CHUNK), at_a_time=1000)


def sieve_of(found: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit for the hash of each (lang, prefix) of ``found``: at most ``bits`` bits come to the driver. What is not in
    the sieve is not in ``found``; what is there by chance is counted like the rest, and falls by its count."""
    at = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("prefix"))) % bits
    words = found.select(F.floor(at / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[[r["w"] for r in words]] = [r["b"] for r in words]
    return out.view(np.uint8)


def _passes(sieve: np.ndarray, lang: str, prefixes: list[bytes]) -> np.ndarray:
    """Which prefixes of a language the sieve lets through. Little-endian words have bit i in byte i // 8."""
    top = lang.encode() + b"\0"
    at = np.array([zlib.crc32(top + p) for p in prefixes], dtype=np.int64) % (len(sieve) * 8)
    return (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _numbers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() if name == "lang" else batch.column(i)[k].values for i, name in enumerate(batch.schema.names)}


def _merged(held: dict, schema: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each key of what several chunks of a task gave, in sums: (lang, tag) -> lists of (keys, counts)."""
    for (lang, tag), parts in held.items():
        number, keys = _numbers(pa.concat_arrays([k for k, _ in parts]))
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, number, np.concatenate([n for _, n in parts]))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), keys, pa.repeat(tag, len(keys)), pa.array(total)], schema)


def prefix_counts(chunks: DataFrame, width: int, before: int, sieve: np.ndarray | None) -> DataFrame:
    """(lang, prefix, whole, docs): in how many rows of a language each prefix of ``width`` bytes begins a term
    (``whole``: is a term of at most so many bytes), of the terms longer than ``before`` bytes whose prefix of that
    length the sieve lets through."""

    def prefixes_of(chunk: dict) -> tuple[pa.Array, np.ndarray] | None:
        terms = chunk["terms"]
        length = pc.binary_length(terms).to_numpy(zero_copy_only=False)
        open_ = length > before
        if sieve is not None:
            begin, prefixes = _numbers(pc.binary_slice(terms, 0, before))
            open_ &= _passes(sieve, chunk["lang"], prefixes.to_pylist())[begin]
        open_ = np.flatnonzero(open_)
        if not len(open_):
            return None
        ends = chunk["ends"].to_numpy()
        rows = np.diff(ends, prepend=0)[open_]
        begin, prefixes = _numbers(pc.binary_slice(terms.take(pa.array(open_)), 0, width))
        number = begin * 2 + (length[open_] <= width)
        seen = np.zeros(2 * len(prefixes), dtype=np.int64)
        # A prefix of one term is in as many rows as the term; rows of several terms are put together.
        alone = np.bincount(number, minlength=len(seen))[number] == 1
        seen[number[alone]] = rows[alone]
        many, n = open_[~alone], rows[~alone]
        at = np.repeat(ends[many] - np.cumsum(n), n) + np.arange(n.sum())
        docs = chunk["docs"].to_numpy()
        top = int(docs.max()) + 1
        pairs = np.unique(np.repeat(number[~alone], n) * top + docs[at])
        return prefixes, seen + np.bincount(pairs // top, minlength=len(seen))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for chunk in _rows_of(batch):
                got = prefixes_of(chunk)
                if got is None:
                    continue
                prefixes, seen = got
                for whole in (False, True):
                    found = np.flatnonzero(seen[whole::2])
                    if len(found):
                        held.setdefault((chunk["lang"], whole), []).append((prefixes.take(pa.array(found)), seen[whole::2][found]))
                        size += len(found)
                if size >= MERGED:
                    yield from _merged(held, ["lang", "prefix", "whole", "docs"])
                    held, size = {}, 0
        yield from _merged(held, ["lang", "prefix", "whole", "docs"])

    out = chunks.select("lang", "terms", "ends", "docs").mapInArrow(count, "lang string, prefix binary, whole boolean, docs long")
    return out.groupBy("lang", "prefix", "whole").agg(F.sum("docs").alias("docs"))


def kept_terms(chunks: DataFrame, least: int, width: int = FIRST_WIDTH) -> DataFrame:
    """(lang, prefix): the terms that stand in at least ``least`` rows of their language.

    Prefixes of three bytes are counted first, each level doubles them, and only what begins with a prefix that
    ``least`` rows have is extended: a term is in no more rows than each of its prefixes. A level counts rows, not
    terms, with partial sums in each task; terms as short as the level are complete and kept or dropped for good."""
    kept, before, sieve = [], 0, None
    while True:
        found = written(prefix_counts(chunks, width, before, sieve).where(F.col("docs") >= least), at_a_time=CHUNKS_AT_A_TIME)
        kept.append(found.where("whole").select("lang", "prefix"))
        longer = found.where("not whole")
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        before, width, sieve = width, 2 * width, sieve_of(longer)


def _joined(cells: list[tuple]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Several (terms, sources, term, source, n), the latter three a cell each, as one in which no cell comes twice."""
    (term, terms), (source, sources) = (_numbers(pa.concat_arrays([c[k] for c in cells])) for k in (0, 1))
    before = [np.cumsum([0, *(len(c[k]) for c in cells)]) for k in (0, 1)]
    term = np.concatenate([term[a + c[2]] for a, c in zip(before[0], cells)])
    source = np.concatenate([source[a + c[3]] for a, c in zip(before[1], cells)])
    key, n = summed(term * len(sources) + source, np.concatenate([c[4] for c in cells]))
    return terms, sources, key // max(len(sources), 1), key % max(len(sources), 1), n


def _dealt(held: dict[str, list[tuple]], blocks: int, tiles: int) -> Iterator[pa.RecordBatch]:
    """A row for each language, block of terms and tile of sources of what several chunks of a task gave."""
    out = []
    for lang, cells in held.items():
        terms, sources, term, source, n = _joined(cells)
        block, tile = (np.array([zlib.crc32(x) for x in xs.cast(pa.binary()).to_pylist()], dtype=np.int64) % k for xs, k in ((terms, blocks), (sources, tiles)))
        group = block[term] * tiles + tile[source]
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else []
        for pick in np.split(order, cuts[1:]) if len(order) else []:
            (own, of), (names, at) = (np.unique(x[pick], return_inverse=True) for x in (term, source))
            row = (lang, int(block[own[0]]), int(tile[names[0]]), terms.take(pa.array(own)).to_pylist(), sources.take(pa.array(names)).to_pylist())
            out.append((*row, *(x.tobytes() for x in (of.astype(np.int32), at.astype(np.int32), n[pick]))))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_CELLS)], schema=_CELLS)


_CELLS = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("tile", pa.int32()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("of", pa.binary()), ("source", pa.binary()), ("n", pa.binary())])
CELLS = "lang string, block int, tile int, terms array<binary>, sources array<string>, of binary, source binary, n binary"


def term_counts(chunks: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each kept term stands in each of ``groups`` (lang, source) that has it.

    A task adds up its chunks and deals out blocks of some 512 terms and 64 sources, each block a row with its terms once
    and its counts as cells (4 bytes term, 4 source, 8 count); behind the shuffle a task holds one block at a time."""
    sieve = sieve_of(kept)
    most = lambda df: df.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks, tiles = -(-most(kept) // BLOCK_TERMS), -(-most(groups) // TILE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for chunk in _rows_of(batch):
                keep = _passes(sieve, chunk["lang"], chunk["terms"].to_pylist())
                of, source, n = (chunk[k].to_numpy() for k in ("of", "source", "n"))
                ok = np.flatnonzero(keep[of])
                if len(ok):
                    held.setdefault(chunk["lang"], []).append((chunk["terms"].filter(pa.array(keep)), chunk["sources"], (np.cumsum(keep) - 1)[of[ok]], source[ok], n[ok]))
                    size += len(ok)
                if size >= MERGED:
                    yield from _dealt(held, blocks, tiles)
                    held, size = {}, 0
        yield from _dealt(held, blocks, tiles)

    def counted(lang: str, cells: list[tuple]) -> pa.RecordBatch:
        terms, sources, term, source, n = _joined(cells)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(n)), sources.take(pa.array(source)), terms.take(pa.array(term)), pa.array(n)], ["lang", "source", "term", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, limit = None, [], 0, MERGED
        for batch in batches:
            for k in range(batch.num_rows):
                lang, block, tile, terms, sources, *cells = (c[k] for c in batch.columns)
                key = (lang.as_py(), block.as_py(), tile.as_py())
                if held and key != at:
                    yield counted(at[0], held)
                    held, size, limit = [], 0, MERGED
                if size >= limit:
                    held = [_joined(held)]
                    limit = MERGED + 2 * len(held[0][4])
                    size = len(held[0][4])
                of, source, n = (np.frombuffer(c.as_py(), kind) for c, kind in zip(cells, (np.int32, np.int32, np.int64)))
                at, size = key, size + len(n)
                held.append((terms.values, sources.values, of, source, n))
        if held:
            yield counted(at[0], held)

    key = ["lang", "block", "tile"]
    dealt = chunks.select("lang", "terms", "sources", "of", "source", "n").mapInArrow(deal, CELLS)
    out = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(add, "lang string, source string, term binary, n long")
    return out.join(kept.select("lang", F.col("prefix").alias("term")), ["lang", "term"]).select("lang", "source", "term", "n")


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly; null where nothing is kept."""
    below = (total + 2 * kept).cast("decimal(20,0)")
    return F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")), F.when(kept > 0, below)) + 1


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of the divergences of all pairs of sources of two tiles, over the kept terms of one block.

    Rows without a term are the sources, with the p of a term that they lack and the number of the block's terms."""
    heads = frame[frame["term"].isna()].drop_duplicates("ix").sort_values("ix")
    cells = frame[frame["term"].notna()].drop_duplicates(["ix", "term"])
    place = {ix: k for k, ix in enumerate(heads["ix"])}
    codes, distinct = pd.factorize(cells["term"])
    p = np.repeat(heads["p"].to_numpy(np.int64)[:, None], len(distinct) + 1, axis=1)
    p[cells["ix"].map(place).to_numpy(np.int64), codes] = cells["p"].to_numpy(np.int64)
    times = np.ones(len(distinct) + 1, dtype=np.int64)
    times[-1] = heads["terms"].iloc[0] - len(distinct)  # the terms that no source of the two tiles has
    a, b = frame["a"].iloc[0], frame["b"].iloc[0]
    tile, names = heads["tile"].to_numpy(), heads["source"].to_numpy()
    right = np.flatnonzero(tile == b)
    out = []
    for g in np.flatnonzero(tile == a):
        gap = p[g] - p[right]
        value = (gap * gap // np.maximum(p[g] + p[right], 1) * times).sum(axis=1)
        for h, v in zip(right, value):
            if g != h:
                out.append((names[g], names[h], v))
                if a != b:
                    out.append((names[h], names[g], v))
    return pd.DataFrame(out, columns=["source", "item", "value"]).assign(lang=frame["lang"].iloc[0])[["lang", "source", "item", "value"]]


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """Divergence of the sources of each language of ``docs`` (text, lang, source; nulls are ''), from their terms.

    Terms are runs of ASCII letters (A-Z lower-cased) and other characters beyond ASCII; a language keeps those in at
    least ``least`` of its rows, V of them. A group (lang, source), and a language, gives a kept term with n
    occurrences p = 1 + floor(10^9 * (n + 2) / (N + 2 V)), N the sum of n; two of them differ at a term by
    floor((p - q)^2 / (p + q)). Part ``pair``: each other source of the language, with the sum over all kept terms (0
    without any). Part ``term``: the ``top`` kept terms that the group has and gives more than its language, q.

    Returns lang, source, part, item, value, rank (from 1 for each group and part; value down, item up by its bytes).
    Groups without terms are groups; a language with one source has no pairs. Repeated rows count as rows; an empty
    table gives an empty result; other columns are not read.

    Every level adds up counts by prefix in its chunks and tasks first, so a language or source with a third of all
    rows, or a word in every row, is one row of each chunk. For pairs, counts are dealt by blocks of 512 terms and pairs of tiles
    of 64 sources; a task holds one block of two tiles. The result has a row for each two sources of a language.
    """
    chunks = term_chunks(docs)
    kept = written(kept_terms(chunks, least))
    groups = written(chunks.select("lang", F.explode("sources").alias("source")).distinct())
    counts = written(term_counts(chunks, kept, groups), at_a_time=CHUNKS_AT_A_TIME)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    ranked = groups.join(sums, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("ix"))
    ranked = ranked.withColumn("p0", _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))).withColumn("sources", F.count("*").over(Window.partitionBy("lang"))).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int"))
    ranked = written(ranked)

    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    lang_total = ranked.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    dealt = counts.join(ranked, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))
    own = dealt.join(by_lang, ["lang", "term"]).join(lang_total, "lang").withColumn("q", _p(F.col("n_lang"), F.col("lang_total"), F.col("v")))
    own = own.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms_part = own.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    block = lambda term: F.pmod(F.xxhash64(term), F.col("blocks")).cast("int").alias("block")
    sizes = kept.join(ranked.select("lang", "blocks").distinct(), "lang").select("lang", block("prefix")).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    heads = ranked.select("lang", "source", "ix", "sources", F.coalesce("p0", F.lit(0).cast("long")).alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(sizes, ["lang", "block"], "left").select("lang", "source", "ix", "sources", "p", "block", F.lit(None).cast("binary").alias("term"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"))
    cells = heads.unionByName(dealt.select("lang", F.lit(None).cast("string").alias("source"), "ix", "sources", "p", block("term"), "term", F.lit(None).cast("long").alias("terms")))
    tile, other = F.floor(F.col("ix") / TILE).cast("int"), F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE).cast("int"))
    met = cells.select("lang", "source", "ix", "p", "block", "term", "terms", tile.alias("tile"), F.explode(other).alias("other")).withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other")).drop("other")
    pairs = met.groupBy("lang", "block", "a", "b").applyInPandas(_tile_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs_part = pairs.withColumn("rank", place).withColumn("part", F.lit("pair"))
    cols = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs_part.select(*cols).unionByName(terms_part.select(*cols))


def op11(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                  regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, UNNEST(ts) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING COUNT(DISTINCT r) >= 10),
v AS (SELECT lang, COUNT(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, COUNT(*) AS n FROM w JOIN kept USING (lang, t) GROUP BY lang, source, t),
dense AS (SELECT g.lang, g.source, kept.t, COALESCE(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
p AS (SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 2)) // (SUM(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM dense JOIN v USING (lang)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 2)) // (SUM(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM (SELECT lang, t, SUM(n) AS n FROM c GROUP BY lang, t) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(pairs.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
