"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, seeded, slices, stash, table, word_keys, word_spans
from .components import components

BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
UNIVERSE_BITS = 20
_U = np.uint64
_SHORT = _U(0xA0761D6478BD642F)
_LANES = seeded(64, 5) | _U(1)
_PI: list[np.ndarray] = []


def _pi() -> np.ndarray:
    """Row i holds the second permutation at i, i+1, ..: all shifts that element i needs, as one view."""
    if not _PI:
        order = np.argsort(seeded(1 << UNIVERSE_BITS, 7), kind="stable").astype(np.uint32)
        _PI.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:COORDINATES]]), COORDINATES))
    return _PI[0]


def signature(items: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit items: the first permutation places an item, the second,
    shifted k places round, gives coordinate k."""
    at = (mix(items + _U(0x2545F4914F6CDD1D)) >> _U(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, _pi()[at[i : i + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted set of hashed shingles of that many lower-cased words; a shorter text is one shingle."""
    for _, _, raw, offsets in slices(column):
        starts, ends, first = word_spans(raw, offsets)
        h = word_keys(raw, starts, ends, lower=True)
        whole = np.zeros(max(0, len(h) - words + 1), dtype=_U)
        for k in range(words):
            whole += h[k : k + len(whole)] * _LANES[k]
        whole = mix(whole)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                yield np.unique(whole[lo : hi - words + 1])
            elif hi > lo:
                yield mix((h[lo:hi] * _LANES[: hi - lo]).sum(keepdims=True) ^ (_SHORT + _U(hi - lo)))
            else:
                yield np.zeros(0, dtype=_U)


def digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n, cls, bands): md5 of the text, set size, a 128-bit digest of the set, and the band hashes;
    cls and bands are null for an empty set."""

    def run(batches):
        for batch in batches:
            n, cls, sigs = [], [], []
            for s in shingle_sets(batch.column("text"), words):
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else np.zeros(COORDINATES, np.uint32))
            sig = np.array(sigs, dtype=_U).reshape(-1, BANDS, ROWS)
            bands = mix((sig * _LANES[:ROWS]).sum(axis=2, dtype=_U) + _LANES[None, ROWS : ROWS + BANDS])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array([b.tobytes() if c else None for b, c in zip(bands, cls, strict=True)], pa.binary())], names=["doc_id", "text_key", "n", "cls", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key string, n long, cls binary, bands binary")


def text_key(text):
    """What tells the texts of one doc_id apart."""
    return F.coalesce(F.md5(text), F.lit("null"))


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(rep, items): the full sets of the classes in ``members`` (rep, doc_id, text_key), from the one document each
    that stands for its class, so that a class of copies sends one text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), words)], pa.binary())], names=["rep", "items"])

    text = F.col("text").cast("string")
    texts = docs.select(_row_key("doc_id", text_key(text)).alias("key"), text.alias("text"))
    chosen = texts.join(members.select(_row_key("doc_id", F.col("text_key")).alias("key"), "rep"), "key")
    return chosen.select("rep", "text").mapInArrow(run, "rep long, items binary").dropDuplicates(["rep"])


#: Ranges of item hashes for which shared items are counted one by one.
RANGES = 32
#: Items that a group of the count holds on average; the number of groups follows from the data.
GROUP_ITEMS = 1 << 20


def _cores(sets: DataFrame, ids: DataFrame, groups: int) -> DataFrame:
    """(rep, core, cells): how many items of a set are in any other set of ``ids``, in all and for each of
    ``RANGES`` ranges of hashes. No intersection has more, in all or in a range.

    Items are dealt into ``RANGES * groups`` ranges. Where a batch holds an item twice, its owners are counted on the
    spot and the item goes on once, without an owner; so an item that all sets share is one entry for each batch."""
    ranges = RANGES * groups
    edges = np.array([(b << 64) // ranges for b in range(ranges)], dtype=_U)

    def deal(batches):
        for batch in batches:
            items = [np.frombuffer(x.as_buffer(), _U) for x in batch.column("items")]
            token = np.concatenate([np.zeros(0, _U), *items])
            owner = np.repeat(batch.column("rep").to_numpy(), [len(x) for x in items])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            first = np.ones(len(token), dtype=bool)
            first[1:] = token[1:] != token[:-1]
            twice = ~first
            twice[:-1] |= ~first[1:]
            at = np.searchsorted(edges, token[twice], side="right") - 1
            here, count = np.unique(np.stack([at, owner[twice]], axis=1), axis=0, return_counts=True)
            token, owner = token[first], np.where(twice[first], -1, owner[first])
            cuts = [*np.searchsorted(token, edges).tolist(), len(token)]
            split = np.searchsorted(here[:, 0], np.arange(ranges + 1)).tolist()
            cols = [[x[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)] for x, c in ((token, cuts), (owner, cuts), (np.ascontiguousarray(here[:, 1]), split), (count.astype(np.int64), split))]
            full = [k for k in range(ranges) if cols[0][k] or cols[2][k]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([c[k] for k in full], pa.binary()) for c in cols)], names=["range", "tokens", "owners", "told", "often"])

    def count(group: pa.Table) -> pa.Table:
        load = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
        token, owner, told, often = load("tokens", _U), load("owners", np.int64), load("told", np.int64), load("often", np.int64)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        shared = np.zeros(len(token), dtype=bool)
        shared[1:] = same
        shared[:-1] |= same
        more, times = np.unique(owner[shared & (owner >= 0)], return_counts=True)
        rep, back = np.unique(np.concatenate([told, more]), return_inverse=True)
        core = np.zeros(len(rep), np.int64)
        np.add.at(core, back, np.concatenate([often, times]))
        bucket = group.column("range")[0].as_py() // groups
        return pa.table({"bucket": pa.array([bucket] * len(rep), pa.int32()), "rep": pa.array(rep, pa.int64()), "core": pa.array(core, pa.int64())})

    dealt = sets.join(ids, "rep", "left_semi").select("rep", "items").mapInArrow(deal, "range int, tokens binary, owners binary, told binary, often binary")
    cells = F.array(*(F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("core"))), F.lit(0)).cast("int") for b in range(RANGES)))
    return dealt.groupBy("range").applyInArrow(count, "bucket int, rep long, core long").groupBy("rep").agg(F.sum("core").alias("core"), cells.alias("cells"))


#: Sets of a block in the last comparison of a bucket, and items that are counted at a time.
BLOCK, CHUNK = 256, 4096


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0-1 matrices, some items at a time."""
    a, b = (np.concatenate([np.zeros(0, _U), *x]) for x in (left, right))
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for i in range(0, len(both), CHUNK):
        some = both[i : i + CHUNK]
        m = []
        for sets in (left, right):
            x = np.zeros((len(sets), len(some)), dtype=np.float32)
            for row, s in zip(x, sets, strict=True):
                part = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
                at = np.searchsorted(some, part)
                row[at[some[at] == part]] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _rest_in_blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between members of a bucket that are in different components, of ``left`` (h, rep, comp).

    The members of a bucket are dealt into blocks of about ``BLOCK``; a task holds two blocks, so a bucket of g members
    sends g * g / ``BLOCK`` rows and no pairs."""
    count = left.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = left.join(count, "h").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = dealt.select("h", "rep", "comp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("theirs"))
    pairs = pairs.select("h", "rep", "comp", "mine", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        items = [np.frombuffer(x.as_buffer(), _U) for x in group.column("items")]
        rep, comp, mine = (group.column(c).to_numpy() for c in ("rep", "comp", "mine"))
        one = np.flatnonzero(mine == group.column("i")[0].as_py())
        two = np.flatnonzero(mine == group.column("j")[0].as_py())
        both = overlaps([items[k] for k in one], [items[k] for k in two])
        n = np.array([len(x) for x in items], dtype=np.int64)
        link = 100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)
        link &= comp[one][:, None] != comp[two][None, :]
        x, y = np.nonzero(link)
        a, b = rep[one][x], rep[two][y]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return pairs.join(sets, "rep").groupBy("h", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) with 100 * |A and B| >= percent * |A or B|, by their full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _hubs(left: DataFrame, hubs: int) -> DataFrame:
    """The members of each bucket with the largest share of common items, picked in two steps so that a large
    bucket is ranked in parts."""
    order = [(F.col("core") / F.col("n")).desc(), "rep"]
    part = left.withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / (16 * hubs))))
    some = part.withColumn("r", F.row_number().over(Window.partitionBy("h", "part").orderBy(*order))).where(F.col("r") <= hubs)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(*order))).where(F.col("r") <= hubs)


def grouped(docs: DataFrame, words: int, percent: int, hubs: int) -> DataFrame:
    """(doc_id, text_key, n, comp, smallest): each row's component, a number of no meaning (null for an empty set),
    and the smallest doc_id in it."""
    every = stash(digests(docs, words))
    one = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    reps = every.where("cls is not null").groupBy("cls").agg(F.min(one).alias("one"), F.max("n").alias("n"), F.max("bands").alias("bands"))
    # Classes get numbers of their own: one doc_id may stand for several texts.
    reps = stash(reps.select("cls", "n", "bands", F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key"), F.monotonically_increasing_id().alias("rep")))
    # Eight bytes of each band, as hexadecimal text turned into a number's worth of key.
    rows = reps.select("rep", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("bands", i * 8 + 1, 8))).alias("h"))
    full = stash(rows.groupBy("h").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1"))
    members = stash(rows.join(full, "h"))
    sets = stash(_sets(docs, reps.join(members.select("rep").distinct(), "rep", "left_semi"), words))
    star = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    comps = components(members.select(F.col("rep").alias("node")), stash(_verified(star, sets, percent)))
    need = F.lit(int(percent)) * (F.col("n") + F.col("m"))
    ranges = [F.least(F.get("cells", F.lit(i)), F.get("cells2", F.lit(i))) for i in range(RANGES)]
    fits = (F.least("core", "core2") * (100 + int(percent)) >= need) & (sum(ranges[1:], ranges[0]) * (100 + int(percent)) >= need)
    cores = None
    for last in (False, True):
        labelled = stash(members.select("h", "rep", "n", "size").join(comps.withColumnRenamed("node", "rep"), "rep"))
        open_ = stash(labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h"))
        if open_.isEmpty():
            break
        left = labelled.join(open_, "h")
        if cores is None:
            ids = stash(left.select("rep", "n").distinct())
            groups = max(1, int((ids.agg(F.sum("n")).first()[0] or 0) // (RANGES * GROUP_ITEMS)))
            cores = stash(_cores(sets, ids.select("rep"), groups))
        left = stash(left.join(cores, "rep").where(f"100 * core >= {int(percent)} * n").select("h", "rep", "n", "size", "core", "cells", "comp"))
        if last:
            apart = left.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
            links = stash(_rest_in_blocks(left.join(apart, "h").select("h", "rep", "comp"), sets, percent))
        else:
            other = stash(_hubs(left, hubs)).select("h", F.col("rep").alias("rep2"), F.col("n").alias("m"), F.col("core").alias("core2"), F.col("cells").alias("cells2"), F.col("comp").alias("comp2"))
            pairs = left.join(other, "h").where("comp <> comp2").where(fits).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
            links = stash(_verified(pairs, sets, percent))
        comps = components(None, links, comps)
    of_class = stash(reps.select("cls", "rep", "doc_id").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "doc_id", F.coalesce("comp", "rep").alias("comp")))
    smallest = of_class.groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    by_class = of_class.select("cls", "comp").join(smallest, "comp")
    named = every.where("cls is not null").select("doc_id", "text_key", "n", "cls").join(by_class, "cls", "left").select("doc_id", "text_key", "n", "comp", "smallest")
    return named.unionByName(every.where("cls is null").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("smallest")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, hubs: int = 16) -> DataFrame:
    """Groups of near-duplicate documents over ``docs`` (doc_id, text).

    Returns one row per input row: doc_id, n_shingles, component_id, kept.

    * Documents with one and the same set are a class, so a large group of copies is one row in everything that follows.
    * Candidates come from ``BANDS`` bands of ``ROWS`` coordinates of a circulant MinHash. At a Jaccard
      similarity of 0.85 a pair shares no band with a chance below 1e-6, at 0.8 below 1e-4.
    * Items that no other candidate has bound what two sets can share, so a text with too many of its own
      is ruled out without a comparison.
    * In each bucket every member is first held against one of them; members of other components then
      against the ``hubs`` members with the fewest items of their own, with which a text links if with any;
      and at last all members that are still in different components against each other, in blocks. So no candidate
      link between components is left out, and a bucket of g similar texts costs about g comparisons.
    * A link is confirmed on full sets of 64-bit shingle hashes.

    A null or blank text has an empty set and links with nothing. Rows are documents of their own: rows of one doc_id
    with one text are in one component, with several texts each in its text's. component_id is the smallest doc_id of
    the component; rows with a null doc_id link like others, and where a component has no doc_id it is null and kept is
    true. Columns besides doc_id and text are not read. An empty table gives an empty result.
    """
    got = grouped(docs, words, percent, hubs)
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("smallest"), F.col("smallest").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, hubs: int = 16) -> DataFrame:
    """``docs`` with its columns: exactly one row of each group of near-duplicates, the one with the smallest doc_id
    (null last), then the smallest digest of its text; of rows that are equal in both any one, since they are equal.

    Rows without words link with nothing and all stay; so does a table's order of columns. An empty table stays empty.
    """
    rows = stash(grouped(docs, words, percent, hubs))
    keys = rows.where("comp is not null").groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    best = keys.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("one")).select("comp", F.col("one.doc_id").alias("best_id"), F.col("one.text_key").alias("best_key"))
    keys = keys.join(best, "comp").withColumn("chosen", F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key")))
    # Most documents have no copy; only the others are looked up.
    odd = stash(keys.where("not chosen or copies > 1").select(_row_key("doc_id", F.col("text_key")).alias("key"), "chosen"))
    keyed = docs.select(F.struct("*").alias("row"), _row_key("doc_id", text_key(F.col("text").cast("string"))).alias("key"))
    alone = keyed.join(odd, "key", "left_anti").select("row")
    several = keyed.join(odd.where("chosen"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(several).select("row.*")


def _row_key(doc_id: str, key):
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), key)


def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
