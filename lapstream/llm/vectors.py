"""Embeddings: near-duplicates in spherical k-means cells, and nearest neighbours through learned partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, stash, table
from .components import components

#: Vectors that cells and partitions are fitted on: the smallest hashes of the id, at most so many.
SAMPLE = 32_768
#: Sampled vectors for each cell or part, and never fewer than ``LEAST_SAMPLE``.
PER_CENTRE, LEAST_SAMPLE = 16, 4096
#: Rows that a cell holds of one label, and rows of a part, on average: cells and parts grow with the table, up to
#: ``SAMPLE // PER_CENTRE``; beyond that they hold more and are searched in more blocks.
PER_CELL, PER_PART = 32, 256
#: Rows of a block: bounds what one task holds.
BLOCK = 2048
RECALL = 0.97
_U = np.uint64


def _fine():
    v = F.col("embedding").cast("array<double>")
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) with v of doubles; only ids and vectors that are whole, finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    return vectors.where(_fine()).select(F.col("vec_id").cast("long").alias("vec_id"), *([F.col("label").cast("string").alias("label")] if "label" in vectors.columns else []), v.alias("v")).where("vec_id is not null").where("v is not null")


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, keepdims=True)
    m = m / big
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def sample_of(rows: DataFrame, n: int, unit: bool = True) -> np.ndarray:
    """At most n vectors, as unit vectors if asked for, those whose ids hash lowest; one bounded matrix on the driver."""
    got = rows.select("vec_id", "v").withColumn("k", F.xxhash64("vec_id")).orderBy("k", "vec_id").limit(n).select("v").toArrow()
    got = got.filter(pc.equal(pc.list_value_length(got.column("v")), pc.list_value_length(got.column("v"))[0])) if len(got) else got
    m = _matrix(got.column("v")) if len(got) else np.zeros((0, 1))
    return _unit(m) if unit and len(m) else m


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; one of zeros where there is nothing to fit."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    k = max(1, min(k, len(x)))
    c = x[np.argsort(mix(np.arange(len(x), dtype=_U) + _U(17)))[:k]].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(cell, kind="stable")
        used, at = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(x[order], at, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[used[norm > 0]] = sums[norm > 0] / norm[norm > 0, None]
    return c


def centres(rows: int, per: int) -> tuple[int, int]:
    """How many cells or parts so many rows get, and the size of the sample they are fitted on."""
    k = max(1, min(-(-rows // per), SAMPLE // PER_CENTRE))
    return k, max(LEAST_SAMPLE, k * PER_CENTRE)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, per_cell: int = PER_CELL) -> DataFrame:
    """Links between rows of ``vectors`` (vec_id, embedding, label) with one label and cosine >= ``least``.

    Returns vec_id, n_links, component_id, kept, one row per input row. Vectors that are null, zero or hold null or
    non-finite components, and rows with a null label or id, link with nothing and are kept (component_id is their
    vec_id). Rows of one label must have vectors of one length to be linked. Repeated rows count as vectors. Other
    columns are not read; an empty table gives an empty result.

    Equal vectors of one label are one class with a count. Spherical k-means, fitted on a bounded sample, assigns
    classes to cells, about ``per_cell`` of the largest label to each. Two vectors with a cosine of ``least`` are no
    further apart than d = sqrt(2 - 2 * least); if a bisector of two cells lies between them, one of them is within
    d / 2 of it. So a vector also visits each cell whose bisector is that near, and every link is seen in the home
    cell of one of its ends; if both ends visit each other's cell it counts in the cell of the lower number. In a cell
    its own rows meet each other and the visitors, in blocks of about ``BLOCK`` rows.
    """
    rows = usable(vectors).where("label is not null")
    # Classes get numbers of their own: one vec_id may stand for several vectors.
    classes = stash(rows.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, n = centres(largest, per_cell)
    cells = spherical_kmeans(sample_of(rows, n), k)
    half = float(np.sqrt(max(0.0, 2 - 2 * least)) / 2 * 1.000001 + 1e-9)

    def visits(batches):
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (cells @ cells.T)))
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            sizes = np.diff(column.offsets.to_numpy())
            at, cell, own, also = [], [], [], []
            for i in range(0, batch.num_rows, 4096):
                some = column.slice(i, 4096)
                fits = sizes[i : i + 4096] == cells.shape[1]
                if fits.any():
                    dots = _unit(_matrix(some.filter(pa.array(fits)))) @ cells.T
                    home = dots.argmax(axis=1)
                    near = dots[np.arange(len(home)), home][:, None] - dots <= half * gaps[home]
                    near[np.arange(len(home)), home] = True
                    r, c = np.nonzero(near)
                    lists = np.split(c.astype(np.int32), np.cumsum(near.sum(axis=1))[:-1])
                    also += [lists[i] if h == j else None for i, j, h in zip(r.tolist(), c.tolist(), home[r].tolist(), strict=True)]
                    at.append(np.flatnonzero(fits)[r] + i)
                    cell.append(c)
                    own.append(home[r])
                other = np.flatnonzero(~fits)  # vectors of another length share cells of their own, one for each length
                at.append(other + i)
                cell.append(-sizes[i : i + 4096][other])
                own.append(-sizes[i : i + 4096][other])
                also += [None] * len(other)
            at = np.concatenate(at)
            out = batch.select(["label", "rep", "copies", "v"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(own), pa.int32()), pa.array(also, pa.list_(pa.int32()))], names=["label", "rep", "copies", "v", "cell", "own", "also"])

    placed = stash(classes.mapInArrow(visits, "label string, rep long, copies long, v array<double>, cell int, own int, also array<int>"))
    home = F.col("own") == F.col("cell")
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("n_all"), F.sum(home.cast("int")).alias("n_home")).where("n_home > 0")
    counted = placed.join(sizes, ["label", "cell"])
    home_blocks, all_blocks = F.ceil(F.col("n_home") / BLOCK), F.ceil(F.col("n_all") / BLOCK)
    # A row of the cell goes, as one side, to all blocks of the other, and each row goes, as the other, to all blocks of the cell's rows.
    h, o = F.pmod(F.xxhash64("rep"), home_blocks), F.pmod(F.xxhash64("rep", F.lit(1)), all_blocks)
    as_home = counted.where(home).select("label", "cell", h.alias("hb"), F.explode(F.sequence(F.lit(0).cast("long"), all_blocks - 1)).alias("ob"), F.lit(True).alias("home"), "rep", "copies", "v", "own", "also")
    as_other = counted.select("label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), home_blocks - 1)).alias("hb"), o.alias("ob"), F.lit(False).alias("home"), "rep", "copies", "v", "own", F.lit(None).cast("array<int>").alias("also"))

    def compare(group: pa.Table) -> pa.Table:
        side = np.array(group.column("home").to_pylist(), dtype=bool)
        rep, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
        x = _unit(_matrix(group.column("v")))
        here = group.column("cell")[0].as_py()
        visiting = None
        if here >= 0:
            visiting = np.zeros((int(side.sum()), len(cells)), dtype=bool)
            for row, them in zip(visiting, group.column("also").filter(pa.array(side)).to_pylist(), strict=True):
                row[them] = True
        hx, hr, hc = x[side], rep[side], copies[side]
        ox, orp, oc, oo = x[~side], rep[~side], copies[~side], own[~side]
        n, a, b = [], [], []
        for i in range(0, len(hx), 256):
            some = slice(i, i + 256)
            link = hx[some] @ ox.T >= least
            # Of two rows of this cell the larger counts as other; a visitor that is visited back counts in the lower cell.
            link &= np.where(oo == here, hr[some, None] < orp, True)
            if visiting is not None:
                link &= ~((oo < here) & visiting[some][:, np.maximum(oo, 0)])
            y, z = np.nonzero(link)
            n += [(hr[some][y], oc[z]), (orp[z], hc[some][y])]
            a.append(np.minimum(hr[some][y], orp[z]))
            b.append(np.maximum(hr[some][y], orp[z]))
        who = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in n)])
        many = np.concatenate([np.zeros(0, np.int64), *(m for _, m in n)])
        reps, back = np.unique(who, return_inverse=True)
        total = np.zeros(len(reps), np.int64)
        np.add.at(total, back, many)
        # Each end as a star from the smallest row it links with: enough to join what the block joins.
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        least_of = reps.copy()
        np.minimum.at(least_of, np.searchsorted(reps, b), a)
        hook = np.minimum(least_of[np.searchsorted(reps, a)], a)
        pair = np.unique(np.stack([np.concatenate([hook, hook]), np.concatenate([a, b])], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        pair = pair[pair[:, 0] != pair[:, 1]]
        gone = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"rep": pa.concat_arrays([pa.array(reps, pa.int64()), gone(len(pair))]), "n": pa.concat_arrays([pa.array(total), gone(len(pair))]), "a": pa.concat_arrays([gone(len(reps)), pa.array(pair[:, 0])]), "b": pa.concat_arrays([gone(len(reps)), pa.array(pair[:, 1])])})

    found = stash(as_home.unionByName(as_other).groupBy("label", "cell", "hb", "ob").applyInArrow(compare, "rep long, n long, a long, b long"))
    links = found.where("a is not null").select("a", "b").distinct()
    comps = components(classes.select(F.col("rep").alias("node")), links)
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    named = comps.withColumnRenamed("node", "rep").join(classes.select("rep", "first"), "rep")
    smallest = named.groupBy("comp").agg(F.min("first").alias("smallest"))
    of_class = stash(classes.join(counts, "rep", "left").join(named.select("rep", "comp"), "rep").join(smallest, "comp").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.col("smallest").alias("comp")))
    linked = rows.join(of_class, ["label", "v"]).select("vec_id", "n", "comp")
    others = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(~F.coalesce(_fine() & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    result = linked.unionByName(others.select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("comp")))
    return result.select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(True)).alias("kept"))


def _neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of x nearest to each row, by Euclidean distance."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    norms = (x * x).sum(axis=1)
    for i in range(0, len(x), 512):
        d = norms - 2 * (x[i : i + 512] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Parts of equal size of the sample's neighbour graph: from k-means cells, vertices move to the part that most of
    their neighbours are in, the most eager first, as long as there is room."""
    room = -(-len(x) // parts)
    score = x @ spherical_kmeans(x, parts).T
    part = np.full(len(x), -1)
    for _ in range(rounds):
        gain = np.zeros((len(x), parts))
        if part.min() >= 0:
            for j in range(graph.shape[1]):
                gain[np.arange(len(x)), part[graph[:, j]]] += 1
        gain[:, : score.shape[1]] += score * 0.5
        order = np.argsort(-(gain.max(axis=1)), kind="stable")
        fill = np.zeros(parts, np.int64)
        new = np.empty(len(x), np.int64)
        for i in order.tolist():
            p = int(gain[i].argmax())
            if fill[p] >= room:
                p = int(np.where(fill < room, gain[i], -np.inf).argmax())
            new[i] = p
            fill[p] += 1
        part = new
    return part


def _routing(m: np.ndarray, scale: float) -> np.ndarray:
    """What the router sees of vectors: direction, length against the sample's mean, and a constant."""
    return np.concatenate([_unit(m), np.linalg.norm(m, axis=1, keepdims=True) / scale, np.ones((len(m), 1))], axis=1)


def router(x1: np.ndarray, part: np.ndarray, parts: int, steps: int = 120, rate: float = 8.0) -> np.ndarray:
    """Softmax regression from a vector's routing features to its part; the step shrinks until the fit improves."""
    w = np.zeros((x1.shape[1], parts))
    goal = np.eye(parts, dtype=np.float32)[part]
    rate /= max(1.0, float((x1 * x1).sum(axis=1).mean()) / 2)
    for _ in range(steps):
        z = x1 @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        w += rate * (x1.T @ (goal - z) / len(x1) - 1e-4 * w)
    return w


def probes_needed(x1: np.ndarray, graph: np.ndarray, w: np.ndarray, recall: float) -> int:
    """The fewest parts whose search finds that share of the sample's true neighbours."""
    logit = x1 @ w
    home = logit.argmax(axis=1)
    rank = np.empty_like(logit, dtype=np.int64)
    rank[np.arange(len(logit))[:, None], np.argsort(-logit, axis=1)] = np.arange(logit.shape[1])
    at = np.sort(rank[np.arange(len(logit))[:, None], home[graph]].ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1 if len(at) else 1


def nearest(vectors: DataFrame, is_query, k: int = 10, per_part: int = PER_PART, recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, embedding) found for each row where ``is_query`` holds.

    Returns query_id, rank (from 1), vec_id, score: the Euclidean distance of the original vectors in double
    precision, ties to the smaller vec_id. A row is no neighbour of itself. Rows that are null, zero or hold null or
    non-finite components, and null ids, take no part; rows that share a vec_id are rows of their own, as candidates of
    each other too and as queries, each with ranks of its own. Vectors must have one length; those of another length than the sample's first take no part. Other
    columns are not read; an empty table gives an empty result.

    A bounded sample gives a neighbour graph, cut into balanced parts of about ``per_part`` rows of the table; a
    softmax regression learns the parts, and so indexes every row. Queries go to their most probable parts, as many as
    found the share ``recall`` of the sample's own neighbours, and in any case so many that they hold ``k`` other rows.
    Each part is searched in blocks whose number follows from its size, so that no task holds a large part whole, and
    each block sends k rows a query.
    """
    rows = stash(usable(vectors).select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()).withColumn("q", F.coalesce(is_query, F.lit(False))))
    parts, n = centres(rows.count(), per_part)
    m = sample_of(rows, n, unit=False)
    dim = m.shape[1]
    scale = float(np.linalg.norm(m, axis=1).mean()) if len(m) else 1.0
    x1 = _routing(m, scale) if len(m) else np.zeros((0, dim + 2))
    graph = _neighbour_graph(m, k) if len(m) > 1 else np.zeros((len(m), 0), np.int64)
    w = router(x1, balanced_partition(x1[:, :dim], graph, parts), parts) if len(m) else np.zeros((dim + 2, 1))
    probes = probes_needed(x1, graph, w, recall)

    def route(batches):
        for batch in batches:
            batch = batch.filter(pa.array(np.diff(batch.column("v").offsets.to_numpy()) == dim))
            if not batch.num_rows:
                continue
            order = np.argsort(-(_routing(_matrix(batch.column("v")), scale) @ w), axis=1, kind="stable").astype(np.int32)
            lists = [o if q else o[:1] for o, q in zip(order, batch.column("q").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    routed = stash(rows.mapInArrow(route, "vec_id long, v array<double>, row long, q boolean, parts array<int>"))
    home = F.get("parts", F.lit(0))
    # One number for each part: at most SAMPLE // PER_CENTRE of them.
    held = {r["p"]: r["n"] for r in routed.groupBy(home.alias("p")).agg(F.count("*").alias("n")).collect()}
    smallest = np.cumsum(sorted(held.get(p, 0) for p in range(w.shape[1])))
    probes = max(probes, int(np.searchsorted(smallest, min(k + 1, smallest[-1]))) + 1)
    asking = routed.where("q").select("vec_id", "v", "row", F.explode(F.slice("parts", 1, probes)).alias("part"))
    asked = {r["part"]: r["n"] for r in asking.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = {p: (max(1, -(-held.get(p, 0) // BLOCK)), max(1, -(-asked.get(p, 0) // BLOCK))) for p in {*held, *asked}}
    number = lambda i: F.get(F.array(*(F.lit(blocks.get(p, (1, 1))[i]) for p in range(w.shape[1]))), F.col("part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    stored = routed.select(home.alias("part"), "vec_id", "v", "row").withColumns({"rows": number(0), "asks": number(1)})
    stored = stored.select("part", dealt(F.col("rows")).alias("rb"), every(F.col("asks")).alias("qb"), F.lit(False).alias("asks"), "vec_id", "v", "row")
    asking = asking.withColumns({"rows": number(0), "asks": number(1)})
    asking = asking.select("part", every(F.col("rows")).alias("rb"), dealt(F.col("asks")).alias("qb"), F.lit(True).alias("asks"), "vec_id", "v", "row")

    def search(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), dtype=bool)
        ids, row, m = group.column("vec_id").to_numpy(), group.column("row").to_numpy(), _matrix(group.column("v"))
        order = np.argsort(ids[~asks], kind="stable")
        own, own_row, c = ids[~asks][order], row[~asks][order], m[~asks][order]
        q_out, r_out, i_out, s_out = [], [], [], []
        norms = (c * c).sum(axis=1)
        for qid, q_row, v in zip(ids[asks].tolist(), row[asks].tolist(), m[asks], strict=True):
            if not len(c):
                break
            rough = norms - 2 * (c @ v)
            rough[own_row == q_row] = np.inf
            # No rough distance is off by more than slack, so whatever may be among the k nearest or tie with the last of them is measured.
            slack = 4 * (len(v) + 8) * np.finfo(float).eps * (norms + v @ v)
            near = np.flatnonzero(~(rough - slack > np.partition(rough + slack, min(k, len(c)) - 1)[min(k, len(c)) - 1]))
            near = near[own_row[near] != q_row]
            d = np.sqrt(((c[near] - v) ** 2).sum(axis=1))
            top = np.argsort(d, kind="stable")[:k]
            q_out.append(np.full(len(top), qid))
            r_out.append(np.full(len(top), q_row))
            i_out.append(own[near][top])
            s_out.append(d[top])
        cat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
        return pa.table({"query_id": cat(q_out, np.int64), "row": cat(r_out, np.int64), "vec_id": cat(i_out, np.int64), "score": cat(s_out, np.float64)})

    found = stored.unionByName(asking).groupBy("part", "rb", "qb").applyInArrow(search, "query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
