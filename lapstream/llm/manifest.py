"""Merkle manifest of a dataset: aligned blocks keep each level of the tree as one string of hexadecimal digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table, tasks

HEX = 64
#: Children of a node, and levels that one block holds: a block has ARITY ** LEVELS leaves.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_SEGMENTS = "array<struct<left:string,right:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: for each value ``-`` if it is null, else its bytes in UTF-8, ``:`` and the value."""
    said = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)))


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf leads to between its siblings (``segments`` from below)."""
    return F.aggregate(segments, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof(segments: Column) -> Column:
    """One digest of all siblings of a leaf, level by level, left to right."""
    return digest(F.array_join(F.transform(segments, lambda s: F.concat(s["left"], s["right"])), ""))


def _part(level: Column, first: Column, nodes: Column) -> Column:
    return level.substr((first * HEX + 1).cast("int"), (nodes * HEX).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (HEX * ARITY)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: digest(_part(level, i * ARITY, F.lit(ARITY)))), "")


def indexed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 in its group ``grp``, and ``total``, the rows of the group.

    Rows are ranged over all groups together, numbered range by range, and moved up by the rows of earlier ranges, so
    a group with a third of all rows is numbered in a third of the tasks."""
    ranged = stash(rows.repartitionByRange(tasks(rows, 8), "grp", *order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("grp").orderBy("range")
    sizes = ranged.groupBy("grp", "range").agg(F.count("*").alias("n"))
    sizes = sizes.select("grp", "range", (F.sum("n").over(own) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    place = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(sizes, ["grp", "range"]).withColumn("idx", F.col("before") + F.col("place")).drop("range", "place", "before")


def _blocks(leaves: DataFrame) -> DataFrame:
    """A row for each aligned block of ``leaves`` (grp, total, idx, node, keep): its items in order, its levels as
    strings, for each level whether it has parents, and the node at its top. Only a block that is the whole group
    (``lone``) stops at a single node; the last block of a longer group goes up as far as all others."""
    item = F.struct((F.col("idx") % BLOCK).cast("int").alias("place"), "node", "keep")
    out = leaves.groupBy("grp", "total", F.floor(F.col("idx") / BLOCK).alias("blk")).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("lone", F.col("total") <= BLOCK)
    out = out.withColumn("level0", F.array_join(F.transform("items", lambda x: x["node"]), ""))
    for k in range(LEVELS):
        out = out.withColumn(f"grows{k}", ~F.col("lone") | (F.length(f"level{k}") > HEX))
        out = out.withColumn(f"level{k + 1}", F.when(F.col(f"grows{k}"), _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    return out.withColumnRenamed(f"level{LEVELS}", "top")


def _tower(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of the leaves, blocks of their tops, and so on, until each group has come to one block."""
    floors = [stash(_blocks(leaves))]
    while not (open_ := floors[-1].where("not lone")).isEmpty():
        nodes = open_.select("grp", F.ceil(F.col("total") / BLOCK).alias("total"), F.col("blk").alias("idx"), F.col("top").alias("node"), F.struct(F.lit(0).alias("none")).alias("keep"))
        floors.append(stash(_blocks(nodes)))
    return floors


def _segments(place: Column) -> Column:
    """Left and right siblings on each level of the block of the item at ``place``."""
    out = []
    for k in range(LEVELS):
        own = F.shiftright(place, 3 * k)
        first = F.shiftright(own, 3) * ARITY
        level = F.col(f"level{k}")
        segment = F.struct(_part(level, first, own - first).alias("left"), _part(level, own + 1, first + ARITY - 1 - own).alias("right"))
        out.append(F.when(F.col(f"grows{k}"), segment))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def _descend(floors: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, idx, node, keep, segments, crown) for all leaves of a tower. ``above`` has the segments over the top of
    each group (grp, blk 0, ups, crown)."""
    own = above
    for k, blocks in reversed(list(enumerate(floors))):
        items = F.transform("items", lambda x: F.struct((F.col("blk") * BLOCK + x["place"]).alias("idx"), x["node"].alias("node"), x["keep"].alias("keep"), F.concat(_segments(x["place"]), F.col("ups")).alias("segments")))
        rows = blocks.join(above, ["grp", "blk"]).select("grp", "crown", F.inline(items))
        if k:
            closed = own.join(floors[k - 1].where("lone").select("grp"), "grp", "left_semi")
            above = closed.unionByName(rows.select("grp", F.col("idx").alias("blk"), F.col("segments").alias("ups"), "crown"))
    return rows


def manifest(docs: DataFrame, group: Column, order: list[str], leaf: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, its ``leaf``, the ``subroot`` of its group, the ``root`` of all
    groups, and ``segments``: left and right siblings from below, over the subroot to the root.

    Rows of a group ascend by ``order`` (null first), then by leaf; equal leaves are equal rows, so any order of theirs
    gives the same tree. Groups ascend bytewise, null first. While more than one node remains, every eight in a row
    become one (the last run may be shorter, even one node). A lone leaf is its own subroot, a lone subroot the root.
    An empty table gives an empty result; other columns of ``docs`` are not read.

    Texts are read once, for their leaves; what is shuffled are digests. A block is 512 leaves, as are the blocks of
    blocks, so there are few floors however long a group is, and no task holds a group.
    """
    cols = [f"o{i}" for i in range(len(order))]
    name = group.cast("string")
    narrow = docs.select(F.coalesce(F.concat(F.lit("g"), name), F.lit("-")).alias("grp"), *(F.col(c).alias(n) for c, n in zip(order, cols)), leaf.alias("node"), F.struct(*keep).alias("keep"))
    # A row's number makes ranges of equal rows divisible; it is fixed before the table is read twice.
    narrow = stash(narrow.withColumn("number", F.monotonically_increasing_id()))
    floors = _tower(indexed(narrow, [*cols, "node", "number"]).select("grp", "total", "idx", "node", "keep"))
    tops = reduce(DataFrame.unionByName, (f.where("lone").select("grp", F.col("top").alias("node")) for f in floors))
    every = indexed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("o0"), "node", F.struct(F.col("grp").alias("grp")).alias("keep")), ["o0"])
    crowns = _tower(every.select("grp", "total", "idx", "node", "keep"))
    root = crowns[-1].select("grp", F.lit(0).cast("long").alias("blk"), F.array().cast(_NO_SEGMENTS).alias("ups"), F.struct(F.col("top").alias("root")).alias("crown"))
    above = _descend(crowns, root).select(F.col("keep.grp").alias("grp"), F.lit(0).cast("long").alias("blk"), F.col("segments").alias("ups"), F.struct(F.col("node").alias("subroot"), F.col("crown.root").alias("root")).alias("crown"))
    return _descend(floors, stash(above)).select("keep.*", F.col("node").alias("leaf"), "crown.*", "segments")


def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in FIELDS]
    tampered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = F.when(marked, leaf_of([*values[:-1], tampered])).alias("seen")
    rows = manifest(docs, F.col("lang"), ["doc_id"], leaf_of(values), [F.col("doc_id"), seen])
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("segments")).alias("proof_sha256"), fold(F.coalesce("seen", "leaf"), F.col("segments")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT lang, doc_id,
         COALESCE(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || COALESCE(strlen(source) || ':' || source, '-') || COALESCE(strlen(lang) || ':' || lang, '-')
           || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
h AS (SELECT lang, doc_id, sha256(head || COALESCE(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN crc % 3 = 0 THEN sha256(head || COALESCE(strlen(low) || ':' || low, '-')) END AS seen FROM d),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS n,
             DENSE_RANK() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM h),
t AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM l
      UNION ALL
      SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lvl, i // 8, n),
tops AS (SELECT g, lvl, h, (SELECT COUNT(*) FROM t WHERE n = 1) AS n FROM t WHERE n = 1),
r AS (SELECT 0 AS lvl, g AS i, h, n FROM tops
      UNION ALL
      SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM r WHERE n > 1 GROUP BY lvl, i // 8, n),
sib AS (
  SELECT g, lvl, t.i AS i, COALESCE(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < t.i), '') AS a, COALESCE(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > t.i), '') AS b
  FROM t JOIN (SELECT g, lvl, i, h FROM t) o USING (g, lvl) WHERE t.n > 1 AND o.i // 8 = t.i // 8 GROUP BY g, lvl, t.i),
rib AS (
  SELECT r.lvl, r.i, COALESCE(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < r.i), '') AS a, COALESCE(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > r.i), '') AS b
  FROM r JOIN r o ON r.lvl = o.lvl AND o.i // 8 = r.i // 8 WHERE r.n > 1 GROUP BY r.lvl, r.i),
s AS (
  SELECT l.g, l.i AS leaf_i, sib.lvl AS stp, a, b FROM l JOIN sib ON l.g = sib.g AND sib.i = l.i // CAST(power(8, sib.lvl) AS BIGINT)
  UNION ALL
  SELECT l.g, l.i, tops.lvl + rib.lvl, a, b FROM l JOIN tops USING (g) JOIN rib ON rib.i = l.g // CAST(power(8, rib.lvl) AS BIGINT)),
f AS (SELECT g, i AS leaf_i, 0 AS stp, COALESCE(seen, leaf) AS node FROM l
      UNION ALL
      SELECT f.g, f.leaf_i, f.stp + 1, sha256(s.a || node || s.b) FROM f JOIN s ON f.g = s.g AND f.leaf_i = s.leaf_i AND f.stp = s.stp),
p AS (SELECT g, leaf_i, sha256(string_agg(a || b, '' ORDER BY stp)) AS proof FROM s GROUP BY g, leaf_i),
e AS (SELECT g, leaf_i, arg_max(node, stp) AS folded FROM f GROUP BY g, leaf_i)
SELECT l.doc_id, l.leaf, tops.h AS subroot, (SELECT h FROM r WHERE n = 1) AS root, COALESCE(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root,
       e.folded = (SELECT h FROM r WHERE n = 1) AS verified
FROM l JOIN tops USING (g) JOIN e ON e.g = l.g AND e.leaf_i = l.i LEFT JOIN p ON p.g = l.g AND p.leaf_i = l.i
"""
