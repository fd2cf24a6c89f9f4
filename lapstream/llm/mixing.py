"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of a key that make a range: 4096 ranges a source.
RANGE_DIGITS = 3


def _weight(rank: Column, weights: tuple[float, ...]) -> Column:
    out = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        out = F.when(F.pmod(rank - 1, F.lit(len(weights))) == i, F.lit(float(w))).otherwise(out)
    return out


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source_size, target) from (src, source, source_size): shares by weight, filled up like water in
    vessels of ``most`` times a source's size. One row for each source goes through one task."""
    ranked = sources.withColumn("w", _weight(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")), weights)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "source", "src")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
        .withColumn("mark", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.coalesce("source", F.lit("")).alias("s"), "level")))
        .withColumn("level", F.min("mark").over(everything)["level"])
    )
    return filled.select("src", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str, narrow: bool) -> DataFrame:
    """``row`` (the input row, or only its doc_id), size, source_size, target, taken."""
    text, source, doc_id = (F.col(c).cast("string") for c in ("text", "source", "doc_id"))
    row = F.struct("doc_id") if narrow else F.struct("*")
    base = docs.select(
        row.alias("row"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"),
        source.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(doc_id, F.lit("")))).alias("key"),
    ).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    if narrow:
        base = stash(base)
    parts = stash(base.groupBy("src", "source", "part").agg(F.sum("size").alias("part_size")))
    sources = parts.groupBy("src", "source").agg(F.sum("part_size").alias("source_size"))
    offsets = parts.select("src", "part", (F.sum("part_size").over(Window.partitionBy("src").orderBy("part")) - F.col("part_size")).alias("part_before"))
    goal = offsets.join(targets(sources, weights, share, most), "src")
    inside = Window.partitionBy("src", "part").orderBy("key", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(goal, ["src", "part"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    left = budget - whole * F.col("source_size") - F.col("part_before") - F.col("before")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:") -> DataFrame:
    """How many words a mix takes from every document of ``docs`` (doc_id, text, source).

    Sources in code-point order, null last, weigh ``weights``, repeating; together they get ``share`` times all
    words, none more than ``most`` times its own; what is above goes to the others by weight. Each source takes
    its documents in the order of a hash of doc_id, as many times over as the target asks, and cuts the last
    pass at the exact word: sum(taken) is the whole part of the target.

    Returns doc_id, size, source_size, target, taken. Null and blank texts have size 0. A null source is a
    source; null and repeated doc_ids are rows like others, in the order of size where ids tie. Sources without
    words have target 0. An empty table gives an empty result.

    The order is cut into 4096 hash ranges a source, so the running sums of a source that holds a third of all
    rows are made in 4096 places; only range totals are summed in one task for each source.
    """
    return planned(docs, tuple(weights), share, most, seed, narrow=True).select("row.doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:") -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row for each whole pass over a document, and one row with
    the first words (joined by one space) of the document that a source's cut falls into. Documents without words
    that the mix reaches take no words and are left out."""
    plan = planned(docs, tuple(weights), share, most, seed, narrow=False).where("taken > 0")
    part = F.pmod("taken", "size")
    whole = plan.where("taken >= size").select(F.explode(F.sequence(F.lit(1), F.floor(F.col("taken") / F.col("size")))).alias("pass"), "row").select("row.*")
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(f"({WORD})"), F.lit(1))
    rest = plan.where(part > 0).withColumn("row", F.col("row").withField("text", F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))).select("row.*")
    return whole.unionByName(rest)


def op4(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * (SELECT SUM(source_size) FROM s)::DOUBLE AS total FROM s),
l AS (SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / SUM(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, LEAST(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(FLOOR(t.target) AS BIGINT) AS b,
             CAST(SUM(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(b // source_size * size + GREATEST(0, LEAST(size, b - b // source_size * source_size - before)) AS BIGINT) AS taken FROM p
"""
