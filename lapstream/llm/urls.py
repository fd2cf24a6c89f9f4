"""URL allow and block rules as a sort-merge range join over reversed hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table, tasks

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    after = F.substring_index(F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)), "/", 1)
    after = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    lower = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, lower).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the top level down, each closed by a dot: a host's subdomains are the keys that its key begins."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def swept(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` (key and others) with ``open``: what is open at the key among the nested intervals of ``marks``.

    A mark (key, inside, outside) is the interval of all keys that begin with its key: ``inside`` is open from its
    start, ``outside`` behind its end. Interval ends and keys are sorted together, range by range, and the last end
    before a key tells what is open there; what is open at the end of a range is carried into the next ones.
    """
    others = [c for c in seen.columns if c != "key"]
    bare = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in others]
    starts = marks.select("key", F.lit(0).alias("kind"), F.struct(F.col("inside").alias("x")).alias("mark"), *bare)
    ends = marks.select(F.concat("key", F.lit(_LAST)).alias("key"), F.lit(2).alias("kind"), F.struct(F.col("outside").alias("x")).alias("mark"), *bare)
    rows = seen.select("key", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["mark"].dataType).alias("mark"), *others)
    # Fixed before it is read twice: a range must be the same range each time.
    ranged = stash(starts.unionByName(ends).unionByName(rows).repartitionByRange(tasks(seen, 8), "key", "kind").withColumn("range", F.spark_partition_id()))
    # Where an outer interval ends at the same key as an inner one, the outer one (the shorter key) counts.
    order = [F.col("key"), F.col("kind"), F.length("key").desc()]
    last = ranged.where("mark is not null").groupBy("range").agg(F.max_by("mark", F.struct("key", "kind", -F.length("key"))).alias("left_open"))
    carried = ranged.select("range").distinct().join(last, "range", "left").select("range", F.last("left_open", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    here = ranged.withColumn("here", F.last("mark", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return here.where("kind = 1").join(carried, "range").select("key", *others, F.coalesce("here", "carried")["x"].alias("open"))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): for each of the distinct hosts the keys of the rules' hosts that it lies under, at most one for
    each label of the host."""
    keys = rules.select(reversed_host(F.col("host")).alias("key")).distinct()
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), "\\.")
    upper = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))).alias("up"))
    chain = upper.join(keys.select(F.col("key").alias("up")), "up").groupBy("key").agg(F.collect_list("up").alias("inside")).withColumn("outside", F.array_remove("inside", F.col("key")))
    return swept(chain, hosts.select(reversed_host(F.col("host")).alias("key"), "host")).select("host", F.col("open").alias("stack"))


def path_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """``asked`` (under, path) with ``rule``: the longest of the rules of the host key ``under`` whose path begins the
    path, null if there is none. All rules of a host nest, so however many there are, one is open at a key."""
    join = lambda under, path: F.concat(under, F.lit("\x01"), path)
    own = rules.select(join(reversed_host(F.col("host")), F.col("path")).alias("key"), reversed_host(F.col("host")).alias("under"), "path", F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("rule"), F.col("verdict")).alias("inside"))
    own = own.groupBy("key", "under", "path").agg(F.max("inside").alias("inside"))
    upper = own.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: join(F.col("under"), F.left("path", n)))).alias("up")).where("up <> key")
    outer = upper.join(own.select(F.col("key").alias("up"), F.col("inside").alias("outer")), "up").groupBy("key").agg(F.max("outer").alias("outside"))
    marks = own.select("key", "inside").join(outer, "key", "left")
    return swept(marks, asked.select(join(F.col("under"), F.col("path")).alias("key"), "under", "path")).select("under", "path", F.col("open").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The longest fitting rule and the verdict for each url of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path starts with
    the rule's; the longest host and path together win, then the longer host, then the larger text. Returns
    page_id, host, path, rule (host and path, else null), verdict (``default`` without a rule). A null url or one
    without ``://`` has host and path ''. Repeated and null page_ids are rows like others; other columns are not
    read; an empty table gives an empty result; without rules every verdict is the default.

    Two sweeps: over distinct hosts, for the stack of rules' hosts that each lies under, and over distinct paths under
    each of those, for the longest rule there. So a host or url with a third of all pages is one row in them, and no
    list of rules is held; the join back reads both sides from exchanges, which the skew join can split.
    """
    rules = rules.select(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), F.concat("host", "path").alias("rule"), F.col("verdict").cast("string").alias("verdict"))
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    places = stash(parsed.select("host", "path").distinct())
    stacks = host_stacks(places.select("host").distinct(), rules)
    under = stash(places.join(stacks, "host").select("host", "path", F.explode("stack").alias("under")))
    found = path_rules(under.select("under", "path").distinct(), rules).where("rule is not null")
    best = under.join(found, ["under", "path"]).groupBy("host", "path").agg(F.max("rule").alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH p AS (SELECT page_id, COALESCE(regexp_replace(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '\x00', ''), '') AS h0,
                  COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM (SELECT DISTINCT * FROM q) q JOIN r ON ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, f.rule, COALESCE(f.v, 'allow') AS verdict
FROM q LEFT JOIN f ON q.page_id IS NOT DISTINCT FROM f.page_id AND q.host = f.host AND q.path = f.path
"""
