"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, table

#: Where a candidate stands: the body of a private key, lines of sixteen or more of base64 (fewer only at the end, before its END
#: line or nothing), so that words behind a header are no part of a key; or a name of up to 41 characters, a sign of assignment and at least eight characters
#: without blanks, quotes, commas or ``=?&``; or sixteen or more of letters, digits and ``+/_-.`` anywhere.
KEY_BODY = r"(?:\s{1,8}[A-Za-z0-9+/]{16,}+={0,2})+(?:\s{1,8}[A-Za-z0-9+/]{1,15}+={0,2}(?=\s{0,8}(?:-----END|$)))?"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
ASSIGNED = r"[\"']?(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_.\-]{1,40}+[\"']?[ \t]{0,2}(?:=>|:=|[=:])[ \t]{0,2}[\"'`]?"
CANDIDATE = rf"({KEY_BLOCK})({KEY_BODY})|({ASSIGNED})([^\s\"'`<>,;=?&]{{8,}}+={{0,2}})|(?<![A-Za-z0-9+/_\-.])([A-Za-z0-9+/_\-.]{{15,}}[A-Za-z0-9+/_\-]={{0,2}})"
#: A value given to a name that is no credential's counts only from this length on.
LONG = 16
#: Names of credentials, names of things that look like them, and how issuers' keys begin.
CREDENTIAL = r"(?i)(token|secret|passw|passphrase|pwd|api[_\-.]?key|access[_\-.]?key|auth|credential|private)"
HARMLESS = r"(?i)(sha|md5|digest|hash|checksum|etag|commit|revision|uuid|guid|version|url|uri|href|src|path|file|https?|ftp|date|time|isbn|doi)"
ISSUED = r"^(AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|AIza|glpat-|eyJ)"
#: Forms of values that are no secrets: numbers, words, addresses, files and dotted names.
PLAIN = r"^(?:[0-9.\-/:]+|[A-Za-z]?[a-z]+(?:[\-_./][A-Za-z]?[a-z]+)*|//.*|.*\.(?:html?|png|jpe?g|gif|css|js|py|txt|pdf|json|xml|csv)|[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})$"
MEASURES = ["length", "digits", "uppers", "hexes", "marks", "variety", "letter_digit", "case", "to_mark", "dictionary", "slashes", "dots", "rooted", "assigned", "block"]
#: Buckets of neighbouring words.
NEIGHBOURS = 64
#: How often a word must stand in all texts to be a word of the dictionary.
DICTIONARY_COUNT = 5
#: Labelled findings of each class that the forest is fitted on: those whose values hash lowest, at most so many.
TRAIN_FINDINGS = 10_000
MASK = "[SECRET]"


def _apart(texts: DataFrame) -> DataFrame:
    """(h, gaps, hits) of each row of (h, text) that has a match of the pattern: what matches and what stands between.

    One pass puts a mark around each match and the text is split there. A mark holds the text's own MD5 ``h``."""
    mark = F.concat(F.lit("\x01"), F.col("h"), F.lit("\x01"))
    marked = F.regexp_replace("text", F.lit(CANDIDATE), F.concat(mark, F.lit("$0"), mark))
    parts = texts.where(F.col("text").rlike(CANDIDATE)).select("h", F.split(marked, mark, -1).alias("parts"))
    return parts.select("h", F.filter("parts", lambda _, i: i % 2 == 0).alias("gaps"), F.filter("parts", lambda _, i: i % 2 == 1).alias("hits"))


def findings(texts: DataFrame) -> DataFrame:
    """(h, nth, before, value, left, right) for each candidate of each row of (h, text): the name and sign before it
    and up to 60 characters on both sides. ``nth`` counts the matches of the pattern, candidates or not."""
    ends = [F.transform("gaps", lambda g: F.right(g, F.lit(60))), F.transform("gaps", lambda g: F.left(g, F.lit(60)))]
    rows = _apart(texts).select("h", F.col("hits").alias("hit"), ends[0].alias("left"), F.slice(ends[1], F.lit(2), F.size("hits")).alias("right"))
    rows = rows.select("h", F.posexplode_outer(F.arrays_zip("hit", F.slice("left", F.lit(1), F.size("hit")).alias("left"), "right")).alias("nth", "c"))
    group = lambda *n: F.concat(*(F.regexp_extract("hit", f"^(?:{CANDIDATE})", i) for i in n))
    found = rows.select("h", "nth", F.col("c.hit").alias("hit"), F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    found = found.select("h", "nth", group(1, 3).alias("before"), group(2, 4, 5).alias("value"), "left", "right")
    return found.where((F.length("value") >= LONG) | F.col("before").rlike(CREDENTIAL))


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")) / F.length(value)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 2)


def dictionary(texts: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """(word): lower-case words of 3 to 20 Latin letters that stand at least so often in all texts of ``text``."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^a-zß-ÿ]+")).alias("word")).where(F.length("word").between(3, 20))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (key, before, value, left, right) with the measures of the value and ``near``, the neighbouring words:
    three on each side and those of the name. Length, kinds of characters and transitions between them, the share of
    the value that words of the dictionary cover, and signs of a path."""
    v = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    steps = lambda *pairs: sum((F.length(F.regexp_replace(kinds, p[0] + "(?=" + p[1] + ")", "..")) - F.length(v) for p in pairs), F.lit(0)) / F.length(v)
    pieces = found.select("key", F.explode(F.regexp_extract_all("value", F.lit(r"[A-Z]?[a-zß-ÿ]{2,}|[A-Z]{3,}"), F.lit(0))).alias("piece")).withColumn("word", F.lower("piece"))
    covered = pieces.join(words, "word").groupBy("key").agg(F.sum(F.length("piece")).alias("covered"))
    left, right = _words(F.col("left")), _words(F.col("right"))
    near = F.array_distinct(F.concat(F.transform(F.slice(F.reverse(left), 1, 3), lambda w: F.concat(F.lit("<"), w)), F.transform(F.slice(right, 1, 3), lambda w: F.concat(F.lit(">"), w)), F.transform(_words(F.col("before")), lambda w: F.concat(F.lit("="), w))))
    return found.join(covered, "key", "left").select(
        *found.columns,
        F.length(v).cast("double").alias("length"),
        _share(v, "0-9").alias("digits"),
        _share(v, "A-Z").alias("uppers"),
        _share(v, "0-9a-fA-F").alias("hexes"),
        (1 - _share(v, "0-9a-zA-Z")).alias("marks"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("variety"),
        steps(("[aB]", "0"), ("0", "[aB]")).alias("letter_digit"),
        steps(("a", "B"), ("B", "a")).alias("case"),
        steps(("[^-]", "-"), ("-", "[^-]")).alias("to_mark"),
        (F.coalesce("covered", F.lit(0)) / F.length(v)).alias("dictionary"),
        _share(v, "/").alias("slashes"),
        _share(v, ".").alias("dots"),
        v.rlike("^[/.]|://").cast("double").alias("rooted"),
        F.col("before").rlike("[=:]").cast("double").alias("assigned"),
        F.startswith("before", F.lit("-----")).cast("double").alias("block"),
        near.alias("near"),
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels where there is no table of reviewed findings: 1 for values given to a credential's name, issuers' keys
    and private keys, 0 for values given to harmless names and for values of a plain form; none for the others.

    Names and forms decide here, not the measures. Each labelled finding with a name comes twice, once without the
    name among the neighbouring words, so that the forest has to tell its value too."""
    plain = F.col("value").rlike(PLAIN)
    label = F.when(F.col("value").rlike(ISSUED) | (F.col("block") == 1), 1.0).when(plain, 0.0).when(F.col("before").rlike(CREDENTIAL), 1.0).when(F.col("before").rlike(HARMLESS), 0.0)
    nameless = F.filter("near", lambda w: ~F.startswith(w, F.lit("=")))
    views = F.array_distinct(F.array(F.col("near"), nameless))
    return found.withColumn("label", label).where("label is not null").withColumn("near", F.explode(views))


def judged(docs: DataFrame, labelled: DataFrame | None = None, most: int = TRAIN_FINDINGS) -> DataFrame:
    """(h, nth, before, value, probability, is_secret) of all candidates in the distinct texts of ``docs``.

    ``labelled`` (before, value, left, right, label) are reviewed findings; without it weak labels teach the forest. It
    is fitted on at most ``most`` of each class. If they are of one class or none, the share of that class (0 without
    any) is the probability of all. A value that stands more than once in a text has its highest probability there.
    """
    text = F.col("text").cast("string")
    held = docs.select(F.md5(text).alias("h"), text.alias("text")).where("text is not null")
    words = dictionary(held)
    found = stash(findings(held).dropDuplicates(["h", "nth"]).withColumn("key", F.concat_ws(":", "h", "nth")))
    found = stash(described(found, words))
    if labelled is None:
        taught = weak_labels(found)
    else:
        given = labelled.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "value", "left", "right")), F.col("label").cast("double").alias("label"))
        taught = described(given.where("value <> ''").withColumn("key", F.sha2(F.concat_ws("\x00", "before", "value", "left", "right"), 256)).dropDuplicates(["key"]), words)
    lowest = [F.xxhash64("value", "before"), "value", "before", F.array_join("near", " ")]
    taught = taught.select("value", "before", "label", "near", *MEASURES)
    taught = stash(taught.where("label > 0").orderBy(*lowest).limit(most).unionByName(taught.where("label <= 0").orderBy(*lowest).limit(most)))
    classes = [r["label"] for r in taught.select("label").distinct().collect()]
    if len(classes) < 2:
        verdicts = found.select("h", "nth", "before", "value", F.lit(float(sum(classes))).alias("probability"))
    else:
        hashed = HashingTF(inputCol="near", outputCol="beside", numFeatures=NEIGHBOURS, binary=True)
        to_vector = VectorAssembler(inputCols=[*MEASURES, "beside"], outputCol="features")
        forest = RandomForestClassifier(labelCol="label", numTrees=40, maxDepth=8, seed=7, probabilityCol="p").fit(to_vector.transform(hashed.transform(taught)))
        verdicts = forest.transform(to_vector.transform(hashed.transform(found))).select("h", "nth", "before", "value", vector_to_array("p")[1].alias("probability"))
    top = verdicts.groupBy("h", "value").agg(F.max("probability").alias("probability"))
    return verdicts.drop("probability").join(top, ["h", "value"]).select("h", "nth", "before", "value", "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates for secrets in ``docs`` (doc_id, text) with the forest's verdict.

    One row for each finding: doc_id, nth (place among the text's matches), name (what the value is given to),
    value_sha256, length, probability, is_secret. Null and empty texts have no findings; rows repeated with one doc_id
    or text have theirs each; null doc_ids stay null. Other columns are not read; an empty table gives an empty result.
    The time for a text grows with its length. Not found: values shorter than eight characters, values without a name
    shorter than sixteen or broken by characters other than ``+/_-.``.
    """
    text = F.col("text").cast("string")
    verdicts = stash(judged(docs, labelled))
    held = docs.select("doc_id", F.md5(text).alias("h"))
    return held.join(verdicts, "h").select("doc_id", "nth", F.regexp_extract("before", "[A-Za-z_][A-Za-z0-9_.-]*", 0).alias("name"), F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "probability", "is_secret")


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with its columns, each secret in a text masked; texts without secrets are unchanged.

    A text is taken apart at its candidates and put together again, so its time grows with its length. Nulls, empty
    texts and repeated rows stay as they are; an empty table stays empty."""
    secret = stash(judged(docs, labelled).where("is_secret").select("h", "nth", "value"))
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.md5(text).alias("h"))
    texts = docs.select(F.md5(text).alias("h"), text.alias("text")).join(secret.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    parts = _apart(texts).select("h", F.posexplode_outer(F.arrays_zip(F.col("gaps").alias("gap"), F.col("hits").alias("hit"))).alias("nth", "c")).select("h", "nth", F.col("c.gap").alias("gap"), F.coalesce("c.hit", F.lit("")).alias("hit"))
    masked = parts.join(secret, ["h", "nth"], "left").select("h", "nth", F.concat("gap", F.when(F.col("value").isNull(), F.col("hit")).otherwise(F.replace("hit", F.col("value"), F.lit(MASK)))).alias("part"))
    again = masked.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "part"))), lambda p: p["part"]), "").alias("masked"))
    return rows.join(again, "h", "left").select(F.col("row").withField("text", F.coalesce("masked", F.col("row.text").cast("string"))).alias("row")).select("row.*")


def op10(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
