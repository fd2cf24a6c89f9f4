"""Splits, training with calibration, importance and bundles on Spark ML."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evaluation as E

def grouped_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups dealt by size in a zigzag, so folds hold about the same number of rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), group)) - 1
    turn = F.floor(rank / folds)
    return sizes.select(group, F.when(turn % 2 == 0, rank % folds).otherwise(folds - 1 - rank % folds).cast("int").alias("fold"))


def split_plan(df: DataFrame, group: str, mode: str, folds: int = 5, order: str | None = None) -> DataFrame:
    """(fold, group, role) for grouped, leave_one_out, rolling_year and expanding splits."""
    if mode == "grouped":
        f = grouped_folds(df, group, folds)
        return f.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select(F.col("test").alias("fold"), group, F.when(F.col("fold") == F.col("test"), "test").otherwise("train").alias("role"))
    keys = df.groupBy(group).agg(F.min(order or group).alias("o"))
    index = F.dense_rank().over(Window.orderBy("o") if mode == "rolling_year" else Window.orderBy("o", group)) - 1
    keys = keys.withColumn("i", index)
    tests = keys.select(F.col("i").alias("fold")).distinct()
    j = keys.join(tests, F.lit(True) if mode == "leave_one_out" else F.col("i") <= F.col("fold"))
    if mode != "leave_one_out":
        j = j.where("fold > 0")
    return j.select("fold", group, F.when(F.col("i") == F.col("fold"), "test").otherwise("train").alias("role"))


def leaks(plan: DataFrame, group: str) -> DataFrame:
    """Groups that are in both roles of a fold."""
    return plan.groupBy("fold", group).agg(F.countDistinct("role").alias("roles")).where("roles > 1")


def pipeline(numeric: list[str], categorical: list[str], label: str, rounds: int = 10) -> Pipeline:
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])
    vector = VectorAssembler(inputCols=[*numeric, *(f"{c}_v" for c in categorical)], outputCol="features", handleInvalid="keep")
    model = GBTClassifier(labelCol=label, featuresCol="features", weightCol="w", maxIter=rounds, maxDepth=4, seed=7)
    return Pipeline(stages=[index, hot, vector, model] if categorical else [vector, model])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """With ``w``: the positives' weight makes both classes count alike."""
    ratio = df.agg((F.sum(1 - F.col(label)) / F.greatest(F.sum(label), F.lit(1))).alias("r"))
    return df.crossJoin(F.broadcast(ratio)).withColumn("w", F.when(F.col(label) == 1, F.col("r")).otherwise(F.lit(1.0))).drop("r")


def train_oof(
    df: DataFrame, plan: DataFrame, group: str, numeric: list[str], categorical: list[str], label: str, grid: list[dict] | None = None, parallel: int = 4, method: str = "auto", least: int = 1000, floor: float = 0.0
) -> DataFrame:
    """Out-of-fold rows of every configuration of ``grid`` (parameters of ``GBTClassifier``) and fold of ``plan``.

    Each fit calibrates on a fifth of its training groups (``calibrator``), where the threshold of the best F1 with a
    precision of at least ``floor`` is locked as well. The rows are joined with the plan and persisted once; at most
    ``parallel`` fits run at a time. Returns the rows with config_id, fold, raw_proba, calibrated, threshold, decision and
    calibration (its method); they are no longer tied to the persisted table, which is dropped at the end."""
    configs = list(enumerate(grid or [{}]))
    held = F.pmod(F.xxhash64(group), F.lit(5)) == 0
    rows = df.join(plan.select(group, "fold", "role"), group).persist()
    spark, points = df.sparkSession, [i / 100 for i in range(1, 100)]
    try:
        folds = [r["fold"] for r in plan.select("fold").distinct().orderBy("fold").collect()]

        def one(task: tuple) -> DataFrame:
            (number, params), fold = task
            own = rows.where(F.col("fold") == fold)
            steps = pipeline(numeric, categorical, label)
            steps.getStages()[-1].setParams(**params)
            model = steps.fit(weighted(own.where((F.col("role") == "train") & ~held), label))
            score = lambda x: model.transform(x.withColumn("w", F.lit(1.0))).withColumn("raw_proba", vector_to_array("probability")[1])
            inner = score(own.where((F.col("role") == "train") & held)).select("raw_proba", label)
            fitted, how = calibrator(inner, label, method, least)
            lock = calibrated(inner, fitted).select(F.col("calibrated").alias(E.P), F.col(label).alias(E.Y))
            threshold = E.best_threshold(E.threshold_sweep(lock, points), floor).first()["threshold"]
            threshold = 0.5 if threshold is None else threshold
            test = calibrated(score(own.where("role = 'test'")).select(*df.columns, "fold", "raw_proba"), fitted)
            told = {"config_id": F.lit(number), "threshold": F.lit(threshold), "decision": (F.col("calibrated") >= threshold).cast("int"), "calibration": F.lit(how)}
            return test.select(*df.columns, "fold", "raw_proba", "calibrated").withColumns(told)

        tasks = [(config, fold) for config in configs for fold in folds]
        with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
            out = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(one), tasks))
        return out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
    finally:
        rows.unpersist()


def leaderboard(oof: DataFrame, label: str) -> DataFrame:
    """A row for each configuration of ``train_oof``: folds, means over them of average precision (of raw and calibrated
    scores), lift, Brier score, F1 of the locked threshold, and the share of folds calibrated by isotonic regression; best
    calibrated average precision first."""
    keys = ["config_id", "fold"]
    said = lambda score, name: E.fold_metrics(oof.select(*keys, F.col(score).alias(E.P), F.col(label).cast("int").alias(E.Y)), [0.5], 0.0, keys).select(*keys, F.col("average_precision").alias(f"ap_{name}"), F.col("lift").alias(f"lift_{name}"), F.col("brier").alias(f"brier_{name}"))
    y, d = F.col(label), F.col("decision")
    locked = oof.groupBy(*keys).agg(F.try_divide(2 * F.sum(y * d), F.sum(y) + F.sum(d)).alias("f1_locked"), F.max("threshold").alias("threshold"), F.max((F.col("calibration") == "isotonic").cast("double")).alias("isotonic"))
    j = said("raw_proba", "raw").join(said("calibrated", "calibrated"), keys).join(locked, keys)
    means = [F.round(F.avg(c), 6).alias(c) for c in ("ap_raw", "ap_calibrated", "lift_calibrated", "brier_raw", "brier_calibrated", "f1_locked", "threshold", "isotonic")]
    return j.groupBy("config_id").agg(F.count("*").alias("folds"), *means).orderBy(F.col("ap_calibrated").desc(), F.col("f1_locked").desc(), "config_id")


def permutation_drop(model: PipelineModel, df: DataFrame, columns: list[str], label: str, key: list[str]) -> DataFrame:
    """How much F1 falls when a column's values are dealt anew: two hash-dealt orders in buckets, joined place by place."""
    def f1(x: DataFrame) -> float:
        r = model.transform(x.withColumn("w", F.lit(1.0))).agg(F.sum(((F.col("prediction") == 1) & (F.col(label) == 1)).cast("int")).alias("tp"), F.sum((F.col("prediction") == 1).cast("int")).alias("p"), F.sum(F.col(label)).alias("y")).first()
        return 2.0 * (r["tp"] or 0) / max(1, (r["p"] or 0) + (r["y"] or 0))

    whole, rows = f1(df), []
    for c in columns:
        bucket = F.pmod(F.xxhash64(*key), F.lit(64))
        a = df.withColumn("__b", bucket).withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(*key)))
        b = a.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(*key, F.lit(c)), *key)).alias("__i"), F.col(c).alias("__v"))
        rows.append((c, whole - f1(a.join(b, ["__b", "__i"]).withColumn(c, F.col("__v")).drop("__b", "__i", "__v"))))
    return df.sparkSession.createDataFrame(rows, "feature string, f1_drop double")


def permutation_by_window(model: PipelineModel, df: DataFrame, columns: list[str], label: str, key: list[str], window: str, repeats: int = 3) -> DataFrame:
    """(window, feature, repeat, f1, f1_drop): how much F1 falls in each ``window`` (a column) when a feature's values are
    dealt anew among the window's rows. All features and repeats are one table, scored once.

    Rows of a window are dealt into 64 buckets by their key; within a bucket a second order by hash says whose value a
    row gets. So a window of any length is permuted in 64 places for each feature and repeat."""
    bucket = [window, "feature", "repeat", "__b"]
    tasks = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for c in columns for r in range(repeats)), F.struct(F.lit("").alias("feature"), F.lit(0).alias("repeat"))))
    each = df.withColumn("__b", F.pmod(F.xxhash64(*key), F.lit(64))).withColumn("__t", tasks).select(*df.columns, "__b", "__t.*")
    placed = each.withColumn("__i", F.row_number().over(Window.partitionBy(*bucket).orderBy(*key)))
    values = F.struct(*columns)
    given = each.select(*bucket, values.alias("__v"), F.row_number().over(Window.partitionBy(*bucket).orderBy(F.xxhash64(*key, "feature", "repeat"), *key)).alias("__i"))
    mixed = placed.join(given, [*bucket, "__i"]).withColumns({c: F.when(F.col("feature") == c, F.col("__v")[c]).otherwise(F.col(c)) for c in columns})
    y, p = F.col(label), F.col("prediction")
    f1 = F.try_divide(2 * F.sum(y * p), F.sum(y) + F.sum(p))
    scored = model.transform(mixed.withColumn("w", F.lit(1.0))).groupBy(window, "feature", "repeat").agg(F.coalesce(f1, F.lit(0.0)).alias("f1"))
    whole = scored.where("feature = ''").select(window, F.col("f1").alias("whole"))
    return scored.where("feature <> ''").join(whole, window).select(window, "feature", "repeat", F.round("f1", 9).alias("f1"), F.round(F.col("whole") - F.col("f1"), 9).alias("f1_drop"))


def rank_agreement(drops: DataFrame, window: str) -> DataFrame:
    """(a, b, spearman): rank correlation of the features' mean drops between each two windows, of ``permutation_by_window``.
    There are as many rows as pairs of windows, each from one row a feature."""
    mean = drops.groupBy(window, "feature").agg(F.avg("f1_drop").alias("m"))
    same = Window.partitionBy(window)
    ranked = mean.withColumn("r", F.rank().over(same.orderBy("m")) + (F.count("*").over(Window.partitionBy(window, "m")) - 1) / 2)
    a, b = (ranked.select("feature", F.col(window).alias(n), F.col("r").alias(f"r{n}")) for n in ("a", "b"))
    return a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"))


def save_bundle(model: PipelineModel, path: str, threshold: float, columns: list[str], context: str, version: int = 1, fitted=None) -> None:
    """A version of a bundle: model, calibrator (``fitted``, a pipeline or an isotonic model, or none) and a row that
    describes them. Written last, the row makes the version visible."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/version={version}/model")
    if fitted is not None:
        wrapped = fitted if isinstance(fitted, PipelineModel) else PipelineModel([fitted])
        wrapped.write().overwrite().save(f"{path}/version={version}/calibrator")
    row = (version, threshold, columns, context, fitted is not None)
    spark.createDataFrame([row], "version int, threshold double, columns array<string>, context string, calibrated boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/v{version}")


def load_bundle(spark, path: str, version: int | None = None):
    """(model, calibrator or none, meta) of a version, by default the newest."""
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta")
    meta = found.where(F.lit(version is None) | (F.col("version") == (version or 0))).orderBy(F.col("version").desc()).first()
    if meta is None:
        raise ValueError(f"no version {version} in {path}")
    top = f"{path}/version={meta['version']}"
    return PipelineModel.load(f"{top}/model"), PipelineModel.load(f"{top}/calibrator") if meta["calibrated"] else None, meta


def calibrated(scored: DataFrame, fitted) -> DataFrame:
    """``scored`` (with raw_proba) with ``calibrated``, by a calibrator of either method; without one, the raw score."""
    if fitted is None:
        return scored.withColumn("calibrated", F.col("raw_proba"))
    kept = [c for c in scored.columns if c not in ("probability", "rawPrediction", "prediction", "features", "calibrated", "__raw")]
    out = fitted.transform(scored.select(*kept))
    return out.select(*kept, (F.col("calibrated") if "calibrated" in out.columns else vector_to_array("probability")[1]).alias("calibrated"))


def calibrator(rows: DataFrame, label: str, method: str = "auto", least: int = 1000):
    """A fitted transformer from ``raw_proba`` to a calibrated score, and the method: isotonic or sigmoid; ``auto`` takes
    isotonic from ``least`` positive rows on. With the sigmoid the score is element 1 of ``probability``."""
    if method == "auto":
        method = "isotonic" if (rows.agg(F.sum(label).alias("n")).first()["n"] or 0) >= least else "sigmoid"
    if method == "isotonic":
        return IsotonicRegression(featuresCol="raw_proba", labelCol=label, predictionCol="calibrated").fit(rows), method
    logit = LogisticRegression(featuresCol="__raw", labelCol=label)
    return Pipeline(stages=[VectorAssembler(inputCols=["raw_proba"], outputCol="__raw"), logit]).fit(rows), method


def surrogate_sweep(train: DataFrame, test: DataFrame, numeric: list[str], label: str, delta: float = 0.0) -> DataFrame:
    """Fidelity of fixed candidates to ``label``, best first by F1, balanced accuracy and accuracy; ``chosen`` is the best
    one if its F1 beats the baseline's (logistic regression) by at least ``delta``, else the baseline."""
    candidates = {"logistic": LogisticRegression(labelCol=label), "forest": RandomForestClassifier(labelCol=label, seed=7), "boosted": GBTClassifier(labelCol=label, maxIter=10, seed=7)}
    vector = VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="keep")
    out = None
    for name, model in candidates.items():
        scored = Pipeline(stages=[vector, model]).fit(train).transform(test)
        y, p = F.col(label), F.col("prediction")
        cell = lambda a, b, y=y, p=p: F.sum(((y == a) & (p == b)).cast("long"))
        one = scored.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")).withColumn("candidate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rates = out.select("candidate", F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"), ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"))
    best = Window.partitionBy()  # one row for each candidate
    gain = F.col("top.f1") - F.col("base")
    ranked = rates.withColumn("top", F.max(F.struct("f1", "balanced_accuracy", "accuracy", "candidate")).over(best)).withColumn("base", F.max(F.when(F.col("candidate") == "logistic", F.col("f1"))).over(best))
    chosen = F.when(gain >= delta, F.col("top.candidate")).otherwise("logistic")
    return ranked.select(*rates.columns, (F.col("candidate") == chosen).alias("chosen")).orderBy(F.col("f1").desc(), F.col("balanced_accuracy").desc(), F.col("accuracy").desc(), "candidate")


def export_matrix(matrix: DataFrame, path: str, label: str, kind: str = "parquet") -> None:
    """Writes the matrix (parquet or csv) and beside it a manifest: a row for each column with place, type and role."""
    matrix.write.mode("overwrite").option("header", True).format(kind).save(f"{path}/matrix")
    rows = [(i, f.name, f.dataType.simpleString(), "label" if f.name == label else "feature") for i, f in enumerate(matrix.schema.fields)]
    matrix.sparkSession.createDataFrame(rows, "place int, name string, type string, role string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
