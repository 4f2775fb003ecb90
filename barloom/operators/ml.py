"""Models on MLlib: preprocessing, baselines, trees, calibration, and the fold loop."""

from __future__ import annotations

import json
import math
import random
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import logit
from barloom.operators.metrics import probability_metrics
from barloom.operators.policy import daily_top_fraction, near_best_ranking
from barloom.sources.files import append_trials, stored_trials


def medians(df: DataFrame, columns: list[str]) -> dict:
    """Exact medians, None without values, in two passes that hold a small part of a column: bounds near the middle, then what lies between them.

    F.median, which counts every distinct value in one task, serves only columns whose bounds would miss the middle.
    """
    near = df.agg(*[F.percentile_approx(c, F.array(F.lit(0.499), F.lit(0.501)), F.lit(10000)).alias(c) for c in columns]).first()
    bounds = {c: near[c] for c in columns if near[c]}
    parts = []
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        x, lo, hi = F.col(c), F.lit(lo), F.lit(hi)
        parts += [F.count(x).alias(f"n_{i}"), F.count_if(x < lo).alias(f"b_{i}"), F.count_if(x == lo).alias(f"l_{i}"), F.count_if((x == hi) & (hi > lo)).alias(f"h_{i}"), F.collect_list(F.when((x > lo) & (x < hi), x)).alias(f"m_{i}")]
    told = df.agg(*parts).first() if parts else None
    out, missed = {c: None for c in columns}, []
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        n, below, low, high, between = (told[f"{k}_{i}"] for k in "nblhm")
        between = sorted(between)

        def at(rank: int):
            k = rank - below
            if not 0 <= k < low + len(between) + high:
                return None
            return lo if k < low else between[k - low] if k < low + len(between) else hi  # noqa: B023

        a, b = at((n - 1) // 2), at(n // 2)
        if a is None or b is None:
            missed.append(c)
        else:
            out[c] = float(a) if a == b else 0.5 * a + 0.5 * b
    return out | (df.agg(*[F.median(c).alias(c) for c in missed]).first().asDict() if missed else {})


def fit_fills(train: DataFrame, numeric: list[str], categorical: list[str] = (), scale: bool = False) -> dict:
    """Exact medians and most frequent values (the smallest of equals) of train; with scale, population mean and deviation after filling."""
    middle, often = medians(train, numeric), train.agg(F.lit(0).alias("_"), *[F.mode(c, True).alias(c) for c in categorical]).first()
    fills = {"numeric": {c: middle[c] if middle[c] is not None else 0.0 for c in numeric}, "categorical": {c: often[c] or "missing" for c in categorical}}
    if scale:
        x = {c: F.coalesce(c, F.lit(fills["numeric"][c])) for c in numeric}
        s = train.agg(*[F.avg(v).alias(f"a_{c}") for c, v in x.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in x.items()]).first()
        fills["scale"] = {c: (s[f"a_{c}"], s[f"s_{c}"] or 1.0) for c in numeric}
    return fills


def apply_fills(df: DataFrame, fills: dict) -> DataFrame:
    scale = fills.get("scale", {})

    def value(c: str, m: float):
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(m)))
        return (x - scale[c][0]) / scale[c][1] if c in scale else x

    return df.withColumns({c: value(c, m) for c, m in fills["numeric"].items()} | {c: F.coalesce(c, F.lit(m)) for c, m in fills["categorical"].items()})


def assembler(numeric: list[str], categorical: list[str] = ()) -> list:
    stages = []
    if categorical:
        stages = [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], dropLast=False)]
    return [*stages, VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="features")]


def class_ratio(train: DataFrame, label: str = "meta_label", weight: str = "sample_weight", mode: str = "full") -> DataFrame:
    """(ratio): weight of negatives over weight of positives; its root for mode sqrt, 1 for none."""
    r = F.sum(F.when(F.col(label) == 0, F.col(weight))) / F.sum(F.when(F.col(label) == 1, F.col(weight)))
    return train.agg({"full": r, "sqrt": F.sqrt(r), "none": F.lit(1.0)}[mode].alias("ratio"))


def balanced(train: DataFrame, label: str = "meta_label", weight: str = "sample_weight") -> DataFrame:
    """train with fit_weight: sample weights times rows / (2 * rows of the class)."""
    n = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    up, down = n.n / (2 * max(1, n.p)), n.n / (2 * max(1, n.n - n.p))
    return train.withColumn("fit_weight", F.col(weight) * F.when(F.col(label) == 1, up).otherwise(down))


def classifier(kind: str, label: str = "meta_label", seed: int = 1729, weight_sum: float = 1.0, **params):
    """Logistic (L2, C = 1), forest or boosted trees. The boosted trees stand in for a library that isn't part of Spark."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "fit_weight"}
    if kind == "logistic":
        return LogisticRegression(elasticNetParam=0.0, regParam=1.0 / weight_sum, standardization=False, maxIter=100, **common)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **({"numTrees": 40, "maxDepth": 3, "impurity": "entropy"} | params), **common)
    if kind == "gbt":
        return GBTClassifier(seed=seed, **({"maxIter": 20, "maxDepth": 2, "stepSize": 0.1} | params), **common)
    raise ValueError(f"no such model: {kind}")


def fit_predict_fold(members: DataFrame, fold: int, kind: str, numeric: list[str], categorical: list[str] = (), label: str = "meta_label", **params) -> tuple[DataFrame, PipelineModel | None]:
    """Validation rows of a fold with p, by a model fitted on its training rows alone. Seeds are 1729 + fold."""
    train, val = members.filter((F.col("fold_id") == fold) & (F.col("role") == "train")), members.filter((F.col("fold_id") == fold) & (F.col("role") == "validation"))
    if kind == "dummy":
        return val.join(F.broadcast(train.agg(F.avg(F.col(label).cast("double")).alias("p")))), None
    fills = fit_fills(train, numeric, list(categorical), scale=kind == "logistic")
    train = balanced(apply_fills(train, fills), label).withColumn(label, F.col(label).cast("double"))
    total = train.agg(F.sum("fit_weight")).first()[0] if kind == "logistic" else 1.0
    model = Pipeline(stages=[*assembler(numeric, list(categorical)), classifier(kind, label, 1729 + fold, total, **params)]).fit(train)
    out = model.transform(apply_fills(val, fills))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features", *[f"{c}_{s}" for c in categorical for s in "iv"]), model


def with_folder(df: DataFrame):
    """The context of df's session, whose checkpoint folder is set."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir") or (tempfile.mkdtemp(prefix="checkpoints-") if sc.master.startswith("local") else None)
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder)
    return sc


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the checkpoint folder: iterative fits then carry no lineage, and a lost executor costs none of it.

    The folder is the session's spark.checkpoint.dir; a local session without one gets a temporary folder, any other is refused.
    """
    with_folder(df)
    return df.checkpoint()


def settled_columns(df: DataFrame) -> DataFrame:
    """settled, in a file format of columns: for wide rows of which each pass reads a few columns."""
    path = f"{with_folder(df).getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_rows(members: DataFrame, features: DataFrame, folds: list[int], numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """A row for each event, settled: its features, and for each fold whether it validates (v_<fold>) and its training weight (w_<fold>).

    members: an event once in a fold; a training row's average_uniqueness, over its mean in the fold, is its weight. Features are neither
    computed nor kept once for each fold, and means are those of the settled rows.
    """
    of = lambda k, role: (F.col("fold_id") == k) & (F.col("role") == role)
    parts = [x for k in folds for x in (F.max(F.when(of(k, "train"), F.col("average_uniqueness"))).alias(f"w_{k}"), F.coalesce(F.bool_or(of(k, "validation")), F.lit(False)).alias(f"v_{k}"))]
    each = members.filter(F.col("role").isin("train", "validation") & F.col("fold_id").isin(*folds)).groupBy("symbol", "d", "event_id", "event_end_date", "meta_label").agg(*parts)
    rows = settled_columns(each.join(features.select("symbol", "d", *numeric, *categorical), ["symbol", "d"], "left"))
    means = rows.agg(*[F.avg(f"w_{k}").alias(f"w_{k}") for k in folds]).first()
    return rows.withColumns({c: F.col(c) / F.lit(m) for c, m in means.asDict().items()})


def fold_rows_of(rows: DataFrame, fold: int, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """Members of one fold from event_rows, with fold_id, role and sample_weight."""
    w, v = F.col(f"w_{fold}"), F.col(f"v_{fold}")
    return rows.filter(w.isNotNull() | v).select(F.lit(fold).alias("fold_id"), F.when(w.isNotNull(), "train").otherwise("validation").alias("role"), "event_id", "symbol", "d", "event_end_date", "meta_label", F.coalesce(w, F.lit(1.0)).alias("sample_weight"), *numeric, *categorical)


def _fold_rows(members: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    used = ["fold_id", "role", "event_id", "symbol", "d", "event_end_date", "meta_label", "sample_weight", *numeric, *categorical]
    return settled(members.filter(F.col("role").isin("train", "validation")).select(*dict.fromkeys(used)))


def _each_fold(rows: DataFrame, folds: list[int], kind: str, numeric: list[str], categorical: list[str] = (), **params) -> DataFrame:
    of = (lambda k: rows) if "fold_id" in rows.columns else lambda k: fold_rows_of(rows, k, numeric, categorical)
    parts = [fit_predict_fold(of(k), k, kind, numeric, categorical, **params)[0] for k in folds]
    return reduce(DataFrame.unionByName, [p.select("fold_id", "event_id", "symbol", "d", "event_end_date", "meta_label", "p") for p in parts])


def out_of_fold(members: DataFrame, folds: list[int], kind: str, numeric: list[str] = (), categorical: list[str] = (), features: DataFrame | None = None, **params) -> DataFrame:
    """Validation predictions of all folds, one below the other; all fits read one settled copy of the members.

    Members bring their features along, or features(symbol, d, ...) has them; then a copy holds an event once, as event_rows has it.
    Trade lines in place of members go the way of oof, which derives members and all model features by itself and keeps neither.
    """
    if "l_suppkey" in members.columns:
        from barloom.operators import oof

        return oof.out_of_fold(members, folds, kind)
    rows = _fold_rows(members, numeric, categorical) if features is None else event_rows(members, features, folds, numeric, categorical)
    return _each_fold(rows, folds, kind, numeric, categorical, **params)


SPACE = {"forest": {"numTrees": (20, 60), "maxDepth": (2, 4), "minInstancesPerNode": (1, 200)}, "gbt": {"maxIter": (10, 40), "maxDepth": (1, 3), "stepSize": (0.02, 0.3)}}


def sample_trial(kind: str, history: list[tuple[dict, float]], seed: int, startup: int = 10, candidates: int = 24, quantile: float = 0.25) -> dict:
    """Next parameters of a seeded search: random at first, then the candidate that good trials make likelier than the others do."""
    r = random.Random(f"{kind}-{seed}-{len(history)}")

    def draw() -> dict:
        return {k: (r.randint(a, b) if isinstance(a, int) else math.exp(r.uniform(math.log(a), math.log(b)))) for k, (a, b) in SPACE[kind].items()}

    if len(history) < startup:
        return draw()
    ranked = sorted(history, key=lambda x: -x[1])
    cut = max(1, math.ceil(quantile * len(ranked)))

    def density(p: dict, group: list) -> float:
        total = 0.0
        for q, _ in group:
            z = [(math.log(p[k]) - math.log(q[k])) / (0.2 * (math.log(b) - math.log(a)) + 1e-9) for k, (a, b) in SPACE[kind].items()]
            total += math.exp(-0.5 * sum(x * x for x in z))
        return math.log(total / len(group) + 1e-12)

    return max((draw() for _ in range(candidates)), key=lambda p: density(p, ranked[:cut]) - density(p, ranked[cut:] or ranked))


_TRIAL = "trial long, params string, mean_auc double, min_auc double, std_auc double"


def search(members: DataFrame, folds: list[int], kind: str, numeric: list[str], categorical: list[str] = (), trials: int = 30, seed: int = 1729, store: str | None = None) -> DataFrame:
    """(trial, params, mean_auc, min_auc, std_auc, in_band, selection_rank, chosen) of a finished study; all trials complete.

    With a store, each trial is added to its table as it ends, and a study that was broken off goes on after the last one.
    """
    from barloom.operators.metrics import classification_metrics, fold_auc_summary

    spark = members.sparkSession
    rows = [tuple(r) for r in stored_trials(spark, store).orderBy("trial").collect()] if store else []
    if [r[0] for r in rows] != list(range(len(rows))):
        raise ValueError(f"{store} isn't one study: trials {[r[0] for r in rows]}")
    history = [(json.loads(r[1]), r[2]) for r in rows]
    at_hand = _fold_rows(members, numeric, categorical) if len(rows) < trials else None
    for i in range(len(rows), trials):
        params = sample_trial(kind, history, seed)
        oof = _each_fold(at_hand, folds, kind, numeric, categorical, **params)
        s = fold_auc_summary(classification_metrics(oof, "fold_id", label="meta_label").withColumn("m", F.lit(0)), "m").first()
        history.append((params, s.mean_auc))
        rows.append((i, json.dumps(params, sort_keys=True), s.mean_auc, s.min_auc, s.std_auc))
        if store:
            append_trials(spark.createDataFrame(rows[-1:], _TRIAL), store)
    return near_best_ranking(spark.createDataFrame(rows, _TRIAL))


def calibrate(kind: str, train: DataFrame, apply: DataFrame, label: str = "meta_label", p: str = "p") -> DataFrame:
    """apply with calibrated: the score itself, a logistic fit on its logit, or an isotonic fit clamped at its ends."""
    if kind == "identity":
        return apply.withColumn("calibrated", F.col(p))
    if kind == "platt":
        v = VectorAssembler(inputCols=["_logit"], outputCol="_x")
        m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-9, standardization=False, maxIter=200).fit(v.transform(train.withColumn("_logit", logit(p)).withColumn("_y", F.col(label).cast("double"))))
        return apply.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(F.lit(float(m.coefficients[0])) * logit(p) + F.lit(float(m.intercept))))))
    if kind == "isotonic":
        m = IsotonicRegression(featuresCol=p, labelCol="_y").fit(train.withColumn("_y", F.col(label).cast("double")))
        return m.transform(apply).withColumnRenamed("prediction", "calibrated")
    raise ValueError(f"no such calibration: {kind}")


def expanding_calibration(oof: DataFrame, folds: list[int], kinds: tuple[str, ...] = ("identity", "platt", "isotonic")) -> DataFrame:
    """Probability metrics of each method on each fold after the first, fitted on the folds before it; all of them in one aggregation.

    oof is settled first, since each fit reads it.
    """
    rows = settled(oof.select("fold_id", "event_id", "meta_label", "p"))
    parts = []
    for k in folds[1:]:
        for kind in kinds:
            t = calibrate(kind, rows.filter(F.col("fold_id") < k), rows.filter(F.col("fold_id") == k))
            parts.append(t.select(F.lit(k).alias("fold_id"), F.lit(kind).alias("method"), "event_id", "meta_label", F.col("calibrated").alias("q")))
    return probability_metrics(reduce(DataFrame.unionByName, parts), "fold_id", "method", label="meta_label", p="q")


def calibration_summary(metrics: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Mean and worst Brier score and log loss of each method; admissible if it is no worse than identity on average."""
    t = metrics.groupBy("method").agg(F.avg("brier_score").alias("mean_brier"), F.max("brier_score").alias("worst_brier"), F.avg("log_loss").alias("mean_log_loss"), F.max("log_loss").alias("worst_log_loss"))
    base = t.filter("method = 'identity'").select(F.col("mean_brier").alias("_b"), F.col("mean_log_loss").alias("_l"))
    return t.join(F.broadcast(base)).withColumn("admissible", (F.col("mean_brier") <= F.col("_b") + tolerance) & (F.col("mean_log_loss") <= F.col("_l") + tolerance)).drop("_b", "_l")


def save_checked(model: PipelineModel, path: str, probe: DataFrame, key: str, tolerance: float = 1e-12) -> float:
    """Save the model, load it, and return the greatest difference of its scores on probe; ValueError above tolerance."""
    model.write().overwrite().save(path)
    score = lambda m, name: m.transform(probe).select(key, vector_to_array("probability")[1].alias(name))
    worst = score(model, "a").join(score(PipelineModel.load(path), "b"), key).agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] or 0.0
    if worst > tolerance:
        raise ValueError(f"reloaded model differs by {worst}")
    return worst


def fitted_feature_names(model: PipelineModel) -> list[str]:
    """Names of the fitted vector's entries in order: numeric columns, then one for each value of a categorical one."""
    values = {out: labels for stage in model.stages if hasattr(stage, "labelsArray") for out, labels in zip(stage.getOutputCols(), stage.labelsArray)}
    hot = {v: i for stage in model.stages if stage.hasParam("dropLast") for i, v in zip(stage.getInputCols(), stage.getOutputCols())}
    inputs = next(stage for stage in model.stages if isinstance(stage, VectorAssembler)).getInputCols()
    return [n for c in inputs for n in ([f"{c.removesuffix('_v')}_{x}" for x in (*values[hot[c]], "other")] if c in hot else [c])]


def frozen_scores(model: PipelineModel, fills: dict, candidates: DataFrame, *, fraction: float = 0.05, minimum: int = 1) -> DataFrame:
    """What may be locked of candidates scored by a frozen model: identity, score, rank, quota, cutoff and selection, and no outcome."""
    from barloom.operators.governance import LOCK_COLUMNS

    scored = model.transform(apply_fills(candidates, fills)).select("event_id", "symbol", "d", vector_to_array("probability")[1].alias("score"))
    return daily_top_fraction(scored, fraction=fraction, minimum=minimum).select(*LOCK_COLUMNS)
