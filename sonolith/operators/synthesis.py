"""Across studies and corpora: random-effects meta-analysis, threshold transfer, overlap, classification."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import p_normal, t_quantile
from ..sources.shared import shared_folder
from .neighbours import nearest_neighbours as nearest_neighbours
from .ranks import mann_whitney, spearman
from .slices import numbered, quantiles


def _weights(studies: DataFrame, by: list[str], rho: str, n: str) -> DataFrame:
    """Fisher z and inverse-variance weight per study (correlations clipped to 0.999; standard error 1 with three or fewer)."""
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col(rho))))
    se2 = F.when(F.col(n) > 3, 1.0 / (F.col(n) - 3)).otherwise(1.0)
    return studies.where(F.col(rho).isNotNull() & (F.col(n) >= 5)).select(*by, z.alias("z"), se2.alias("se2"))


def meta_dl(studies: DataFrame, by: list[str], rho: str = "rho", n: str = "n", with_p: bool = False) -> DataFrame:
    """DerSimonian-Laird pooling of correlations: ``k, q, tau2, i2, rho, low, high`` and the pooled ``z`` and ``se``; two studies of five or more at least."""
    rows = _weights(studies, by, rho, n)
    w = 1 / F.col("se2")
    fixed = rows.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col("z")).alias("swz"), F.sum(w * F.col("z") * F.col("z")).alias("swz2")).where("k >= 2")
    q = F.greatest(F.col("swz2") - F.col("swz") * F.col("swz") / F.col("sw"), F.lit(0.0))  # rounding can leave a little less
    tau2 = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("k") + 1, F.col("sw") - F.col("sw2") / F.col("sw")))
    fixed = fixed.withColumn("q", q).withColumn("tau2", tau2).withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - F.col("k") + 1, F.col("q")), F.lit(0.0)) * 100)).select(*by, "k", "q", "tau2", "i2")
    v = 1 / (F.col("se2") + F.col("tau2"))
    joined = rows.join(fixed, by) if by else rows.crossJoin(F.broadcast(fixed))  # without keys one row
    pooled = joined.groupBy(*by, "k", "q", "tau2", "i2").agg(F.sum(v).alias("sv"), (F.sum(v * F.col("z")) / F.sum(v)).alias("z"), (F.sum(v * F.col("z") * F.col("z")) - F.pow(F.sum(v * F.col("z")), 2) / F.sum(v)).alias("q_random"))
    se = F.sqrt(1 / F.col("sv"))
    out = pooled.withColumn("se", se).withColumn("rho", F.tanh("z")).withColumn("low", F.tanh(F.col("z") - 1.96 * se)).withColumn("high", F.tanh(F.col("z") + 1.96 * se)).drop("sv")
    return out.withColumn("p", p_normal(F.col("z") / F.col("se"))) if with_p else out


def meta_hksj(pooled: DataFrame) -> DataFrame:
    """From :func:`meta_dl`: the interval with a t quantile and a scale of at least 1, and the prediction interval."""
    t = t_quantile(F.lit(0.975), (F.col("k") - 1).cast("double"))
    se = F.col("se") * F.sqrt(F.greatest(F.lit(1.0), F.col("q_random") / (F.col("k") - 1)))
    wide = F.sqrt(F.col("se") * F.col("se") + F.col("tau2"))
    out = pooled.withColumn("__t", t).withColumn("hksj_low", F.tanh(F.col("z") - F.col("__t") * se)).withColumn("hksj_high", F.tanh(F.col("z") + F.col("__t") * se))
    return out.withColumn("pred_low", F.tanh(F.col("z") - 1.96 * wide)).withColumn("pred_high", F.tanh(F.col("z") + 1.96 * wide)).drop("__t")


def thresholds(long: DataFrame, level: str, by: list[str]) -> DataFrame:
    """Midpoints of the medians of adjacent levels: ``level_at, median, threshold`` (null for the last level)."""
    med = quantiles(long.where(F.col(level).isNotNull()), "value", [*by, level], {"median": 0.5})
    nxt = F.lead("median").over(Window.partitionBy(*by).orderBy(level))
    return med.select(*by, F.col(level).alias("level_at"), "median", ((F.col("median") + nxt) / 2).alias("threshold"))


def threshold_transfer(long: DataFrame, level: str, corpus: str, feature: str = "feature", min_n: int = 5) -> DataFrame:
    """How well one corpus's thresholds order another's entities: rho of true and predicted level per (train, test) corpus.

    The predicted level is that of the first threshold which the value reaches, else the last level. Thresholds are a
    short array per corpus and feature.
    """
    cut = F.array_sort(F.collect_list(F.struct("level_at", "threshold")))
    rules = thresholds(long, level, [corpus, feature]).groupBy(F.col(corpus).alias("train"), feature).agg(cut.alias("cuts"), F.max("level_at").alias("last"))
    rows = long.where(F.col(level).isNotNull() & F.col("value").isNotNull()).select(F.col(corpus).alias("test"), feature, level, "value")
    hit = F.filter("cuts", lambda c: F.col("value") >= c["threshold"])
    predicted = rows.join(rules, feature).withColumn("predicted", F.coalesce(F.get(hit, F.lit(0))["level_at"], F.col("last")))
    return spearman(predicted.withColumn("__t", F.col(level).cast("double")).withColumn("__p", F.col("predicted").cast("double")), "__t", "__p", ["train", "test", feature], min_n)


def overlap(long: DataFrame, level: str, by: list[str], min_n: int = 5) -> DataFrame:
    """Rank tests between all pairs of levels."""
    return mann_whitney(long, "value", level, by, min_n=min_n)


def folds_or_parts(df: DataFrame, fold: str, ident: str, label: str | None = None, out: str = "fold", least: int = 3, parts: int = 5) -> DataFrame:
    """``out``: the row's ``fold`` as text where there are ``least`` different ones; otherwise one of ``parts``: rows in the order of a hash of their id are dealt out in turn, with ``label`` each label's by themselves, so that every part has its share of each."""
    n = df.agg(F.count_distinct(fold).alias("__folds"))
    dealt = numbered(df.withColumn("__order", F.struct(F.xxhash64(ident), F.col(ident))), [label] if label else [], "__order")
    in_turn = F.concat(F.lit("part "), F.col("pos") % parts)
    return dealt.crossJoin(F.broadcast(n)).withColumn(out, F.when(F.col("__folds") >= least, F.col(fold).cast("string")).otherwise(in_turn)).drop("__folds", "__order", "pos", "size")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(df.where(" AND ".join(f"{f} IS NOT NULL" for f in features)))


def logistic_fit(rows: DataFrame, label_index: str, penalty: float | None = None, max_iter: int = 1000) -> tuple[StandardScalerModel, LogisticRegressionModel]:
    """Scaler and multinomial model of rows with a vector ``raw``. ``penalty``: the factor of half the squared coefficients beside the mean loss; by default one over the number of rows, a penalty of 1 beside the summed loss."""
    n = rows.count()
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    model = LogisticRegression(labelCol=label_index, family="multinomial", regParam=1 / max(1, n) if penalty is None else penalty, maxIter=max_iter, tol=1e-7, standardization=False)
    return scaler, model.fit(scaler.transform(rows))


def mean_abs_coefficients(model: LogisticRegressionModel, features: list[str]) -> list[tuple[str, float]]:
    return [(f, float(abs(model.coefficientMatrix.toArray()[:, i]).mean())) for i, f in enumerate(features)]


def logistic_weights(df: DataFrame, features: list[str], label_index: str, penalty: float | None = None, max_iter: int = 1000) -> DataFrame:
    """``feature``, ``mean_abs_coefficient`` over the classes of one model of all rows, features scaled; rows with a missing feature drop out."""
    shared_folder(df.sparkSession)
    _, model = logistic_fit(_assembled(df, features).checkpoint(), label_index, penalty, max_iter)
    return df.sparkSession.createDataFrame(mean_abs_coefficients(model, features), "feature string, mean_abs_coefficient double")


def logistic_by_fold(df: DataFrame, features: list[str], label_index: str, fold: str, penalty: float | None = None, max_iter: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(predictions, mean absolute coefficients per feature over the folds) of a multinomial logistic model per held-out fold; the scaler is fitted inside the fold.

    Folds are data sets, one model each; rows with a missing feature drop out.
    """
    shared_folder(df.sparkSession)
    rows = _assembled(df, features).checkpoint()  # read by every fold
    predictions, weights = None, None
    for (value,) in rows.select(fold).distinct().orderBy(fold).collect():
        scaler, model = logistic_fit(rows.where(F.col(fold) != value), label_index, penalty, max_iter)
        out = model.transform(scaler.transform(rows.where(F.col(fold) == value))).withColumn("held", F.lit(value)).drop("raw", "features", "rawPrediction").withColumn("probability", vector_to_array("probability"))
        coef = df.sparkSession.createDataFrame(mean_abs_coefficients(model, features), "feature string, weight double")
        predictions = out if predictions is None else predictions.unionByName(out)
        weights = coef if weights is None else weights.unionByName(coef)
    return predictions, weights.groupBy("feature").agg(F.avg("weight").alias("mean_abs_coefficient"))


def class_report(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and support per class, and the accuracy over all of them."""
    t = predictions.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("right"))
    p = predictions.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("given"))
    every = t.agg((F.sum("right") / F.sum("support")).alias("accuracy"))
    return t.join(p, "class", "left").crossJoin(F.broadcast(every)).select("class", "accuracy", "support", (F.col("right") / F.col("support")).alias("recall"), F.coalesce(F.try_divide("right", "given"), F.lit(0.0)).alias("precision"))
