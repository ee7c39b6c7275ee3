"""From tokens with vectors to metrics per entity. A token row is projected to one number as early as the metric allows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, dot, heron_area, let, unit, vector_sum


def mean_vector(vec: Column) -> Column:
    """Aggregate: the mean of array columns (JVM side, with partial sums)."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(vec, lambda x: x.cast("double")))))


def classify(tokens: DataFrame, contrasts: DataFrame, phone: str = "phone", on: tuple[str, ...] = ("language",), fallback: dict[str, str] | None = None) -> DataFrame:
    """Each token once per feature for which its symbol is in a class; a symbol in both classes is positive.

    ``contrasts`` (keys, feature, phone, class) is as large as the symbol inventories; it is broadcast by its size.
    ``fallback``: languages that take another one's contrasts instead of their own, as (language, other).
    """
    if fallback:
        own = contrasts.where(~F.col("language").isin(list(fallback)))
        for language, other in fallback.items():
            own = own.unionByName(contrasts.where(F.col("language") == other).withColumn("language", F.lit(language)))
        contrasts = own
    keys = [k for k in on if k in contrasts.columns]
    one = contrasts.groupBy(*keys, "feature", "phone").agg(F.max(F.col("class") == "positive").alias("positive"))
    if phone != "phone":
        one = one.withColumnRenamed("phone", phone)
    return tokens.join(one, [*keys, phone])


FRAMES = 64  # of a block


def pool_frames(frames: DataFrame, intervals: DataFrame, fps: float = 50.0, within: tuple[str, ...] = ("utterance",)) -> DataFrame:
    """Mean frame vector per interval: frames from floor(xmin * fps) to floor(xmax * fps), one at least, as far as there are any.

    ``within``: the columns of both tables that say whose frames they are; without any, all intervals share one table.
    Frames are packed into blocks of consecutive numbers. An interval meets the blocks that it touches, which is an
    equality, and makes one sum of each, so neither side lists frame numbers. Frames of many utterances are shuffled
    whatever Spark takes their size for (they may come out of an explode, which it does not count). Intervals behind the
    last frame drop out. The float product is taken as it is (0.58 * 50 is under 29).
    """
    keys, on = intervals.columns, [*within, "__block"]
    block = lambda c: F.floor(c / FRAMES).cast("int")
    start = F.floor(F.col("xmin") * fps).cast("int")
    end = F.greatest(F.floor(F.col("xmax") * fps).cast("int"), start + 1)
    wanted = intervals.select("*", start.alias("__start"), end.alias("__end")).withColumn("__block", F.explode(F.sequence(block(F.col("__start")), block(F.col("__end") - 1))))
    blocks = frames.groupBy(*within, block(F.col("frame_idx")).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "vec"))).alias("__frames"))
    own = F.filter("__frames", lambda f: (f["frame_idx"] >= F.col("__start")) & (f["frame_idx"] < F.col("__end")))
    part = let(F.transform(own, lambda f: f["vec"]), lambda vs: F.struct(F.col("__block").alias("at"), vector_sum(vs).alias("sum"), F.size(vs).alias("n")))
    met = wanted.join(blocks.hint("merge") if within else blocks, on).select(*keys, part.alias("__part"))
    sums = met.groupBy(*keys).agg(F.array_sort(F.collect_list("__part")).alias("__parts"), F.sum("__part.n").alias("n_frames")).where("n_frames > 0")
    total = vector_sum(F.transform(F.filter("__parts", lambda x: x["n"] > 0), lambda x: x["sum"]))
    return sums.select(*keys, F.transform(total, lambda x: x / F.col("n_frames")).alias("embedding"), "n_frames")


def contrast_directions(tokens: DataFrame, by: list[str], vec: str = "embedding", min_n: int = 5) -> DataFrame:
    """Per key the unit vector from the negative to the positive centroid, with both sizes; null with under ``min_n`` tokens in a class or a vanishing difference.

    ``tokens`` are classified (column ``positive``), usually of the control group only; pass the entity among the keys
    for each entity's own axis.
    """
    centroids = tokens.groupBy(*by, "positive").agg(mean_vector(F.col(vec)).alias("m"), F.count("*").alias("n"))
    pick = lambda c, side: F.max(F.when(F.col("positive") == side, F.col(c)))
    both = centroids.groupBy(*by).agg(pick("m", True).alias("p"), pick("m", False).alias("q"), F.coalesce(pick("n", True), F.lit(0)).alias("n_pos"), F.coalesce(pick("n", False), F.lit(0)).alias("n_neg"))
    enough = (F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n)
    return both.select(*by, F.when(enough, unit(F.zip_with("p", "q", lambda a, b: a - b))).alias("direction"), "n_pos", "n_neg")


def dprime(projected: DataFrame, by: list[str], z: str = "z", min_n: int = 5, ddof: int = 0, signed: bool = False) -> DataFrame:
    """d-prime of already projected tokens (``positive``, ``z``): distance of the class means in pooled deviations.

    0 where the deviation vanishes, null with under ``min_n`` tokens in a class. One aggregation, with partial sums.
    """
    var = F.var_pop if ddof == 0 else F.var_samp
    of = lambda f, side: f(F.when(F.col("positive") == side, F.col(z)))
    sums = projected.groupBy(*by).agg(of(F.avg, True).alias("mean_pos"), of(F.avg, False).alias("mean_neg"), of(var, True).alias("v1"), of(var, False).alias("v0"), of(F.count, True).alias("n_pos"), of(F.count, False).alias("n_neg"))
    gap, sd = F.col("mean_pos") - F.col("mean_neg"), F.sqrt((F.col("v1") + F.col("v0")) / 2.0)
    value = F.when(sd <= 1e-8, 0.0).otherwise(F.try_divide(gap if signed else F.abs(gap), sd))
    return sums.withColumn("dprime", F.when((F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n), value)).drop("v1", "v0")


def midpoint_accuracy(projected: DataFrame, scores: DataFrame, by: list[str], z: str = "z") -> DataFrame:
    """``scores`` with the share of tokens on the right side of the midpoint of the class means."""
    cuts = scores.select(*by, ((F.col("mean_pos") + F.col("mean_neg")) / 2).alias("__cut"))
    right = projected.join(cuts, by).groupBy(*by).agg(F.avg(((F.col(z) > F.col("__cut")) == F.col("positive")).cast("double")).alias("accuracy"))
    return scores.join(right, by, "left")


def project(classified: DataFrame, directions: DataFrame, on: list[str], vec: str = "embedding") -> DataFrame:
    """``z`` = token · direction; the vector is dropped at once. Directions are few; Spark broadcasts them by their size."""
    joined = classified.join(directions.select(*on, "direction"), on)
    return joined.withColumn("z", F.when(F.col("direction").isNotNull(), dot(F.col(vec), F.col("direction")))).drop(vec, "direction")


def dprime_vector(classified: DataFrame, is_control: Column, entity: list[str], on: list[str], vec: str = "embedding", min_n: int = 5) -> DataFrame:
    """Directions from the control tokens, then d-prime per entity and feature along them."""
    directions = contrast_directions(classified.where(is_control), on, vec, min_n)
    return dprime(project(classified, directions, on, vec), [*entity, *[k for k in on if k not in entity]], min_n=min_n)


def dprime_self(classified: DataFrame, entity: list[str], vec: str = "embedding", min_n: int = 2) -> DataFrame:
    """Signed d-prime on each entity's own axis, sample variance."""
    directions = contrast_directions(classified, entity, vec, min_n)
    return dprime(project(classified, directions, entity, vec), entity, min_n=min_n, ddof=1, signed=True)


def adjacent_similarity(tokens: DataFrame, entity: list[str], utterance: str, order: list[str], vec: str = "embedding") -> DataFrame:
    """Per entity ``boundary_sharpness``, the mean cosine of neighbouring tokens, and ``cross_position``, the mean over inner tokens of their similarity to both neighbours.

    Both come from one similarity per adjacency: it counts for the second mean once per inner token at its ends.
    """
    spoken = Window.partitionBy(*entity, utterance).orderBy(*order)
    whole = Window.partitionBy(*entity, utterance)
    rows = tokens.select(*entity, utterance, *order, vec).withColumn("__before", F.lag(vec).over(spoken)).withColumn("__i", F.row_number().over(spoken)).withColumn("__n", F.count("*").over(whole))
    pairs = rows.where(F.col("__before").isNotNull()).withColumn("s", cosine(F.col("__before"), F.col(vec))).withColumn("w", (F.col("__i") > 2).cast("int") + (F.col("__i") < F.col("__n")).cast("int"))
    return pairs.groupBy(*entity).agg(F.avg("s").alias("boundary_sharpness"), F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")).alias("cross_position"), F.count("*").alias("n_pairs"))


def triangle_area(tokens: DataFrame, corners: list, entity: list[str], phone: str = "phone", vec: str = "embedding", min_n: int = 3) -> DataFrame:
    """Area of the triangle of three corner centroids; null where a corner has under ``min_n`` tokens."""
    centroids = tokens.where(F.col(phone).isin(corners)).groupBy(*entity, phone).agg(mean_vector(F.col(vec)).alias("m"), F.count("*").alias("n"))
    corner = lambda c: F.max(F.when((F.col(phone) == c) & (F.col("n") >= min_n), F.col("m")))
    wide = centroids.groupBy(*entity).agg(*[corner(c).alias(f"c{i}") for i, c in enumerate(corners)])
    complete = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull()
    return wide.select(*entity, F.when(complete, heron_area(F.col("c0"), F.col("c1"), F.col("c2"))).alias("triangle_area"))


def prosody(intervals: DataFrame, entity: list[str], utterance: str, min_pause: float, is_vowel: Column) -> DataFrame:
    """Own definitions: symbols per second, pauses (gaps of ``min_pause`` or more) per second, and variation of vowel durations, per entity.

    An utterance's time goes from its first start to its last end; entities without time have no rates.
    """
    spoken = Window.partitionBy(*entity, utterance).orderBy("xmin", "xmax")
    rows = intervals.withColumn("__gap", F.col("xmin") - F.lag("xmax").over(spoken)).withColumn("__v", F.when(is_vowel, F.col("xmax") - F.col("xmin")))
    per = rows.groupBy(*entity, utterance).agg(F.count("*").alias("n"), (F.max("xmax") - F.min("xmin")).alias("t"), F.sum((F.col("__gap") >= min_pause).cast("int")).alias("pauses"), F.sum("__v").alias("sv"), F.sum(F.col("__v") * F.col("__v")).alias("sv2"), F.count("__v").alias("nv"))
    total = per.groupBy(*entity).agg(*[F.sum(c).alias(c) for c in ("n", "t", "pauses", "sv", "sv2", "nv")])
    mean = F.try_divide("sv", "nv")
    sd = F.sqrt(F.greatest(F.try_divide(F.col("sv2"), F.col("nv")) - mean * mean, F.lit(0.0)))
    return total.select(*entity, F.try_divide("n", "t").alias("speech_rate"), F.try_divide("pauses", "t").alias("pause_rate"), F.try_divide(sd, mean).alias("vowel_duration_cv"))


def duration_sweep(tokens: DataFrame, thresholds: list[float], entity: list[str], duration: str, min_tokens: int = 10) -> DataFrame:
    """Per entity and threshold: tokens kept, share kept, and whether enough are. The few thresholds are exploded per row and counted before any shuffle."""
    rows = tokens.select(*entity, duration, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    out = rows.groupBy(*entity, "threshold").agg(F.count("*").alias("n"), F.count_if(F.col(duration) >= F.col("threshold")).alias("kept"))
    return out.withColumn("kept_share", F.col("kept") / F.col("n")).withColumn("enough", F.col("kept") >= min_tokens)


def assemble(features: DataFrame, entity: list[str], names: list[str], others: list[DataFrame]) -> DataFrame:
    """The wide metric row: one column per known feature (no pass to find them), joined with further metrics by entity."""
    wide = features.groupBy(*entity).agg(*[F.max(F.when(F.col("feature") == n, F.col("dprime"))).alias(f"{n.removeprefix('vowel_')}_dprime") for n in names])
    for more in others:
        wide = wide.join(more, entity, "left")
    return wide
