"""Ranking and classification metrics, intervals, thresholds and samples."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per judged query: ndcg (gain 2^grade - 1 against the ideal of all judged), recall at k and reciprocal rank (grade >= 2)."""
    discount = lambda r: 1 / F.log2(r + 1)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal_rank = Window.partitionBy("qid").orderBy(F.desc("grade"), "id")
    ideal = qrels.withColumn("r", F.row_number().over(ideal_rank)).groupBy("qid").agg(
        F.sum(F.when(F.col("r") <= k, gain * discount(F.col("r")))).alias("ideal"), F.count_if(F.col("grade") >= 2).alias("relevant")
    )
    hits = ranking.select("qid", "id", "rank").join(qrels, ["qid", "id"])
    found = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, gain * discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") >= 2)).alias("got"),
        F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"),
    )
    return ideal.join(found, "qid", "left").select(
        "qid",
        F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("relevant") > 0, F.coalesce(F.col("got"), F.lit(0)) / F.col("relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct of low and high; nulls without trials."""
    p, zz = k / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.struct(F.when(n > 0, (centre - half) / (1 + zz / n)).alias("low"), F.when(n > 0, (centre + half) / (1 + zz / n)).alias("high"))


def precision_at_floors(scored: DataFrame, floors: list[float]) -> DataFrame:
    """Of score and gold (0/1): for each floor the pairs at or above it, the right ones, precision and interval."""
    levels = F.array(*[F.lit(x) for x in floors])
    rows = scored.select("gold", F.explode(F.filter(levels, lambda f: F.col("score") >= f)).alias("floor"))
    out = rows.groupBy("floor").agg(F.count("*").alias("n"), F.sum("gold").alias("k"))
    interval = wilson(F.col("k"), F.col("n"))
    return out.select("floor", "n", "k", (F.col("k") / F.col("n")).alias("precision"), interval["low"].alias("low"), interval["high"].alias("high"))


def precision_by_bin(scored: DataFrame, edges: list[float]) -> DataFrame:
    """Of score and gold (0/1): for each bin [low, high) its rows, the right ones, precision and interval."""
    at = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: F.col("score") >= e))
    rows = scored.select("gold", at.alias("at")).where((F.col("at") > 0) & (F.col("at") < len(edges)))
    out = rows.groupBy((F.col("at") - 1).alias("bin")).agg(F.count("*").alias("n"), F.sum("gold").alias("k"))
    interval = wilson(F.col("k"), F.col("n"))
    return out.select("bin", "n", "k", (F.col("k") / F.col("n")).alias("precision"), interval["low"].alias("low"), interval["high"].alias("high"))


def overall(rows: DataFrame) -> DataFrame:
    """Accuracy, and F1 averaged over the classes of gold and predicted labels."""
    right = rows.agg(F.avg((F.col("gold") == F.col("predicted")).cast("int")).alias("accuracy"))
    return right.join(per_class(rows).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes")), F.lit(True))


def missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys that are wanted and not known: strata without a population, queries without a judgment."""
    return wanted.select(*keys).distinct().join(known.select(*keys).distinct(), keys, "left_anti")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(rows: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of gold and predicted (0/1), weighted where a weight is named."""
    w = F.col(weight) if weight else F.lit(1.0)
    count = lambda g, p: F.sum(F.when((F.col("gold") == g) & (F.col("predicted") == p), w).otherwise(0.0))
    c = rows.groupBy(*(by or [])).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*(by or []), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def design_weights(rows: DataFrame, stratum: str, population: DataFrame) -> DataFrame:
    """Adds `weight`: the stratum's population by its sample. population: stratum, population."""
    sampled = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    sizes = population.join(sampled, stratum).select(stratum, (F.col("population") / F.col("_n")).alias("weight"))
    return rows.join(sizes, stratum)


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class of gold and predicted labels."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    c = sides.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    p, r = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("g"))
    return c.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def threshold_curve(scored: DataFrame) -> DataFrame:
    """Of score and gold, each distinct score as a threshold: tp, selected, precision, recall, F1.

    Scores are told apart to six decimals and aggregated before the cumulative window, so its single task holds at most
    a million rows for scores in [0, 1], whatever the input.
    """
    scored = scored.withColumn("score", F.round("score", 6))
    steps = scored.groupBy("score").agg(F.sum("gold").alias("k"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = scored.agg(F.sum("gold").alias("positives"))
    c = steps.select("score", F.sum("k").over(w).alias("tp"), F.sum("n").over(w).alias("selected")).join(F.broadcast(total), F.lit(True))
    p, r = ratio(F.col("tp"), F.col("selected")), ratio(F.col("tp"), F.col("positives"))
    return c.select(F.col("score").alias("threshold"), "tp", "selected", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def chosen_threshold(curve: DataFrame, target: float | None = None) -> DataFrame:
    """The threshold of the best F1; with a target, of the largest recall at that precision, or else the most precise.
    Ties go to the higher threshold."""
    if target is None:
        best = F.max_by(F.struct(*curve.columns), F.struct(F.round("f1", 9), "threshold"))
    else:
        ok = (F.col("precision") >= target).cast("int")
        key = F.struct(ok, F.when(ok == 1, F.round("recall", 9)).otherwise(F.round("precision", 9)), "threshold")
        best = F.max_by(F.struct(*curve.columns), key)
    return curve.agg(best.alias("x")).select("x.*")


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in any engine."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def stratified_sample(rows: DataFrame, stratum: str, id_column: str, quota: int, seed: str = "7") -> DataFrame:
    """The `quota` rows of the smallest seeded hashes of each stratum."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_column).cast("string"))), id_column)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def bootstrap_means(values: DataFrame, replicates: int = 1000, seed: str = "7") -> DataFrame:
    """replicate, mean: each draws as many rows as there are, the j-th by a hash of (seed, replicate, j).

    values: i (0 to n - 1), value.
    """
    spark, n = values.sparkSession, values.count()
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    at = F.floor(unit_hash(F.lit(seed), F.col("replicate"), F.col("j")) * n).cast("bigint")
    return draws.withColumn("i", at).join(values, "i").groupBy("replicate").agg(F.avg("value").alias("mean"))


def bootstrap_interval(values: DataFrame, replicates: int = 1000, seed: str = "7", alpha: float = 0.05) -> DataFrame:
    """mean, low, high by percentiles of the replicates. For a paired comparison, give the differences as values."""
    means = bootstrap_means(values, replicates, seed)
    return means.agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high")).join(values.agg(F.avg("value").alias("mean")), F.lit(True))


def folds(rows: DataFrame, id_column: str, k: int, stratum: str | None = None, repeat: int = 0) -> DataFrame:
    """Adds `fold`: by hashed order within the stratum, so folds differ by one row of each; without one, by hash of the id (a group's rows stay together)."""
    h = unit_hash(F.lit(f"fold{repeat}"), F.col(id_column))
    if stratum is None:
        return rows.withColumn("fold", F.floor(h * k).cast("int"))
    return rows.withColumn("fold", ((F.row_number().over(Window.partitionBy(stratum).orderBy(h, id_column)) - 1) % k).cast("int"))


def fitted_logistic(rows: DataFrame, features: list[str], label: str, ridge: float = 0.01) -> dict[str, float]:
    """A logistic fit over standardized features, given back as weights of the raw ones and an intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=ridge, standardization=True).fit(x)
    return dict(zip(features, (float(w) for w in model.coefficients))) | {"intercept": float(model.intercept)}


def fitted_classifier(rows: DataFrame, feature: str, label: str, ridge: float = 0.01) -> tuple[list[list[float]], list[float]]:
    """Weights and intercepts of a multinomial fit over an array column, for softmax()."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    model = LogisticRegression(featuresCol="_x", labelCol=label, family="multinomial", regParam=ridge).fit(rows.withColumn("_x", array_to_vector(feature)))
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()


def schema_hash(schema: dict) -> str:
    """A digest of a feature schema; a model of another digest is refused by guarded()."""
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()


def guarded(model: dict, schema: dict) -> dict:
    if model.get("schema") != schema_hash(schema):
        raise ValueError("the model was trained on other features")
    return model


def fingerprint(rows: DataFrame, key: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """One digest of all rows: the sum of row digests, which needs no global order."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], *[F.round(F.col(v).cast("double"), digits).cast("string") for v in values])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(part).alias("digest"))


def judgments(lines: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """qid, id, grade from lines `q01: 12=3 +15=2`; pooled items without a grade have 0."""
    rows = lines.where(F.col("value").rlike(r"^\s*\w+\s*:")).select(F.regexp_extract("value", r"^\s*(\w+)\s*:", 1).alias("qid"), F.explode(F.regexp_extract_all("value", F.lit(r"\+?\d+=\d"), F.lit(0))).alias("x"))
    graded = rows.select("qid", F.regexp_extract("x", r"(\d+)=", 1).cast("bigint").alias("id"), F.regexp_extract("x", r"=(\d)", 1).cast("int").alias("grade"))
    graded = graded.groupBy("qid", "id").agg(F.max("grade").alias("grade"))
    return graded if pool is None else graded.join(pool, ["qid", "id"], "full_outer").select("qid", "id", F.coalesce("grade", F.lit(0)).alias("grade"))


def merge_precision(audits: DataFrame) -> DataFrame:
    """Per audit and policy: joins, right ones, precision and interval. audits: audit, policy, correct (0/1)."""
    c = audits.groupBy("audit", "policy").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    i = wilson(F.col("k"), F.col("n"))
    return c.select("audit", "policy", "n", "k", (F.col("k") / F.col("n")).alias("precision"), i["low"].alias("low"), i["high"].alias("high"))


def regressed(metrics: dict[str, float], baseline: dict[str, float], tolerance: float = 0.01) -> list[str]:
    """Names of the metrics that fell more than the tolerance below the baseline."""
    return sorted(n for n, b in baseline.items() if metrics.get(n, float("-inf")) < b - tolerance)
