"""Quality, calibration, failures and mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.schemas import THRESHOLD

STAGES = ("RETRIEVAL", "SCORING", "OWNERSHIP", "DECODING", "AMBIGUOUS_OR_INSUFFICIENT_EVIDENCE")
KEYS = ["s1_id", "target_id"]
EPSILON = 2.220446049250313e-16


def truth_sets(truth: DataFrame, queries: DataFrame) -> DataFrame:
    sets = truth.groupBy("s1_id").agg(F.sort_array(F.collect_set("target_id")).alias("truth_targets"))
    return queries.select("s1_id").join(sets, "s1_id", "left").withColumn("truth_targets", F.coalesce("truth_targets", F.array().cast("array<string>")))


def set_metrics(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a query: tp, fp, fn, precision, recall, f05, exact_set."""
    rows = resolved.join(truth_sets(truth, resolved), "s1_id")
    hit = F.size(F.array_intersect("accepted_targets", "truth_targets"))
    found, wanted = F.size("accepted_targets"), F.size("truth_targets")
    rows = rows.select("s1_id", hit.alias("tp"), (found - hit).alias("fp"), (wanted - hit).alias("fn"), wanted.alias("truth_count"), found.alias("found"))
    p = F.when(F.col("found") > 0, F.col("tp") / F.col("found")).when(F.col("truth_count") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("truth_count") > 0, F.col("tp") / F.col("truth_count")).otherwise(1.0)
    rows = rows.withColumns({"precision": p, "recall": r})
    low = 0.25 * F.col("precision") + F.col("recall")
    f = F.when(F.col("truth_count") + F.col("found") == 0, 1.0).when((F.col("precision") > 0) & (low > 0), 1.25 * F.col("precision") * F.col("recall") / low).otherwise(0.0)
    big = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("s1_id", big("tp"), big("fp"), big("fn"), big("truth_count"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f, 9).alias("f05"), ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact_set"))


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("query_count"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f05"), 6).alias("macro_f05"),
        F.round(F.avg(F.col("exact_set").cast("double")), 6).alias("exact_set_accuracy"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )


def quality_report(metrics: DataFrame) -> DataFrame:
    """The macro report of all queries and of those with no, one and several true targets."""
    cohort = F.when(F.col("truth_count") == 0, "zero").when(F.col("truth_count") == 1, "single").otherwise("multi")
    both = metrics.withColumn("cohort", F.explode(F.array(F.lit("all"), cohort)))
    return macro(both, "cohort")


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, count, mean_score, positive_fraction from (score, label); edges are i / bins, the last closed."""
    ladder: Column = F.lit(0)
    for i in range(1, bins):
        ladder = F.when(F.col("score") >= F.lit(i / bins), F.lit(i)).otherwise(ladder) if i == 1 else F.when(F.col("score") >= F.lit(i / bins), F.lit(i)).otherwise(ladder)
    binned = rows.withColumn("bin", ladder.cast("long"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_fraction"))


def ece(binned: DataFrame) -> DataFrame:
    return binned.agg(F.round(F.sum(F.col("count") * F.abs(F.col("mean_score") - F.col("positive_fraction"))) / F.sum("count"), 6).alias("ece"))


def ranking_metrics(rows: DataFrame) -> DataFrame:
    """auroc (average ranks), average_precision (distinct thresholds), log_loss, brier of (score, label);
    the first three are null where a class is absent. Scores are first summed to distinct values; running
    sums over these are dealt out by range of score, with the sums of ranges before them added."""
    y = F.col("label").cast("double")
    steps = rows.groupBy("score").agg(F.sum(y).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    steps = steps.withColumn("part", F.floor(F.col("score") * 64).cast("int"))
    parts = steps.groupBy("part").agg(F.sum("pos").alias("pp"), F.sum("n").alias("pn"))  # 65 rows at most
    above = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0.0)).alias("pos_above"), F.coalesce(F.sum("pn").over(above), F.lit(0.0)).alias("n_above"))
    down = W.partitionBy("part").orderBy(F.desc("score"))
    run = steps.join(parts, "part").withColumns({"tp": F.col("pos_above") + F.sum("pos").over(down), "seen": F.col("n_above") + F.sum("n").over(down)})
    neg = F.col("n") - F.col("pos")
    # a positive beats the negatives below it and half of those beside it
    won = F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    sums = run.agg(won.alias("won"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("score")))
    loss = rows.agg(F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"))
    two = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    joined = sums.crossJoin(loss)  # single rows
    out = lambda x, name: F.round(F.when(two, x), 6).alias(name)
    return joined.select(out(F.col("won") / (F.col("p") * (F.col("n") - F.col("p"))), "auroc"), out(F.col("ap") / F.col("p"), "average_precision"), out(F.col("log_loss"), "log_loss"), F.round("brier", 6).alias("brier"))


def score_distributions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


def labelled(scores: DataFrame, truth: DataFrame) -> DataFrame:
    marked = truth.select(*KEYS, F.lit(1).alias("hit"))
    return scores.join(marked, KEYS, "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def failures(candidates: DataFrame, owned: DataFrame, disposed: DataFrame, truth: DataFrame, ambiguous: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Missed and wrong links, each with the earliest policy stage that explains it, tags and diagnostics."""
    accepted = disposed.filter("accepted").select(*KEYS)
    missed = truth.select(*KEYS).join(accepted, KEYS, "left_anti").withColumn("error_type", F.lit("FALSE_NEGATIVE"))
    wrong = accepted.join(truth.select(*KEYS), KEYS, "left_anti").withColumn("error_type", F.lit("FALSE_POSITIVE"))
    rows = missed.unionByName(wrong)
    rows = rows.join(candidates.select(*KEYS, F.bit_count("retrieval_view_mask").alias("lanes")), KEYS, "left")
    rows = rows.join(owned.select(*KEYS, "score", "is_owner", "rival_s1_id", "rival_margin"), KEYS, "left").join(disposed.select(*KEYS, "rejection_reason"), KEYS, "left")
    reason = ambiguous.select(*KEYS, F.col("reason").alias("ambiguity")) if ambiguous is not None else None
    rows = rows.join(reason, KEYS, "left") if reason is not None else rows.withColumn("ambiguity", F.lit(None).cast("string"))
    counts = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("wanted"))
    rows = rows.join(counts, "s1_id", "left")
    there, enough = F.col("lanes").isNotNull(), F.col("score") >= threshold
    stage = (
        F.when(F.col("ambiguity").isNotNull(), STAGES[4])
        .when(F.col("error_type") == "FALSE_POSITIVE", F.when(there & enough, STAGES[1]).otherwise(STAGES[3]))
        .when(~there, STAGES[0]).when(~enough, STAGES[1]).when(~F.col("is_owner"), STAGES[2]).otherwise(STAGES[3])
    )
    tags = F.array_compact(F.array(F.when(F.col("wanted") > 1, "MULTI_MATCH"), F.when(F.col("lanes") == 1, "SINGLE_LANE"), F.when(F.col("wanted").isNull(), "ZERO_MATCH")))
    return rows.select(*KEYS, "error_type", stage.alias("failure_stage"), tags.alias("tags"), there.alias("retrieved"), "score", "is_owner", "rival_s1_id", "rival_margin", "rejection_reason", F.col("ambiguity").alias("label_ambiguity_reason"))


def failure_counts(rows: DataFrame) -> DataFrame:
    """error_type by stage, zero cells too."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(e, s) for e in ("FALSE_NEGATIVE", "FALSE_POSITIVE") for s in STAGES], "error_type string, failure_stage string")
    counts = rows.groupBy("error_type", "failure_stage").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["error_type", "failure_stage"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def failure_examples(rows: DataFrame, each: int = 2) -> DataFrame:
    order = W.partitionBy("error_type", "failure_stage").orderBy(*KEYS)
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= each).drop("nth")


def mine_pairs(candidates: DataFrame, truth: DataFrame, per_query: int = 16, seed: int = 42) -> DataFrame:
    """All retrieved truths and each query's nearest other candidates: best lane similarity, then a seeded
    digest. Truths that were not retrieved are never added."""
    rows = labelled(candidates, truth)
    best = F.greatest(*[F.coalesce(f"{lane}_similarity", F.lit(0.0)) for lane in ("name", "compact", "address", "combined", "reverse")])
    inside = lambda c: F.expr(f"substring(to_json(named_struct('v', {c})), 6, length(to_json(named_struct('v', {c}))) - 6)")  # noqa: E731  a JSON string
    digest = F.sha2(F.concat(F.lit(f"[{seed},"), inside("s1_id"), F.lit(","), inside("target_id"), F.lit("]")), 256)
    order = W.partitionBy("s1_id", "label").orderBy(F.desc("best"), "digest")
    rows = rows.withColumns({"best": best, "digest": digest}).withColumn("nth", F.row_number().over(order)).filter((F.col("label") == 1) | (F.col("nth") <= per_query))
    why = F.when(F.col("label") == 1, "retrieved_labelled_truth").otherwise("retrieved_not_labelled_truth_top_similarity")
    return rows.select(*KEYS, F.col("label").cast("tinyint").alias("label"), why.alias("reason"))
