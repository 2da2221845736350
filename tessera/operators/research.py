"""Perturbations, cohorts, atlas, paired comparisons, risk coverage, scale summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.script import latin_table, script_column, transliterated
from tessera.operators.evaluate import KEYS, macro
from tessera.schemas import LANE_BIT, THRESHOLD

PERTURBATIONS = ("case", "spacing", "punctuation", "token_order", "transliteration", "competition")
INJECTED = "!injected-public-competitor"


def swapped(text: Column) -> Column:
    swap = lambda c: F.when(c == F.lower(c), F.upper(c)).otherwise(F.lower(c))
    return F.when(text.isNotNull(), F.array_join(F.transform(F.split(text, ""), swap), ""))


def perturbed(entities: DataFrame, name: str) -> DataFrame:
    """Entities with the queries' texts changed, or with a copy of the first named query added."""
    if name == "competition":
        first = entities.filter("source = 'S1' and business_name <> ''").orderBy("entity_id").limit(1)
        return entities.unionByName(first.withColumn("entity_id", F.lit(INJECTED)))
    table = latin_table(entities, ["business_name", "business_address"]) if name == "transliteration" else {}
    change = {
        "case": swapped,
        "spacing": lambda t: F.concat(F.lit("  "), F.replace(t, F.lit(" "), F.lit("   ")), F.lit("  ")),
        "punctuation": lambda t: F.replace(t, F.lit(" "), F.lit(" / ")),
        "token_order": lambda t: F.when(t.isNotNull(), F.array_join(F.reverse(F.filter(F.split(t, r"\s+"), lambda w: w != "")), " ")),
        "transliteration": lambda t: transliterated(t, table),
    }[name]
    at = lambda c: F.when(F.col("source") == "S1", change(F.col(c))).otherwise(F.col(c))
    return entities.withColumns({c: at(c) for c in ("business_name", "business_address")})


def stability(reference: DataFrame, other: DataFrame) -> DataFrame:
    """s1_id, changed: whether the accepted set differs."""
    b = other.select("s1_id", F.col("accepted_targets").alias("other_targets"))
    return reference.select("s1_id", "accepted_targets").join(b, "s1_id").select("s1_id", (~F.col("accepted_targets").eqNullSafe(F.col("other_targets"))).alias("changed"))


def paired_delta(reference: DataFrame, challenger: DataFrame, metric: str = "f05") -> DataFrame:
    b = challenger.select("s1_id", F.col(metric).alias("challenger"))
    return reference.select("s1_id", F.col(metric).alias("reference")).join(b, "s1_id").withColumn("delta", F.round(F.col("challenger") - F.col("reference"), 9))


def stage_movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """from_stage, to_stage, n over all errors of either run; no error is a stage of its own."""
    keys = [*KEYS, "error_type"]
    a, b = before.select(*keys, F.col("failure_stage").alias("from_stage")), after.select(*keys, F.col("failure_stage").alias("to_stage"))
    moved = a.join(b, keys, "full_outer").select(F.coalesce("from_stage", F.lit("NOT_ERROR")).alias("from_stage"), F.coalesce("to_stage", F.lit("NOT_ERROR")).alias("to_stage"))
    return moved.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))


def cohort_tags(entities: DataFrame, truth: DataFrame, candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """s1_id, tag."""
    q = entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "business_name", "business_address", "country")
    wanted = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("wanted"))
    load = candidates.groupBy("target_id").agg(F.count(F.lit(1)).alias("load"))
    seen = candidates.join(load, "target_id").groupBy("s1_id").agg(F.max("load").alias("load"), F.bit_or(F.col("retrieval_view_mask").cast("int")).alias("mask"))
    margin = owned.filter(F.col("is_owner") & (F.col("score") >= THRESHOLD)).groupBy("s1_id").agg(F.min("rival_margin").alias("margin"))
    rows = q.join(wanted, "s1_id", "left").join(seen, "s1_id", "left").join(margin, "s1_id", "left")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tags = [
        F.concat(F.lit("country:"), F.coalesce(F.when(F.col("country") != "", F.col("country")), F.lit("None"))),
        F.when(full("business_name"), "name_present").otherwise("name_missing_or_empty"), F.when(full("business_address"), "address_present").otherwise("address_missing_or_empty"),
        F.when(F.col("wanted").isNull(), "truth_zero").when(F.col("wanted") == 1, "truth_single").otherwise("truth_multi"),
        F.when(F.col("load") > 8, "competition_gt8").otherwise("competition_le8"),
        *[F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, f"retrieved_by:{lane}") for lane, bit in LANE_BIT.items()],
        F.when(F.col("margin").isNull(), "ownership_margin_undefined").when(F.col("margin") <= 0.01, "ownership_margin_le001").otherwise("ownership_margin_gt001"),
    ]
    out = rows.select("s1_id", F.explode(F.array_compact(F.array(*tags))).alias("tag"))
    side = entities.select("entity_id", "source", script_column("business_name").alias("script"))
    a = side.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("script").alias("qs"))
    b = side.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("script").alias("ts"))
    crossed = truth.join(a, "s1_id").join(b, "target_id").filter("qs <> ts and qs <> 'UNKNOWN' and ts <> 'UNKNOWN'").select("s1_id").distinct().withColumn("c", F.lit(1))
    script = q.select("s1_id").join(crossed, "s1_id", "left").select("s1_id", F.when(F.col("c") == 1, "cross_script").otherwise("same_script_or_no_truth").alias("tag"))
    return out.unionByName(script)


def cohort_quality(tags: DataFrame, metrics: DataFrame) -> DataFrame:
    return macro(tags.join(metrics, "s1_id"), "tag")


def atlas(failed: DataFrame, entities: DataFrame, candidates: DataFrame, owned: DataFrame, disposed: DataFrame, resolved: DataFrame, truth: DataFrame, best: int = 8) -> DataFrame:
    """Each failure with its query, true and accepted targets, and its query's best candidates (the
    attributed one too) as JSON."""
    order = W.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    ranked = disposed.withColumns({"nth": F.row_number().over(order), "total": F.count(F.lit(1)).over(W.partitionBy("s1_id"))})
    ranked = ranked.join(owned.select(*KEYS, "owner_rank", "rival_s1_id", "rival_margin"), KEYS).join(candidates.select(*KEYS, "target_source", "retrieval_view_mask"), KEYS)
    names = entities.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), "business_name", "business_address")
    ranked = ranked.join(names, "target_id")
    shown = F.struct("nth", "target_id", "target_source", "business_name", "business_address", F.col("score").cast("decimal(20,9)").cast("string").alias("score"), "is_owner", "owner_rank", "rejection_reason", "retrieval_view_mask")
    f = failed.select("s1_id", F.col("target_id").alias("failed_id"), "error_type", "failure_stage")
    near = f.join(ranked, "s1_id", "left").filter((F.col("nth") <= best) | (F.col("target_id") == F.col("failed_id")) | F.col("nth").isNull())
    rows = near.groupBy("s1_id", "failed_id", "error_type", "failure_stage").agg(F.coalesce(F.max("total"), F.lit(0)).cast("int").alias("candidate_count"), F.to_json(F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), shown)))).alias("candidate_evidence_json"))
    q = entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.to_json(F.struct("entity_id", "business_name", "business_address", "country"), {"ignoreNullFields": "false"}).alias("source_json"))
    wanted = truth.groupBy("s1_id").agg(F.sort_array(F.collect_set("target_id")).alias("truth_targets"))
    rows = rows.join(q, "s1_id").join(wanted, "s1_id", "left").join(resolved.select("s1_id", "accepted_targets"), "s1_id")
    return rows.select("s1_id", F.col("failed_id").alias("target_id"), "error_type", "failure_stage", "source_json", F.coalesce("truth_targets", F.array().cast("array<string>")).alias("truth_targets"), "accepted_targets", "candidate_count", "candidate_evidence_json")


def risk_coverage(rows: DataFrame) -> DataFrame:
    """nth, s1_id, running_error of (s1_id, risk, error) by risk, then identifier. Running sums are dealt
    out by range of risk."""
    rows = rows.withColumn("part", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "risk")) * 256).cast("int"))
    parts = rows.groupBy("part").agg(F.sum("error").alias("e"), F.count(F.lit(1)).alias("n"))  # 257 rows at most
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("e").over(before), F.lit(0.0)).alias("e0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = W.partitionBy("part").orderBy("risk", "s1_id").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(parts, "part").withColumns({"nth": F.col("n0") + F.count(F.lit(1)).over(inside), "sum": F.col("e0") + F.sum("error").over(inside)})
    return out.select(F.col("nth").cast("long").alias("nth"), "s1_id", F.round(F.col("sum") / F.col("nth"), 6).alias("running_error"))


def risk_at(curve: DataFrame, coverages: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    n = curve.agg(F.max("nth").alias("n"))
    points = curve.sparkSession.createDataFrame([(c,) for c in coverages], "coverage double")
    wanted = n.crossJoin(points).select("coverage", F.ceil(F.round(F.col("coverage") * F.col("n"), 9)).alias("nth"))  # a row a coverage
    return wanted.join(curve, "nth").select("coverage", "running_error")


def bootstrap_mean(values: np.ndarray, repetitions: int = 1000, seed: int = 2026) -> dict[str, float]:
    """Mean and its 2.5 and 97.5 percentiles over resamples of a small paired vector."""
    rng = np.random.Generator(np.random.PCG64(seed))
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(repetitions)])
    low, high = np.quantile(means, [0.025, 0.975])
    return {"mean": float(values.mean()), "low": float(low), "high": float(high)}


def auroc(labels: np.ndarray, scores: np.ndarray) -> float | None:
    p, n = int(labels.sum()), int((1 - labels).sum())
    if not p or not n:
        return None
    _, at, count = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    return float((rank[labels == 1].sum() - p * (p + 1) / 2) / (p * n))


def average_precision(labels: np.ndarray, scores: np.ndarray) -> float | None:
    if not labels.sum():
        return None
    order = np.argsort(-scores, kind="stable")
    tp, last = np.cumsum(labels[order]), np.append(np.diff(scores[order]) != 0, True)
    tp, seen = tp[last], np.flatnonzero(last) + 1
    return float((np.diff(np.append(0, tp)) * tp / seen).sum() / labels.sum())


def bootstrap_risks(errors: np.ndarray, first: np.ndarray, second: np.ndarray, repetitions: int = 500, seed: int = 2026) -> dict[str, dict[str, float]]:
    """Deltas of AUROC and average precision of two risks as predictors of errors; resamples of one class
    are left out."""
    rng, deltas = np.random.Generator(np.random.PCG64(seed)), {"auroc": [], "average_precision": []}
    for _ in range(repetitions):
        at = rng.integers(0, len(errors), len(errors))
        if 0 < errors[at].sum() < len(at):
            for name, f in (("auroc", auroc), ("average_precision", average_precision)):
                deltas[name].append(f(errors[at], second[at]) - f(errors[at], first[at]))
    return {k: {"mean": float(np.mean(v)), "low": float(np.quantile(v, 0.025)), "high": float(np.quantile(v, 0.975))} for k, v in deltas.items() if v}


def scale_summary(observations: DataFrame) -> DataFrame:
    """queries, stage: median seconds, range, largest memory, queries a second."""
    middle = F.percentile("seconds", F.lit(0.5))
    return observations.groupBy("queries", "stage").agg(F.round(middle, 6).alias("median_seconds"), F.round(F.max("seconds") - F.min("seconds"), 6).alias("range_seconds"), F.max("rss_mib").alias("max_rss_mib"), F.round(F.col("queries") / middle, 6).alias("queries_per_second"))


def rescued(original: DataFrame, extra: DataFrame) -> DataFrame:
    """A challenger's additional pairs added to a graph; on overlap the original's row stays."""
    return original.unionByName(extra.join(original.select(*KEYS), KEYS, "left_anti"))
