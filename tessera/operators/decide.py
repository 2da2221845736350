"""Ownership, decoding, and the evidence behind decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.schemas import THRESHOLD, refuse, same_keys


def rounded(value: Column, places: int) -> Column:
    """A double at so many places as SQL rounds it: scaled, then to the nearest whole number. F.round() looks at
    the shortest decimal text instead, and parts from it where a mean of decimals lies halfway."""
    return F.round(value * 10.0**places) / 10.0**places


def stub_scores(cosines: DataFrame) -> DataFrame:
    """A model-free score: the mean of the four cosines, within [0, 1]. For plans without a fitted model."""
    mean = (F.col("exact_name_cosine") + F.col("exact_compact_name_cosine") + F.col("exact_address_cosine") + F.col("exact_combined_cosine")) / 4
    return cosines.select("s1_id", "target_id", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 6).alias("score"))


def check_scores(scores: DataFrame) -> DataFrame:
    refuse(scores.filter("score is null or isnan(score) or score < 0 or score > 1"), "score outside [0, 1]")
    return scores


def ownership(scores: DataFrame) -> DataFrame:
    """Each target belongs to its best query (score, then identifier); a rival is the runner-up for the
    owner and the owner for everyone else."""
    order = W.partitionBy("target_id").orderBy(F.desc("score"), "s1_id")
    rows = scores.withColumns({
        "owner_rank": F.row_number().over(order), "next_id": F.lead("s1_id").over(order), "next_score": F.lead("score").over(order),
        "top_id": F.first("s1_id").over(order), "top_score": F.first("score").over(order),
    })
    owner = F.col("owner_rank") == 1
    rival = F.when(owner, F.col("next_score")).otherwise(F.col("top_score"))
    return rows.select(
        "s1_id", "target_id", "score", owner.alias("is_owner"), "owner_rank",
        F.when(owner, F.col("next_id")).otherwise(F.col("top_id")).alias("rival_s1_id"), rival.alias("rival_score"), F.round(F.col("score") - rival, 9).alias("rival_margin"),
    )


def dispositions(owned: DataFrame, threshold: float = THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """Accepted: owner at the threshold or above. A low score is named before a lost ownership. extra: columns
    of `owned` that go along."""
    enough = F.col("score") >= threshold
    reason = F.when(~enough, "BELOW_THRESHOLD").when(~F.col("is_owner"), "LOST_OWNERSHIP").otherwise("NONE")
    return owned.select("s1_id", "target_id", "score", "is_owner", F.lit(threshold).alias("threshold"), F.round(F.col("score") - threshold, 9).alias("threshold_margin"), (enough & F.col("is_owner")).alias("accepted"), reason.alias("rejection_reason"), *extra)


def resolutions(disposed: DataFrame, queries: DataFrame) -> DataFrame:
    """s1_id, accepted_targets (sorted), decision_type; queries without a candidate are kept."""
    sets = disposed.filter("accepted").groupBy("s1_id").agg(F.sort_array(F.collect_set("target_id")).alias("found"))
    joined = queries.select("s1_id").join(sets, "s1_id", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    kind = F.when(F.size(found) == 0, "ZERO_MATCH").when(F.size(found) == 1, "SINGLE_MATCH").otherwise("MULTI_MATCH")
    return joined.select("s1_id", found.alias("accepted_targets"), kind.alias("decision_type"))


def check_exclusive(resolved: DataFrame) -> None:
    refuse(resolved.select(F.explode("accepted_targets").alias("target_id")).groupBy("target_id").count().filter("count > 1"), "a target accepted twice")


def check_aligned(candidates: DataFrame, scores: DataFrame, owned: DataFrame, disposed: DataFrame) -> None:
    """The four stages have the same pairs and agree on scores and owners."""
    keys = ["s1_id", "target_id"]
    for name, stage in (("scores", scores), ("ownership", owned), ("dispositions", disposed)):
        same_keys(candidates, stage, keys, name)
    joined = owned.select(*keys, F.col("score").alias("a"), F.col("is_owner").alias("x")).join(disposed.select(*keys, F.col("score").alias("b"), F.col("is_owner").alias("y")), keys)
    refuse(joined.filter("not (a <=> b and x <=> y)"), "stages disagree")


def evidence(candidates: DataFrame, owned: DataFrame, resolved: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a query: what its decision rests on."""
    keys = ["s1_id", "target_id"]
    rows = dispositions(owned, threshold, ("rival_margin",)).join(candidates.select(*keys, F.bit_count("retrieval_view_mask").alias("lanes")), keys)
    nth = F.row_number().over(W.partitionBy("s1_id").orderBy(F.desc("score"), "target_id"))
    rows = rows.withColumn("nth", nth)
    ok = F.col("accepted")
    got = rows.groupBy("s1_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("second"),
        F.min(F.when(ok, F.col("lanes"))).alias("lanes"), F.min(F.when(ok, F.col("rival_margin"))).alias("margin"), F.count_if(ok & F.col("rival_margin").isNull()).alias("unrivalled"),
        F.min(F.when(ok, F.col("threshold_margin"))).alias("above"), F.min(F.when(ok, F.col("score"))).alias("min_accepted"), F.max(F.when(~ok, F.col("score"))).alias("max_rejected"),
    )
    out = resolved.join(got, "s1_id", "left")
    return out.select(
        "s1_id", "decision_type", "accepted_targets", F.coalesce("n", F.lit(0)).cast("long").alias("candidate_count"), F.col("first").alias("top_candidate_score"),
        F.col("lanes").cast("long").alias("min_accepted_lane_count"), (F.col("lanes") >= 2).alias("alternate_lane_support"),
        F.when(F.col("unrivalled") == 0, F.col("margin")).alias("min_ownership_margin"), F.col("above").alias("min_threshold_margin"),
        F.when(F.col("first") > 0, F.round(F.col("second") / F.col("first"), 9)).alias("ambiguity_ratio"),
        F.col("min_accepted").alias("minimum_accepted_score"), F.col("max_rejected").alias("best_rejected_score"), F.round(F.col("first") - F.col("second"), 9).alias("score_gap"),
    )


def risks(capsules: DataFrame) -> DataFrame:
    """s1_id, confidence_risk, structure_risk from evidence()."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    structure = (
        (1 - F.coalesce(F.col("min_accepted_lane_count"), F.lit(0)) / 5) + (1 - F.least(F.lit(1.0), zero("min_ownership_margin")))
        + (1 - F.least(F.lit(1.0), zero("min_threshold_margin") / 0.36)) + zero("ambiguity_ratio")
    ) / 4
    confidence = F.when(F.col("minimum_accepted_score").isNotNull(), 1 - F.col("minimum_accepted_score")).otherwise(zero("top_candidate_score"))
    return capsules.select("s1_id", F.round(confidence, 6).alias("confidence_risk"), rounded(structure, 6).alias("structure_risk"))


def policy_check(owned: DataFrame, disposed: DataFrame, truth: DataFrame) -> DataFrame:
    """contested_targets, owners, ownership_loss_truths."""
    contested = owned.groupBy("target_id").count().agg(F.count_if(F.col("count") > 1).alias("contested_targets"))
    owners = owned.agg(F.count_if("is_owner").alias("owners"))
    lost = disposed.filter("rejection_reason = 'LOST_OWNERSHIP'").join(truth, ["s1_id", "target_id"], "left_semi").agg(F.count(F.lit(1)).alias("ownership_loss_truths"))
    return contested.crossJoin(owners).crossJoin(lost)  # single rows


def explain(candidates: DataFrame, owned: DataFrame, disposed: DataFrame, rejected: int = 5) -> DataFrame:
    """The accepted pairs of every query and its best rejected ones, with retrieval and ownership."""
    keys = ["s1_id", "target_id"]
    order = W.partitionBy("s1_id", "accepted").orderBy(F.desc("score"), "target_id")
    rows = disposed.withColumn("nth", F.row_number().over(order)).filter(F.col("accepted") | (F.col("nth") <= rejected))
    return rows.join(candidates.select(*keys, "retrieval_view_mask"), keys).join(owned.select(*keys, "owner_rank", "rival_s1_id", "rival_margin"), keys)
