"""Bounded retrieval: five lanes of sparse similarity joins, their union, and its bounds.

A lane joins queries and targets on (country, term), sums products of weights, and keeps the best of each
left row. Terms beyond the profile's document-frequency share never reach the join, which bounds its hot
keys; skew-aware joins split what is left. Ranks are by similarity rounded to nine places, then identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.blocks import best_pairs
from tessera.operators.terms import Profile, eligible, term_weights
from tessera.schemas import LANE_BIT, LANES, refuse
from tessera.staging import staged

def products(weights: DataFrame) -> DataFrame:
    """country, s1_id, target_id, target_source and one similarity a view (null without a shared term): every
    pair of a country that shares a term of any view, by one join and one aggregation."""
    q = weights.filter("source = 'S1'").select(F.col("country").alias("qc"), F.col("view").alias("qv"), F.col("term").alias("qt"), F.col("entity_id").alias("s1_id"), F.col("w").alias("qw"))
    t = weights.filter("source <> 'S1'").select("country", "view", "term", F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), "w")
    joined = q.join(t, F.col("country").eqNullSafe(F.col("qc")) & (F.col("view") == F.col("qv")) & (F.col("term") == F.col("qt")))
    of = lambda view: F.sum(F.when(F.col("view") == view, F.col("qw") * F.col("w"))).alias(view)
    return joined.groupBy("country", "s1_id", "target_id", "target_source").agg(of("name"), of("compact"), of("address"))


def combined() -> Column:
    """The combined view: half the name's and half the address's similarity; at most .5 without one."""
    half = lambda view: F.coalesce(F.lit(0.5) * F.col(view), F.lit(0.0))
    return half("name") + half("address")


def lane_hits(pairs: DataFrame, profile: Profile) -> DataFrame:
    """country, s1_id, target_id, target_source, lane, rank, similarity: the best of each lane's left rows. The
    forward lanes are ranked side by side in one partitioning by query; the reverse lane in one by target."""
    pairs = pairs.withColumn("combined", combined()).withColumn("reverse", F.col("combined"))
    forward, back = [x for x in profile.lanes if x != "reverse"], [x for x in profile.lanes if x == "reverse"]
    out = None
    for lanes, left, right in ((forward, "s1_id", "target_id"), (back, "target_id", "s1_id")):
        if not lanes:
            continue
        place = lambda lane: F.row_number().over(W.partitionBy(left).orderBy(F.round(lane, 9).desc_nulls_last(), right))  # noqa: B023, E731
        rows = pairs.withColumns({f"{lane}_at": place(lane) for lane in lanes})
        kept = [F.when((F.col(f"{lane}_at") <= profile.budgets[lane]) & (F.round(lane, 9) > 0), F.struct(F.lit(lane).alias("lane"), F.col(f"{lane}_at").alias("rank"), F.round(lane, 6).alias("similarity"))) for lane in lanes]
        rows = rows.select("country", "s1_id", "target_id", "target_source", F.explode(F.array_compact(F.array(*kept))).alias("hit"))
        hits = rows.select("country", "s1_id", "target_id", "target_source", "hit.lane", "hit.rank", "hit.similarity")
        out = hits if out is None else out.unionByName(hits)
    return out


def union_lanes(hits: DataFrame) -> DataFrame:
    """One row a pair: the mask of its lanes, and each lane's rank and similarity (null where absent)."""
    bit = F.create_map(*[F.lit(x) for kv in LANE_BIT.items() for x in kv])[F.col("lane")]
    of = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    evidence = [x for lane in LANES for x in (of(lane, "rank").cast("int").alias(f"{lane}_rank"), of(lane, "similarity").alias(f"{lane}_similarity"))]
    return hits.groupBy("s1_id", "target_id", "target_source", "country").agg(F.bit_or(bit).cast("int").alias("retrieval_view_mask"), *evidence)


def lane_rows(candidates: DataFrame) -> DataFrame:
    """The inverse of union_lanes: a row for each pair and lane."""
    stack = ", ".join(f"'{lane}', {lane}_rank, {lane}_similarity" for lane in LANES)
    rows = candidates.selectExpr("s1_id", "target_id", "target_source", "country", f"stack({len(LANES)}, {stack}) as (lane, rank, similarity)")
    return rows.filter("rank is not null")


def retrieve(rows: DataFrame, profile: Profile) -> DataFrame:
    """The candidate graph of views() rows."""
    return union_lanes(lane_hits(lane_pairs(eligible(rows), profile), profile))


def lane_pairs(rows: DataFrame, profile: Profile) -> DataFrame:
    """What lane_hits() needs of products(), staged: by blocks of texts; by the join where identifiers are null or shared."""
    found = best_pairs(rows, profile)
    return staged(products(term_weights(rows, profile)), "pairs") if found is None else found


def bounds(rows: DataFrame, profile: Profile) -> DataFrame:
    """eligible_pairs and candidate_bound: what the graph can hold at most."""
    sides = rows.groupBy("country").agg(F.count_if(F.col("source") == "S1").alias("q"), F.count_if(F.col("source") != "S1").alias("t"))
    forward = sum(profile.budgets[lane] for lane in profile.lanes if lane != "reverse")
    back = profile.budgets["reverse"] if "reverse" in profile.lanes else 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return sides.agg(total(F.col("q") * F.col("t")).alias("eligible_pairs"), total(F.col("q") * forward + F.col("t") * back).alias("candidate_bound"))


def check_bounds(candidates: DataFrame, rows: DataFrame, profile: Profile) -> None:
    limit = bounds(rows, profile)
    refuse(candidates.agg(F.count(F.lit(1)).alias("n")).crossJoin(limit).filter("n > least(eligible_pairs, candidate_bound)"), "graph beyond its bound")


def warnings(rows: DataFrame, profile: Profile) -> DataFrame:
    """country, warning: countries without a query or target, and views whose vocabulary is empty."""
    from tessera.operators.terms import fit_evidence

    sides = rows.groupBy("country").agg(F.count_if(F.col("source") == "S1").alias("q"), F.count_if(F.col("source") != "S1").alias("t"))
    lonely = sides.filter("q = 0 or t = 0").select("country", F.when(F.col("q") == 0, "no query").otherwise("no target").alias("warning"))
    empty = fit_evidence(rows, profile).filter("vocabulary = 0").select("country", F.concat(F.lit("empty vocabulary: "), "view").alias("warning"))
    return lonely.unionByName(empty)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """s1_id, target_id, similarity: the k rows of the highest cosine for each query vector, itself left out;
    ties go to the smaller identifier, after rounding to nine places. Queries come in blocks of `block`, each
    multiplied with all rows where these lie; a task hands on its best k of each query only."""
    spark, size = rows.sparkSession, queries.count()
    out = None
    for at in range(max(1, -(-size // block))):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-size // block)))) == at).toPandas()  # about `block` rows
        held = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), unit_rows(part["embedding"])))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, vectors = held.value
            kept = pd.DataFrame({"s1_id": ids[:0], "target_id": ids[:0], "similarity": np.zeros(0)})
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                target, found = batch["vec_id"].to_numpy(), vectors @ unit_rows(batch["embedding"]).T
                found[ids[:, None] == target[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(target, found.shape), -np.round(found, 9)), axis=1)[:, :k]
                some = pd.DataFrame({"s1_id": np.repeat(ids, order.shape[1]), "target_id": target[order].ravel(), "similarity": np.take_along_axis(found, order, 1).ravel()})
                kept = pd.concat([kept, some[np.isfinite(some["similarity"])]])
                kept = kept.assign(r=kept["similarity"].round(9)).sort_values(["s1_id", "r", "target_id"], ascending=[True, False, True]).groupby("s1_id").head(k).drop(columns="r")
            yield kept

        some = rows.mapInPandas(best, "s1_id bigint, target_id bigint, similarity double")
        out = some if out is None else out.unionByName(some)
    order = W.partitionBy("s1_id").orderBy(F.round("similarity", 9).desc(), "target_id")
    return out.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def unit_rows(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    m = np.array(vectors.tolist(), np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))
