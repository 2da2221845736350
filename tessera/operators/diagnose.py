"""Diagnostics of a candidate graph against truth. Labels enter here only, after the graph is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schemas import LANE_BIT, LANES, refuse

KEYS = ["s1_id", "target_id"]
FORWARD = LANES[:-1]


def check_eligible(candidates: DataFrame, truth: DataFrame, rows: DataFrame) -> None:
    """Candidates and truths name known entities of one country, targets of the named source."""
    q = rows.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), F.col("country").alias("qc"))
    t = rows.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("country").alias("tc"), "source")
    seen = lambda df: df.join(q.withColumn("_q", F.lit(1)), "s1_id", "left").join(t.withColumn("_t", F.lit(1)), "target_id", "left")
    apart = "_q is null or _t is null or not (qc <=> tc)"
    refuse(seen(candidates).filter(f"{apart} or not (country <=> qc) or target_source <> source"), "candidate outside its universe")
    refuse(seen(truth).filter(apart), "truth outside its universe")
    refuse(truth.groupBy(*KEYS).count().filter("count > 1"), "duplicate truth")


def marked(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return candidates.join(truth.select(*KEYS, F.lit(1).alias("hit")), KEYS, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def density(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates a query, queries without any counted: mean, quantiles, max, zero count and rate."""
    counts = candidates.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    n = queries.select("s1_id").join(counts, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    at = lambda p, name: F.round(F.percentile("n", F.lit(p)), 6).alias(name)
    zero = F.count_if(F.col("n") == 0)
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), at(0.5, "p50"), at(0.9, "p90"), at(0.99, "p99"), F.max("n").alias("max"), zero.alias("zero_queries"), F.round(F.try_divide(zero, F.count(F.lit(1))), 6).alias("zero_rate"))


def recall_at(candidates: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """lane, k, recall for each forward lane and for their union; a reverse lane has no such recall."""
    hits, total = marked(candidates, truth).filter("hit = 1"), truth.agg(F.count(F.lit(1)).alias("truths"))
    cells = []
    for lane in (*FORWARD, "union"):
        for k in ks:
            inside = F.col(f"{lane}_rank") <= k if lane != "union" else F.least(*[F.coalesce(f"{x}_rank", F.lit(1 << 30)) for x in FORWARD]) <= k
            cells.append(F.struct(F.lit(lane).alias("lane"), F.lit(k).cast("long").alias("k"), F.count_if(inside).alias("found")))
    table = hits.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return table.crossJoin(total).select("lane", "k", F.round(F.try_divide("found", "truths"), 6).alias("recall"))  # one row


def _lane_table(spark, lanes=LANES) -> DataFrame:
    return spark.createDataFrame([(lane, LANE_BIT[lane]) for lane in lanes], "lane string, bit int")


def lane_rescue(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """What each lane adds alone, and what is lost without it; masks are counted first, so five lanes meet
    a row for each mask."""
    masks = marked(candidates, truth).groupBy("retrieval_view_mask").agg(F.count(F.lit(1)).alias("pairs"), F.sum("hit").alias("hits"))
    total = truth.agg(F.count(F.lit(1)).alias("truths"))
    rows = masks.crossJoin(_lane_table(candidates.sparkSession)).crossJoin(total)  # 31 masks by 5 lanes
    has = F.col("retrieval_view_mask").bitwiseAND(F.col("bit")) != 0
    only = F.col("retrieval_view_mask") == F.col("bit")
    of = lambda flag, value: F.coalesce(F.sum(F.when(flag, F.col(value))), F.lit(0)).cast("long")
    got = rows.groupBy("lane").agg(of(has, "pairs").alias("candidate_pairs"), of(only, "pairs").alias("unique_pairs"), of(has, "hits").alias("truths_recovered"), of(only, "hits").alias("unique_truths"), of(~only, "pairs").alias("pairs_without"), of(~only, "hits").alias("hits_without"), F.max("truths").alias("truths"))
    rate = F.try_divide(F.col("unique_truths") / F.col("truths") * 1_000_000, "unique_pairs")
    return got.select("lane", "candidate_pairs", "unique_pairs", "truths_recovered", "unique_truths", F.round(rate, 6).alias("marginal_recall_per_million"), "pairs_without", F.round(F.try_divide("hits_without", "truths"), 6).alias("recall_without"))


def lane_overlap(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """lane_a, lane_b, pairs, truths: the five-by-five overlaps."""
    spark = candidates.sparkSession
    masks = marked(candidates, truth).groupBy("retrieval_view_mask").agg(F.count(F.lit(1)).alias("pairs"), F.sum("hit").alias("hits"))
    a = _lane_table(spark).withColumnsRenamed({"lane": "lane_a", "bit": "bit_a"})
    b = _lane_table(spark).withColumnsRenamed({"lane": "lane_b", "bit": "bit_b"})
    both = (F.col("retrieval_view_mask").bitwiseAND(F.col("bit_a")) != 0) & (F.col("retrieval_view_mask").bitwiseAND(F.col("bit_b")) != 0)
    of = lambda value: F.coalesce(F.sum(F.when(both, F.col(value))), F.lit(0)).cast("long").alias("truths" if value == "hits" else value)
    return masks.crossJoin(a).crossJoin(b).groupBy("lane_a", "lane_b").agg(of("pairs"), of("hits"))  # 31 by 5 by 5


def truths_by_lane_count(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return marked(candidates, truth).filter("hit = 1").groupBy(F.bit_count("retrieval_view_mask").cast("long").alias("lanes")).agg(F.count(F.lit(1)).alias("truths"))


def summary(candidates: DataFrame, truth: DataFrame, limits: DataFrame) -> DataFrame:
    """candidate_pairs, eligible_pairs, reduction_ratio, truths, recall, candidates for each found truth."""
    got = marked(candidates, truth).agg(F.count(F.lit(1)).alias("candidate_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("truths_recovered"))
    rows = got.crossJoin(truth.agg(F.count(F.lit(1)).alias("truths"))).crossJoin(limits)  # single rows
    part = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return rows.select("candidate_pairs", "eligible_pairs", F.round(1 - F.try_divide("candidate_pairs", "eligible_pairs"), 6).alias("reduction_ratio"), "truths", "truths_recovered", part("truths_recovered", "truths").alias("recall"), part("candidate_pairs", "truths_recovered").alias("candidates_per_truth"))


def pareto(points: DataFrame, cost: str) -> DataFrame:
    """Points (name, recall, cost columns) with whether no other is as good in both and better in one."""
    o = points.select(F.col("name").alias("o_name"), F.col("recall").alias("o_recall"), F.col(cost).alias("o_cost"))
    beaten = (F.col("o_recall") >= F.col("recall")) & (F.col("o_cost") <= F.col(cost)) & ((F.col("o_recall") > F.col("recall")) | (F.col("o_cost") < F.col(cost)))
    best = points.filter("recall is not null").join(o, beaten, "left_anti").select("name", F.lit(True).alias("best"))
    return points.join(best, "name", "left").withColumn("pareto", F.when(F.col("recall").isNotNull(), F.coalesce("best", F.lit(False)))).drop("best")


def profile(entities: DataFrame) -> DataFrame:
    """field, source, country: rows, missing, empty, length statistics; a field's texts in one row a group."""
    long = entities.select("source", "country", F.explode(F.map_from_arrays(F.array(F.lit("business_name"), F.lit("business_address")), F.array("business_name", "business_address"))).alias("field", "value"))
    n = F.length("value")
    return long.groupBy("field", "source", "country").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value") == "").alias("empty"),
        F.round(F.avg(n), 6).alias("mean_length"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("p50_length"), F.max(n).cast("long").alias("max_length"),
    )


def families(entities: DataFrame) -> DataFrame:
    """field, family, records: records whose text has a letter of the family."""
    from tessera.functions.script import families_column

    out = None
    for field in ("business_name", "business_address"):
        some = entities.select(F.lit(field).alias("field"), F.explode(families_column(field)).alias("family"))
        out = some if out is None else out.unionByName(some)
    return out.groupBy("field", "family").agg(F.count(F.lit(1)).alias("records"))
