"""The engine's queries on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import provenance
from tessera.functions import fuzzy
from tessera.operators import decide, diagnose, evaluate, experiments, models, pair_features, research, retrieve, terms
from tessera.plans.fixtures import entities, parts, run, traders, truth
from tessera.plans.sql import FOLD, LANES, MASK, PARTS, TRADERS, grams, sql
from tessera.schemas import ENTITY_VERSION
from tessera.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["s1_id", "target_id"]


def query(name: str, final: str | None = None, **over) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if final:
            ORACLES[name] = sql(final, **over)
        return f

    return keep


# Sources and projections


@query("entity_profile", "select field, source, country, count(*) as rows, count(*) filter (where value is null) as missing, count(*) filter (where value = '') as empty, round(avg(length(value)), 6) as mean_length, round(quantile_cont(length(value), 0.5), 6) as p50_length, max(length(value))::bigint as max_length from (select 'business_name' as field, source, country, business_name as value from ents union all select 'business_address', source, country, business_address from ents) group by all")
def entity_profile(spark, sf):
    return diagnose.profile(entities(spark, sf))


@query("name_families")
def name_families(spark, sf):
    return diagnose.families(entities(spark, sf))


@query("normalize", "select entity_id, source, business_name, business_address, country, name_normal, address_normal from normal")
def normalize(spark, sf):
    return terms.normalized(entities(spark, sf)).drop("schema_version")


@query("text_views", "select entity_id, source, country, name, compact, address, false as name_missing, false as address_missing from views")
def text_views(spark, sf):
    return terms.views(terms.normalized(entities(spark, sf)))


@query("source_split", "select country, source, count(*) as n from views group by all")
def source_split(spark, sf):
    return terms.views(terms.normalized(entities(spark, sf))).groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"))


# Terms and retrieval


@query("vocabulary", "select country, view, term, df, n, round(idf, 6) as idf from vocab")
def vocabulary(spark, sf):
    r = run(spark, sf)
    return terms.vocabulary(r.rows, r.profile, r.counts).select("country", "view", "term", "df", "n", F.round("idf", 6).alias("idf"))


@query("term_weights", "select country, source, entity_id, view, term, round(w, 6) as w from weights")
def term_weights(spark, sf):
    return run(spark, sf).weights.withColumn("w", F.round("w", 6))


@query("fit_evidence", "select s.country, v.view, coalesce(vocabulary, 0) as vocabulary, coalesce(query_nnz, 0) as query_nnz, coalesce(target_nnz, 0) as target_nnz, s.n as documents from sizes s cross join (select unnest(['name', 'compact', 'address']) as view) v left join (select country, view, count(distinct term) as vocabulary, count(*) filter (where source = 'S1') as query_nnz, count(*) filter (where source <> 'S1') as target_nnz from weights group by all) f on s.country is not distinct from f.country and v.view = f.view")
def fit_evidence(spark, sf):
    r = run(spark, sf)
    return terms.fit_evidence(r.rows, r.profile)


def _lane(lane: str) -> None:
    @query(f"lane_{lane}", f"select country, s1_id, target_id, target_source, lane, rank::bigint as rank, similarity from hits where lane = '{lane}'")
    def hits(spark, sf):
        return run(spark, sf).hits.filter(F.col("lane") == lane).withColumn("rank", F.col("rank").cast("long"))


for _name in LANES:
    _lane(_name)


@query("candidates", "select * from cand")
def candidates(spark, sf):
    return run(spark, sf).candidates


@query("lane_evidence", "select s1_id, target_id, target_source, country, lane, rank::int as rank, similarity from hits")
def lane_evidence(spark, sf):
    return retrieve.lane_rows(run(spark, sf).candidates)


@query("mask_algebra", "select s1_id, target_id, bit_count(retrieval_view_mask)::bigint as lanes, retrieval_view_mask & ~1 <> 0 as without_name, retrieval_view_mask & ~16 <> 0 as without_reverse from cand")
def mask_algebra(spark, sf):
    mask = F.col("retrieval_view_mask")
    without = lambda bit: mask.bitwiseAND(F.lit(~bit)) != 0
    return run(spark, sf).candidates.select(*KEYS, F.bit_count(mask).cast("long").alias("lanes"), without(1).alias("without_name"), without(16).alias("without_reverse"))


@query("retrieval_bounds", "select coalesce(sum(q * t), 0)::bigint as eligible_pairs, coalesce(sum(q * 25 + t * 8), 0)::bigint as candidate_bound from (select country, count(*) filter (where source = 'S1') as q, count(*) filter (where source <> 'S1') as t from views group by country)")
def retrieval_bounds(spark, sf):
    r = run(spark, sf)
    return retrieve.bounds(terms.views(r.entities), r.profile)


@query("trader_bounds", "select coalesce(sum(q * t), 0)::bigint as eligible_pairs, coalesce(sum(q * 25 + t * 8), 0)::bigint as candidate_bound from (select country, sum(q) as q, sum(t) as t from (select c_nationkey as country, 1 as q, 0 as t from customer union all select s_nationkey, 0, 1 from supplier) group by country)")
def trader_bounds(spark, sf):
    return retrieve.bounds(terms.views(terms.normalized(traders(spark, sf))), terms.STRICT)


_WARNINGS = """with sides as (select country, count(*) filter (where source = 'S1') as q, count(*) filter (where source <> 'S1') as t from views group by country)
 select country, case when q = 0 then 'no query' else 'no target' end as warning from sides where q = 0 or t = 0
 union all select s.country, 'empty vocabulary: ' || v.view from sides s cross join (select unnest(['name', 'compact', 'address']) as view) v where q > 0 and t > 0 and not exists (select 1 from weights w where w.country is not distinct from s.country and w.view = v.view)"""


@query("retrieval_warnings", _WARNINGS)
def retrieval_warnings(spark, sf):
    r = run(spark, sf)
    return retrieve.warnings(terms.views(r.entities), r.profile)


@query("trader_warnings", _WARNINGS, entities=TRADERS)
def trader_warnings(spark, sf):
    """Traders have no addresses, and some nations lack a side."""
    return retrieve.warnings(terms.views(terms.normalized(traders(spark, sf))), terms.STRICT)


@query("part_candidates", "select * from cand", entities=PARTS, loose=True)
def part_candidates(spark, sf):
    """Extreme ties: budgets hold and ranks are decided by identifier."""
    return retrieve.retrieve(terms.views(terms.normalized(parts(spark, sf))), terms.LOOSE)


def _variant(spark, sf, name: str) -> DataFrame:
    r = run(spark, sf)
    return retrieve.union_lanes(retrieve.lane_hits(r.pairs, experiments.variant(r.profile, name)))


@query("no_reverse_candidates", "select s1_id, target_id, target_source, count(*) as lanes from hits where lane <> 'reverse' group by all")
def no_reverse_candidates(spark, sf):
    return _variant(spark, sf, "no_reverse").select("s1_id", "target_id", "target_source", F.bit_count("retrieval_view_mask").cast("long").alias("lanes"))


@query("top1_candidates", f"select s1_id, target_id, target_source, bit_or({MASK})::int as retrieval_view_mask from hits where rank = 1 group by all")
def top1_candidates(spark, sf):
    return _variant(spark, sf, "k1").select("s1_id", "target_id", "target_source", "retrieval_view_mask")


@query("transliterated_candidates")
def transliterated_candidates(spark, sf):
    r = run(spark, sf)
    return experiments.with_latin_names(r.candidates, r.entities, r.profile).select("s1_id", "target_id", "target_source", "retrieval_view_mask", "origin")


@query("embedding_neighbours", """with e as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)
select q.vec_id as s1_id, t.vec_id as target_id, q.label = t.label as same_label, round(list_dot_product(q.v, t.v) / (q.n * t.n), 6) as similarity from e q join e t on t.vec_id <> q.vec_id where q.vec_id % 100 = 0
qualify row_number() over (partition by q.vec_id order by round(list_dot_product(q.v, t.v) / (q.n * t.n), 9) desc, t.vec_id) <= 5""")  # fmt: skip
def embedding_neighbours(spark, sf):
    """The stated set of query vectors against all others, best five each."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    q = e.filter("vec_id % 100 = 0")
    found = retrieve.nearest(q.select("vec_id", "embedding"), e.select("vec_id", "embedding"), 5)
    of = lambda df, key, name: df.select(F.col("vec_id").alias(key), F.col("label").alias(name))
    return found.join(of(q, "s1_id", "ql"), "s1_id").join(of(e, "target_id", "tl"), "target_id").select("s1_id", "target_id", (F.col("ql") == F.col("tl")).alias("same_label"), F.round("similarity", 6).alias("similarity"))


# Diagnostics


@query("density", "select round(avg(n), 6) as mean, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.99), 6) as p99, max(n) as max, count(*) filter (where n = 0) as zero_queries, round(count(*) filter (where n = 0) / count(*), 6) as zero_rate from (select q.s1_id, count(c.s1_id) as n from queries q left join cand c using (s1_id) group by q.s1_id)")
def density(spark, sf):
    r = run(spark, sf)
    return diagnose.density(r.candidates, r.queries)


_RECALL = " union all ".join(f"select '{lane}' as lane, {k}::bigint as k, round(count(*) filter (where {(lane + '_rank') if lane != 'union' else 'least(name_rank, compact_name_rank_, address_rank, combined_rank)'} <= {k}) / (select count(*) from truth), 6) as recall from marked where hit = 1" for lane in ("name", "compact", "address", "combined", "union") for k in (1, 5, 10, 20)).replace("compact_name_rank_", "compact_rank")


@query("recall_at_k", _RECALL)
def recall_at_k(spark, sf):
    r = run(spark, sf)
    return diagnose.recall_at(r.candidates, r.truth)


@query("lane_rescue", " union all ".join(f"""select '{x}' as lane, count(*) filter (where retrieval_view_mask & {b} <> 0)::bigint as candidate_pairs, count(*) filter (where retrieval_view_mask = {b})::bigint as unique_pairs,
 count(*) filter (where hit = 1 and retrieval_view_mask & {b} <> 0)::bigint as truths_recovered, count(*) filter (where hit = 1 and retrieval_view_mask = {b})::bigint as unique_truths,
 round(count(*) filter (where hit = 1 and retrieval_view_mask = {b}) / (select count(*) from truth) * 1000000 / nullif(count(*) filter (where retrieval_view_mask = {b}), 0), 6) as marginal_recall_per_million,
 count(*) filter (where retrieval_view_mask <> {b})::bigint as pairs_without, round(count(*) filter (where hit = 1 and retrieval_view_mask <> {b}) / (select count(*) from truth), 6) as recall_without from marked""" for x, (b, _) in LANES.items()))
def lane_rescue(spark, sf):
    r = run(spark, sf)
    return diagnose.lane_rescue(r.candidates, r.truth)


@query("lane_overlap", " union all ".join(f"select '{x}' as lane_a, '{y}' as lane_b, count(*) filter (where retrieval_view_mask & {a} <> 0 and retrieval_view_mask & {b} <> 0)::bigint as pairs, count(*) filter (where hit = 1 and retrieval_view_mask & {a} <> 0 and retrieval_view_mask & {b} <> 0)::bigint as truths from marked" for x, (a, _) in LANES.items() for y, (b, _) in LANES.items()))
def lane_overlap(spark, sf):
    r = run(spark, sf)
    return diagnose.lane_overlap(r.candidates, r.truth)


@query("truths_by_lane_count", "select bit_count(retrieval_view_mask)::bigint as lanes, count(*) as truths from marked where hit = 1 group by 1")
def truths_by_lane_count(spark, sf):
    r = run(spark, sf)
    return diagnose.truths_by_lane_count(r.candidates, r.truth)


@query("retrieval_summary", "select count(*) as candidate_pairs, e as eligible_pairs, round(1 - count(*) / e, 6) as reduction_ratio, t as truths, sum(hit)::bigint as truths_recovered, round(sum(hit) / t, 6) as recall, round(count(*) / nullif(sum(hit), 0), 6) as candidates_per_truth from marked cross join (select count(*) as t from truth) cross join (select sum(q * t)::bigint as e from (select country, count(*) filter (where source = 'S1') as q, count(*) filter (where source <> 'S1') as t from views group by country)) group by e, t")
def retrieval_summary(spark, sf):
    r = run(spark, sf)
    return diagnose.summary(r.candidates, r.truth, retrieve.bounds(terms.views(r.entities), r.profile))


_POINTS = " union all ".join(f"select 'k{k}' as name, count(distinct (s1_id, target_id)) as candidate_pairs, count(distinct case when (s1_id, target_id) in (select (s1_id, target_id) from truth) then (s1_id, target_id) end) / (select count(*) from truth) as recall from hits where rank <= {k}" for k in (1, 2, 3, 5))


@query("frontier", f"with points as ({_POINTS}) select name, candidate_pairs::bigint as candidate_pairs, round(recall, 6) as recall, not exists (select 1 from points o where o.recall >= p.recall and o.candidate_pairs <= p.candidate_pairs and (o.recall > p.recall or o.candidate_pairs < p.candidate_pairs)) as pareto from points p")
def frontier(spark, sf):
    """Recall against candidates for several budgets of all lanes, and which points none dominates."""
    r, budgets = run(spark, sf), (1, 2, 3, 5)
    best = r.hits.groupBy(*KEYS).agg(F.min("rank").alias("rank")).join(r.truth.withColumn("hit", F.lit(1)), KEYS, "left")
    counts = [F.struct(F.lit(f"k{k}").alias("name"), F.count_if(F.col("rank") <= k).alias("candidate_pairs"), F.count_if((F.col("rank") <= k) & (F.col("hit") == 1)).alias("hits")) for k in budgets]
    totals = best.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("p")).select("p.*").crossJoin(r.truth.agg(F.count(F.lit(1)).alias("t")))  # a row a budget, by a single row
    points = totals.select("name", "candidate_pairs", F.try_divide("hits", "t").alias("recall"))
    return diagnose.pareto(staged(points, "points"), "candidate_pairs").withColumn("recall", F.round("recall", 6))


# Pair features


def _overlaps(name: str, a: str, b: str) -> str:
    hit, union = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    part = lambda n, d: f"coalesce({n}::double / nullif({d}, 0), 0)"
    j, q, t = name.split(",")
    return ", ".join(f"{x} as {y}" for x, y in ((part(hit, union), j), (part(hit, f"len({a})"), q), (part(hit, f"len({b})"), t)) if y)


_W, _N = r"'[\p{L}\p{N}_]+'", r"'\p{Nd}+'"
_tok = lambda c, p: f"list_distinct(regexp_extract_all({c}, {p}))"
_gr = lambda c: f"list_distinct({grams(c)})"


@query("features_direct", f"""select s1_id, target_id, (qn <> '' and qn = tn)::int::double as name_nonempty_exact_match, {_overlaps('name_char_trigram_jaccard,,', _gr('qn'), _gr('tn'))},
 {_overlaps('name_token_jaccard,name_query_token_coverage,name_target_token_coverage', _tok('qn', _W), _tok('tn', _W))}, (qa <> '' and qa = ta)::int::double as address_nonempty_exact_match, {_overlaps('address_char_trigram_jaccard,,', _gr('qa'), _gr('ta'))},
 {_overlaps('address_token_jaccard,address_query_token_coverage,address_target_token_coverage', _tok('qa', _W), _tok('ta', _W))}, {_overlaps('numeric_token_jaccard,numeric_query_coverage,numeric_target_coverage', _tok('qa', _N), _tok('ta', _N))},
 (regexp_extract(qa, {_N}) <> '' and regexp_extract(qa, {_N}) = regexp_extract(ta, {_N}))::int::double as nonempty_first_number_equality, len({_tok('qa', _N)})::double as query_numeric_token_count, len({_tok('ta', _N)})::double as target_numeric_token_count,
 (qn = '')::int::double as query_name_missing, (tn = '')::int::double as target_name_missing, (qa = '')::int::double as query_address_missing, (ta = '')::int::double as target_address_missing, (target_source = 'S2')::int::double as target_source_is_S2 from paired""")  # fmt: skip
def features_direct(spark, sf):
    rows = pair_features.direct(run(spark, sf).paired)
    native = [c for c in pair_features.FEATURES[:29] if c in rows.columns]
    return rows.select(*KEYS, *native)


@query("feature_jaro_winkler", "select s1_id, target_id, case when qn = '' or tn = '' then 0 else round(jaro_winkler_similarity(qn, tn), 6) end::double as name_jaro_winkler from paired")
def feature_jaro_winkler(spark, sf):
    rows = run(spark, sf).paired
    return rows.select(*KEYS, F.round(fuzzy.jaro_winkler_column("q_name_normal", "t_name_normal"), 6).alias("name_jaro_winkler"))


@query("features_fuzzy")
def features_fuzzy(spark, sf):
    rows = pair_features.fuzzy_features(run(spark, sf).paired)
    return rows.select(*KEYS, *[c for c in pair_features.FEATURES[:29] if "ratio" in c or "winkler" in c])


@query("features_cosine", "select * from cosines")
def features_cosine(spark, sf):
    r = run(spark, sf)
    return pair_features.cosines(r.candidates, r.weights)


@query("features_rank", "select s1_id, target_id, " + ", ".join(f"coalesce({x}_rank::double - 1, 999.0::double) as {'compact_name' if x == 'compact' else x}_rank" for x in LANES) + " from cand")
def features_rank(spark, sf):
    return pair_features.ranks(run(spark, sf).candidates).select(*KEYS, "name_rank", "compact_name_rank", "address_rank", "combined_rank", "reverse_rank")


def _context(s: str) -> str:
    x = f"exact_{s}_cosine"
    top = f"max({x}) over t"
    return (
        f"rank() over (partition by s1_id, target_source order by {x} desc)::double as {s}_query_source_rank, round({x} - max({x}) over q, 9) as {s}_query_source_delta_best, rank() over (partition by target_id order by {x} desc)::double as {s}_target_owner_rank, round({x} - {top}, 9) as {s}_target_delta_best, "
        f"round(case when count(*) over t = 1 then 0 when {x} = {s}_top and count(*) filter (where {x} = {s}_top) over t = 1 then {x} - max({x}) filter (where {x} < {s}_top) over t else {x} - {s}_top end, 9)::double as {s}_target_rival_margin"
    )


@query("features_context", "select s1_id, target_id, " + ", ".join(map(_context, ("name", "address", "combined"))) + ", count(*) over q::double as candidate_count_within_s1_source, count(*) over t::double as distinct_competing_s1_count_for_target from (select k.*, c.target_source, max(exact_name_cosine) over (partition by target_id) as name_top, max(exact_address_cosine) over (partition by target_id) as address_top, max(exact_combined_cosine) over (partition by target_id) as combined_top from cosines k join cand c using (s1_id, target_id)) window q as (partition by s1_id, target_source), t as (partition by target_id)")
def features_context(spark, sf):
    r = run(spark, sf)
    rows = pair_features.context(r.cosines.join(r.candidates.select(*KEYS, "target_source"), KEYS))
    return rows.select(*KEYS, *pair_features.FEATURES[38:55])


@query("features_cross_script")
def features_cross_script(spark, sf):
    r = run(spark, sf)
    return pair_features.cross_script(pair_features.paired(r.candidates, pair_features.spelled(r.entities))).select(*KEYS, "f55", "f56", "f57", "f58")


@query("features_all")
def features_all(spark, sf):
    r = run(spark, sf)
    return r.features


@query("features_masked", "select s1_id, target_id, 0.0::double as exact_name_cosine, round(exact_combined_cosine * 0, 6) as exact_combined_cosine from cosines")
def features_masked(spark, sf):
    return pair_features.zero_masked(run(spark, sf).cosines, ["retrieval"]).select(*KEYS, "exact_name_cosine", "exact_combined_cosine")


# Decisions


@query("ownership", "select * from owned")
def ownership(spark, sf):
    return run(spark, sf).owned


@query("dispositions", "select * from disposed")
def dispositions(spark, sf):
    return run(spark, sf).disposed


@query("resolutions", "select s1_id, array_to_string(accepted_targets, ',') as accepted_targets, decision_type from resolved")
def resolutions(spark, sf):
    return run(spark, sf).resolved.withColumn("accepted_targets", F.array_join("accepted_targets", ","))


@query("decision_counts", "select decision_type, count(*) as n from resolved group by 1")
def decision_counts(spark, sf):
    return run(spark, sf).resolved.groupBy("decision_type").agg(F.count(F.lit(1)).alias("n"))


@query("exclusive_targets", "select target_id, count(*) as n from disposed where accepted group by 1")
def exclusive_targets(spark, sf):
    r = run(spark, sf)
    decide.check_exclusive(r.resolved)
    return r.resolved.select(F.explode("accepted_targets").alias("target_id")).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("stage_alignment", "select count(*) as pairs from cand")
def stage_alignment(spark, sf):
    r = run(spark, sf)
    decide.check_aligned(r.candidates, r.scores, r.owned, r.disposed)
    return r.owned.agg(F.count(F.lit(1)).alias("pairs"))


@query("evidence", "select * replace (array_to_string(accepted_targets, ',') as accepted_targets) from evidence")
def evidence(spark, sf):
    r = run(spark, sf)
    return r.evidence.withColumn("accepted_targets", F.array_join("accepted_targets", ","))


@query("risks", "select * from risks")
def risks(spark, sf):
    r = run(spark, sf)
    return decide.risks(r.evidence)


@query("policy_check", "select (select count(*) from (select target_id from owned group by 1 having count(*) > 1)) as contested_targets, (select count(*) from owned where is_owner) as owners, (select count(*) from disposed d join truth t on d.s1_id = t.s1_id and d.target_id = t.target_id where rejection_reason = 'LOST_OWNERSHIP') as ownership_loss_truths")
def policy_check(spark, sf):
    r = run(spark, sf)
    return decide.policy_check(r.owned, r.disposed, r.truth)


@query("explain", "select d.s1_id, d.target_id, d.score, accepted, rejection_reason, retrieval_view_mask, owner_rank, rival_s1_id from (select *, row_number() over (partition by s1_id, accepted order by score desc, target_id) as nth from disposed) d join cand c on d.s1_id = c.s1_id and d.target_id = c.target_id join owned o on d.s1_id = o.s1_id and d.target_id = o.target_id where accepted or nth <= 5")
def explain(spark, sf):
    r = run(spark, sf)
    return decide.explain(r.candidates, r.owned, r.disposed).select(*KEYS, "score", "accepted", "rejection_reason", "retrieval_view_mask", "owner_rank", "rival_s1_id")


# Evaluation


@query("set_metrics", "select * from metrics")
def set_metrics(spark, sf):
    r = run(spark, sf)
    return r.metrics


_MACRO = "count(*) as query_count, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f05), 6) as macro_f05, round(avg(exact_set::int::double), 6) as exact_set_accuracy, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn"


@query("quality_report", f"select cohort, {_MACRO} from (select *, unnest(['all', case when truth_count = 0 then 'zero' when truth_count = 1 then 'single' else 'multi' end]) as cohort from metrics) group by cohort")
def quality_report(spark, sf):
    r = run(spark, sf)
    return evaluate.quality_report(r.metrics)


_BIN = "case " + " ".join(f"when score >= {i / 10!r}::double then {i}" for i in range(9, 0, -1)) + " else 0 end::bigint"


@query("calibration", f"select {_BIN} as bin, count(*) as count, round(avg(score), 6) as mean_score, round(avg(label::double), 6) as positive_fraction from labelled group by 1")
def calibration(spark, sf):
    r = run(spark, sf)
    return evaluate.calibration(evaluate.labelled(r.scores, r.truth))


@query("ranking_metrics", """select round((select sum(won) from (select p.n * (select coalesce(sum(g.n), 0) from (select score, count(*) as n from labelled where label = 0 group by score) g where g.score < p.score) + 0.5 * p.n * coalesce((select count(*) from labelled z where z.label = 0 and z.score = p.score), 0) as won from (select score, count(*) as n from labelled where label = 1 group by score) p))
 / ((select count(*) from labelled where label = 1) * (select count(*) from labelled where label = 0)), 6) as auroc,
 (select round(sum(pos * tp / seen) / sum(pos), 6) from (select sum(label) as pos, sum(sum(label)) over (order by score desc) as tp, sum(count(*)) over (order by score desc) as seen from labelled group by score)) as average_precision,
 (select round(avg(-(label * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))) + (1 - label) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, score))))), 6) from labelled) as log_loss,
 (select round(avg((score - label) * (score - label)), 6) from labelled) as brier""")  # fmt: skip
def ranking_metrics(spark, sf):
    r = run(spark, sf)
    return evaluate.ranking_metrics(evaluate.labelled(r.scores, r.truth))


@query("label_metrics", "select label, count(*) as count, round(avg(score), 6) as mean, min(score) as min, max(score) as max from (select toxic as label, 1.0::double / (1 + quality) as score from labels) group by label")
def label_metrics(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("toxic").alias("label"), (1.0 / (1 + F.col("quality"))).alias("score"))
    return evaluate.score_distributions(rows)


@query("score_distributions", "select label, count(*) as count, round(avg(score), 6) as mean, min(score) as min, max(score) as max from labelled group by label")
def score_distributions(spark, sf):
    r = run(spark, sf)
    return evaluate.score_distributions(evaluate.labelled(r.scores, r.truth))


def _failed(r) -> DataFrame:
    return r.failed


@query("failures", "select * replace (array_to_string(tags, ',') as tags) from failures")
def failures(spark, sf):
    return _failed(run(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("failure_counts", "select e.error_type, s.failure_stage, count(f.s1_id) as n from (select unnest(['FALSE_NEGATIVE', 'FALSE_POSITIVE']) as error_type) e cross join (select unnest(['RETRIEVAL', 'SCORING', 'OWNERSHIP', 'DECODING', 'AMBIGUOUS_OR_INSUFFICIENT_EVIDENCE']) as failure_stage) s left join failures f on f.error_type = e.error_type and f.failure_stage = s.failure_stage group by all")
def failure_counts(spark, sf):
    return evaluate.failure_counts(_failed(run(spark, sf)))


@query("failure_tags", "select tag, count(*) as n from (select unnest(tags) as tag from failures) group by 1")
def failure_tags(spark, sf):
    return _failed(run(spark, sf)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("failure_examples", "select s1_id, target_id, error_type, failure_stage from failures qualify row_number() over (partition by error_type, failure_stage order by s1_id, target_id) <= 2")
def failure_examples(spark, sf):
    return evaluate.failure_examples(_failed(run(spark, sf))).select(*KEYS, "error_type", "failure_stage")


_SIM = "greatest(" + ", ".join(f"coalesce({x}_similarity, 0)" for x in LANES) + ")"


@query("mined_pairs", f"select s1_id, target_id, hit::tinyint as label, case when hit = 1 then 'retrieved_labelled_truth' else 'retrieved_not_labelled_truth_top_similarity' end as reason from (select *, row_number() over (partition by s1_id, hit order by {_SIM} desc, sha256('[42,\"' || s1_id || '\",\"' || target_id || '\"]')) as nth from marked) where hit = 1 or nth <= 16")
def mined_pairs(spark, sf):
    r = run(spark, sf)
    return evaluate.mine_pairs(r.candidates, r.truth)


# Research


@query("cohort_tags", "select * from tags")
def cohort_tags(spark, sf):
    r = run(spark, sf)
    return research.cohort_tags(r.entities, r.truth, r.candidates, r.owned)


@query("cohort_quality", f"select tag, {_MACRO} from tags join metrics using (s1_id) group by tag")
def cohort_quality(spark, sf):
    r = run(spark, sf)
    tags = research.cohort_tags(r.entities, r.truth, r.candidates, r.owned)
    return research.cohort_quality(tags, r.metrics)


@query("script_cohorts")
def script_cohorts(spark, sf):
    r = run(spark, sf)
    return research.cohort_tags(r.entities, r.truth, r.candidates, r.owned).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("atlas")
def atlas(spark, sf):
    r = run(spark, sf)
    return research.atlas(_failed(r), r.entities, r.candidates, r.owned, r.disposed, r.resolved, r.truth)


@query("risk_coverage", "select row_number() over w as nth, s1_id, round(avg(1 - f05) over (order by structure_risk, s1_id rows unbounded preceding), 6) as running_error from risks join metrics using (s1_id) window w as (order by structure_risk, s1_id)")
def risk_coverage(spark, sf):
    r = run(spark, sf)
    risk = decide.risks(r.evidence)
    rows = risk.join(r.metrics, "s1_id").select("s1_id", F.col("structure_risk").alias("risk"), (1 - F.col("f05")).alias("error"))
    return research.risk_coverage(staged(rows, "risk"))


def _perturbed(name: str, text: str) -> None:
    at = lambda c: f"case when source = 'S1' then {text.format(c)} else {c} end as {c}"

    @query(f"perturb_{name}", f"select entity_id, source, {at('business_name')}, {at('business_address')}, country from ents")
    def change(spark, sf):
        return research.perturbed(entities(spark, sf), name).drop("schema_version")


_perturbed("case", "array_to_string(list_transform(string_split({0}, ''), lambda x: case when x = 'ß' then 'SS' when x = lower(x) then upper(x) else lower(x) end), '')")
_perturbed("spacing", "'  ' || replace({0}, ' ', '   ') || '  '")
_perturbed("punctuation", "replace({0}, ' ', ' / ')")
_perturbed("token_order", r"array_to_string(list_reverse(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')), ' ')")


@query("perturb_transliteration")
def perturb_transliteration(spark, sf):
    return research.perturbed(entities(spark, sf), "transliteration").drop("schema_version")


@query("perturb_competition", "select * from ents union all (select '!injected-public-competitor', * exclude (entity_id) from ents where source = 'S1' and business_name <> '' order by entity_id limit 1)")
def perturb_competition(spark, sf):
    return research.perturbed(entities(spark, sf), "competition").drop("schema_version")


_LOW = "select s1_id, list_sort(list(target_id)) as found from disposed where is_owner and score >= 0.9 group by s1_id"


@query("stability", f"select r.s1_id, r.accepted_targets is distinct from coalesce(o.found, []::varchar[]) as changed from resolved r left join ({_LOW}) o using (s1_id)")
def stability(spark, sf):
    """How accepted sets change under a stricter threshold."""
    r = run(spark, sf)
    return research.stability(r.resolved, decide.resolutions(decide.dispositions(r.owned, 0.9), r.queries))


@query("paired_delta", f"with o as (select q.s1_id, coalesce(found, []::varchar[]) as acc from queries q left join ({_LOW}) using (s1_id)), m as (select o.s1_id, len(list_intersect(acc, coalesce(truth_targets, []::varchar[]))) as tp, len(acc) as f, coalesce(wanted, 0) as w from o left join wanted using (s1_id)), s as (select *, case when f > 0 then tp::double / f when w = 0 then 1.0::double else 0.0::double end as p, case when w > 0 then tp::double / w else 1.0::double end as r from m), g as (select s1_id, round(case when f + w = 0 then 1.0::double when p > 0 and .25 * p + r > 0 then 1.25::double * p * r / (0.25::double * p + r) else 0.0::double end, 9) as challenger from s) select s1_id, f05 as reference, challenger, round(challenger - f05, 9) as delta from metrics join g using (s1_id)")
def paired_delta(spark, sf):
    r = run(spark, sf)
    other = decide.resolutions(decide.dispositions(r.owned, 0.9), r.queries)
    return research.paired_delta(r.metrics, evaluate.set_metrics(other, r.truth))


@query("stage_movement", """with accepted9 as (select s1_id, target_id from owned where is_owner and score >= 0.9),
 errors9 as (select s1_id, target_id, 'FALSE_NEGATIVE' as error_type from truth where (s1_id, target_id) not in (select (s1_id, target_id) from accepted9) union all select s1_id, target_id, 'FALSE_POSITIVE' from accepted9 where (s1_id, target_id) not in (select (s1_id, target_id) from truth)),
 failures9 as (select e.s1_id, e.target_id, e.error_type, case when e.error_type = 'FALSE_POSITIVE' then 'SCORING' when c.s1_id is null then 'RETRIEVAL' when o.score < 0.9 then 'SCORING' when not o.is_owner then 'OWNERSHIP' else 'DECODING' end as failure_stage
  from errors9 e left join cand c on e.s1_id = c.s1_id and e.target_id = c.target_id left join owned o on e.s1_id = o.s1_id and e.target_id = o.target_id)
 select coalesce(a.failure_stage, 'NOT_ERROR') as from_stage, coalesce(b.failure_stage, 'NOT_ERROR') as to_stage, count(*) as n from failures a full join failures9 b on a.s1_id = b.s1_id and a.target_id = b.target_id and a.error_type = b.error_type group by all""")  # fmt: skip
def stage_movement(spark, sf):
    """How errors move between stages, come and go under a stricter threshold."""
    r = run(spark, sf)
    return research.stage_movement(r.failed, evaluate.failures(r.candidates, r.owned, decide.dispositions(r.owned, 0.9), r.truth, threshold=0.9))


@query("scale_summary", "select queries, stage, round(quantile_cont(seconds, 0.5), 6) as median_seconds, round(max(seconds) - min(seconds), 6) as range_seconds, max(rss_mib) as max_rss_mib, round(queries / quantile_cont(seconds, 0.5), 6) as queries_per_second from (select o_orderpriority as stage, o_custkey % 5 + 1 as queries, o_totalprice / 1000 as seconds, o_totalprice as rss_mib from orders) group by queries, stage")
def scale_summary(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("stage"), (F.col("o_custkey") % 5 + 1).alias("queries"), (F.col("o_totalprice") / 1000).alias("seconds"), F.col("o_totalprice").alias("rss_mib"))
    return research.scale_summary(o)


@query("rescue_union", "select s1_id, target_id, min(lane) as first_lane from hits where lane in ('name', 'reverse') group by all")
def rescue_union(spark, sf):
    """The name lane's pairs and those only the reverse lane adds; on overlap the name lane's row stays."""
    hits = run(spark, sf).hits
    lane = lambda x: hits.filter(F.col("lane") == x).select(*KEYS, F.col("lane").alias("first_lane"))
    return research.rescued(lane("name"), lane("reverse"))


def _digest_sql(version: str, fields: dict[str, str], rows: str) -> str:
    """The digest of `rows` as provenance.fingerprint() makes it."""
    text = " || ',' || ".join(f"""'"{k}":' || coalesce(to_json({fields[k]})::varchar, 'null')""" for k in sorted(fields))
    return (
        f"with hashed as (select sha256('{{' || {text} || '}}') as h from {rows}), folded as (select ('0x' || substring(h, 1, 6))::bigint % 4096 as part, sha256(string_agg(h, chr(10) order by h)) as sha from hashed group by 1) "
        f"select sha256('{version}' || chr(10) || string_agg(sha, chr(10) order by part)) as fingerprint from folded"
    )


_PAIR = {"s1_id": "s1_id", "target_id": "target_id"}


@query("truth_fingerprint", _digest_sql("tessera.truth.v1", _PAIR, "truth"))
def truth_fingerprint(spark, sf):
    return provenance.fingerprint(run(spark, sf).truth, "tessera.truth.v1")


@query("resolution_fingerprint", _digest_sql("tessera.resolution.v1", {"s1_id": "s1_id", "accepted": "array_to_string(accepted_targets, ',')", "decision_type": "decision_type"}, "resolved"))
def resolution_fingerprint(spark, sf):
    return provenance.fingerprint(run(spark, sf).resolved.select("s1_id", F.array_join("accepted_targets", ",").alias("accepted"), "decision_type"), "tessera.resolution.v1")


@query("score_fingerprint", _digest_sql("tessera.score.v1", {**_PAIR, "score": "score::decimal(12, 6)::varchar"}, "scores"))
def score_fingerprint(spark, sf):
    return provenance.fingerprint(run(spark, sf).scores.select(*KEYS, F.col("score").cast("decimal(12,6)").cast("string").alias("score")), "tessera.score.v1")


@query("split_fingerprint", _digest_sql("tessera.split.v1", {"source": "source", "entity_id": "entity_id", "role": "role"}, "(select *, case entity_id::bigint % 4 when 0 then 'test' when 1 then 'calibration' else 'train' end as role from ents)"))
def split_fingerprint(spark, sf):
    n = F.col("entity_id").cast("long") % 4
    return provenance.fingerprint(entities(spark, sf).select("source", "entity_id", F.when(n == 0, "test").when(n == 1, "calibration").otherwise("train").alias("role")), "tessera.split.v1")


@query("dataset_fingerprint", _digest_sql("tessera.dataset.v1", {c: c for c in ("entity_id", "source", "business_name", "business_address", "country")} | {"schema_version": f"'{ENTITY_VERSION}'"}, "ents"))
def dataset_fingerprint(spark, sf):
    return provenance.fingerprint(entities(spark, sf), "tessera.dataset.v1")


@query("candidate_fingerprint", _digest_sql("tessera.graph.v1", {**_PAIR, "target_source": "target_source", "mask": "retrieval_view_mask::varchar"}, "cand"))
def candidate_fingerprint(spark, sf):
    return provenance.fingerprint(run(spark, sf).candidates.select(*KEYS, "target_source", F.col("retrieval_view_mask").cast("string").alias("mask")), "tessera.graph.v1")


@query("row_digests", "select sha256('{\"s1_id\":\"' || s1_id || '\",\"target_id\":\"' || target_id || '\"}') as row_sha256 from truth")
def row_digests(spark, sf):
    return provenance.row_digests(truth(spark, sf))


def _fitted(spark, sf, scorer):
    """Scores of the whole graph by a model that has seen the truth of queries outside the held-out part only."""
    r, held_out = run(spark, sf), F.crc32(F.col("s1_id").cast("binary")) % 4 == 2
    mined = evaluate.mine_pairs(r.candidates.filter(~held_out), r.truth.filter(~held_out))
    return scorer.fit(r.features, mined).predict(r.features).withColumn("held_out", held_out)


@query("logistic_scores")
def logistic_scores(spark, sf):
    return _fitted(spark, sf, models.LogisticScorer())


@query("boosted_scores")
def boosted_scores(spark, sf):
    return _fitted(spark, sf, models.BoostedScorer(trees=100))


@query("bootstrap_delta")
def bootstrap_delta(spark, sf):
    """Mean paired delta with its interval; the paired vector is one number a query of an evaluation set."""
    delta = paired_delta(spark, sf).orderBy("s1_id").select("delta").toPandas()["delta"].to_numpy(np.float64)
    found = research.bootstrap_mean(delta)
    return spark.createDataFrame([(found["mean"], found["low"], found["high"])], "mean double, low double, high double")


@query("risk_comparison")
def risk_comparison(spark, sf):
    """Deltas of two risks as predictors of wrong sets; three numbers a query of an evaluation set."""
    r = run(spark, sf)
    return spark.createDataFrame(experiments.risk_comparison(r.evidence, r.metrics), "metric string, mean double, low double, high double")


@query("fold_check", f"select doc_id, {FOLD.format('text')} as folded from documents")
def fold_check(spark, sf):
    from tessera.functions.text import fold

    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", fold("text").alias("folded"))
