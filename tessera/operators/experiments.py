"""The experiment suite: other scorers, feature groups left out, retrieval variants and perturbed queries, each
run through all stages and compared with the reference run. Nothing here promotes a challenger.

A suite is a handful of settings; its loop is over settings, and each run is distributed. What comes to the
driver is one number a query of the test part, for the bootstrap.
"""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.script import latin_table, transliterated
from tessera.operators import decide, evaluate, models, pair_features, research, retrieve, terms
from tessera.staging import staged

KEYS = ["s1_id", "target_id"]
SCORERS = ("boosted", "logistic")
VARIANTS = ("reference", "k1", "no_reverse", "transliterated_name")


@dataclass(frozen=True)
class Experiment:
    """One change to the reference: its scorer, a feature group set to 0 in fitting and scoring, its retrieval,
    or its seed (which the logistic solver only records: it draws no random numbers)."""

    name: str
    scorer: str = "boosted"
    without: str | None = None
    retrieval: str = "reference"
    seed: int = 42

    def __post_init__(self):
        if not self.name or self.scorer not in SCORERS or self.retrieval not in VARIANTS or self.without not in (None, *pair_features.GROUPS):
            raise ValueError(f"no such experiment: {self}")
        if self.seed < 0 or (self.scorer == "boosted" and self.seed != 42):
            raise ValueError("the reference's seed is fixed")

    def made(self, trees: int | None = None) -> models.PipelineScorer:
        if self.scorer == "logistic":
            return models.LogisticScorer(seed=self.seed)
        return models.BoostedScorer(**({"trees": trees} if trees else {}))

    def masked(self, features: DataFrame) -> DataFrame:
        return pair_features.zero_masked(features, [self.without] if self.without else [])


SUITE = (
    Experiment("reference"), Experiment("logistic", scorer="logistic"), *(Experiment(f"without_{g}", without=g) for g in pair_features.GROUPS),
    *(Experiment(v, retrieval=v) for v in VARIANTS[1:]), Experiment("logistic_seed7", scorer="logistic", seed=7),
)


def variant(profile: terms.Profile, retrieval: str) -> terms.Profile:
    """The profile of a retrieval variant; a changed budget has a name of its own."""
    if retrieval == "k1":
        return budget_variant(profile, 1)
    if retrieval == "no_reverse":
        return replace(profile, name=f"{profile.name}-no-reverse", lanes=tuple(x for x in profile.lanes if x != "reverse"))
    return profile


def budget_variant(profile: terms.Profile, k: int) -> terms.Profile:
    return replace(profile, name=f"{profile.name}-budget-{k}", budgets=dict.fromkeys(profile.budgets, k))


def with_latin_names(graph: DataFrame, entities: DataFrame, profile: terms.Profile) -> DataFrame:
    """The graph and what the name lane finds among names in Latin letters; `origin` says which. On overlap
    the graph's own row stays."""
    table = latin_table(entities, ["business_name"])
    latin = terms.normalized(entities.withColumn("business_name", transliterated(F.col("business_name"), table)).drop("name_normal", "address_normal"))
    extra = retrieve.retrieve(terms.views(latin), replace(profile, name=f"{profile.name}-latin-name", lanes=("name",)))
    return research.rescued(graph.withColumn("origin", F.lit("original")), extra.withColumn("origin", F.lit("transliterated_name")))


@dataclass
class Prepared:
    """A part's entities, truth, graph and features under one retrieval."""

    entities: DataFrame
    truth: DataFrame
    graph: DataFrame
    features: DataFrame

    @property
    def queries(self) -> DataFrame:
        return self.entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"))


def prepare(entities: DataFrame, truth: DataFrame, profile: terms.Profile, retrieval: str = "reference") -> Prepared:
    entities, profile = terms.normalized(entities), variant(profile, retrieval)
    rows = terms.views(entities)
    weights = staged(terms.term_weights(terms.eligible(rows), profile), "weights")
    graph = staged(retrieve.union_lanes(retrieve.lane_hits(retrieve.products(weights), profile)), "graph")
    retrieve.check_bounds(graph, rows, profile)
    if retrieval == "transliterated_name":
        graph = staged(with_latin_names(graph, entities, profile).drop("origin"), "graph")
    return Prepared(entities, truth, graph, staged(pair_features.pair_features(graph, entities, weights), "features"))


@dataclass
class Outcome:
    scores: DataFrame
    owned: DataFrame
    disposed: DataFrame
    resolved: DataFrame
    metrics: DataFrame
    failures: DataFrame


def fitted(experiment: Experiment, train: Prepared, trees: int | None = None) -> models.PipelineScorer:
    return experiment.made(trees).fit(experiment.masked(train.features), evaluate.mine_pairs(train.graph, train.truth))


def resolve(experiment: Experiment, scorer: models.PipelineScorer, part: Prepared) -> Outcome:
    scores = staged(models.check_scores(scorer.predict(experiment.masked(part.features)), part.graph), "scores")
    owned = staged(decide.ownership(scores.select(*KEYS, "score")), "owned")
    disposed = decide.dispositions(owned)
    resolved = staged(decide.resolutions(disposed, part.queries), "resolved")
    decide.check_exclusive(resolved)
    return Outcome(scores, owned, disposed, resolved, staged(evaluate.set_metrics(resolved, part.truth), "metrics"), staged(evaluate.failures(part.graph, owned, disposed, part.truth), "failures"))


def interval(before: DataFrame, after: DataFrame) -> dict[str, float]:
    """The mean difference of F0.5 with its bootstrap interval; one number a query comes to the driver."""
    delta = research.paired_delta(before, after).orderBy("s1_id").select("delta").toPandas()["delta"].to_numpy(np.float64)
    return research.bootstrap_mean(delta) if len(delta) else {"mean": 0.0, "low": 0.0, "high": 0.0}


def risk_comparison(evidence: DataFrame, metrics: DataFrame) -> list[tuple[str, float, float, float]]:
    """metric, mean, low, high: how much better structure risk tells wrong sets than confidence risk does."""
    rows = decide.risks(evidence).join(metrics, "s1_id").orderBy("s1_id").select((~F.col("exact_set")).cast("int").alias("wrong"), "confidence_risk", "structure_risk").toPandas()
    found = research.bootstrap_risks(rows["wrong"].to_numpy(np.int64), rows["confidence_risk"].to_numpy(np.float64), rows["structure_risk"].to_numpy(np.float64)) if len(rows) else {}
    return [(k, v["mean"], v["low"], v["high"]) for k, v in found.items()]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def suite(train: tuple[DataFrame, DataFrame], test: tuple[DataFrame, DataFrame], profile: terms.Profile, trees: int | None = None, experiments: tuple[Experiment, ...] = SUITE, perturbations: tuple[str, ...] = research.PERTURBATIONS) -> dict:
    """Runs the experiments over (entities, truth) of a training and a test part: each one's quality and model,
    its comparison with the first, the perturbed queries under the first one's frozen model, and whether a
    repeat and another order of rows give the same."""
    parts: dict[str, tuple[Prepared, Prepared]] = {}
    out: dict = {"experiments": {}, "comparisons": {}, "robustness": {}}
    first = None
    for e in experiments:
        if e.retrieval not in parts:
            parts[e.retrieval] = prepare(*train, profile, e.retrieval), prepare(*test, profile, e.retrieval)
        learn, part = parts[e.retrieval]
        start = time.perf_counter()
        scorer = fitted(e, learn, trees)
        seconds, got = time.perf_counter() - start, resolve(e, scorer, part)
        out["experiments"][e.name] = {"model": scorer.fingerprint(), "fit_seconds": round(seconds, 3), "candidates": part.graph.count(), "quality": _rows(evaluate.quality_report(got.metrics))}
        if first is None:
            first = (e, scorer, got, part)
        else:
            tags = research.cohort_tags(first[3].entities, part.truth, first[3].graph, first[2].owned)
            by_tag = tags.join(research.paired_delta(first[2].metrics, got.metrics), "s1_id").groupBy("tag").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("delta"), 6).alias("delta"))
            out["comparisons"][e.name] = {"f05": interval(first[2].metrics, got.metrics), "cohorts": _rows(by_tag), "movement": _rows(research.stage_movement(first[2].failures, got.failures)), "promotion": "DIAGNOSTIC_ONLY"}
    e, scorer, got, part = first
    for name in perturbations:
        changed = resolve(e, scorer, prepare(research.perturbed(test[0], name), test[1], profile, e.retrieval))
        moved = research.stability(got.resolved, changed.resolved)
        out["robustness"][name] = {**_rows(moved.agg(F.count(F.lit(1)).alias("queries"), F.count_if("changed").alias("changed")))[0], "quality": _rows(evaluate.quality_report(changed.metrics))}
    again = resolve(e, scorer, prepare(test[0].orderBy(F.desc("entity_id")), test[1], profile, e.retrieval))
    out["row_order_equal"] = not got.scores.exceptAll(again.scores).take(1) and not got.resolved.exceptAll(again.resolved).take(1)
    out["repeat_equal"] = fitted(e, parts[e.retrieval][0], trees).fingerprint() == scorer.fingerprint()
    out["risk"] = risk_comparison(decide.evidence(part.graph, got.owned, got.resolved), got.metrics)
    return out


def measured(spark, work: Callable[[], object]) -> dict[str, float]:
    """Seconds of a piece of work, and the driver's memory after it: heap in use and the process's peak."""
    start = time.perf_counter()
    work()
    seconds, jvm = time.perf_counter() - start, spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    return {"wall_seconds": seconds, "driver_heap_mib": jvm.getHeapMemoryUsage().getUsed() / (1 << 20), "driver_peak_mib": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def scale(entities: DataFrame, profile: terms.Profile, repetitions: int = 3, warm_up: int = 1) -> DataFrame:
    """Scale observations (queries, repetition, stage, seconds, rss_mib) of the stages up to decisions over
    whole entities; repetitions for warming up leave none."""
    spark, n, seen = entities.sparkSession, entities.filter("source = 'S1'").count(), []
    for nth in range(-warm_up, repetitions):
        made: dict[str, DataFrame] = {}
        rows = terms.normalized(entities)
        steps = {
            "terms": lambda rows=rows: staged(terms.term_weights(terms.eligible(terms.views(rows)), profile), "weights"),
            "retrieval": lambda made=made: staged(retrieve.union_lanes(retrieve.lane_hits(retrieve.products(made["terms"]), profile)), "graph"),
            "features": lambda made=made: staged(pair_features.cosines(made["retrieval"], made["terms"]), "cosines"),
            "decisions": lambda made=made: staged(decide.ownership(decide.stub_scores(made["features"])), "owned"),
        }
        for stage, step in steps.items():
            cost = measured(spark, lambda stage=stage, step=step, made=made: made.update({stage: step()}))
            if nth >= 0:
                seen.append((n, nth, stage, cost["wall_seconds"], cost["driver_peak_mib"]))
    return spark.createDataFrame(seen, "queries bigint, repetition bigint, stage string, seconds double, rss_mib double")
