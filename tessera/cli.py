"""Command line: inspect, retrieve, train, resolve, evaluate, benchmark. Exits 0 with canonical JSON, or 2."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import provenance, schemas
from tessera.operators import decide, diagnose, evaluate, experiments, models, pair_features, research, retrieve, terms
from tessera.sources import tables
from tessera.staging import staged

PROFILES = {"strict": terms.STRICT, "loose": terms.LOOSE}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _digest(entities: DataFrame) -> str:
    return provenance.fingerprint(entities.select("entity_id", "source", "business_name", "business_address", "country"), schemas.ENTITY_VERSION).first()[0]


def _population(spark: SparkSession, a: argparse.Namespace, entities: DataFrame) -> tuple[DataFrame, dict | None]:
    """The entities of the part a verb works on, and what a model for it must have been fitted on. Training
    takes the training part and no other; other verbs take the test part unless told otherwise."""
    if not a.split:
        if a.verb == "train" or a.model != "none":
            raise ValueError("training, and scoring with a trained model, need a split plan")
        return entities, None
    role = a.role or ("train" if a.verb == "train" else "test")
    if a.verb == "train" and role != "train":
        raise ValueError("only the training part may be learnt from")
    members = tables.read_split(spark, a.split)
    origin = {"plan": provenance.file_sha256(a.split), "population": _digest(tables.select_split(entities, members, "train")), "profile": a.profile}
    return tables.select_split(entities, members, role), origin


def _graph(a: argparse.Namespace, entities: DataFrame):
    entities = terms.normalized(entities)
    rows = terms.views(entities)
    weights = terms.term_weights(terms.eligible(rows), PROFILES[a.profile]).persist()
    graph = retrieve.union_lanes(retrieve.lane_hits(retrieve.products(weights), PROFILES[a.profile])).persist()
    retrieve.check_bounds(graph, rows, PROFILES[a.profile])
    return entities, rows, weights, graph


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    what = f"{a.verb} {a.action}"
    if what == "inspect schema":
        return {"entity": schemas.ENTITY.jsonValue(), "stages": schemas.STAGES, "features": pair_features.FEATURES}
    entities = tables.inputs(spark, a.parquet, {s: p for s, p in (("S1", a.s1), ("S2", a.s2), ("S3", a.s3)) if p} or None)
    if what == "inspect profile":
        return {"profile": _rows(diagnose.profile(entities)), "families": _rows(diagnose.families(entities))}
    if what in ("inspect fingerprint", "train fingerprint"):
        return {"fingerprint": _digest(entities)}
    if what == "benchmark public":
        if not (a.split and a.truth):
            raise ValueError("the experiments need a split plan and truth")
        members, pairs = tables.read_split(spark, a.split), tables.read_pairs(spark, a.truth)
        parts = []
        for role in ("train", "test"):
            some = tables.select_split(entities, members, role)
            parts.append((some, pairs.join(some.filter("source = 'S1'").selectExpr("entity_id as s1_id"), "s1_id", "left_semi")))
        return experiments.suite(*parts, PROFILES[a.profile], a.trees)
    if what == "benchmark scale":
        seen = experiments.scale(entities, PROFILES[a.profile], a.repetitions)
        if a.out:
            tables.write_stage(seen, a.out, "scale_observations")
        return {"stages": _rows(research.scale_summary(seen))}
    entities, origin = _population(spark, a, entities)
    entities, rows, weights, graph = _graph(a, entities)
    if a.verb == "retrieve" and a.out:
        with provenance.run_folder(a.out, "retrieve", time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), {}) as out:
            tables.write_normalized(entities, str(out / "normalized"))
            tables.write_stage(graph, str(out / "candidates"), "candidates")  # frozen before labels are read
    truth = tables.read_pairs(spark, a.truth) if a.truth else spark.createDataFrame([], "s1_id string, target_id string")
    diagnose.check_eligible(graph, truth, entities)  # truth of another part names entities that are not here
    if what == "retrieve run":
        return {"summary": _rows(diagnose.summary(graph, truth, retrieve.bounds(rows, PROFILES[a.profile]))), "warnings": _rows(retrieve.warnings(rows, PROFILES[a.profile]))}
    if what == "retrieve lane-rescue" or what == "retrieve ablate":
        return {"lanes": _rows(diagnose.lane_rescue(graph, truth))}
    if what == "retrieve frontier":
        points = []
        for k in map(int, a.budgets.split(",")):
            profile, found = experiments.budget_variant(PROFILES[a.profile], k), []
            cost = experiments.measured(spark, lambda profile=profile, found=found: found.append(staged(retrieve.union_lanes(retrieve.lane_hits(retrieve.products(weights), profile)), "point")))
            point = diagnose.summary(found[0], truth, retrieve.bounds(rows, profile)).first()
            points.append({"name": profile.name, "candidate_pairs": float(point.candidate_pairs), "recall": point.recall, **cost})
        costs = [c for c in points[0] if c not in ("name", "recall")]
        best = spark.createDataFrame(points, "name string, recall double, " + ", ".join(f"{c} double" for c in costs))
        for c in costs:
            best = diagnose.pareto(best, c).withColumnRenamed("pareto", f"pareto_{c}")
        return {"points": _rows(best)}
    if what == "train negatives":
        return {"pairs": _rows(evaluate.mine_pairs(graph, truth).groupBy("label").count())}
    queries = entities.filter("source = 'S1'").selectExpr("entity_id as s1_id")
    if a.verb == "train" or a.model != "none":
        features = pair_features.pair_features(graph, entities, weights).persist()
        scorer = models.BoostedScorer(**({"trees": a.trees} if a.trees else {})) if a.model == "boosted" else models.LogisticScorer()
        if a.verb == "train":
            scorer.fit(features, evaluate.mine_pairs(graph, truth))
        elif a.saved:
            scorer.load(a.saved, spark, origin)
        else:
            raise ValueError("name the folder of the trained model with --saved")
        scores = models.check_scores(scorer.predict(features), graph).persist()
    else:
        scores = decide.stub_scores(pair_features.cosines(graph, weights)).persist()
    if what == "train fit":
        if not a.out:
            raise ValueError("name a folder for the model with --out")
        scorer.save(a.out, origin)
        return {"model": scorer.fingerprint()}
    labelled = evaluate.labelled(scores, truth)
    if what in ("train calibrate", "evaluate calibration"):
        return {"bins": _rows(evaluate.calibration(labelled)), "metrics": _rows(evaluate.ranking_metrics(labelled))}
    owned = decide.ownership(scores).persist()
    disposed = decide.dispositions(owned)
    resolved = decide.resolutions(disposed, queries)
    decide.check_aligned(graph, scores, owned, disposed)
    decide.check_exclusive(resolved)
    capsules = decide.evidence(graph, owned, resolved)
    answers = {
        "resolve run": lambda: {"decisions": _rows(resolved.groupBy("decision_type").count())},
        "resolve explain": lambda: {"pairs": _rows(decide.explain(graph, owned, disposed).filter(F.col("s1_id") == a.query))},
        "resolve export-evidence": lambda: {"written": capsules.write.parquet(a.out) or a.out},
        "evaluate quality": lambda: {"report": _rows(evaluate.quality_report(evaluate.set_metrics(resolved, truth)))},
        "evaluate failures": lambda: {"counts": _rows(evaluate.failure_counts(evaluate.failures(graph, owned, disposed, truth)))},
        "evaluate policy": lambda: {"policy": _rows(decide.policy_check(owned, disposed, truth))},
    }
    return answers[what]()


ACTIONS = {"inspect": "profile schema fingerprint", "retrieve": "run frontier lane-rescue ablate", "train": "fit negatives calibrate fingerprint", "resolve": "run explain export-evidence", "evaluate": "quality calibration failures policy", "benchmark": "public scale"}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("verb", choices=ACTIONS)
    parser.add_argument("action")
    for name in ("parquet", "s1", "s2", "s3", "truth", "out", "query", "split", "saved"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--profile", choices=PROFILES, default="strict")
    parser.add_argument("--model", choices=("none", "logistic", "boosted"), default="none")
    parser.add_argument("--role", choices=("train", "calibration", "test"))
    parser.add_argument("--trees", type=int)
    parser.add_argument("--repetitions", type=int, default=3)
    parser.add_argument("--budgets", default="1,5,10")
    a = parser.parse_args(argv)
    if a.action not in ACTIONS[a.verb].split():
        parser.error(f"{a.verb} has {ACTIONS[a.verb]}")
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(provenance.settled_text(run(spark, a)).decode())
    except (ValueError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
