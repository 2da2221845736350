import itertools
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.script import script_of
from tessera.operators import blocks, boosting, decide, diagnose, evaluate, experiments, models, pair_features, research, retrieve, terms
from tessera.plans import queries
from tessera.plans.sql import sql
from tessera.schemas import ENTITY, ContractError, check_entities
from tessera.sources import tables
from tessera.staging import shared_folder


def made(spark, rows):
    return spark.createDataFrame([(*r, "v") for r in rows], ENTITY)


def views(df):
    return terms.views(terms.normalized(df))


def test_document_frequency_fixture(spark):
    """200 by 200 under the strict profile: 272 candidates, all truths."""
    rows = []
    for i in range(200):
        rows += [(f"q{i:03d}", "S1", f"brand{i:04x}", f"location{i:04x}", "US"), (f"t{i:03d}", "S2", f"brand{i:04x}", f"location{i:04x}", "US")]
    got = retrieve.retrieve(views(made(spark, rows)), terms.STRICT).select("s1_id", "target_id").collect()
    assert len(got) == 272
    assert {(f"q{i:03d}", f"t{i:03d}") for i in range(200)} <= {tuple(r) for r in got}


def test_reverse_lane_reaches_every_target(spark):
    rows = [("q", "S1", "same name", "same road", "US")] + [(f"t{i}", "S2", "same name", "same road", "US") for i in range(40)]
    got = retrieve.retrieve(views(made(spark, rows)), terms.LOOSE).collect()
    assert len(got) == 40 and all(r.reverse_rank == 1 for r in got)
    assert sum(r.name_rank is not None for r in got) == 5


def test_strict_profile_empties_small_countries(spark):
    rows = [("q", "S1", "maple works", None, None), ("t", "S2", "maple works", "", None), ("x", "S3", "maple", None, "")]
    df = made(spark, rows)
    assert retrieve.retrieve(views(df), terms.STRICT).count() == 0
    got = retrieve.retrieve(views(df), terms.LOOSE).collect()
    assert [(r.s1_id, r.target_id) for r in got] == [("q", "t")]  # a null country meets null alone
    assert {r.warning for r in retrieve.warnings(views(df), terms.STRICT).collect()} >= {"no query", "empty vocabulary: name"}


def test_row_order_changes_nothing(spark):
    rows = [(f"{s}{i}", s, f"name {i % 5} {i}", f"{i % 7} road", "c") for i in range(30) for s in ("S1", "S2", "S3")]
    a = retrieve.retrieve(views(made(spark, rows)), terms.LOOSE).orderBy("s1_id", "target_id").collect()
    b = retrieve.retrieve(views(made(spark, rows[::-1])), terms.LOOSE).orderBy("s1_id", "target_id").collect()
    assert a == b
    long = retrieve.union_lanes(retrieve.lane_rows(spark.createDataFrame(a)))
    assert long.orderBy("s1_id", "target_id").select(*a[0].asDict()).collect() == a


def test_blocks_lose_no_hit_and_hand_on_few_pairs(spark):
    """Copies, ties, blocks of a few classes: the hits of all pairs, from a fraction of them."""
    rows = [(f"{s}{i}", s, f"shop {i % 37} of{'' if i % 5 else chr(9)} {i % 11}", f"{i % 13} road {i % 29}", "c" if i % 3 else None) for i in range(180) for s in ("S1", "S2", "S3")]
    rows += [(f"{s}{i}", s, "same  name", "" if i % 2 else None, "c") for i in range(200, 230) for s in ("S1", "S2")]
    some = terms.eligible(views(made(spark, rows)))
    for profile in (terms.LOOSE, experiments.variant(terms.LOOSE, "k1"), experiments.variant(terms.LOOSE, "no_reverse")):
        every = retrieve.products(terms.term_weights(some, profile)).localCheckpoint()
        few = blocks.best_pairs(some, profile, queries=30, targets=50).localCheckpoint()
        assert few.count() == few.select("s1_id", "target_id").distinct().count() < every.count() / 2
        a, b = ({(r.s1_id, r.target_id, r.lane, r.rank): r.similarity for r in retrieve.lane_hits(pairs, profile).collect()} for pairs in (every, few))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)
    assert retrieve.lane_pairs(some, terms.LOOSE).count() < retrieve.products(terms.term_weights(some, terms.LOOSE)).count() / 2


def test_blocks_find_the_terms_of_the_analyzers(spark):
    texts = ["", "a", "ab  cd\t\te", " lead and trail ", "\u00a0x\u2003yz", "\U0001f600\U0001f601 \U0001f602b", "no. 12-b", "ab\n\ncd\x0b e"]
    for view in terms.VIEWS:
        col = F.replace(F.col("t"), F.lit(" "), F.lit("")) if view == "compact" else F.col("t")
        want = {r.i: sorted(r.found) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", terms.analyzed(view, col).alias("found")).collect()}
        known = sorted({x for found in want.values() for x in found})
        text, term = blocks.occurrences(view, texts, known)
        assert {i: sorted(known[x] for x in term[text == i]) for i in range(len(texts))} == want


def test_vocabulary_is_fitted_on_all_rows(spark):
    """More than three million rows of a country: none is left out of a count."""
    n, term = 3_000_100, F.lit("ab")
    rows = spark.range(n).select(F.lit("c").alias("country"), F.lit("S1").alias("source"), F.col("id").cast("string").alias("entity_id"), term.alias("name"), term.alias("compact"), term.alias("address"))
    got = {(r.view, r.term): (r.df, r.n) for r in terms.vocabulary(rows, terms.LOOSE, keyed=True).collect()}
    assert got == dict.fromkeys([("name", " ab"), ("name", "ab "), ("address", "ab")], (n, n))


def test_scores_halfway_are_rounded_as_in_sql(spark):
    """The mean of these four is 0.4452845 but for its last bits; DuckDB gives 0.445285."""
    names = ["exact_name_cosine", "exact_compact_name_cosine", "exact_address_cosine", "exact_combined_cosine"]
    row = spark.createDataFrame([("q", "t", 0.643360772, 0.51584714, 0.200166468, 0.42176362)], ["s1_id", "target_id", *names])
    assert decide.stub_scores(row).first().score == 0.445285


def test_ownership_in_every_order(spark):
    rows = [("a", "t", 0.9), ("z", "t", 0.9), ("m", "t", 0.5), ("solo", "u", 0.7)]
    for order in list(itertools.permutations(rows))[::6]:
        got = {(r.s1_id, r.target_id): r for r in decide.ownership(spark.createDataFrame(order, "s1_id string, target_id string, score double")).collect()}
        assert got["a", "t"].is_owner and got["a", "t"].rival_s1_id == "z" and got["a", "t"].rival_margin == 0
        assert got["m", "t"].rival_s1_id == "a" and got["m", "t"].rival_margin == pytest.approx(-0.4)
        assert got["solo", "u"].rival_score is None


def test_threshold_and_types(spark):
    scores = [("a", "1", 0.639999999999), ("b", "2", 0.640), ("b", "3", 1.0), ("c", "2", 0.65)]
    owned = decide.ownership(spark.createDataFrame(scores, "s1_id string, target_id string, score double"))
    disposed = decide.dispositions(owned)
    why = {(r.s1_id, r.target_id): r.rejection_reason for r in disposed.collect()}
    assert why == {("a", "1"): "BELOW_THRESHOLD", ("b", "2"): "LOST_OWNERSHIP", ("b", "3"): "NONE", ("c", "2"): "NONE"}
    got = {r.s1_id: (r.accepted_targets, r.decision_type) for r in decide.resolutions(disposed, spark.createDataFrame([("a",), ("b",), ("none",)], "s1_id string")).collect()}
    assert got == {"a": ([], "ZERO_MATCH"), "b": (["3"], "SINGLE_MATCH"), "none": ([], "ZERO_MATCH")}


def test_set_metrics_and_calibration(spark):
    resolved = spark.createDataFrame([("a", ["1"], "x"), ("b", [], "x"), ("c", ["2", "3"], "x"), ("d", ["9"], "x"), ("e", [], "x")], "s1_id string, accepted_targets array<string>, decision_type string")
    truth = spark.createDataFrame([("a", "1"), ("c", "2"), ("e", "7")], "s1_id string, target_id string")
    got = {r.s1_id: (r.precision, r.recall, r.f05, r.exact_set) for r in evaluate.set_metrics(resolved, truth).collect()}
    assert got["a"] == (1, 1, 1, True) and got["b"] == (1, 1, 1, True) and got["d"] == (0, 1, 0, False)
    assert got["c"][:2] == (0.5, 1) and got["c"][2] == pytest.approx(0.625 / 1.125) and got["e"][1] == 0
    rows = spark.createDataFrame([(0, 0.0), (1, 1.0), (0, 0.25), (1, 0.75)], "label int, score double")
    m = evaluate.ranking_metrics(rows).first()
    assert (m.auroc, m.average_precision, m.brier) == (1, 1, 0.03125)
    assert evaluate.ece(evaluate.calibration(rows, 2)).first().ece == 0.125
    assert evaluate.ranking_metrics(rows.filter("label = 1")).first().auroc is None


def test_context_ties(spark):
    rows = [("a", "t", "S2", .5, .5, .5), ("b", "t", "S2", .5, .2, .1), ("a", "u", "S3", .3, .3, .3)]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, target_source string, exact_name_cosine double, exact_address_cosine double, exact_combined_cosine double")
    got = {(r.s1_id, r.target_id): r for r in pair_features.context(df).collect()}
    assert got["a", "t"].name_target_rival_margin == 0 and got["a", "t"].address_target_rival_margin == pytest.approx(0.3)
    assert got["b", "t"].name_target_owner_rank == 1 and got["b", "t"].combined_target_rival_margin == pytest.approx(-0.4)
    assert got["a", "u"].name_target_rival_margin == 0 and got["a", "t"].distinct_competing_s1_count_for_target == 2


def test_missing_text_features(spark):
    df = terms.normalized(made(spark, [("q", "S1", None, "1 road", "c"), ("t", "S2", "", None, "c")]))
    graph = spark.createDataFrame([("q", "t", "S2", "c", 4, None, None, None, None, 2, .5, None, None, None, None)], "s1_id string, target_id string, target_source string, country string, retrieval_view_mask int, name_rank int, name_similarity double, compact_rank int, compact_similarity double, address_rank int, address_similarity double, combined_rank int, combined_similarity double, reverse_rank int, reverse_similarity double")
    row = pair_features.pair_features(graph, df, terms.term_weights(terms.views(df), terms.LOOSE)).first().asDict()
    assert len(pair_features.FEATURES) == 59 and len(row) == 62
    assert [row[f"{s}_missing"] for s in ("query_name", "target_name", "query_address", "target_address")] == [1, 1, 0, 1]
    assert [row[x] for x in pair_features.FEATURES[33:38]] == [999, 999, 1, 999, 999]
    assert row["f56"] == 0 and row["exact_combined_cosine"] == 0


def test_failures_and_mining(spark):
    graph = "s1_id string, target_id string, retrieval_view_mask int, name_similarity double, compact_similarity double, address_similarity double, combined_similarity double, reverse_similarity double"
    cand = spark.createDataFrame([("q", "true", 3, .2, None, None, None, None), ("q", "near", 1, .9, None, None, None, None), ("q", "far", 1, .1, None, None, None, None)], graph)
    truth = spark.createDataFrame([("q", "true"), ("q", "gone")], "s1_id string, target_id string")
    got = {r.target_id: r.label for r in evaluate.mine_pairs(cand, truth, per_query=1).collect()}
    assert got == {"true": 1, "near": 0}
    owned = decide.ownership(spark.createDataFrame([("q", "true", .3), ("q", "near", .9), ("q", "far", .1)], "s1_id string, target_id string, score double"))
    rows = {r.target_id: r for r in evaluate.failures(cand, owned, decide.dispositions(owned), truth).collect()}
    assert {t: r.failure_stage for t, r in rows.items()} == {"true": "SCORING", "gone": "RETRIEVAL", "near": "SCORING"}
    assert rows["near"].tags == ["MULTI_MATCH", "SINGLE_LANE"]
    assert evaluate.failure_counts(evaluate.failures(cand, owned, decide.dispositions(owned), truth)).count() == 10


def test_guards(spark):
    with pytest.raises(ContractError):
        check_entities(made(spark, [("a", "S2", None, None, None), ("a", "S3", None, None, None)]))
    with pytest.raises(ContractError):
        check_entities(made(spark, [(" ", "S1", None, None, None)]))
    bad = spark.createDataFrame([("q", "t", "S2", "c")], "s1_id string, target_id string, target_source string, country string")
    with pytest.raises(ContractError):
        diagnose.check_eligible(bad, bad.select("s1_id", "target_id"), made(spark, [("q", "S1", None, None, "c"), ("t", "S2", None, None, "d")]))


def test_sources(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("id\tname\taddress\n1\tNULL\t\n2\t a \tb\n")
    got = {r.entity_id: (r.business_name, r.business_address, r.country) for r in tables.inputs(spark, tsv={"S1": str(tmp_path / "s.tsv")}).collect()}
    assert got == {"1": ("NULL", "", None), "2": (" a ", "b", None)}
    df = made(spark, [("1", "S1", "NULL", None, ""), ("2", "S2", "", "x", None)])
    tables.write_entities(df, str(tmp_path / "e"))
    assert sorted(tables.read_entities(spark, str(tmp_path / "e")).collect()) == sorted(df.collect())
    owned = decide.ownership(spark.createDataFrame([("q", "t", .3)], "s1_id string, target_id string, score double"))
    tables.write_stage(owned, str(tmp_path / "o"), "ownership")
    assert tables.read_stage(spark, str(tmp_path / "o"), "ownership").count() == 1
    with pytest.raises(ContractError):
        tables.read_stage(spark, str(tmp_path / "o"), "scores")


def test_perturbations_and_risk(spark):
    df = made(spark, [("q", "S1", "Ab c", None, "c"), ("t", "S2", "Ab c", None, "c")])
    name = lambda p: {r.entity_id: r.business_name for r in research.perturbed(df, p).collect()}
    assert name("case")["q"] == "aB C" and name("case")["t"] == "Ab c"
    assert name("spacing")["q"] == "  Ab   c  " and name("punctuation")["q"] == "Ab / c" and name("token_order")["q"] == "c Ab"
    assert research.INJECTED in name("competition")
    rows = spark.createDataFrame([("a", .1, 0.0), ("b", .2, 0.0), ("c", .3, 1.0), ("d", .9, 1.0)], "s1_id string, risk double, error double")
    assert [r.running_error for r in research.risk_coverage(rows).orderBy("nth").collect()] == [0, 0, 0.333333, 0.5]


def test_cohorts_have_their_scripts(spark, tmp_path):
    """cohort_tags names a script cohort for each query, as its SQL does, which finds scripts as script_of() does."""
    duckdb = pytest.importorskip("duckdb")
    names = ["ab αβγ", "αβ ab", "12", "", None, "日本 shop", "कमल", "ªﬁĳ", "Ж\U0001f600жA"]
    values = ", ".join(f"('{i}', 'S1', {'null' if x is None else repr(x)})" for i, x in enumerate(names))
    got = duckdb.sql(sql("select entity_id, script from scripts", entities=f"select * from (values {values}) as v(entity_id, source, business_name)")).fetchall()
    assert dict(got) == {str(i): script_of(x or "") for i, x in enumerate(names)}
    docs = [(i, f"{'alpha beta gamma' if i % 2 else 'αλφα βητα'} text number {i // 6} of a few words, and more words after it {i // 6}", "en", "a", 9) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    tags = sorted(tuple(r) for r in queries.QUERIES["cohort_tags"](spark, str(tmp_path)).collect())
    assert sum(t == "same_script_or_no_truth" for _, t in tags) == 20
    documents = f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')"
    with duckdb.connect() as con:
        con.execute(documents)
        assert sorted(con.sql(queries.ORACLES["cohort_tags"]).fetchall()) == tags


def test_command_line(spark, tmp_path, capsys):
    from tessera import cli

    for i, rows in enumerate(("1\tMaple Works\t1 Pine Road", "2\tMaple Works\t1 Pine Road", "3\tOther\t9 Quay"), 1):
        (tmp_path / f"{i}.tsv").write_text("id\tname\taddress\n" + rows + "\n")
    files = [x for i in (1, 2, 3) for x in (f"--s{i}", str(tmp_path / f"{i}.tsv"))]
    (tmp_path / "truth.json").write_text('[["1", "2"]]')
    assert cli.main(["evaluate", "quality", *files, "--truth", str(tmp_path / "truth.json"), "--profile", "loose"]) == 0
    assert '"cohort":"single","exact_set_accuracy":1.0' in capsys.readouterr().out
    (tmp_path / "truth.json").write_text('[["1", "nobody"]]')
    assert cli.main(["retrieve", "run", *files, "--truth", str(tmp_path / "truth.json")]) == 2


def test_normalized_table(spark, tmp_path):
    rows = terms.normalized(made(spark, [("1", "S1", "Ab  C", None, ""), ("2", "S2", "", "X", None)]))
    tables.write_normalized(rows, str(tmp_path / "n"))
    got = tables.read_normalized(spark, str(tmp_path / "n"))
    assert {(r.entity_id, r.name_normal, r.address_normal) for r in got.collect()} == {(r.entity_id, r.name_normal, r.address_normal) for r in rows.collect()}
    tables.write_stage(got.replace("tessera.normal.v1", "tessera.normal.v0", "normal_version"), str(tmp_path / "old"), "normalized")
    with pytest.raises(ContractError):
        tables.read_normalized(spark, str(tmp_path / "old"))


def test_training_is_kept_apart(spark, tmp_path, capsys):
    """A model is fitted on the training part alone, saved, and refused where another part is asked for."""
    import json

    from tessera import cli
    from tessera.operators import models

    places = [("train", range(0, 12)), ("calibration", range(12, 14)), ("test", range(14, 18))]
    for s in (1, 2):
        lines = [f"{s}_{i}\tword{i} works {i % 3}\t{i} pine road" for i in range(18)]
        (tmp_path / f"{s}.tsv").write_text("id\tname\taddress\n" + "\n".join(lines) + "\n")
    groups = [{"name": role, "role": role, "members": [[f"S{s}", f"{s}_{i}"] for s in (1, 2) for i in some]} for role, some in places]
    (tmp_path / "plan.json").write_text(json.dumps({"groups": groups}))
    for role, some in places:
        (tmp_path / f"{role}.json").write_text(json.dumps([[f"1_{i}", f"2_{i}"] for i in some]))
    files = [x for s in (1, 2) for x in (f"--s{s}", str(tmp_path / f"{s}.tsv"))] + ["--profile", "loose", "--model", "logistic"]
    plan, truth = ["--split", str(tmp_path / "plan.json")], lambda role: ["--truth", str(tmp_path / f"{role}.json")]
    saved = ["--saved", str(tmp_path / "model")]
    assert cli.main(["train", "fit", *files, *truth("train"), "--out", str(tmp_path / "none")]) == 2  # no plan
    assert cli.main(["train", "fit", *files, *plan, *truth("test"), "--out", str(tmp_path / "none")]) == 2  # held-out truth
    assert cli.main(["train", "fit", *files, *plan, *truth("train"), "--role", "test", "--out", str(tmp_path / "none")]) == 2
    assert not (tmp_path / "none").exists()
    assert cli.main(["train", "fit", *files, *plan, *truth("train"), "--out", str(tmp_path / "model")]) == 0
    capsys.readouterr()
    assert cli.main(["evaluate", "quality", *files, *plan, *truth("test"), *saved]) == 0
    assert '"query_count":4' in capsys.readouterr().out
    assert cli.main(["evaluate", "quality", *files, *plan, *truth("test")]) == 2  # would have to be refitted
    (tmp_path / "other.json").write_text(json.dumps({"groups": groups, "note": "another plan"}))
    assert cli.main(["evaluate", "quality", *files, "--split", str(tmp_path / "other.json"), *truth("test"), *saved]) == 2
    with pytest.raises(ValueError, match="settings"):
        models.LogisticScorer(c=2.0).load(str(tmp_path / "model"), spark)
    with pytest.raises(ValueError, match="fitted or loaded"):
        models.LogisticScorer().fingerprint()


def test_experiment_definitions():
    from tessera.operators import experiments as x

    assert len(x.SUITE) == 12 and len({e.name for e in x.SUITE}) == 12
    assert {e.without for e in x.SUITE} - {None} == {"name", "address", "numeric", "retrieval", "competition", "cross_script"}
    for wrong in ({"scorer": "other"}, {"without": "other"}, {"retrieval": "other"}, {"seed": 7}, {"scorer": "logistic", "seed": -1}):
        with pytest.raises(ValueError, match="seed|experiment"):
            x.Experiment("wrong", **wrong)
    assert set(x.variant(terms.STRICT, "k1").budgets.values()) == {1} and "reverse" not in x.variant(terms.STRICT, "no_reverse").lanes
    assert x.variant(terms.STRICT, "k1").name != terms.STRICT.name and x.variant(terms.STRICT, "reference") is terms.STRICT


def test_latin_names_rescue(spark):
    from tessera.operators import experiments as x

    rows = made(spark, [("q", "S1", "Волга", None, "c"), ("t", "S2", "Volga", None, "c"), ("p", "S1", "Maple", None, "c"), ("u", "S3", "Maple", None, "c")])
    entities = terms.normalized(rows)
    graph = retrieve.retrieve(terms.views(entities), terms.LOOSE)
    got = {(r.s1_id, r.target_id): r.origin for r in x.with_latin_names(graph, entities, terms.LOOSE).collect()}
    assert ("q", "t") not in {(r.s1_id, r.target_id) for r in graph.collect()}
    assert got[("q", "t")] == "transliterated_name" and got[("p", "u")] == "original"


def test_experiment_suite(spark):
    """Two experiments over a training and a test part: comparisons, perturbed reruns, repeat and order."""
    from tessera.operators import experiments as x

    def part(some):
        rows = [(f"{s}_{i}", f"S{s}", f"word{i} works {i % 3}", f"{i} pine road", "c") for s in (1, 2) for i in some]
        return made(spark, rows), spark.createDataFrame([(f"1_{i}", f"2_{i}") for i in some], "s1_id string, target_id string")

    got = x.suite(part(range(10)), part(range(10, 16)), terms.LOOSE, experiments=(x.Experiment("reference", scorer="logistic"), x.Experiment("no_reverse", scorer="logistic", retrieval="no_reverse")), perturbations=("case",))
    assert got["row_order_equal"] and got["repeat_equal"]
    assert set(got["robustness"]) == {"case"} and got["robustness"]["case"]["queries"] == 6
    assert got["robustness"]["case"]["changed"] == 0  # folding undoes it
    assert set(got["comparisons"]) == {"no_reverse"} and got["comparisons"]["no_reverse"]["promotion"] == "DIAGNOSTIC_ONLY"


def test_scale_observations(spark):
    from tessera.operators import experiments as x

    rows = made(spark, [("q", "S1", "Maple Works", None, "c"), ("t", "S2", "Maple Works", None, "c")])
    seen = x.scale(rows, terms.LOOSE, repetitions=1, warm_up=0)
    assert {(r.queries, r.stage) for r in research.scale_summary(seen).collect()} == {(1, s) for s in ("terms", "retrieval", "features", "decisions")}


def test_retrieval_deletes_its_tables_on_the_way(spark):
    """Of the stages of best_pairs the pairs alone stay on disk."""
    rows = [(f"{s}{i}", s, f"shop {i % 37} of {i % 11}", f"{i % 13} road", "c") for i in range(60) for s in ("S1", "S2")]
    old = set(Path(shared_folder(spark).removeprefix("file://"), "tessera").glob("*"))
    folder = lambda: {p.name.rsplit("-", 1)[0] for p in Path(shared_folder(spark).removeprefix("file://"), "tessera").glob("*") if p not in old}
    pairs = retrieve.lane_pairs(terms.eligible(views(made(spark, rows))), terms.LOOSE)
    assert pairs.count() and folder() == {"sizes", "pairs"}


def test_boosted_trees_are_those_of_spark_in_few_jobs(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    draw, n, names = np.random.default_rng(5), 3000, ["share", "count", "flag", "spread", "fixed"]
    share, count, flag = draw.random(n), draw.integers(0, 20, n), draw.integers(0, 2, n)
    label = (share + 0.05 * count + 0.3 * flag + draw.normal(0, 0.3, n) > 1.1).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"s1_id": np.arange(n), "label": label, "share": share, "count": count, "flag": flag, "spread": draw.normal(0, 1e4, n), "fixed": 0.0})).cache()
    gathered = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=6, stepSize=0.05, maxDepth=6, minInstancesPerNode=100, seed=42).fit(gathered)
    wanted = model.transform(gathered).select("s1_id", vector_to_array("probability")[1].alias("wanted"))
    spark.sparkContext.setJobGroup("boosted", "")
    forest = boosting.fit(rows, names, 6, 0.05, 6, 100)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) < 12
    both = boosting.predict(rows, ["s1_id"], names, forest, 0.05, 6).join(wanted, "s1_id").toPandas()
    assert len(both) == n and both["wanted"].nunique() > 50
    assert np.allclose(both["score"], both["wanted"], atol=1e-6)
    assert boosting.fit(rows.orderBy(F.desc("spread")), names, 6, 0.05, 6, 100) == forest
    with pytest.raises(Exception, match="null or NaN"):
        boosting.fit(rows.withColumn("share", F.expr("if(s1_id = 7, null, share)")), names, 6, 0.05, 6, 100)


def test_boosted_scorer_is_saved_and_is_not_grown_by_jobs(spark, tmp_path):
    draw, n = np.random.default_rng(6), 600
    found = pd.DataFrame(draw.random((n, len(pair_features.FEATURES))), columns=pair_features.FEATURES)
    found.insert(0, "s1_id", np.arange(n).astype(str))
    rows = spark.createDataFrame(found.assign(target_id="t", target_source="S2")).cache()
    labels = rows.select("s1_id", "target_id", (F.col(pair_features.FEATURES[0]) > 0.5).cast("tinyint").alias("label"))
    spark.sparkContext.setJobGroup("boosted scorer", "")
    scorer = models.BoostedScorer(trees=5).fit(rows, labels)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted scorer")) < 15
    scorer.save(str(tmp_path / "m"), {"split": "a"})
    loaded = models.BoostedScorer(trees=5).load(str(tmp_path / "m"), spark, {"split": "a"})
    assert loaded.fingerprint() == scorer.fingerprint()
    scores = models.check_scores(loaded.predict(rows), rows.select("s1_id", "target_id")).toPandas()
    assert scores.columns.tolist() == ["s1_id", "target_id", "target_source", "score", "model_sha256"]
    assert scores["score"].between(0, 1).all() and sorted(scores["score"]) == sorted(scorer.predict(rows).toPandas()["score"])
