"""Entities made of the driver's tables, truths, and the shared stages of the queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decide, evaluate, pair_features, retrieve, terms
from tessera.schemas import ENTITY_VERSION
from tessera.staging import release, staged


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entities: a third of them queries; characters 1 to 40 as name and 41 to 100 as
    address, fields of the length that entities have; language as country."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.when(F.col("doc_id") % 3 == 0, "S1").when(F.col("doc_id") % 3 == 1, "S2").otherwise("S3")
    return d.select(F.col("doc_id").cast("string").alias("entity_id"), source.alias("source"), F.substring("text", 1, 40).alias("business_name"), F.substring("text", 41, 60).alias("business_address"), F.col("lang").alias("country"), F.lit(ENTITY_VERSION).alias("schema_version"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as entities with extreme ties of names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    source = F.when(F.col("p_partkey") % 3 == 0, "S1").when(F.col("p_partkey") % 3 == 1, "S2").otherwise("S3")
    address = F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").cast("string").alias("entity_id"), source.alias("source"), F.col("p_name").alias("business_name"), address.alias("business_address"), F.col("p_brand").alias("country"), F.lit(ENTITY_VERSION).alias("schema_version"))


def traders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as queries, supplier as targets, by nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("entity_id"), F.lit("S1").alias("source"), F.col("c_name").alias("business_name"), F.col("c_nationkey").cast("string").alias("country"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.lit("S2").alias("source"), F.col("s_name").alias("business_name"), F.col("s_nationkey").cast("string").alias("country"))
    return c.unionByName(s).withColumns({"business_address": F.lit(None).cast("string"), "schema_version": F.lit(ENTITY_VERSION)})


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal texts of one language, a query and a target."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    q = d.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("s1_id"), "lang", "digest")
    t = d.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("target_id"), "lang", "digest")
    return q.join(t, ["lang", "digest"]).select("s1_id", "target_id")


class Run:
    """The stages over one input, each made and written once, when first asked for: the graph is kept before
    labels are read, and a later stage's plan starts from the tables of the earlier ones."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: terms.Profile = terms.STRICT):
        self.spark, self.sf_dir, self.profile = spark, sf_dir, profile
        self.entities = terms.normalized(entities(spark, sf_dir))
        self.rows = terms.eligible(terms.views(self.entities))
        self.queries = self.entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"))

    @cached_property
    def counts(self) -> DataFrame:
        return staged(terms.term_counts(self.rows), "counts")

    @cached_property
    def weights(self) -> DataFrame:
        return staged(terms.term_weights(self.rows, self.profile, self.counts), "weights")

    @cached_property
    def pairs(self) -> DataFrame:
        return retrieve.lane_pairs(self.rows, self.profile)

    @cached_property
    def hits(self) -> DataFrame:
        hits = staged(retrieve.lane_hits(self.pairs, self.profile), "hits")
        release(self.spark)
        return hits

    @cached_property
    def candidates(self) -> DataFrame:
        graph = staged(retrieve.union_lanes(self.hits), "candidates")
        release(self.spark)
        return graph

    @cached_property
    def cosines(self) -> DataFrame:
        cosines = staged(pair_features.known_cosines(self.candidates, self.pairs), "cosines")
        release(self.spark)
        return cosines

    @property
    def scores(self) -> DataFrame:
        return decide.stub_scores(self.cosines)

    @cached_property
    def features(self) -> DataFrame:
        return staged(pair_features.pair_features(self.candidates, self.entities, None, self.cosines), "features")

    @cached_property
    def owned(self) -> DataFrame:
        return staged(decide.ownership(self.scores), "owned")

    @property
    def disposed(self) -> DataFrame:
        return decide.dispositions(self.owned)

    @cached_property
    def resolved(self) -> DataFrame:
        return staged(decide.resolutions(self.disposed, self.queries), "resolved")

    @cached_property
    def truth(self) -> DataFrame:
        return staged(truth(self.spark, self.sf_dir), "truth")

    @cached_property
    def evidence(self) -> DataFrame:
        return staged(decide.evidence(self.candidates, self.owned, self.resolved), "evidence")

    @cached_property
    def metrics(self) -> DataFrame:
        return staged(evaluate.set_metrics(self.resolved, self.truth), "metrics")

    @cached_property
    def failed(self) -> DataFrame:
        return staged(evaluate.failures(self.candidates, self.owned, self.disposed, self.truth), "failures")

    @property
    def paired(self) -> DataFrame:
        return pair_features.paired(self.candidates, self.entities)


_RUNS: dict[tuple, Run] = {}


def run(spark: SparkSession, sf_dir: str, profile: terms.Profile = terms.STRICT) -> Run:
    key = (spark.sparkContext.applicationId, sf_dir, profile.name)
    if key not in _RUNS:
        _RUNS[key] = Run(spark, sf_dir, profile)
    return _RUNS[key]
