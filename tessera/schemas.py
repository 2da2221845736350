"""Relations of the engine, their keys, and guards that fail a query on bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = ("S1", "S2", "S3")
LANES = ("name", "compact", "address", "combined", "reverse")
LANE_BIT = {"name": 1, "compact": 2, "address": 4, "combined": 8, "reverse": 16}
ABSENT_RANK = 999.0
THRESHOLD = 0.640
ENTITY_VERSION, NORMAL_VERSION, FEATURE_VERSION = "tessera.entity.v1", "tessera.normal.v1", "tessera.features.v1"


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(", "):
        name, kind = part.split(" ", 1)
        out.add(name, kind.rstrip("?"), kind.endswith("?"))
    return out


ENTITY = _struct("entity_id string, source string, business_name string?, business_address string?, country string?, schema_version string")
CANDIDATE = "s1_id string, target_id string, target_source string, country string, retrieval_view_mask smallint, " + ", ".join(f"{lane}_rank int, {lane}_similarity float" for lane in LANES)

#: Stage tables: name -> DDL. Written and read by sources.stages.
STAGES = {
    "normalized": "entity_id string, source string, business_name string, business_address string, name_normal string, address_normal string, country string, normal_version string",
    "candidates": CANDIDATE,
    "scores": "s1_id string, target_id string, target_source string, score double, model_sha256 string, model_version string",
    "ownership": "s1_id string, target_id string, score double, is_owner boolean, owner_rank int, rival_s1_id string, rival_score double, rival_margin double",
    "candidate_dispositions": "s1_id string, target_id string, score double, is_owner boolean, threshold double, threshold_margin double, accepted boolean, rejection_reason string",
    "resolutions": "s1_id string, accepted_targets array<string>, decision_type string",
    "failure_attribution": "s1_id string, target_id string, error_type string, failure_stage string, tags array<string>, diagnostics string",
    "negatives": "s1_id string, target_id string, label tinyint, reason string, retrieval_sha256 string, graph_sha256 string, split_sha256 string, config_sha256 string",
    "scale_observations": "queries bigint, repetition bigint, stage string, seconds double, rss_mib double",
    "atlas": "s1_id string, target_id string, error_type string, failure_stage string, source_json string, truth_targets array<string>, accepted_targets array<string>, candidate_count int, candidate_evidence_json string",
}
KEYS = {
    "normalized": ["source", "entity_id"],
    "candidates": ["s1_id", "target_id"], "scores": ["s1_id", "target_id"], "ownership": ["s1_id", "target_id"],
    "candidate_dispositions": ["s1_id", "target_id"], "resolutions": ["s1_id"], "features": ["s1_id", "target_id"],
    "failure_attribution": ["s1_id", "target_id", "error_type"], "negatives": ["s1_id", "target_id"],
    "scale_observations": ["queries", "repetition", "stage"], "atlas": ["s1_id", "target_id", "error_type"],
}


class ContractError(ValueError):
    """Rows that break a relation's contract."""


def refuse(bad: DataFrame, what: str) -> None:
    """Fail if `bad` has a row; reads one at most."""
    if found := bad.take(1):
        raise ContractError(f"{what}: {found[0].asDict()}")


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    refuse(df.groupBy(*keys).count().filter("count > 1"), f"duplicate {what}")
    return df


def check_entities(df: DataFrame) -> DataFrame:
    """Sources known, identifiers not blank, keys unique, target identifiers unique over both target sources."""
    refuse(df.filter(~F.col("source").isin(*SOURCES) | F.col("source").isNull()), "unknown source")
    refuse(df.filter(F.col("entity_id").isNull() | (F.trim("entity_id") == "")), "blank identifier")
    unique(df, ["source", "entity_id"], "entity")
    unique(df.filter("source <> 'S1'"), ["entity_id"], "target identifier")
    return df


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Both have the same keys: a full outer join finds none on one side alone."""
    a, b = left.select(*keys).withColumn("_l", F.lit(1)), right.select(*keys).withColumn("_r", F.lit(1))
    refuse(a.join(b, keys, "full_outer").filter("_l is null or _r is null"), f"stages disagree on {what}")
