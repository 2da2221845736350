"""The 59 pair features, in a fixed order, on a bounded candidate graph.

Everything but the kernels of functions/fuzzy.py and scripts stays in the JVM. What is of one entity (words,
numbers, script, Latin spelling) is made once an entity, before the pairs are. Cosines are products of shared
coordinates of retrieved pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import fuzzy
from tessera.functions import text as X
from tessera.functions.script import latin_table, script_column, transliterated
from tessera.operators.retrieve import lane_rows  # noqa: F401  (the inverse pivot belongs to the feature surface)
from tessera.operators.retrieve import combined
from tessera.schemas import ABSENT_RANK, LANES

# The names and order of the feature contract.
FEATURES = """
name_nonempty_exact_match name_normalized_string_ratio name_jaro_winkler name_token_sort_ratio name_token_set_ratio name_partial_ratio
name_char_trigram_jaccard name_token_jaccard name_query_token_coverage name_target_token_coverage
address_nonempty_exact_match address_normalized_string_ratio address_token_sort_ratio address_token_set_ratio
address_char_trigram_jaccard address_token_jaccard address_query_token_coverage address_target_token_coverage
numeric_token_jaccard numeric_query_coverage numeric_target_coverage nonempty_first_number_equality
query_numeric_token_count target_numeric_token_count query_name_missing target_name_missing query_address_missing target_address_missing
target_source_is_S2 exact_name_cosine exact_compact_name_cosine exact_address_cosine exact_combined_cosine
name_rank compact_name_rank address_rank combined_rank reverse_rank
name_query_source_rank name_query_source_delta_best name_target_owner_rank name_target_delta_best name_target_rival_margin
address_query_source_rank address_query_source_delta_best address_target_owner_rank address_target_delta_best address_target_rival_margin
combined_query_source_rank combined_query_source_delta_best combined_target_owner_rank combined_target_delta_best combined_target_rival_margin
candidate_count_within_s1_source distinct_competing_s1_count_for_target f55 f56 f57 f58
""".split()
GROUPS = {
    "name": FEATURES[0:10], "address": FEATURES[10:18], "numeric": FEATURES[18:24], "retrieval": FEATURES[29:38],
    "competition": FEATURES[38:55], "cross_script": FEATURES[55:59],
}


#: What spelled() adds to entities.
SPELLED = ("script", "name_latin", "address_latin_words")


def spelled(entities: DataFrame) -> DataFrame:
    """Entities with what cross_script() needs: the name's script, its lower-case Latin spelling, and the words of
    the address's; transliteration by a table of the data's own characters."""
    table = latin_table(entities, ["business_name", "business_address"])
    latin = lambda c: F.lower(transliterated(F.coalesce(F.col(c), F.lit("")), table))
    return entities.withColumns({"script": script_column("business_name"), "name_latin": latin("business_name"), "address_latin_words": X.token_set(latin("business_address"), X.ASCII_WORD)})


def paired(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with both entities' raw and normalized texts, words and numbers (q_..., t_...), and with what
    spelled() has added to the entities."""
    words = {"name_words": X.token_set(F.coalesce("name_normal", F.lit(""))), "address_words": X.token_set(F.coalesce("address_normal", F.lit(""))), "numbers": X.token_set(F.coalesce("address_normal", F.lit("")), X.NUMBER)}
    kept = ["business_name", "business_address", "name_normal", "address_normal", *words, *[c for c in SPELLED if c in entities.columns]]
    side = lambda p: [F.col("country").alias(f"{p}_country"), *[F.col(c).alias(f"{p}_{c}") for c in kept]]
    entities = entities.withColumns(words)
    q = entities.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), *side("q"))
    t = entities.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), *side("t"))
    rows = candidates.join(q, "s1_id").join(t, ["target_id", "target_source"])
    return rows.filter(F.col("q_country").eqNullSafe(F.col("t_country")))


def _texts() -> tuple[Column, Column, Column, Column]:
    return tuple(F.coalesce(c, F.lit("")) for c in ("q_name_normal", "t_name_normal", "q_address_normal", "t_address_normal"))


def direct(rows: DataFrame) -> DataFrame:
    """The exact, trigram, token, number and presence features; all but the trigrams are native."""
    qn, tn, qa, ta = _texts()
    number = lambda c: c.cast("double")
    same = lambda a, b: number((a != "") & (a == b))
    kinds = ("name_words", "address_words", "numbers")
    hits = {f"_hit_{k}": F.size(F.array_intersect(f"q_{k}", f"t_{k}")) for k in kinds}
    rows = rows.withColumns(hits)

    def overlap(k: str) -> tuple[Column, Column, Column]:
        hit, q, t = F.col(f"_hit_{k}"), F.size(f"q_{k}"), F.size(f"t_{k}")
        return X.share(hit, q + t - hit), X.share(hit, q), X.share(hit, t)

    names, words, digits = (overlap(k) for k in kinds)
    first = lambda side: F.coalesce(F.get(f"{side}_numbers", F.lit(0)), F.lit(""))
    out = rows.withColumns({
        "name_nonempty_exact_match": same(qn, tn), "name_char_trigram_jaccard": fuzzy.trigram_column(qn, tn),
        "name_token_jaccard": names[0], "name_query_token_coverage": names[1], "name_target_token_coverage": names[2],
        "address_nonempty_exact_match": same(qa, ta), "address_char_trigram_jaccard": fuzzy.trigram_column(qa, ta),
        "address_token_jaccard": words[0], "address_query_token_coverage": words[1], "address_target_token_coverage": words[2],
        "numeric_token_jaccard": digits[0], "numeric_query_coverage": digits[1], "numeric_target_coverage": digits[2],
        "nonempty_first_number_equality": same(first("q"), first("t")),
        "query_numeric_token_count": number(F.size("q_numbers")), "target_numeric_token_count": number(F.size("t_numbers")),
        "query_name_missing": number(qn == ""), "target_name_missing": number(tn == ""),
        "query_address_missing": number(qa == ""), "target_address_missing": number(ta == ""),
        "target_source_is_S2": number(F.col("target_source") == "S2"),
    })
    return out.drop(*hits)


def fuzzy_features(rows: DataFrame) -> DataFrame:
    qn, tn, qa, ta = _texts()
    kernels = {
        "name_normalized_string_ratio": fuzzy.ratio_column(qn, tn), "name_jaro_winkler": fuzzy.jaro_winkler_column(qn, tn),
        "name_token_sort_ratio": fuzzy.token_sort_column(qn, tn), "name_token_set_ratio": fuzzy.token_set_column(qn, tn), "name_partial_ratio": fuzzy.partial_column(qn, tn),
        "address_normalized_string_ratio": fuzzy.ratio_column(qa, ta), "address_token_sort_ratio": fuzzy.token_sort_column(qa, ta), "address_token_set_ratio": fuzzy.token_set_column(qa, ta),
    }
    return rows.withColumns(kernels)


def cross_script(rows: DataFrame) -> DataFrame:
    """f55 to f58 on raw texts, of pairs of spelled() entities."""
    raw = lambda c: F.coalesce(F.col(c), F.lit(""))
    best = fuzzy.best_ratio_column(F.lower(raw("q_business_name")), F.col("q_name_latin"), F.lower(raw("t_business_name")), F.col("t_name_latin"))
    known = (F.col("q_script") != "UNKNOWN") & (F.col("t_script") != "UNKNOWN")
    return rows.withColumns({
        "f55": fuzzy.trigram_column("q_name_latin", "t_name_latin"),
        "f56": F.when((raw("q_business_name") == "") & (raw("t_business_name") == ""), 0.0).otherwise(best),
        "f57": ((F.col("q_script") != F.col("t_script")) & known).cast("double"),
        "f58": X.overlap(F.col("q_address_latin_words"), F.col("t_address_latin_words"))[0],
    })


def cosines(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """s1_id, target_id and the four cosines (rounded to nine places; 0 without a shared term)."""
    q = weights.filter("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "view", "term", F.col("w").alias("qw"))
    t = weights.filter("source <> 'S1'").select(F.col("entity_id").alias("target_id"), "view", "term", "w")
    pairs = candidates.select("s1_id", "target_id")
    dots = pairs.join(q, "s1_id").join(t, ["target_id", "view", "term"]).groupBy("s1_id", "target_id")
    of = lambda view: F.sum(F.when(F.col("view") == view, F.col("qw") * F.col("w")).otherwise(0.0))
    found = dots.agg(of("name").alias("n"), of("compact").alias("c"), of("address").alias("a"))
    place = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9)
    n, c, a = F.coalesce("n", F.lit(0.0)), F.coalesce("c", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return pairs.join(found, ["s1_id", "target_id"], "left").select("s1_id", "target_id", place(n).alias("exact_name_cosine"), place(c).alias("exact_compact_name_cosine"), place(a).alias("exact_address_cosine"), place(0.5 * n + 0.5 * a).alias("exact_combined_cosine"))


def known_cosines(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """cosines() where the products of all pairs are at hand: every candidate is one of them."""
    place = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 9)
    rows = candidates.select("s1_id", "target_id").join(products.select("s1_id", "target_id", "name", "compact", "address"), ["s1_id", "target_id"], "left")
    return rows.select("s1_id", "target_id", place(F.col("name")).alias("exact_name_cosine"), place(F.col("compact")).alias("exact_compact_name_cosine"), place(F.col("address")).alias("exact_address_cosine"), place(combined()).alias("exact_combined_cosine"))


def ranks(rows: DataFrame) -> DataFrame:
    """Each lane's rank from zero; absent lanes have a sentinel."""
    name = lambda lane: "compact_name_rank" if lane == "compact" else f"{lane}_rank"
    values = {lane: F.coalesce(F.col(f"{lane}_rank").cast("double") - 1.0, F.lit(ABSENT_RANK)) for lane in LANES}
    kept = [c for c in rows.columns if c not in {f"{lane}_rank" for lane in LANES}]
    return rows.select(*kept, *[v.alias(name(lane)) for lane, v in values.items()])


def context(rows: DataFrame) -> DataFrame:
    """Ranks, distances to the best and rival margins of three cosines, within query and source and within
    target; two window partitionings serve all of them."""
    mine, theirs = W.partitionBy("s1_id", "target_source"), W.partitionBy("target_id")
    out = {}
    for signal in ("name", "address", "combined"):
        score = F.col(f"exact_{signal}_cosine")
        out[f"{signal}_query_source_rank"] = F.rank().over(mine.orderBy(score.desc())).cast("double")
        out[f"{signal}_query_source_delta_best"] = F.round(score - F.max(score).over(mine), 9)
    out["candidate_count_within_s1_source"] = F.count(F.lit(1)).over(mine).cast("double")
    rows = rows.withColumns(out)
    best = {f"_best_{s}": F.max(f"exact_{s}_cosine").over(theirs) for s in ("name", "address", "combined")}
    rows = rows.withColumns(best | {"distinct_competing_s1_count_for_target": F.count(F.lit(1)).over(theirs).cast("double")})
    out = {}
    for signal in ("name", "address", "combined"):
        score, top = F.col(f"exact_{signal}_cosine"), F.col(f"_best_{signal}")
        out[f"{signal}_target_owner_rank"] = F.rank().over(theirs.orderBy(score.desc())).cast("double")
        out[f"{signal}_target_delta_best"] = F.round(score - top, 9)
        tied = F.sum(F.when(score == top, 1).otherwise(0)).over(theirs)
        second = F.max(F.when(score < top, score)).over(theirs)
        alone = F.col("distinct_competing_s1_count_for_target") == 1
        out[f"{signal}_target_rival_margin"] = F.round(F.when(alone, 0.0).when((score == top) & (tied == 1), score - second).otherwise(score - top), 9)
    return rows.withColumns(out).drop(*best)


def pair_features(candidates: DataFrame, entities: DataFrame, weights: DataFrame | None, known: DataFrame | None = None) -> DataFrame:
    """s1_id, target_id, target_source and the 59 features in order; known: the candidates' cosines, where they are
    at hand, instead of weights."""
    rows = ranks(candidates).join(cosines(candidates, weights) if known is None else known, ["s1_id", "target_id"])
    # distances and ranks within query and target come first: their rows have no texts yet
    rows = cross_script(fuzzy_features(direct(paired(context(rows), spelled(entities)))))
    return rows.select("s1_id", "target_id", "target_source", *FEATURES)


def zero_masked(features: DataFrame, groups: list[str]) -> DataFrame:
    """The features of some groups set to 0, order kept."""
    masked = {c for g in groups for c in GROUPS[g]}
    return features.select(*[F.lit(0.0).alias(c) if c in masked else F.col(c) for c in features.columns])
