"""DuckDB SQL of the stages, as named common table expressions that queries pick from."""

from __future__ import annotations

import re
import sys
import unicodedata

FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"
SPACE = r"regexp_replace({0}, '\s\s+', ' ', 'g')"


def grams(text: str) -> str:
    return f"case when length({text}) >= 3 then list_transform(range(1, length({text}) - 1), lambda i: substring({text}, i, 3)) else []::varchar[] end"


def _of(view: str) -> str:
    if view == "name":
        words = rf"list_filter(string_split_regex({SPACE.format('name')}, '\s+'), lambda w: w <> '')"
        return f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))))"
    return grams(SPACE.format("compact")) if view == "compact" else "regexp_extract_all(address, '[a-z0-9]+')"


def _lane(lane: str, k: int) -> str:
    left, right = ("target_id", "s1_id") if lane == "reverse" else ("s1_id", "target_id")
    table = "combined" if lane in ("combined", "reverse") else f"(select * from pairs where view = '{lane}')"
    return (
        f"select country, s1_id, target_id, target_source, '{lane}' as lane, rank, round(sim, 6) as similarity from (select *, row_number() over (partition by {left} order by round(sim, 9) desc, {right}) as rank "
        f"from {table} where round(sim, 9) > 0) where rank <= {k}"
    )


LANES = {"name": (1, 5), "compact": (2, 5), "address": (4, 5), "combined": (8, 10), "reverse": (16, 8)}
MASK = "case lane " + " ".join(f"when '{lane}' then {bit}" for lane, (bit, _) in LANES.items()) + " end"
TAGS = " union all ".join(f"select s1_id, 'retrieved_by:{lane}' as tag from seen where mask & {bit} <> 0" for lane, (bit, _) in LANES.items())

def script_ranges() -> str:
    """Values (low, high, script): runs of code points of letters whose Unicode names have the same first word."""
    found: list[list] = []
    for c in filter(str.isalpha, map(chr, range(sys.maxunicode + 1))):
        if name := unicodedata.name(c, ""):
            at, word = ord(c), name.split(" ", 1)[0]
            if found and found[-1][1:] == [at - 1, word]:
                found[-1][1] = at
            else:
                found.append([at, at, word])
    return ", ".join(f"({low}, {high}, '{word}')" for low, high, word in found)


#: Each may use those before it.
CTES = {
    "ents": "select cast(doc_id as varchar) as entity_id, case doc_id % 3 when 0 then 'S1' when 1 then 'S2' else 'S3' end as source, substring(text, 1, 40) as business_name, substring(text, 41, 60) as business_address, lang as country from documents",
    "normal": f"select *, {FOLD.format('business_name')} as name_normal, {FOLD.format('business_address')} as address_normal from ents",
    "views": "select entity_id, source, country, coalesce(name_normal, '') as name, replace(coalesce(name_normal, ''), ' ', '') as compact, coalesce(address_normal, '') as address from normal",
    "tf": " union all ".join(f"select country, source, entity_id, '{v}' as view, term, count(*) as tf from (select country, source, entity_id, unnest({_of(v)}) as term from views) group by all" for v in ("name", "compact", "address")),
    "sizes": "select country, count(*) as n from views group by country",
    "vocab": "select t.country, t.view, t.term, count(*) as df, any_value(s.n) as n, ln((1.0 + any_value(s.n)) / (1.0 + count(*))) + 1.0 as idf from tf t join sizes s on t.country is not distinct from s.country group by t.country, t.view, t.term having 0.05::double * any_value(s.n) >= 2 and count(*) >= 2 and count(*) <= 0.05::double * any_value(s.n)",
    "weights": "select *, raw / sqrt(sum(raw * raw) over (partition by source, entity_id, view)) as w from (select tf.country, source, entity_id, tf.view, tf.term, (1.0 + ln(tf.tf)) * idf as raw from tf join vocab v on tf.country is not distinct from v.country and tf.view = v.view and tf.term = v.term)",
    "pairs": "select t.country, t.view, q.entity_id as s1_id, t.entity_id as target_id, t.source as target_source, sum(q.w * t.w) as sim from weights q join weights t on q.country is not distinct from t.country and q.view = t.view and q.term = t.term where q.source = 'S1' and t.source <> 'S1' group by all",
    "combined": "select country, s1_id, target_id, target_source, sum(0.5::double * sim) as sim from pairs where view in ('name', 'address') group by all",
    "hits": " union all ".join(_lane(lane, k) for lane, (_, k) in LANES.items()),
    "cand": "select s1_id, target_id, target_source, country, bit_or(" + MASK + ")::int as retrieval_view_mask, " + ", ".join(f"max(case when lane = '{x}' then rank end)::int as {x}_rank, max(case when lane = '{x}' then similarity end) as {x}_similarity" for x in LANES) + " from hits group by s1_id, target_id, target_source, country",
    "dots": "select c.s1_id, c.target_id, coalesce(max(case when view = 'name' then sim end), 0) as n, coalesce(max(case when view = 'compact' then sim end), 0) as c, coalesce(max(case when view = 'address' then sim end), 0) as a from cand c left join pairs p on c.s1_id = p.s1_id and c.target_id = p.target_id group by c.s1_id, c.target_id",
    "cosines": "select s1_id, target_id, round(n, 9) as exact_name_cosine, round(c, 9) as exact_compact_name_cosine, round(a, 9) as exact_address_cosine, round(0.5::double * n + 0.5::double * a, 9) as exact_combined_cosine from dots",
    "scores": "select s1_id, target_id, round(greatest(0.0::double, least(1.0::double, (exact_name_cosine + exact_compact_name_cosine + exact_address_cosine + exact_combined_cosine) / 4)), 6) as score from cosines",
    "owned": "select s1_id, target_id, score, owner_rank = 1 as is_owner, owner_rank::int as owner_rank, case when owner_rank = 1 then next_id else top_id end as rival_s1_id, case when owner_rank = 1 then next_score else top_score end as rival_score, round(score - case when owner_rank = 1 then next_score else top_score end, 9) as rival_margin from (select *, row_number() over w as owner_rank, lead(s1_id) over w as next_id, lead(score) over w as next_score, first(s1_id) over w as top_id, first(score) over w as top_score from scores window w as (partition by target_id order by score desc, s1_id))",
    "disposed": "select s1_id, target_id, score, is_owner, 0.64::double as threshold, round(score - 0.64::double, 9) as threshold_margin, score >= 0.64 and is_owner as accepted, case when score < 0.64 then 'BELOW_THRESHOLD' when not is_owner then 'LOST_OWNERSHIP' else 'NONE' end as rejection_reason from owned",
    "queries": "select entity_id as s1_id from ents where source = 'S1'",
    "accepted": "select s1_id, list_sort(list(target_id)) as found from disposed where accepted group by s1_id",
    "resolved": "select q.s1_id, coalesce(found, []::varchar[]) as accepted_targets, case when found is null then 'ZERO_MATCH' when len(found) = 1 then 'SINGLE_MATCH' else 'MULTI_MATCH' end as decision_type from queries q left join accepted a using (s1_id)",
    "truth": "select cast(q.doc_id as varchar) as s1_id, cast(t.doc_id as varchar) as target_id from documents q join documents t on q.lang = t.lang and q.text = t.text where q.doc_id % 3 = 0 and t.doc_id % 3 <> 0",
    "wanted": "select s1_id, list_sort(list(target_id)) as truth_targets, count(*) as wanted from truth group by s1_id",
    "sets": "select r.s1_id, len(list_intersect(accepted_targets, coalesce(truth_targets, []::varchar[]))) as tp, len(accepted_targets) as found, coalesce(wanted, 0) as truth_count from resolved r left join wanted w using (s1_id)",
    "pr": "select s1_id, tp, found - tp as fp, truth_count - tp as fn, truth_count, found, case when found > 0 then tp::double / found when truth_count = 0 then 1.0::double else 0.0::double end as p, case when truth_count > 0 then tp::double / truth_count else 1.0::double end as r from sets",
    "metrics": "select s1_id, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, truth_count::bigint as truth_count, round(p, 9) as precision, round(r, 9) as recall, round(case when truth_count + found = 0 then 1.0::double when p > 0 and 0.25 * p + r > 0 then 1.25::double * p * r / (0.25::double * p + r) else 0.0::double end, 9) as f05, fp = 0 and fn = 0 as exact_set from pr",
    "marked": "select c.*, (t.s1_id is not null)::int as hit from cand c left join truth t on c.s1_id = t.s1_id and c.target_id = t.target_id",
    "labelled": "select s.*, (t.s1_id is not null)::int as label from scores s left join truth t on s.s1_id = t.s1_id and s.target_id = t.target_id",
    "errors": "select s1_id, target_id, 'FALSE_NEGATIVE' as error_type from truth where (s1_id, target_id) not in (select (s1_id, target_id) from disposed where accepted) union all select s1_id, target_id, 'FALSE_POSITIVE' from disposed where accepted and (s1_id, target_id) not in (select (s1_id, target_id) from truth)",
    "failures": """select e.s1_id, e.target_id, e.error_type,
        case when e.error_type = 'FALSE_POSITIVE' then case when c.s1_id is not null and o.score >= 0.64 then 'SCORING' else 'DECODING' end
             when c.s1_id is null then 'RETRIEVAL' when o.score < 0.64 then 'SCORING' when not o.is_owner then 'OWNERSHIP' else 'DECODING' end as failure_stage,
        list_filter([case when w.wanted > 1 then 'MULTI_MATCH' end, case when bit_count(c.retrieval_view_mask) = 1 then 'SINGLE_LANE' end, case when w.wanted is null then 'ZERO_MATCH' end], lambda x: x is not null) as tags,
        c.s1_id is not null as retrieved, o.score, o.is_owner, o.rival_s1_id, o.rival_margin, d.rejection_reason, cast(null as varchar) as label_ambiguity_reason
      from errors e left join cand c on e.s1_id = c.s1_id and e.target_id = c.target_id left join owned o on e.s1_id = o.s1_id and e.target_id = o.target_id
      left join disposed d on e.s1_id = d.s1_id and e.target_id = d.target_id left join wanted w on e.s1_id = w.s1_id""",
    "ranked": "select d.*, o.rival_margin, bit_count(c.retrieval_view_mask) as lanes, row_number() over (partition by d.s1_id order by d.score desc, d.target_id) as nth from disposed d join owned o on d.s1_id = o.s1_id and d.target_id = o.target_id join cand c on d.s1_id = c.s1_id and d.target_id = c.target_id",
    "caps": "select s1_id, count(*) as n, max(case when nth = 1 then score end) as first, max(case when nth = 2 then score end) as second, min(case when accepted then lanes end) as lanes, min(case when accepted then rival_margin end) as margin, count(*) filter (where accepted and rival_margin is null) as unrivalled, min(case when accepted then threshold_margin end) as above, min(case when accepted then score end) as min_accepted, max(case when not accepted then score end) as max_rejected from ranked group by s1_id",
    "evidence": "select r.s1_id, decision_type, accepted_targets, coalesce(n, 0)::bigint as candidate_count, first as top_candidate_score, lanes::bigint as min_accepted_lane_count, lanes >= 2 as alternate_lane_support, case when unrivalled = 0 then margin end as min_ownership_margin, above as min_threshold_margin, case when first > 0 then round(second / first, 9) end as ambiguity_ratio, min_accepted as minimum_accepted_score, max_rejected as best_rejected_score, round(first - second, 9) as score_gap from resolved r left join caps using (s1_id)",
    "risks": "select s1_id, round(case when minimum_accepted_score is not null then 1 - minimum_accepted_score else coalesce(top_candidate_score, 0) end, 6) as confidence_risk, round(((1 - coalesce(min_accepted_lane_count, 0) / 5.0::double) + (1 - least(1.0::double, coalesce(min_ownership_margin, 0))) + (1 - least(1.0::double, coalesce(min_threshold_margin, 0) / 0.36::double)) + coalesce(ambiguity_ratio, 0)) / 4, 6) as structure_risk from evidence",
    "loads": "select target_id, count(*) as load from cand group by target_id",
    "seen": "select s1_id, max(load) as load, bit_or(retrieval_view_mask) as mask from cand join loads using (target_id) group by s1_id",
    "margins": "select s1_id, min(rival_margin) as margin from owned where is_owner and score >= 0.64 group by s1_id",
    "script_ranges": f"select * from (values {script_ranges()}) as v(low, high, script)",
    "letters": "select entity_id, source, i, script from (select entity_id, source, i, unicode(substring(business_name, i, 1)) as point from (select entity_id, source, business_name, unnest(range(1, length(business_name) + 1)) as i from ents)) l asof join script_ranges r on l.point >= r.low where point <= high",
    "scripts": "select entity_id, source, coalesce(script, 'UNKNOWN') as script from ents left join (select entity_id, source, script from (select entity_id, source, script, count(*) as n, min(i) as first from letters group by entity_id, source, script) qualify row_number() over (partition by entity_id, source order by n desc, first) = 1) using (entity_id, source)",
    "crossed": "select distinct s1_id from truth t join scripts a on a.source = 'S1' and a.entity_id = t.s1_id join scripts b on b.source <> 'S1' and b.entity_id = t.target_id where a.script <> b.script and a.script <> 'UNKNOWN' and b.script <> 'UNKNOWN'",
    "tags": "select s1_id, unnest(['country:' || coalesce(nullif(country, ''), 'None'), case when coalesce(business_name, '') <> '' then 'name_present' else 'name_missing_or_empty' end, case when coalesce(business_address, '') <> '' then 'address_present' else 'address_missing_or_empty' end, case when wanted is null then 'truth_zero' when wanted = 1 then 'truth_single' else 'truth_multi' end, case when load > 8 then 'competition_gt8' else 'competition_le8' end, case when margin is null then 'ownership_margin_undefined' when margin <= 0.01 then 'ownership_margin_le001' else 'ownership_margin_gt001' end]) as tag from (select entity_id as s1_id, * exclude (entity_id) from ents where source = 'S1') q left join wanted using (s1_id) left join seen using (s1_id) left join margins using (s1_id) union all select s1_id, case when c.s1_id is null then 'same_script_or_no_truth' else 'cross_script' end as tag from queries left join crossed c using (s1_id) union all " + TAGS,
    "paired": "select c.*, q.name_normal as qn, q.address_normal as qa, t.name_normal as tn, t.address_normal as ta from cand c join normal q on q.source = 'S1' and q.entity_id = c.s1_id join normal t on t.source = c.target_source and t.entity_id = c.target_id",
}
KEPT = ("tf", "weights", "pairs", "hits", "cand", "scores", "owned", "resolved", "truth", "ranked", "paired")


PARTS = "select cast(p_partkey as varchar) as entity_id, case p_partkey % 3 when 0 then 'S1' when 1 then 'S2' else 'S3' end as source, p_name as business_name, p_type || ' ' || cast(p_size as varchar) as business_address, p_brand as country from part"
TRADERS = "select cast(c_custkey as varchar) as entity_id, 'S1' as source, c_name as business_name, cast(null as varchar) as business_address, cast(c_nationkey as varchar) as country from customer union all select cast(s_suppkey as varchar), 'S2', s_name, null, cast(s_nationkey as varchar) from supplier"


def sql(final: str, entities: str | None = None, loose: bool = False) -> str:
    """`final` with the expressions that it needs; over other entities than the documents, or with no limits on
    the documents that a term may occur in."""
    needed: list[str] = []
    changed = {"ents": entities} if entities else {}
    if loose:
        changed["vocab"] = CTES["vocab"].split(" having ")[0]
    ctes = CTES | changed

    def add(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b(?:from|join)\s+\(?{name}\b", text):
                add(ctes[name])
                if name not in needed:
                    needed.append(name)

    add(final)
    body = ",\n".join(f"{name} as {'materialized ' if name in KEPT else ''}({ctes[name]})" for name in needed)
    if not body:
        return final
    return f"with {body},\n{final.removeprefix('with ')}" if final.startswith("with ") else f"with {body}\n{final}"
