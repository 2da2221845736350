"""DuckDB SQL of the operators' queries, where SQL can express them: the contracts written out plainly, without
anchors, blocks, sketches dealt by hash or bounds."""

from __future__ import annotations

import math

from tessera.llm.mixing import MOST_COPIES, OFFSETS, UNIT, WEIGHTS
from tessera.llm.quality_rules import LEAST_WORDS, RULES, SYMBOLS

WORDS = r"'[^\x20\x09-\x0D]+'"
SPACES = r"'[\x20\x09-\x0D]+'"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_sql(reach: float = 3.0, prior: float = 50.0, least_spread: float = 0.1, accuracy: float = 0.01) -> str:
    base = math.log((1 + accuracy) / (1 - accuracy))
    values = {"word_length": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)"}
    long = " union all ".join(f"select doc_id, lang, source, '{rule}' as rule, ({v})::double as value from counted" for rule, v in values.items())

    def fences(keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        return (
            f"select {by}, max(total) as n, min(case when upto >= 0.25::double * total then middle end) as q25, min(case when upto >= 0.75::double * total then middle end) as q75 "
            f"from (select {by}, bucket * {base!r}::double + {math.log(2 / (1 + math.exp(base)))!r}::double as middle, sum(n) over (partition by {by} order by bucket) as upto, sum(n) over (partition by {by}) as total "
            f"from (select {by}, bucket, count(*) as n from sketched group by {by}, bucket)) group by {by}"
        )

    side = lambda t, sign: f"({t}.q{25 if sign == '-' else 75} {sign} {reach!r}::double * greatest({t}.q75 - {t}.q25, {least_spread!r}::double))"
    drawn = lambda sign: f"exp((o.n * {side('o', sign)} + {prior!r}::double * ((l.n * {side('l', sign)} + {prior!r}::double * {side('e', sign)}) / (l.n + {prior!r}::double))) / (o.n + {prior!r}::double))"
    order = ", ".join(f"'{r}'" for r in RULES)
    both = ", ".join(f"'{r}'" for r, s in RULES.items() if s == "both")
    return rf"""
with docs as (select doc_id, lang, source, coalesce(text, '') as body from documents),
words as (select doc_id, regexp_extract_all(body, {WORDS}) as w from docs),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
triples as (select doc_id, i, word, lead(word) over following as word2, lead(word, 2) over following as word3 from placed window following as (partition by doc_id order by i)),
windows as (select doc_id, i, count(*) over (partition by doc_id, word, word2, word3) as n from triples where word3 is not null),
repeats as (select doc_id, count(distinct i + step) as n from windows cross join (select unnest([0, 1, 2]) as step) where n >= 2 group by doc_id),
lines as (select doc_id, len(string_split(body, chr(10))) as n_lines, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as filled from docs),
counted as (select d.doc_id, lang, source, len(w) as n_words, length(regexp_replace(body, {SPACES}, '', 'g')) as word_chars, length(regexp_replace(body, '[^{SYMBOLS}]', '', 'g')) as n_symbols,
  len(filled) - len(list_distinct(filled)) as n_dup_lines, n_lines, coalesce(r.n, 0) as n_repeat_words from docs d join words using (doc_id) join lines using (doc_id) left join repeats r using (doc_id)),
long as ({long}),
sketched as (select *, ceil(ln(value) / {base!r}::double)::bigint as bucket from long where value > 0),
own as ({fences('lang, source')}), langs as ({fences('lang')}), every as ({fences('')}),
limits as (select o.lang, o.source, o.rule, {drawn('-')} as low, {drawn('+')} as high from own o join langs l on o.lang is not distinct from l.lang and o.rule = l.rule join every e on o.rule = e.rule),
failed as (select doc_id, array_to_string(list_filter([{order}], lambda r: list_contains(list(x.rule), r)), ',') as failed_rules from long x join limits t on x.lang is not distinct from t.lang and x.source is not distinct from t.source and x.rule = t.rule
  where value > high or (x.rule in ({both}) and value < low) group by doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words) and failed_rules is null as kept, coalesce(failed_rules, '') as failed_rules
from counted left join failed using (doc_id)
"""


def repeats_sql(length: int = 400, passage: int = 51, block: int = 256) -> str:
    """Bytes as two hexadecimal digits each; strings are told apart by their md5. Texts are cut into blocks that
    overlap, as substring() walks from a text's begin."""
    return rf"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as body, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
blocks as (select doc_id, base, substring(body, (2 * base + 1)::bigint, {2 * (block + length - 1)}) as piece from (select doc_id, body, unnest(range(0, length(body) // 2, {block})) as base from docs)),
starts as (select doc_id, base + j as i, md5(substring(piece, (2 * j + 1)::bigint, {2 * length})) as key from (select doc_id, base, piece, unnest(range(0, least({block}, length(piece) // 2 - {length - 1}))) as j from blocks)),
twice as (select doc_id, i from (select *, count(*) over (partition by key) as n from starts) where n > 1),
marked as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > {length}, true)::int as fresh from twice),
runs as (select doc_id, min(i) as lo, max(i) + {length} as hi from (select *, sum(fresh) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
before as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as last from runs),
cut as (select r.doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(substring(body, (2 * last + 1)::bigint, (2 * (lo - last))::bigint), '' order by lo) || any_value(substring(body, (2 * most + 1)::bigint)) as kept
  from before r join docs using (doc_id) join (select doc_id, max(hi) as most from runs group by doc_id) using (doc_id) group by r.doc_id),
placed as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from docs),
passages as (select doc_id, i, md5(string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {passage - 1} following)) as key, n from placed),
shared as (select doc_id, i from (select *, min(doc_id) over (partition by key) as least, max(doc_id) over (partition by key) as greatest from passages where i <= n - {passage - 1}) where least <> greatest),
ends as (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from shared),
told as (select doc_id, sum(least({passage}, coalesce(i - prev, {passage}))) as n from ends group by doc_id)
select doc_id, (length(body) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, body))) as kept_sha256, coalesce(n, 0)::bigint as n_passage_words
from docs left join cut using (doc_id) left join told using (doc_id)
"""


def mixing_sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix", block_rows: int = 50_000) -> str:
    copies = f"((upto + shift) // {UNIT} - (upto + shift - units) // {UNIT})"
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::bigint as size from documents),
weighed as (select source, sum(size)::bigint as source_size, case when sum(size) > 0 then [{', '.join(map(str, weights))}][(row_number() over (order by source nulls last) - 1) % {len(weights)} + 1] else 0 end::double as weight from sized group by source),
limited as (select *, {most}::double * source_size as most, (select sum(source_size) from weighed)::double as total, (select sum(weight) from weighed) as all_weight from weighed),
levels as (select *, (total - coalesce(sum(most) over below, 0)) / nullif(all_weight - coalesce(sum(weight) over below, 0), 0) as level, row_number() over (order by most / nullif(weight, 0) nulls first, source nulls last) as nth from limited
  window below as (order by most / nullif(weight, 0) nulls first, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, case when weight = 0 then 0::double else least(most, coalesce(weight * (select arg_min(level, nth) from levels where weight * level < most), most)) end as target from levels),
drawn as (select s.*, source_size, target, round(coalesce(target / nullif(source_size, 0), 0) * {UNIT})::bigint as units,
  ('0x' || substring(md5('{seed}' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % (select greatest(8, count(*) // {block_rows}) from sized) as part from sized s join targets t on s.source is not distinct from t.source),
summed as (select *, (sum(units) over (partition by source order by size, part, doc_id rows unbounded preceding))::bigint + ('0x' || substring(md5('{seed}' || coalesce(source, chr(0))), 1, 6))::bigint as upto from drawn),
shifts as (select k * {UNIT} // {OFFSETS} as shift from (select unnest(range(0, {OFFSETS})) as k)),
tried as (select source, shift, abs(sum(size * {copies}) - max(target)) as off from summed cross join shifts group by source, shift),
best as (select source, arg_min(shift, (off, shift)) as shift from tried group by source)
select doc_id, size, source_size, target, (size * {copies})::bigint as taken, {copies}::bigint as copies, s.source from summed s join best b on s.source is not distinct from b.source
"""


def jaccard_sql(n: int = 4, percent: int = 85) -> str:
    return rf"""
with recursive docs as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) as w from documents),
placed as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from docs),
runs as (select doc_id, n, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {n - 1} following) as gram from placed),
grams as (select distinct doc_id, gram from runs where i <= greatest(1, n - {n - 1})),
sizes as (select doc_id, count(*) as size from grams group by doc_id),
long as (select doc_id, gram, size from grams join sizes using (doc_id)),
links as (select a.doc_id as x, b.doc_id as y from long a join long b on a.gram = b.gram and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= {percent} * (any_value(a.size) + any_value(b.size) - count(*))),
reach as (select doc_id as x, doc_id as y from docs union select reach.x, links.y from reach join links on reach.y = links.x)
select doc_id, coalesce(size, 0)::bigint as n_shingles, component_id from docs left join sizes using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by x) using (doc_id)
"""


#: Equal texts after white space is made one blank; the smallest identifier stays.
EXACT = rf"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), {SPACES}, ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from t
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_sql(),
        "op4_suffix_dedup": repeats_sql(),
        "op7_mixing": mixing_sql(),
        "op8_jaccard_join": jaccard_sql(),
        "op9_exact_dedup": EXACT,
    }
