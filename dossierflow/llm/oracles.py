"""The queries in plain SQL for a second engine, where SQL can express them."""

from __future__ import annotations

from dossierflow.llm import licenses

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = """
with recursive d as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), g as (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n from g group by doc_id
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.gram = y.gram and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 90 * (na.n + nb.n - c)
), reach(a, b) as (
  select doc_id, doc_id from documents union select reach.a, links.b from reach join links on links.a = reach.b
)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(b) from reach where a = d.doc_id) as component_id
from d left join n using (doc_id)
"""

OP6 = f"""
with d as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text, {WORDS} as w from documents
), windows as (
  select row, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') as gram
  from (select row, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), again as (
  select row, i from (select row, i, count(*) over (partition by row, gram) as c from windows) where c > 1
), covered as (
  select row, count(distinct i + k) as n from again, (select unnest(range(0, 8)) as k) group by row
), lines as (
  select row, count(*) - count(distinct line) as dup, sum(strlen(line)) as bytes,
    list_sum(list_transform(list(distinct line), lambda x: strlen(x))) as once
  from (select row, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row
), m as (
  select d.row, doc_id, text, w, len(w)::bigint as n_words,
    coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(lines.dup, 0)::bigint as n_dup_lines, coalesce(lines.bytes, 0) as line_bytes, coalesce(lines.once, 0) as once,
    coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as n_stutters,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as upper,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as letters
  from d left join lines using (row) left join covered using (row)
), v as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or 100 * (line_bytes - once) > 50 * line_bytes
    or 100 * n_stutters > 20 * n_words or 100 * upper > 50 * letters
    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from v
"""

# The phrases and templates of the operator, as rows.
_TEMPLATES = ", ".join(
    f"({i}, '{label}', '{words}', {base})"
    for i, (label, words, base) in enumerate([(*p, True) for p in licenses.PHRASES] + [(*t, False) for t in licenses.TEMPLATES])
)

OP10 = f"""
with t as (
  select id, label, string_split(words, ' ') as w, base from (values {_TEMPLATES}) as v(id, label, words, base)
), tg as (
  select id, label, base, len(w) as size, i as t, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as gram
  from (select *, unnest(range(0, len(w) - 2)) as i from t)
), d as (
  select row_number() over () as row, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), g as (
  select row, i as p, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as gram
  from (select row, w, unnest(range(0, len(w) - 2)) as i from d where len(w) >= 3)
), v as (
  select row, id, label, base, size, p - t as diagonal, t from g join tg using (gram)
), whole as (
  select row, id, label, diagonal from v where base
  group by row, id, label, size, diagonal having count(distinct t) = size - 2
), lagged as (
  select *, case when diagonal - lag(diagonal) over (partition by row, id order by diagonal) <= 2 then 0 else 1 end as torn
  from (select distinct row, id, diagonal from v)
), spans as (
  select *, sum(torn) over (partition by row, id order by diagonal) as span from lagged
), covers as (
  select row, label, count(distinct t + k)::double / size as cover
  from v join spans using (row, id, diagonal), (select unnest(range(0, 3)) as k)
  group by row, id, label, size, span
), labels as (
  select row, label, true as base from whole union all select row, label, false from covers where cover >= 0.8
)
select doc_id, len(w)::bigint as n_words,
  coalesce(b.n, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
  coalesce(l.base_labels, '') as base_labels, coalesce(l.labels, '') as labels, coalesce(c.score, 0)::double as score
from d
left join (select row, count(*) as n, min(diagonal) as first_word, max(diagonal) as last_word from whole group by row) b using (row)
left join (select row, string_agg(distinct label, ',' order by label) filter (base) as base_labels,
  string_agg(distinct label, ',' order by label) as labels from labels group by row) l using (row)
left join (select row, max(cover) as score from covers group by row) c using (row)
"""

# A CRC-32 of the decimal key, bit by bit: code points and eight shifts each.
OP11 = f"""
with d as (
  select row_number() over () as row, doc_id, {WORDS} as w from documents
), hashed as (
  select *, len(w) as n, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c:
      [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: case when e >= 0 then xor(c, e) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as h
  from d
), places as (
  select *, case when n > 0 then (h // 10) % n end as a from hashed
), c as (
  select row, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end])
    else w end as w
  from places
), words as (
  select row, n, i, w[i + 1] as word from (select row, n, w, unnest(range(n)) as i from c where n > 0)
), same as (
  select x.row, y.i - x.i as q, x.i as i
  from words x join words y on x.row = y.row and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), stretches as (
  select row, q, min(i) as s, count(*) + q as size
  from (select *, i - row_number() over (partition by row, q order by i) as island from same)
  group by row, q, island having count(*) + q >= greatest(6, 4 * q)
), runs as (
  select * from stretches x where not exists (
    from stretches y where y.row = x.row and y.q < x.q and y.s <= x.s and y.s + y.size >= x.s + x.size)
), dropped as (
  select distinct row, unnest(range(s + q, s + size)) as i from runs
), kept as (
  select row, string_agg(word, ' ' order by i) as text from words anti join dropped using (row, i) group by row
), best as (
  select * from runs qualify row_number() over (partition by row order by size::decimal(38, 18) / q desc, s, q) = 1
), listed as (
  select row, count(*) as n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' order by s, q) as body from runs group by row
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, size::bigint as length, q::bigint as period,
  ((1000 * size) // q)::bigint as exponent_milli, sha256(coalesce(body, '')) as runs_sha256,
  sha256(coalesce(kept.text, '')) as collapsed_sha256
from c left join listed using (row) left join best using (row) left join kept using (row)
"""

FOLDED = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

OP12 = f"""
with d as (
  select row_number() over () as row, doc_id, {FOLDED} as w from documents
), b as (
  select item_id, w, least(len(w), 10) as size from (select item_id, {FOLDED} as w from benchmark) where len(w) > 0
), held as (
  select distinct item_id::varchar as item, size, array_to_string(w[i + 1 : i + size], ' ') as gram
  from (select *, unnest(range(0, len(w) - size + 1)) as i from b)
), placed as (
  select row, size, i, array_to_string(w[i + 1 : i + size], ' ') as gram
  from (select row, w, size, unnest(range(0, len(w) - size + 1)) as i from d, (select distinct size from b) where len(w) >= size)
), hits as (
  select row, i, size, item from placed join held using (size, gram)
), marked as (
  select row, count(distinct place) as n from (select row, unnest(range(i, i + size)) as place from hits) group by row
), named as (
  select row, count(item) as n, string_agg(item, ',' order by item) as items from (select distinct row, item from hits) group by row
)
select doc_id, len(w)::bigint as n_words, coalesce(marked.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, marked.n is not null as contaminated
from d left join marked using (row) left join named using (row)
"""

OP13 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), met as (
  select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id as id,
    list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * v.e[i]))::bigint as score
  from v a join v on a.vec_id <> v.vec_id where a.vec_id % 50 = 0
), positive as (
  select anchor_id, id, score from met where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::int as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positive p join met n on n.anchor_id = p.anchor_id and not n.same
  and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""

SQL = {"op1_ngram_join": OP1, "op6_quality_rules": OP6, "op10_licenses": OP10, "op11_periodic_runs": OP11, "op12_decontamination": OP12, "op13_hard_negatives": OP13}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
