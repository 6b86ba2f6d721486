"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(right(p, 3) as int), 0) > 255)) = 0"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(g) between 13 and 19 and list_sum(list_transform(range(1, length(g) + 1), lambda i: case when i % 2 = 1 then cast(substring(g, length(g) + 1 - i, 1) as int)"
        " when cast(substring(g, length(g) + 1 - i, 1) as int) > 4 then 2 * cast(substring(g, length(g) + 1 - i, 1) as int) - 9 else 2 * cast(substring(g, length(g) + 1 - i, 1) as int) end)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) between 9 and 15"),
}


def _places(pattern: str) -> str:
    """(doc_id, i, v, s, e): matches of a pattern and where they lie, from the lengths of matches and of what lies between."""
    return f"""select doc_id, i, v, sum(length(gap) + length(v)) over (partition by doc_id order by i) - length(v) s, sum(length(gap) + length(v)) over (partition by doc_id order by i) e
  from (select doc_id, unnest(vs) v, unnest(gaps[1:len(vs)]) gap, generate_subscripts(vs, 1) i
    from (select doc_id, regexp_extract_all(t, '{pattern}') vs, string_split_regex(t, '{pattern}') gaps from d))"""


PRIVATE = f"""
with d as (
  select doc_id, coalesce(text, '') t from documents
), base as (
  {" union all ".join(f"select {n} k, '{kind}' kind, doc_id, s, e, case when '{kind}' in ('email', 'ip') then lower(v) else g end plain from (select *, regexp_replace(v, '[^0-9]', '', 'g') g from ({_places(p)})) where {ok}" for n, (kind, (p, ok)) in enumerate(_KINDS.items()))}
), held as (
  select distinct doc_id, kind || ':' || plain entity from base
), holders as (
  select entity, count(*) n_e from held group by entity having count(*) >= 3
), spoken as (
  {_places(r"\p{L}{4,}")}
), words as (
  select distinct doc_id, lower(v) term from spoken
), known as (
  select term, count(*) n_t from words group by term
), seen as (
  select entity, n_e, term, count(*) n_te from held join holders using (entity) join words using (doc_id) group by all having count(*) >= 3
), told as (
  select entity, term, round(1 - log2(greatest(n_t, n_te) / n_te) / log2((select count(*) from d) / n_e), 9) share from seen join known using (term) where n_e < (select count(*) from d)
), marked as (
  select p.doc_id, p.i, any_value(p.s) s, any_value(p.e) e, any_value(p.v) v, max(share) share
  from spoken p join held h using (doc_id) join told o on o.entity = h.entity and o.term = lower(p.v) and share >= 0.75 group by p.doc_id, p.i
), terms as (
  select m.* from marked m where not exists (select 1 from base b where b.doc_id = m.doc_id and b.s <= m.s and m.e <= b.e)
), spans as (
  select k, kind, doc_id, s, e, '[' || upper(kind) || ']' put from base
  union all select 4, 'term', doc_id, s, e, case when share >= 0.9 then '' when v = upper(v) then '[ACRONYM]' when v[1] <> lower(v[1]) then '[NAME]' else '[WORD]' end from terms
), ordered as (
  select *, coalesce(max(e) over (partition by doc_id order by s, e, put rows between unbounded preceding and 1 preceding), 0) at_, row_number() over (partition by doc_id order by s, e, put) r from spans
), texts as (
  select o.doc_id, coalesce(string_agg(substring(t, cast(at_ + 1 as bigint), cast(s - at_ as bigint)) || put, '' order by r) filter (s >= at_), '') || substring(any_value(t), cast(max(e) + 1 as bigint)) body
  from ordered o join d using (doc_id) group by o.doc_id
), sums as (
  select doc_id, {", ".join(f"count_if(kind = '{k}') n_{k}" for k in [*_KINDS, "term"])},
    string_agg(kind || ':' || s || ':' || e, ',' order by k, s) filter (k < 4) base, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) every from spans group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in [*_KINDS, "term"])}, sha256(coalesce(base, '')) base_sha256, coalesce(every, '') spans, sha256(coalesce(body, t)) sanitised_sha256
from d left join sums using (doc_id) left join texts using (doc_id)"""

MIXING = r"""
with rows as (
  select doc_id, source, size, ('0x' || substr(md5('4:' || size || ':' || coalesce(cast(doc_id as varchar), 'null:' || coalesce(text, ''))), 1, 8))::bigint k
  from (select *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents)
), sources as (
  select source, sum(size) s, ([3, 1, 2]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight from rows group by source
), full_first as (
  select *, row_number() over (order by 2.0::double * s / weight, source nulls last) r from sources
), units as (
  select *, (1.5::double * sum(s) over () - 2.0::double * coalesce(sum(s) over (order by r rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by r rows between current row and unbounded following) unit
  from full_first
), plan as (
  select source, s, least(2.0::double * s, (select unit from units where unit * weight <= 2.0::double * s order by r limit 1) * weight) target from units
), places as (
  select rows.*, cast(s as bigint) source_size, target, case when s > 0 then cast(floor(target / s) as bigint) else 0 end epochs,
    cast(coalesce(sum(size) over (partition by rows.source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as bigint) before
  from rows join plan on rows.source is not distinct from plan.source
)
select doc_id, size, source_size, target,
  cast(case when source_size > 0 then epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * source_size - before)) else 0 end as bigint) taken
from places"""


ORACLES: dict[str, str] = {
    "op3_private": PRIVATE,
    "op4_mixing": MIXING,
    "op2_repeats": r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') s from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)
), hit as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) least from windows) where least < doc_id
), each as (
  select doc_id, unnest(w) word, generate_subscripts(w, 1) j from d
), marked as (
  select e.*, max(case when h.i is null then 0 else 1 end) over (partition by e.doc_id order by e.j rows between 49 preceding and current row) gone
  from each e left join hit h on h.doc_id = e.doc_id and h.i = e.j
), sums as (
  select doc_id, count(*) n_words, count_if(gone = 1) n_removed, string_agg(word, ' ' order by j) filter (gone = 0) kept from marked group by doc_id
)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join sums using (doc_id)""",
    "op7_exact": """
select doc_id, max(doc_id) over same keep_id, count(*) over same group_size, doc_id = max(doc_id) over same kept, sha256(coalesce(text, '')) text_sha256
from documents window same as (partition by coalesce(text, ''))""",
    "op8_lines": f"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents
), l as (
  select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from d
), k as (
  select *, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l
), common as (
  select key, max(doc_id) top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.*, coalesce(top <> doc_id, false) gone from k left join common using (key)
)
select doc_id, count(*) n_lines, count_if(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from marked group by doc_id""",
}
