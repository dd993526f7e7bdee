"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .mixing import SEEDS

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_P = 2147483647


def _draw(doc: str, seed: str) -> str:
    x = f"(((coalesce({doc}, 0) % {_P}) + {_P}) % {_P})"
    a = f"(({x} * 48271 + ({seed} + 1) * 1234577) % {_P})"
    b = f"(({a} * {a} + {a} * 3 + {seed}) % {_P})"
    return f"((({b} * {b} + 16807 * {b} + 7) % {_P}) / {_P}.0::double)"


OP6 = f"""
with d as (select doc_id, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 12))::bigint) as k, source, {_WORDS}::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w, source_size * 3 as cap from s),
f as (select *, cap::double / w as full_at from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(w) over () - coalesce(sum(w) over o, 0))::double as level from f
      window o as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(w * coalesce((select max(level) from l where level <= full_at), full_at), cap::double) as target from l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
k as (select range::bigint as seed from range({SEEDS})),
tried as (select r.source, k.seed, abs(sum(case when {_draw('d.k', 'k.seed')} < r.rate - floor(r.rate) then d.size else 0 end)
            + floor(any_value(r.rate)) * any_value(r.source_size) - any_value(r.target)) as miss
          from d join r on d.source is not distinct from r.source cross join k group by r.source, k.seed),
best as (select source, seed from tried qualify row_number() over (partition by source order by miss, seed) = 1)
select d.doc_id, d.size, r.source_size, r.target,
       ((floor(r.rate) + case when {_draw('d.k', 'b.seed')} < r.rate - floor(r.rate) then 1 else 0 end) * d.size)::bigint as taken
from d join r on d.source is not distinct from r.source join best b on d.source is not distinct from b.source
"""

_OWN = "</s>[INST] ok [/INST]"
_MARKS = "(length({0}) - length(replace(replace({0}, '<', ''), '[', '')))"
OP4 = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '{_OWN}' union all select -1, 1, 'assistant', '{_OWN}'),
g as (select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text) as loss,
        sum(12 + length(role) + {_MARKS.format("role")} + 1 + length(text) + {_MARKS.format("text")} + 11)::bigint as formatted_chars from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

_LANES = "range(0, 120)"


def _vector(units: str) -> str:
    """A lane i is bit s + 20 * k of hash word h, where k = i // 40, h = i % 40 // 20 and s = i % 20."""
    halves = [f"list_transform({units}, lambda u: ('0x' || substr(md5(u), {at}, 15))::bigint)" for at in (1, 16)]
    bit = "(list_extract(w, 1 + i % 40 // 20) >> (i % 20 + 20 * (i // 40))) & 1"
    pairs = f"list_transform(list_zip({halves[0]}, {halves[1]}), lambda z: [z[1], z[2]])"
    lanes = f"list_transform({_LANES}, lambda i: coalesce(list_sum(list_transform({pairs}, lambda w: 2 * ({bit}) - 1)), 0)::bigint)"
    residues = [f"(coalesce(list_sum(list_transform({x}, lambda v: v::hugeint)), 0) % 1152921504606846976)::bigint" for x in halves]
    return f"list_concat({lanes}, [{residues[0]}, {residues[1]}, len({units})::bigint])"


def _like(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product({x}[1:120]::double[], {y}[1:120]::double[])"
    norm = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"case when {a} = {b} then 1.0 when {norm} > 0 then round(greatest(0.0, least(1.0, {dot(a, b)} / {norm})), 9) else 0.0 end"


_UNITS = r"list_filter(list_transform(regexp_extract_all({0}, '[^\n.!?]{{1,64}}[.!?]{{0,64}}|[.!?]{{1,64}}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"
_JOINED = "array_to_string({0}, ',')"
OP7 = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, length(text)::bigint as n, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as following from d),
e as (select *, left(text, (n - n // 3)::int) || left(following, (n // 3)::int) as edited from n),
u as (select *, {_UNITS.format("text")} as a, {_UNITS.format("edited")} as b, {_UNITS.format("following")} as c from e),
w as (select doc_id, n, edited, {_vector("a")} as x, {_vector("b")} as y, {_vector("c")} as z from u)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, {_JOINED.format("x")} as fingerprint, {_JOINED.format("y")} as edited_fingerprint,
       {_like("x", "y")} as near_edited, {_like("x", "z")} as near_next from w
"""

OP10 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as same from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * same >= 85 * (x.n + y.n - same)),
e as (select u, v from l union select v, u from l),
r as (select u, v from e union select r.u, e.v from r join e on e.u = r.v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join (select u, min(v) as least from r group by u) m on m.u = d.doc_id
"""

OP12 = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
n as (select *, octet_length(b)::bigint as n from d),
p as (select r, b, unnest(range(0, n - 199)) as i from n where n >= 200),
w as (select r, i, count(*) over (partition by b[i + 1 : i + 200]) as often from p),
e as (select r, i, i > coalesce(lag(i) over (partition by r order by i) + 200, -1) as new from w where often > 1),
g as (select r, i, sum(new::int) over (partition by r order by i) as g from e),
s as (select r, min(i) as a, max(i) + 200 as z from g group by r, g),
k as (select r, a, z, coalesce(lag(z) over (partition by r order by a), 0) as from_, row_number() over (partition by r order by a desc) as back from s),
h as (select k.r, sum(z - a)::bigint as n_removed, count(*)::bigint as n_spans,
        string_agg(hex(b[from_ + 1 : a]), '' order by a) || any_value(hex(b[z + 1 : n])) filter (where back = 1) as kept from k join n on n.r = k.r group by k.r)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(case when h.r is null then b else unhex(kept) end) as kept_sha256
from n left join h on h.r = n.r
"""

_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, 8 * length(c::varchar)), lambda k: (case when k % 8 = 0 then ord(substr(c::varchar, (k // 8 + 1)::int, 1)) else 0 end)::bigint)),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
OP13 = f"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null),
s as (select c, count(*) as n, {_CRC} % 4 as h, c - c % 20 as b from t group by c),
u as (select s.c, t.n as d, t.role, t.text from s join t on t.c = s.b and t.n <= s.h
      union all select s.c, t.n - s.h + least(s.h, coalesce(f.n, 0)), t.role, t.text from s join t on t.c = s.c and t.n > s.h left join s f on f.c = s.b),
p as (select c, d, {_WORDS} as w, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by d) over (partition by c order by d) as k from u union all select c, 0, 0, '' from s),
n as (select d, k, min(c) as conv_id, count(*) as n_convs, any_value(w) as w from p group by d, k),
m as (select p.c, p.d, n.conv_id as top from p join n on n.d = p.d and n.k = p.k),
v as (select n.*, m.top as parent from n left join m on m.c = n.conv_id and m.d = n.d - 1),
ch as (select parent as conv_id, d - 1 as d, count(*) as n_children from v where d > 0 group by 1, 2),
x as (select v.*, coalesce(ch.n_children, 0) as n_children from v left join ch on ch.conv_id = v.conv_id and ch.d = v.d),
sub as (select m.top as conv_id, m.d, sum((x.n_children = 0)::int)::bigint as n_leaves, sum((x.n_convs - 1) * x.w)::bigint as saved_tokens from x join m on m.c = x.conv_id and m.d <= x.d group by 1, 2),
l as (select c, max(d) as d from p group by c),
e as (select m.top as conv_id, m.d, sha256(string_agg(l.c::varchar, ',' order by l.c)) as ends from l join m on m.c = l.c and m.d = l.d group by 1, 2)
select x.conv_id, x.d::bigint as depth, x.parent as parent_conv_id, x.n_convs, x.n_children, sub.n_leaves, sub.saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from x join sub on sub.conv_id = x.conv_id and sub.d = x.d left join e on e.conv_id = x.conv_id and e.d = x.d
"""

ORACLES = {"op4_chat_format": OP4, "op6_mixing": OP6, "op7_fingerprints": OP7, "op10_ngram_jaccard": OP10, "op12_suffix_dedup": OP12, "op13_prefix_trie": OP13}
