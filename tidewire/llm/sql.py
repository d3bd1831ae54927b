"""SQL for the queries of this subpackage that it can express."""

RULES = r"""
with split as (
  select doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
words as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
windows as (
  select doc_id, i, case when lead(w, 4) over o is not null then concat_ws(
           chr(1), w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) end as five
  from words window o as (partition by doc_id order by i)),
counted as (
  select doc_id, i, five is not null and count(*) over (partition by doc_id, five) > 1 as twice from windows),
covered as (
  select doc_id, max(twice::int) over (partition by doc_id order by i rows between 4 preceding and current row) as c
  from counted),
repeated as (select doc_id, sum(c)::bigint as n from covered group by 1),
stats as (
  select doc_id, coalesce('=' || source, '-') as host, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         (length(t) - length(replace(t, '!', '')))::bigint as n_calls
  from split left join repeated using (doc_id)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or 2 * n_calls > n_words
           or word_chars > 12 * n_words or 5 * word_chars < 10 * n_words as beyond_1,
         10 * n_symbols > 2 * n_words or 10 * n_dup_lines > 6 * n_lines or 2 * n_calls > 2 * n_words
           or word_chars > 24 * n_words or 10 * word_chars < 10 * n_words as beyond_2
  from stats),
hosts as (
  select host, count(*)::double as n, sum((base_failed or beyond_1)::int)::double as f from judged group by 1),
total as (
  select count(*) as h, sum(n) as n, sum(f) as f, sum(f * f / n) as ff, sum(n * n) as nn, sum(f) / sum(n) as m from hosts),
prior as (
  select m, case when h > 1 and m > 0 and m < 1 then least(greatest(m * (1 - m) / greatest(
           (ff - n * m * m - (h - 1) * m * (1 - m)) / greatest(n - nn / n, 1e-9), 1e-9) - 1, 2.0), 10000.0)
         else 10.0 end as k
  from total),
rates as (select host, (f + m * k) / (n + k) as rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (case when rate > 0.5 then beyond_1 else beyond_2 end) as kept
from judged join rates using (host)
"""

_REACH = """
reach(id, r) as (
  select id, id from nodes
  union
  select l.b, reach.r from reach join links l on l.a = reach.id)
"""

NEARDUP = rf"""
with recursive words as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n
  from (select doc_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x20\x09-\x0D]+') as ws from documents)),
windows as (
  select doc_id, n, concat_ws(chr(1), w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o) as s,
         lead(w, 4) over o is not null or (n < 5 and i = 1) as whole
  from words window o as (partition by doc_id order by i)),
sets as (select distinct doc_id, s from windows where whole),
sizes as (select doc_id, count(*) as n from sets group by 1),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
nodes as (select doc_id as id from documents),
{_REACH}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id)
join (select id, min(r) as component_id from reach group by 1) c on c.id = d.doc_id
"""

LATTICE = f"""
with recursive links as (
  select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b
    on a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.95),
nodes as (select vec_id as id from embeddings),
{_REACH}
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join (select id, min(r) as component_id from reach group by 1) c on c.id = vec_id
"""

REPEATS = r"""
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
parts as (
  select doc_id, n, b, substring(h, 2 * b + 1, 1000) as h
  from (select doc_id, n, h, unnest(range(0, n - 99, 400)) as b from docs where n >= 100)),
places as (select doc_id, b, h, unnest(range(least(400, n - b - 99))) as p from parts),
ranked as (
  select doc_id, b + p as p, row_number() over (partition by substring(h, 2 * p + 1, 200) order by doc_id, b + p) as k from places),
begun as (
  select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 100, true) as fresh from ranked where k > 1),
numbered as (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as span from begun),
spans as (select doc_id, min(p) as s, max(p) + 100 as e from numbered group by doc_id, span),
pieces as (
  select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as b from spans),
cuts as (
  select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans, max(e) as last,
         string_agg(substring(h, 2 * b + 1, 2 * (s - b)), '' order by s) as kept
  from pieces join docs using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from docs left join cuts using (doc_id)
"""


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar)) || ':' || {value}::varchar, '-')"


_HEAD = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
# The lowest bit of a CRC-32 is the inverse of that of the last remainder.
_EVEN = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) & 1 = 1"""


def _levels(name: str, leaves: str) -> str:
    return f"""
{name}(k, lvl, i, n, d) as (
  select k, 0, i, n, d from {leaves}
  union all
  select k, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from {name} where n > 1
  group by k, lvl, i // 3, n)"""


MERKLE = rf"""
with recursive hashed as (
  select doc_id, coalesce('=' || source, '') as k, sha256({_HEAD} || {_framed("text")}) as leaf,
         case when {_EVEN} and text is not null
              then sha256({_HEAD} || {_framed("replace(text, chr(10), '')")}) end as tampered
  from documents),
leaves as (
  select *, row_number() over (partition by k order by doc_id, leaf) - 1 as i, count(*) over (partition by k) as n, leaf as d
  from hashed),
{_levels("low", "leaves")},
tops as (
  select k as group_key, '' as k, row_number() over (order by encode(k)) - 1 as i, count(*) over () as n, d from low where n = 1),
{_levels("high", "tops")},
nodes as (
  select 'l' || k as k, lvl, i, n, d from low union all select 'h' as k, lvl, i, n, d from high),
folded(doc_id, leaf, k, phase, lvl, i, d) as (
  select doc_id, leaf, k, 'l' || k, 0, i, coalesce(tampered, leaf) from leaves
  union all
  select f.doc_id, f.leaf, f.k, f.phase, f.lvl + 1, f.i // 3,
         sha256(string_agg(case when x.i = f.i then f.d else x.d end, '' order by x.i))
  from folded f join nodes x on x.k = f.phase and x.lvl = f.lvl and x.n > 1 and x.i // 3 = f.i // 3
  group by f.doc_id, f.leaf, f.k, f.phase, f.lvl, f.i),
subfolded as (
  select f.doc_id, f.leaf, t.i, t.d as subroot, f.d
  from folded f join (select k, max(lvl) as lvl from low group by k) m on m.k = f.k and m.lvl = f.lvl
  join tops t on t.group_key = f.k),
crowned(doc_id, leaf, subroot, lvl, i, d) as (
  select doc_id, leaf, subroot, 0, i, d from subfolded
  union all
  select f.doc_id, f.leaf, f.subroot, f.lvl + 1, f.i // 3,
         sha256(string_agg(case when x.i = f.i then f.d else x.d end, '' order by x.i))
  from crowned f join high x on x.lvl = f.lvl and x.n > 1 and x.i // 3 = f.i // 3
  group by f.doc_id, f.leaf, f.subroot, f.lvl, f.i),
beside as (
  select l.doc_id, l.leaf, 0 as phase, x.lvl, x.i, x.d
  from leaves l join low x on x.k = l.k and x.n > 1
   and x.i // 3 = l.i // (3 ** (x.lvl + 1))::bigint and x.i <> l.i // (3 ** x.lvl)::bigint
  union all
  select l.doc_id, l.leaf, 1, x.lvl, x.i, x.d
  from leaves l join tops t on t.group_key = l.k join high x on x.n > 1
   and x.i // 3 = t.i // (3 ** (x.lvl + 1))::bigint and x.i <> t.i // (3 ** x.lvl)::bigint),
proofs as (
  select doc_id, leaf, sha256(string_agg(d, '' order by phase, lvl, i)) as proof_sha256 from beside group by doc_id, leaf),
root as (select d as root from high where n = 1)
select c.doc_id, c.leaf, c.subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, c.d as folded_root,
       c.d = root as verified
from crowned c cross join root left join proofs p on p.doc_id = c.doc_id and p.leaf = c.leaf
where c.lvl = (select max(lvl) from high)
"""
