"""DuckDB SQL for the queries that SQL can express."""

URLS = r"""
with cut as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select row_number() over () as r, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), rules(h, p, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
  select r, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc, length(h) desc) as k
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict
from parts left join fits on parts.r = fits.r and k = 1
"""

CHATS = r"""
with placed as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as place from conversations
), convs as (
  select conv_id, list(row(turn, role, text) order by place) as turns, count(*) as n from placed group by conv_id
), groups as (
  select min(conv_id) as conv_id, turns, n, count(*) as copies from convs group by turns, n
), kept as (
  select g.conv_id, g.turns, g.n from groups g
  where not exists (select 1 from groups l where l.turns[1] = g.turns[1] and l.n > g.n and l.turns[1:g.n] = g.turns)
), stood as (
  select k.conv_id, k.n, sum(g.copies)::bigint as n_snapshots from kept k join groups g on g.turns[1] = k.turns[1] and g.n <= k.n and k.turns[1:g.n] = g.turns group by k.conv_id, k.n
)
select conv_id, (place - 1) // 1024 as part, s.n as n_turns, n_snapshots,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by place) as rendered
from placed join stood s using (conv_id) group by conv_id, (place - 1) // 1024, s.n, n_snapshots
"""

#: DuckDB's sha1 of a string is that of its UTF-8 bytes.
WARC = r"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select payload_digest, payload_bytes, max(page_id) as first from p where payload_bytes >= 1000 group by all
)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p left join g using (payload_digest, payload_bytes)
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), x as (
  select doc_id, len(g) as n, unnest(g) as g from s
), p as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from p where 100 * c >= 75 * (an + bn - c)
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
)
select doc_id, len(g)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id from s
"""


def _covered(n: int) -> str:
    """Words in n-word windows that the text holds twice or more."""
    return f"""
  c{n} as (
    select doc_id, i, length(x) as size, max(again) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as hit from (
      select doc_id, i, x, g is not null and count(*) over (partition by doc_id, g) > 1 as again from (
        select doc_id, i, w[i] as x, case when i + {n - 1} <= len(w) then array_to_string(w[i:i + {n - 1}], ' ') end as g from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)))
  ),
  s{n} as (select doc_id, count(case when hit then 1 end) as words, coalesce(sum(case when hit then size end), 0) as chars from c{n} group by doc_id)"""


def rules(limits: dict[int, float], line_limit: float) -> str:
    grams = sorted({3, *limits})
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w from documents
), l as (
  select doc_id, x, row_number() over (partition by doc_id, x order by i) as k, length(array_to_string(regexp_extract_all(x, {_WORDS}), '')) as size
  from (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from d)
), lines as (
  select doc_id, count(*) as n, sum(size) as chars from l where size > 0 and k > 1 group by doc_id
), {",".join(map(_covered, grams))}
select *, not base_failed and line_chars <= {line_limit} * word_chars {" ".join(f"and chars_{n}gram <= {x} * word_chars" for n, x in limits.items())} as kept
from (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(s3.words, 0)::bigint as n_repeat_words, len(w) < 50 or 100 * coalesce(s3.words, 0) > 50 * len(w) as base_failed,
    coalesce(lines.chars, 0)::bigint as line_chars, {", ".join(f"coalesce(s{n}.chars, 0)::bigint as chars_{n}gram" for n in limits)}
  from d left join lines using (doc_id) {" ".join(f"left join s{n} using (doc_id)" for n in grams)}
)
"""


def _assigned(k: int) -> str:
    return f"""
  a{k} as (
    select r, vec_id, x, c, d from (
      select v.r, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{k} c
    ) qualify row_number() over (partition by r order by d, c) = 1
  )"""


def _moved(k: int) -> str:
    """Componentwise floor of the mean; a centroid without vectors stays."""
    return f"""
  m{k} as (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from (
      select c, i, sum(y) as s, count(*) as n from (select c, unnest(x) as y, unnest(range(64)) as i from a{k}) group by c, i
    ) group by c
  ), c{k + 1} as (select c.c, coalesce(m.x, c.x) as x from c{k} c left join m{k} m on m.c = c.c)"""


def centroids(clusters: int, rounds: int) -> str:
    steps = ",".join(f"{_assigned(k)},{_moved(k)}" for k in range(rounds))
    return f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as (
  select (row_number() over (order by sha256('1:' || vec_id)) - 1)::integer as c, x from v qualify c < {clusters}
), {steps}, {_assigned(rounds)}
select vec_id, c as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(k.x, ',')) as centroid_sha256
from a{rounds} join c{rounds} k using (c)
"""


_CODED = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
#: CRC-32 of decimal digits, bit by bit: a byte comes in, then the register is shifted eight times.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295)"""


def _levels(name: str, base: str, tree: str) -> str:
    """All nodes of a forest, level by level, and what stands beside each of its leaves on the way up."""
    return f"""
  {name}_nodes as (
    select {tree} as tree, 0 as level, pos, n, h from {base}
    union all
    select tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos)) from {name}_nodes where n > 1 group by tree, level, pos // 3
  ), {name}_steps as (
    select b.r, s.level, coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos < b.pos // pow(3, s.level)::bigint), '') as lft,
      coalesce(string_agg(s.h, '' order by s.pos) filter (where s.pos > b.pos // pow(3, s.level)::bigint), '') as rgt
    from {base} b join {name}_nodes s on s.tree is not distinct from b.{tree} and s.n > 1 and s.pos // 3 = b.pos // pow(3, s.level + 1)::bigint group by b.r, s.level
  )"""


MANIFEST = f"""
with recursive d as (
  select row_number() over () as r, doc_id, source, sha256({" || ".join(_CODED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) as h,
    case when {_CRC32} % 2 = 0 then sha256({" || ".join(_CODED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))}) end as other
  from documents
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by source) as n from d
), {_levels("low", "leaves", "source")}, subroots as (
  select row_number() over (order by tree nulls first) as r, tree as source, h, row_number() over (order by tree nulls first) - 1 as pos, count(*) over () as n, 0 as every from low_nodes where n = 1
), {_levels("top", "subroots", "every")}, steps as (
  select r, level, lft, rgt from low_steps
  union all
  select l.r, 1000 + t.level, lft, rgt from leaves l join subroots s on l.source is not distinct from s.source join top_steps t on t.r = s.r
), paths as (
  select r, string_agg(lft || rgt, '' order by level) as beside, list(lft || '|' || rgt order by level) as path from steps group by r
), found as (
  select doc_id, l.h as leaf, s.h as subroot, t.h as root, sha256(coalesce(beside, '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(other, l.h), coalesce(path, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
  from leaves l join subroots s on l.source is not distinct from s.source join top_nodes t on t.n = 1 left join paths p on p.r = l.r
)
select *, folded_root = root as verified from found
"""
