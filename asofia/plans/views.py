"""The derived tables of ``sources.corpus`` in DuckDB's SQL, as common table expressions."""

from __future__ import annotations

from asofia.functions.stemmer import stem_sql as stem
from asofia.functions.text import STOPWORDS

STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


VIEWS = {
    "docs": r"""
      docs0 as (
        select doc_id, cast(doc_id as varchar) as source_id, substr(split_part(text, chr(10), 1), 1, 80) as title, source as department,
          ['circular', 'master_direction', 'notification'][doc_id % 3 + 1] as doc_type,
          date '2015-01-01' + cast((doc_id * 37) % 3650 as integer) as issued_date,
          timestamp '2024-01-01' + to_hours(doc_id) as created_at, text
        from documents
      ),
      docs as (
        select *, issued_date + (case when doc_id % 7 = 0 then 30 else 0 end) as valid_from,
          case when doc_id % 4 = 0 then issued_date + cast((case when doc_id % 7 = 0 then 30 else 0 end) + 200 + (doc_id * 13) % 700 as integer) end as valid_to,
          doc_id % 4 = 0 or doc_id % 31 = 0 as is_withdrawn
        from docs0
      )""",
    "questions": r"""
      questions as (
        select item_id as qid, text as question, [date '2026-10-04', date '2019-01-01', date '2022-01-01'][item_id % 3 + 1] as as_of from benchmark
      )""",
    "edges": r"""
      edges as (
        select distinct l_orderkey % n as src, l_partkey % n as dst, ['amends', 'supersedes', 'repeals', 'refers'][l_linenumber % 4 + 1] as type,
          case when l_linenumber % 2 = 0 then 'link' else 'regex' end as method
        from lineitem, (select max(doc_id) + 1 as n from documents) where l_orderkey % n <> l_partkey % n
      )""",
    "postings": r"""
      tokens as (
        select doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') as a, regexp_extract_all(lower(text), '[a-z0-9]+') as b from docs
      ),
      postings as (
        select doc_id, unnest(a) as term, 1.0::double as weight, unnest(range(1, len(a) + 1)) as pos from tokens
        union all
        select doc_id, unnest(b), 0.4::double, unnest(range(1, len(b) + 1)) + len(a) from tokens
      )""",
    "terms": f"""
      words as (
        select distinct qid, term from (select qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from questions) where term not in {STOP}
      ),
      df as (select term, count(distinct doc_id) as df from postings group by term),
      vocab as (select term, {stem("term")} as stem from (select distinct term from postings) where term not in {STOP}),
      terms as (select qid, stem, term from (select distinct qid, {stem("term")} as stem from words) join vocab using (stem))""",
    "scored": r"""
      hits as (
        select t.qid, p.doc_id, p.pos, p.weight, p.pos - lag(p.pos) over (partition by t.qid, p.doc_id order by p.pos) as gap
        from terms t join postings p using (term)
      ),
      scored as (
        select h.qid, h.doc_id, round(sum(weight) / ln(1 + any_value(len(a) + len(b))) * (case when count(*) > 1 then sum(1.0 / gap) / count(*) else 1 end), 9) as score
        from hits h join tokens using (doc_id) group by h.qid, h.doc_id
      )""",
    "vectors": r"""
      vecs as (
        select vec_id, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings
      ),
      near as (
        select q.vec_id as qid, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::double * z[2]::double)), 6) as cosine
        from embeddings q join embeddings v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id
      )""",
}
#: What each view builds on.
NEEDS = {"postings": ["docs"], "terms": ["questions", "postings"], "scored": ["terms"]}


def sql(query: str, *views: str, **extra: str) -> str:
    """A query after the views it names, those they build on first, and further expressions of its own."""
    order: list[str] = []

    def add(view: str) -> None:
        for need in NEEDS.get(view, []):
            add(need)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    parts = [VIEWS[v] for v in order] + [f"{name} as ({body})" for name, body in extra.items()]
    return ("with recursive " + ",\n".join(parts) if parts else "") + "\n" + query
