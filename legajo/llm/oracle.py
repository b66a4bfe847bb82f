"""DuckDB SQL of the operators whose results it can tell exactly, over the whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Smallest node reachable over ``edges`` (a, b, in either direction) of each node.
_REACH = """
reach(node, other) as (
  select a, b from edges
  union
  select r.node, e.b from reach r join edges e on e.a = r.other
),
least as (select node, min(other) as least from reach group by node)"""

JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') as w from documents
),
shingles as (
  select distinct doc_id, md5(array_to_string(w[i:least(i + 4, len(w))], ' ')) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
met as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
),
edges as (
  select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
),
{_REACH}
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join least on node = d.doc_id
"""

SUBSTRING = f"""
with words as (select doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) as w from documents),
each as (
  select doc_id, i, w[i] as word, case when i + 49 <= len(w) then md5(array_to_string(w[i:i + 49], ' ')) end as k
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)
),
firsts as (select k, min(doc_id) as first from each where k is not null group by k),
marked as (select e.doc_id, i, word, coalesce(first < e.doc_id, false) as again from each e left join firsts f on f.k = e.k),
covered as (select doc_id, i, word, max(again) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from marked),
done as (
  select doc_id, count(*) as n, count_if(gone) as g, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept
  from covered group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(g, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join done using (doc_id)
"""

EMBEDDINGS = f"""
with recursive units as (
  select vec_id, list_transform(v, lambda x: x / norm) as u
  from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from (select vec_id, embedding::double[] as v from embeddings))
  where norm > 0 and isfinite(norm) and len(list_filter(v, lambda x: x is null)) = 0
),
edges as (
  select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id and len(a.u) = len(b.u)
  where list_inner_product(a.u, b.u) >= 0.9
),
{_REACH},
counts as (select a, count(*) as n from edges group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(least, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(least, e.vec_id)) as kept
from embeddings e left join least on node = e.vec_id left join counts on counts.a = e.vec_id
"""

SQL = {"op3_jaccard_join": JACCARD, "op4_substring_dedup": SUBSTRING, "op6_embedding_dedup": EMBEDDINGS}
