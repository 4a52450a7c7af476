"""DuckDB SQL of queries of this subpackage whose results SQL can express."""

from __future__ import annotations

from siltstone.llm.mixing import report_sql as mixing_sql
from siltstone.llm.prefix_trie import REPORT_SQL as TRIE
from siltstone.llm.quality_rules import report_sql as quality_sql

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
with recursive words as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id join sizes s on s.doc_id = x.doc_id join sizes t on t.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, s.n, t.n having 100 * count(*) >= 85 * (s.n + t.n - count(*))
), reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a)
select words.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, least(words.doc_id, min(b)) as component_id
from words left join sizes using (doc_id) left join reach on a = words.doc_id group by words.doc_id
"""

ARCHIVE = """
with hashed as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
dated as (select *, min(page_id) over (partition by x, payload_bytes) as first from hashed),
coded as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::int) as v from dated)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from coded
"""

#: For pages that mark their article and separate its blocks by p and h1 alone, as the tables here do.
MAIN_TEXT = r"""
with article as (select page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|\z)', 1), '<[a-zA-Z/!][^>]*\z', '') as a from pages),
parts as (
  select page_id, url, list_transform(string_split_regex(a, '</?(p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]+>', '', 'g')) as p from article
), decoded as (
  select page_id, url, list_transform(p, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) as p from parts
), joined as (select page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), chr(10)) as text from decoded)
select page_id, url, text, length(text) as n_chars from joined
"""

DECONTAMINATION = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select coalesce(item_id::varchar, '') as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
patterns as (
  select distinct item, size, array_to_string(w[i : i + size - 1], ' ') as g
  from (select item, w, least(len(w), 10) as size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)
), lengths as (select distinct size from patterns),
starts as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as i, w from dw join lengths on len(w) >= size),
found as (select doc_id, i, patterns.size, item from starts join patterns on patterns.size = starts.size and g = array_to_string(w[i : i + starts.size - 1], ' ')),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hits using (doc_id) left join items using (doc_id)
"""

SQL = {
    "op1_count_vector_join": JACCARD,
    "op2_arc_to_warc": ARCHIVE,
    "op3_wrapper_main_text": MAIN_TEXT,
    "op6_risk_controlled_rules": quality_sql(),
    "op8_wu_manber_decontamination": DECONTAMINATION,
    "op10_source_mixing": mixing_sql(),
    "op12_family_prefix_trie": TRIE,
}
