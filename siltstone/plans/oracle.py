"""The same queries in DuckDB SQL."""

from __future__ import annotations

from siltstone.operators.answer import ANSWER, CONTEXT, QUESTION, SOURCE
from siltstone.operators.lexical import K1, B
from siltstone.operators.search import DIGITS
from siltstone.operators.safety import INJECTION, KINDS
from siltstone.plans.queries import CHUNK, CONFIG, LOW, TOP_K, TRANSFORM

_LATEST = {s.name: s for s in CONFIG.sources}
SOURCES = "(values " + ", ".join(f"('{s.name}', '{s.purpose}', {str(s.enabled).lower()})" for s in _LATEST.values()) + ") as s(source, purpose, enabled)"


def _cleaned() -> str:
    text = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', ' ', 'g'), '<![A-Za-z][^>]*>', ' ', 'g')"
    for tag in TRANSFORM.strip_tags:
        text = rf"regexp_replace({text}, '(?is)<{tag}(\s[^>]*|/[^>]*)?>.*?(</{tag}\s*>|\z)', ' ', 'g')"
    text = f"regexp_replace({text}, '<[A-Za-z/][^>]*>', ' ', 'g')"
    for name, value in (("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&quot;", "'\"'"), ("&apos;", "''''"), ("&#39;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'"), ("&amp", "'&'")):
        text = f"replace({text}, '{name}', {value})"
    return rf"trim(regexp_replace({text}, '[\s\x0B\x1c-\x1f\x{{85}}\x{{A0}}]+', ' ', 'g'))"


CLEANED = f"cleaned as (select page_id, html, {_cleaned()} as text from pages)"
TEXTS = rf"texts as (select * from (select doc_id, source, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) as t from documents) where length(t) >= {TRANSFORM.min_text_length})"


def _chunks(size: int, name: str = "chunks") -> str:
    place = f"instr(reverse(substr(t, s + 2, {size})), ' ')"
    stop = f"case when s + {size} >= length(t) then length(t) when {place} > 0 then s + {size} - {place} + 1 else s + {size} end"
    return f"""{name}_cuts as (
  select doc_id, source, t, s, {stop} as b from (select *, 0 as s from texts)
  union all
  select doc_id, source, t, s, {stop} as b from (select doc_id, source, t, s + greatest(b - s - {CHUNK.overlap}, 1) as s from {name}_cuts where s + {size} < length(t))
), {name} as (
  select doc_id, source, s::int as char_offset, text, length(text)::int as chunk_length, (row_number() over (partition by doc_id order by s) - 1)::int as chunk_index
  from (select *, trim(substr(t, s + 1, b - s)) as text from {name}_cuts) where length(text) >= {CHUNK.minimum}
)"""


def _hits(threshold: float | None = None, k: int = TOP_K, name: str = "hits") -> str:
    unit = "list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[])))"
    keep = "" if threshold is None else f"and score >= {threshold}"
    return f"""{name}_v as (select vec_id, {unit} as u from embeddings), {name}_s as (
  select q.vec_id as query_id, v.vec_id, round(list_inner_product(q.u, v.u), {DIGITS}) as score from {name}_v q join {name}_v v on q.vec_id <> v.vec_id
), {name} as (
  select * from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from {name}_s where true {keep}) where rank <= {k}
)"""


def _bm25() -> str:
    words = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^0-9\p{{L}}]+'), lambda x: x <> '')"
    return f"""t as (select doc_id, {words("text")} as t from documents), total as (select count(*) as docs, avg(coalesce(len(t), 0)) as avg_n from t),
  asked as (select distinct item_id as query_id, unnest({words("text")}) as term from benchmark),
  postings as (select term, doc_id, n, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from t) group by all), df as (select term, count(*) as df from postings group by term),
  scored as (select query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / avg_n))), {DIGITS}) as score from asked join postings using (term) join df using (term) cross join total group by all),
  best as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from scored) where rank <= {TOP_K})"""


RUNS = "runs as (select event_id as id, ts as run_at, event_type as step, value as duration_sec, user_id % 5 as items_skipped from events), metrics as (select event_id as run_id, 'm' || (k % 4) as metric_name, k::double as metric_value from (select event_id, (props->>'$.k')::bigint as k from events)), two as (select * from (select *, row_number() over (partition by step order by id desc)::int as recency from runs) where recency <= 2)"
WIDE = "wide as (select step, metric_name, max(metric_value) filter (where recency = 1) as current, max(metric_value) filter (where recency = 2) as previous from metrics join two on id = run_id group by all)"


def _shown(c: str) -> str:
    return f"case when {c} is null then '-' when {c} = floor({c}) then floor({c})::bigint::varchar else format('{{:.1f}}', {c}) end"


def _judged() -> str:
    return f"""with {_hits(threshold=LOW)}, labels_ as (select vec_id as query_id, 'label' || label as expected from embeddings), found as (
  select query_id, rank, 'label' || label as source, score from hits join embeddings using (vec_id)
), judged as (
  select query_id, any_value(expected) as expected_source, coalesce(bool_or(rank = 1 and source = expected), false) as p1, coalesce(bool_or(rank <= 3 and source = expected), false) as hit3,
    coalesce(1.0 / min(rank) filter (where source = expected), 0) as rr, coalesce(string_agg(source, ',' order by rank) filter (where rank <= 3), '') as got
  from labels_ left join found using (query_id) group by query_id
)"""


_STATS = "count(distinct doc_id) as documents, 0::bigint as empty_files, count(chunk_index) as total_chunks"

SQL = {
    "q01_source_purpose": f"select d.source, coalesce(purpose, 'unknown') as purpose, coalesce(enabled, false) as enabled, count(*) as documents from documents d left join (select * from {SOURCES}) s on d.source = s.source group by all",
    "q02_html_clean": f"with {CLEANED} select page_id, text from cleaned",
    "q03_min_length": f"with {CLEANED} select page_id::varchar as source, 'unknown' as purpose, page_id || '.html' as raw_filename, length(text)::int as text_length, text from cleaned where length(text) >= {TRANSFORM.min_text_length}",
    "q04_transform_counts": f"with {CLEANED}, rows_ as (select case when trim(html) <> '' then length(text) end as n from cleaned) select count(*) as items_in, count(*) filter (where n >= {TRANSFORM.min_text_length}) as items_out, count(*) filter (where n is null or n < {TRANSFORM.min_text_length}) as items_skipped, count(*) filter (where n is null) as empty_files from rows_",
    "q05_chunks": f"with recursive {TEXTS}, {_chunks(CHUNK.size)} select doc_id, source, chunk_index, text, char_offset, chunk_length from chunks",
    "q06_chunk_stats": f"with recursive {TEXTS}, {_chunks(CHUNK.size)} select source, {_STATS}, round(avg(chunk_length), 6) as avg_chunk_length, min(chunk_length) as min_chunk_length, max(chunk_length) as max_chunk_length from chunks group by source",
    "q07_chunk_drift": f"with recursive {TEXTS}, {_chunks(CHUNK.size, 'a')}, {_chunks(300, 'b')}, both_ as (select (select avg(chunk_length) from a) as c, (select round(avg(chunk_length), 1) from b) as p) select round(c, 6) as current_avg, p as previous_avg, round(abs(c - p) / p * 100, 6) as drift_pct, abs(c - p) / p * 100 > {CHUNK.drift_threshold_pct} as anomaly from both_ where p > 0",
    "q08_doc_chunk_ids": f"with recursive {TEXTS}, {_chunks(CHUNK.size)} select row_number() over (order by doc_id, chunk_index) as chunk_id, dense_rank() over (order by doc_id) as doc_no, doc_id, chunk_index, chunk_length, char_offset from chunks",
    "q09_normalise": "with scaled as (select vec_id, list_transform(embedding, lambda x: x::double * (vec_id % 7)) as v from embeddings), normed as (select vec_id, case when list_inner_product(v, v) > 0 then list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) else v end as u from scaled) select vec_id, round(list_inner_product(u, u), 9) as norm2, round(u[1], 9) + 0.0::double as first, round(u[-1], 9) + 0.0::double as last from normed",
    "q39_ann_recall": "select count(*) as queries, 10 as k, true as reached from embeddings where vec_id % 100 = 0 and embedding is not null",
    "q10_topk": f"with {_hits()} select query_id, vec_id, round(score, 6) as score, rank from hits",
    "q11_topk_threshold": f"with {_hits(0.5, name='h')}, {_hits(threshold=LOW, name='l')} select query_id, vec_id, round(score, 6) as score, rank, '0.5' as threshold from h union all select query_id, vec_id, round(score, 6), rank, '0.3' from l",
    "q12_search_hits": f"with {_hits(LOW)} select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, round(score, 4) as score, source, vec_id as chunk_id, left(text, 200) as preview, text from hits join documents on doc_id = vec_id",
    "q13_retrieval_eval": f"{_judged()} select count(*) as queries, round(avg(p1::int), 9) as precision_at_1, round(avg(hit3::int), 9) as precision_at_3, round(avg(rr), 9) as mrr from judged",
    "q14_fragment_hit": f"with {_bm25()}, judged as (select item_id, coalesce(bool_or(b.text <> '' and contains(d.text, b.text)), false) as hit, coalesce(max(round(score, 4)), 0) as top from benchmark b left join best on query_id = item_id left join documents d using (doc_id) group by item_id) select count(*) as queries, round(avg(hit::int), 9) as fragment_rate, round(coalesce(avg(top) filter (where hit), 0), 6) as avg_hit_score, round(coalesce(avg(top) filter (where not hit), 0), 6) as avg_miss_score from judged",
    "q17_last_two_runs": f"with {RUNS} select step, recency, id, strftime(run_at, '%Y-%m-%d %H:%M') as run_at, duration_sec from two",
    "q18_run_diff": f"with {RUNS}, {WIDE} select step, metric_name, current, previous, case when current is null or previous is null or current = previous then '' else ' (' || case when current > previous then '+' else '' end || format('{{:.1f}}', current - previous) || ')' end as change from wide",
    "q19_latest_metric": f"with {RUNS} select step, metric_name, max(run_id) as run_id, max_by(metric_value, run_id) as metric_value from metrics join runs on id = run_id group by all",
    "q20_duration_totals": f"with {RUNS} select recency, round(sum(duration_sec), 6) as total_duration, count(*) as steps from two group by recency",
    "q21_metric_union": f"with {RUNS}, {WIDE} select step, metric_name, {_shown('current')} as current_text, {_shown('previous')} as previous_text from wide",
    "q22_run_status": f"with {RUNS} select step, case when duration_sec < 5 then 'failed' when items_skipped > 0 then 'partial' when id % 2 = 0 then 'success' else 'no_data' end as status, count(*) as runs, count(*) filter (where duration_sec < 5) as fetch_failures from runs group by all",
    "q23_load_quality": f"with recursive {TEXTS}, {_chunks(CHUNK.size)} select (select count(*) from chunks where chunk_index = 3) as empty_chunks, (select count(*) from chunks) as total_chunks, (select count(*) from embeddings) as total_vectors, (select count(*) from embeddings where vec_id % 5 = 0) as embedding_failures",
    "q24_display_format": "select event_id, floor(value)::bigint::varchar as whole, format('{:.1f}', floor(value) + 0.5) as half, left(props, 16) as prefix from events",
    "q25_eval_failures": f"{_judged()} select query_id, expected_source, got from judged",
}


SQL |= {
    "q26_duplicate_texts": "select sha256(coalesce(text, '')) as content_hash, count(*) as copies, min(doc_id) as first from documents group by 1 having count(*) > 1",
    "q27_load_plan": "with a as (select doc_id, case when doc_id % 7 = 0 then 'old' else text end as old from documents where doc_id % 5 <> 0), b as (select doc_id, text as new from documents where doc_id % 11 <> 0) select case when a.doc_id is null then 'insert' when b.doc_id is null then 'gone' when old = new then 'skip' else 'replace' end as action, count(*) as documents from a full join b on a.doc_id = b.doc_id group by 1",
    "q28_url_identity": r"""with bare as (select page_id, string_split(trim(url), '#')[1] as u from pages), cut as (select page_id, string_split(u, '?')[1] as front, substr(u, length(string_split(u, '?')[1]) + 2) as asked from bare),
  parts as (select page_id, asked, lower(string_split(front, '/')[1]) || '//' || lower(string_split(front, '/')[3]) as head, rtrim(array_to_string(string_split(front, '/')[4:], '/'), '/') as path from cut)
  select case when starts_with(head, 'http://') and ends_with(head, ':80') then left(head, length(head) - 3) when starts_with(head, 'https://') and ends_with(head, ':443') then left(head, length(head) - 4) else head end
    || case when path = '' then '' else '/' || path end || case when asked = '' then '' else '?' || array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '')), '&') end as url, count(*) as pages, min(page_id) as first from parts group by 1""",
    "q29_bm25": f"with {_bm25()} select query_id, doc_id, round(score, 6) as score, rank from best",
    "q31_latency": "select strftime(ts, '%Y-%m-%d') as day, count(*) as queries, round(avg((value < 5)::int), 9) as fallback_rate, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1",
}


SQL |= {
    "q32_document_table": f"with {CLEANED} select row_number() over (order by page_id::varchar) as id, page_id::varchar as source, 'unknown' as purpose, page_id || '.html' as raw_filename, length(text)::int as full_text_length from cleaned where length(text) >= {TRANSFORM.min_text_length}",
    "q33_hybrid": f"with {_bm25()}, {_hits()}, sem as (select query_id, vec_id as doc_id, score from hits where query_id in (select item_id from benchmark)), lex as (select query_id, doc_id, score / max(score) over (partition by query_id) as score from best), mixed as (select coalesce(l.query_id, s.query_id) as query_id, coalesce(l.doc_id, s.doc_id) as doc_id, round(0.7::double * coalesce(s.score, 0) + 0.3::double * coalesce(l.score, 0), {DIGITS}) as score from lex l full join sem s on l.query_id = s.query_id and l.doc_id = s.doc_id), placed as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from mixed) select query_id, doc_id, round(score, 6) as score, rank from placed where rank <= {TOP_K}",
    "q34_consistency": "select doc_id as chunk_id, 'no vector' as problem from documents where doc_id not in (select vec_id from embeddings) union all select vec_id, 'no chunk' from embeddings where vec_id not in (select doc_id from documents)",
}


def _safety() -> None:
    """From the rules: runs of digits are told apart as a list, whatever stands beside them; phones twice, since a match takes its neighbours."""
    digits = "list_transform(string_split({}, ''), lambda d: try_cast(d as int))"
    luhn = f"list_sum(list_transform({digits.format('reverse(r)')}, lambda d, i: case when i % 2 = 0 then d * 2 - case when d > 4 then 9 else 0 end else d end)) % 10 = 0"
    run = f"case when not regexp_full_match(r, '[0-9]{{13,19}}') then r when {luhn} then '[card]' when len(r) = 13 then '[national_id]' else r end"
    phone = r"(^|[^0-9])(?:\+[0-9]{1,3}[ -]?(?:\(0\) ?)?\(?[0-9]{1,4}\)?(?:[ /-]?[0-9]{2,4}){2,3}|(?:[0-9]{1,3}[ -])?\(?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{3,4})([^0-9]|\z)"
    hide = lambda t: rf"regexp_replace({t}, '{phone}', '\1[phone]\2', 'g')"
    parts = "regexp_extract_all(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[email]', 'g'), '[0-9]+|[^0-9]+')"
    numbers = f"coalesce(array_to_string(list_transform({parts}, lambda r: {run}), ''), '')"
    redacted = f"redacted as (select *, {hide(hide(numbers))} as clean from documents)"
    marks = lambda kind: f"sum((length(clean) - length(replace(clean, '[{kind}]', '')) - length(coalesce(text, '')) + length(replace(coalesce(text, ''), '[{kind}]', ''))) // {len(kind) + 2})::bigint as {kind}"
    weights = " + ".join(f"{7 - i} * (try_cast(substr(r, {i + 1}, 1) as int) + try_cast(substr(r, {i + 7}, 1) as int))" for i in range(6))
    date = "try_strptime(case when substr(r, 5, 3) >= '800' then '1' else '2' end || substr(r, 5, 3) || substr(r, 3, 2) || substr(r, 1, 2), '%Y%m%d') is not null"
    checked = f"len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda r: len(r) = 13 and {date} and try_cast(substr(r, 13, 1) as int) = case when 11 - ({weights}) % 11 > 9 then 0 else 11 - ({weights}) % 11 end))"
    injected = f"count(*) filter (where len(regexp_extract_all(coalesce(text, ''), '{INJECTION}')) > 0) as injections"
    SQL["q35_personal_data"] = f"with {redacted} select source, {', '.join(map(marks, KINDS))}, sum({checked})::bigint as checked_id, {injected} from redacted group by source"
    SQL["q36_redacted"] = f"with {redacted} select doc_id, sha256(clean) as redacted_sha256 from redacted"
    SQL["q37_question_checks"] = rf"with c as (select conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) as question from conversations) select conv_id, turn, question, case when question = '' then 'empty' when length(question) > 200 then 'too long' when regexp_matches(question, '{INJECTION}') then 'injection' end as problem from c"
    SQL["q38_versions"] = "with d as (select doc_id, sha256(coalesce(text, '')) as h from documents), o as (select doc_id, case when doc_id % 7 = 0 then 'old' else h end as h from d where doc_id % 5 <> 0), n as (select * from d where doc_id % 11 <> 0) select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(n.h, o.h) as content_hash, case when o.doc_id is null then '2024-01-03' else '2024-01-01' end as first_indexed, case when n.doc_id is null then '2024-01-02' else '2024-01-03' end as last_seen, case when n.doc_id is not null and (o.doc_id is null or o.h <> n.h) then '2024-01-03' else '2024-01-01' end as last_changed, case when n.doc_id is null then 'gone' else 'live' end as status from o full join n on o.doc_id = n.doc_id"


_safety()


def _sweep() -> str:
    settings = [(size, int(size * share)) for size in (300, 500) for share in (0.0, 0.2)]
    parts = [f"{_chunks(size, f'c{i}').replace(f'- {CHUNK.overlap}, 1)', f'- {overlap}, 1)')}" for i, (size, overlap) in enumerate(settings)]
    rows = [f"select {size} as size, {overlap} as overlap, (select count(*) from texts) as documents, (select count(*) from texts) - count(distinct doc_id) as empty_files, count(*) as total_chunks, round(avg(chunk_length), 6) as avg_chunk_length, min(chunk_length) as min_chunk_length, max(chunk_length) as max_chunk_length from c{i}" for i, (size, overlap) in enumerate(settings)]
    return f"with recursive {TEXTS}, {', '.join(parts)} {' union all '.join(rows)}"


SQL["q30_chunk_sweep"] = _sweep()


def _sections() -> str:
    """Headings are cut out with marks: chr(1) and the level before one, chr(2) at the end of any block."""
    text = r"regexp_replace(html, '<p><b>([^<]*)<br>', '<h2>\1</h2>', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', '', 'g'), '(?is)<({'|'.join(TRANSFORM.strip_tags)}|title)[^>]*>.*?</({'|'.join(TRANSFORM.strip_tags)}|title)>', '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '<h([12])>', chr(2) || chr(1) || '\\1', 'g'), '</?(h[12]|p|li|div|article|body)>|<div [^>]*>', chr(2), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '<br>', ' ', 'g'), '<[A-Za-z/!][^>]*>', '', 'g')"
    own = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
    for name, value in (("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&quot;", "'\"'"), ("&apos;", "''''"), ("&#39;", "''''"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'"), ("&amp", "'&'")):
        text, own = f"replace({text}, '{name}', {value})", f"replace({own}, '{name}', {value})"
    squeeze = lambda t: rf"trim(regexp_replace({t}, '[\s\x0B\x1c-\x1f\x{{85}}\x{{A0}}]+', ' ', 'g'))"
    return rf"""with recursive cut as (select page_id, url, {squeeze(own)} as own, string_split({text}, chr(1)) as parts from pages),
  numbered as (select page_id, url, own, unnest(parts) as part, unnest(range(len(parts))) as i from cut),
  blocks as (select page_id, url, own, i, case when i > 0 then left(part, 1)::int else 0 end as level, list_transform(string_split(case when i > 0 then substr(part, 2) else part end, chr(2)), lambda x: {squeeze("x")}) as b from numbered),
  split as (select page_id, url, own, i, level, case when i > 0 then b[1] end as heading, array_to_string(list_filter(case when i > 0 then b[2:] else b end, lambda x: x <> ''), ' ') as t from blocks),
  kept as (select *, i - min(i) over (partition by page_id) as section, max(case when level = 1 then i end) over w as last1, first_value(heading ignore nulls) over (partition by page_id order by i rows between unbounded preceding and unbounded following) as first_heading
    from split where i > 0 or t <> '' window w as (partition by page_id order by i)),
  pathed as (select k.*, case when k.level = 2 and o.heading is not null then o.heading || ' > ' || k.heading else coalesce(k.heading, '') end as heading_path from kept k left join kept o on o.page_id = k.page_id and o.i = k.last1),
  texts as (select page_id * 100000 + section as doc_id, url as source, t from pathed where t <> ''), {_chunks(CHUNK.size)}
  select page_id, url, section::int as section, coalesce(nullif(own, ''), first_heading) as page_title, heading as section_title, level, heading_path, (row_number() over (partition by page_id order by section, chunk_index) - 1)::int as chunk_index, text, char_offset, chunk_length
  from chunks join pathed on doc_id = page_id * 100000 + section"""


SQL["q40_section_chunks"] = _sections()


_NORMAL = """case when starts_with({0}, 'http://') then regexp_replace({0}, '^(http://[^/?]*):80($|[/?])', '\\1\\2') else regexp_replace({0}, '^(https://[^/?]*):443($|[/?])', '\\1\\2') end"""
#: The tables' links all begin with a slash, and their URLs have a host in lower case.
LINKS = rf"""own as (select page_id, u.i, {_NORMAL.format("string_split(url, '#')[1]")} as full_url, url, html from pages, (select 0 as i) u),
  norm as (select page_id, html, case when contains(full_url, '?') then rtrim(string_split(full_url, '?')[1], '/') || '?' || array_to_string(list_sort(string_split(string_split(full_url, '?')[2], '&')), '&') else rtrim(full_url, '/') end as url from own),
  hrefs as (select distinct url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) as href from norm),
  links as (select distinct url, regexp_extract(url, '^[a-z]+://[^/?]*') || rtrim(href, '/') as target from hrefs)"""
SQL["q43_vector_versions"] = f"""with unit as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings),
  live as (select vec_id, case when vec_id % 7 = 0 then list_transform(u, lambda x: -x) else u end as u from unit where vec_id % 11 <> 0 union all select vec_id + 1000000000, u from unit where vec_id % 13 = 0),
  scored as (select q.vec_id as query_id, l.vec_id, round(list_inner_product(q.u, l.u), {DIGITS}) as score from unit q, live l where q.vec_id % 100 = 0),
  placed as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored) select query_id, vec_id, round(score, 6) as score, rank from placed where rank <= {TOP_K}"""


def _expanded() -> str:
    score = f"round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / avg_n))), {DIGITS}) as score from {{0}} join postings using (term) join df using (term) cross join total group by all"
    top = "select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {0}) where rank <= {1}"
    return f"""with {_bm25()}, one as (select *, 1.0 as weight from asked), s1 as (select query_id, doc_id, {score.format("one")}), r1 as ({top.format("s1", 20)}),
  feedback as (select query_id, doc_id, score / sum(score) over (partition by query_id) as share from r1 where rank <= 3),
  likely as (select query_id, term, round(sum(share * tf / n), {DIGITS}) as p from feedback join postings using (doc_id) where (query_id, term) not in (select (query_id, term) from asked) group by all),
  chosen as (select * from (select *, row_number() over (partition by query_id order by p desc, term) as i from likely where p > 0) where i <= 10),
  more as (select query_id, term, 0.6::double / count(*) over (partition by query_id) as weight from asked union all select query_id, term, 0.4::double * p / sum(p) over (partition by query_id) from chosen),
  s2 as (select query_id, doc_id, {score.format("more")}), r2 as ({top.format("s2", 20)}),
  votes as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), {DIGITS}) as score from (select query_id, doc_id, rank from r1 union all select query_id, doc_id, rank from r2) group by all),
  placed as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from votes) select query_id, doc_id, score, rank from placed where rank <= {TOP_K}"""


SQL["q44_expanded"] = _expanded()
SQL["q41_page_links"] = f"with {LINKS} select url, target from links"
SQL["q42_crawl"] = f"""with recursive {LINKS}, graph as (
    select distinct 'https://s' || page_id % 2 || '.example/p' || page_id as url, 'https://s' || m % 2 || '.example/p' || m as target
    from (select page_id, ('0x' || left(md5(case when path = '' then '/' else path end), 7))::bigint % (select count(*) from pages) as m from (select page_id, substr(target, length(regexp_extract(url, '^[a-z]+://[^/?]*')) + 1) as path from links join norm using (url)))
    where page_id % 2 = m % 2
  ), reach as (
    select 'site' || page_id % 2 as source, 'https://s' || page_id % 2 || '.example/p' || page_id as url, 0 as depth from (select min(page_id) as page_id from pages group by page_id % 2)
    union select source, target, depth + 1 from reach join graph using (url) where depth < 5 and not (target like '%/p3%' and target not like '%/p30%')
  ), first as (select source, url, min(depth) as depth from reach group by all), placed as (select *, row_number() over (partition by source order by depth, url) as n from first)
  select source, url, depth from placed where n <= 60"""


def _prompts() -> str:
    from siltstone.config import GenerateConfig

    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    asked = "questions as (select conv_id as query_id, min_by(text, turn) as query from conversations where role = 'user' group by conv_id)"
    found = f"{_hits(0.2)}, {asked}, found as (select h.query_id, rank, source, text, round(score, 4) as score from hits h join documents on doc_id = vec_id)"
    lines = f"string_agg('[' || n || '] ({SOURCE}: ' || source || ') ' || text, chr(10) || chr(10) order by rank)"
    prompt = f"{quote(GenerateConfig().system_prompt)} || chr(10) || chr(10) || '{CONTEXT}' || chr(10) || context || chr(10) || chr(10) || '{QUESTION}' || chr(10) || query || chr(10) || chr(10) || '{ANSWER}' || chr(10)"
    SQL["q15_prompt"] = f"with {found}, numbered as (select *, row_number() over (partition by query_id order by rank) as n from found), contexts as (select query_id, {lines} as context from numbered group by query_id) select query_id, {prompt} as prompt from questions join contexts using (query_id)"
    SQL["q16_query_metrics"] = f"with {found} select query_id, count(rank)::int as num_chunks, coalesce(max(score), 0) as top_score, coalesce(round(avg(score) filter (where rank <= 3), 4), 0) as avg_top3_score, coalesce(string_agg(distinct source, ',' order by source), '') as sources, (count(rank) = 0)::int as fallback from questions left join found using (query_id) group by query_id"
    split = lambda t: rf"list_filter(regexp_split_to_array({t}, '[^0-9\p{{L}}]+'), lambda w: w <> '')"
    SQL["q45_grounding"] = rf"""with {found}, answers as (select conv_id as query_id, min_by(text, turn) || ' [' || conv_id % 7 || '] [2]' as answer from conversations where role = 'assistant' group by conv_id),
  parsed as (select query_id, trim(regexp_replace(regexp_replace(answer, '\s*\[[0-9]+\]', '', 'g'), '[ \t]+', ' ', 'g')) as said, list_distinct(regexp_extract_all(answer, '\[([0-9]+)\]', 1)) as marks from answers),
  claims as (select query_id, i, {split("s")} as w from (select query_id, unnest(string_split_regex(said, '[.!?]+\s+')) as s, generate_subscripts(string_split_regex(said, '[.!?]+\s+'), 1) as i from parsed) where len({split("s")}) > 0),
  words as (select query_id, i, lower(word) as word, bool_or(regexp_matches(word, '[0-9]') or (k > 1 and lower(left(word, 1)) <> left(word, 1))) as fact from (select query_id, i, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from claims) group by 1, 2, 3),
  known as (select distinct query_id, unnest({split("lower(text)")}) as word, true as known from found),
  judged as (select query_id, i, count(*) filter (where fact and known is null) as missing, count(known) as met, count(*) as n from words left join known using (query_id, word) group by 1, 2),
  summed as (select query_id, count(*) as claims, count(*) filter (where missing = 0 and met >= 0.6 * n) as grounded, sum(missing)::bigint as missing_facts from judged group by 1), hits_of as (select query_id, count(*) as hits from found group by 1)
  select query_id, coalesce(claims, 0) as claims, coalesce(grounded, 0) as grounded, round(grounded / claims, 6) as grounded_share, coalesce(missing_facts, 0) as missing_facts, len(marks)::int as citations, len(list_filter(marks, lambda m: m::int < 1 or m::int > coalesce(hits, 0)))::int as dangling
  from parsed left join summed using (query_id) left join hits_of using (query_id)"""


_prompts()

SQL["q46_alerts"] = """with points as (select event_type as key, time_bucket(interval 6 hours, ts, timestamp '2024-01-01') as "at", avg(value) as value, row_number() over (partition by event_type order by time_bucket(interval 6 hours, ts, timestamp '2024-01-01')) as i from events group by 1, 2),
  base as (select key, avg(value) as mean, stddev_pop(value) as spread from points where i <= 24 group by key),
  d as (select *, case when i > 24 and spread > 0 then (value - mean) / spread - 0.25 else 0 end as u, case when i > 24 and spread > 0 then (mean - value) / spread - 0.25 else 0 end as w from points join base using (key)),
  c as (select *, sum(u) over k as cu, sum(w) over k as cw from d window k as (partition by key order by "at")),
  s as (select *, cu - least(min(cu) over k, 0) as up, cw - least(min(cw) over k, 0) as down from c window k as (partition by key order by "at")),
  a as (select *, case when up > 2 and coalesce(lag(up) over k, 0) <= 2 then 'up' when down > 2 and coalesce(lag(down) over k, 0) <= 2 then 'down' end as alert from s window k as (partition by key order by "at"))
  select key, strftime("at", '%Y-%m-%d %H:%M') as "at", round(value, 6) as value, round(up, 6) as up, round(down, 6) as down, alert from a where alert is not null"""
SQL["q47_stability"] = """with c as (select event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, least(floor(value / 20), 10) as bin, count(*) as n from events group by all),
  dense as (select event_type, week, bin, greatest(coalesce(n, 0), 0.5)::double as n from (select distinct event_type, week from c) join (select distinct event_type, bin from c) using (event_type) left join c using (event_type, week, bin)),
  p as (select *, n / sum(n) over (partition by event_type, week) as p from dense), q as (select *, lag(p) over (partition by event_type, bin order by week) as q from p)
  select event_type, week, round(sum((p - q) * ln(p / q)), 9) as psi from q where q is not null group by all"""
SQL["q48_feedback"] = """with rated as (select event_id, user_id % 50 as query_id, case event_type when 'error' then -1 when 'purchase' then 1 end as rating, case when value > 100 then props end as correction, ts from events),
  latest as (select * from rated where rating is not null and query_id is not null qualify row_number() over (partition by query_id order by ts desc, event_id desc) = 1)
  select label % 2 = 0 as fallback, count(*) as queries, count(rating) as rated, count(*) filter (where rating > 0) as liked, count(*) filter (where rating < 0) as disliked, count(correction) as corrected, round(avg(round(embedding[1]::double, 6)) filter (where rating < 0), 6) as disliked_score
  from embeddings left join latest on query_id = vec_id group by 1"""
