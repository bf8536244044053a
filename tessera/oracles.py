"""DuckDB SQL for every query that SQL can express.

Regular expressions are written for an engine whose ``\\b`` and ``\\w`` are ASCII and
which has no look-behind; where the queries use those, the SQL splits another way.
"""

from __future__ import annotations

from tessera.cases import ANSWER_CASES, UNANSWERABLE

T = r"'[\p{L}\p{N}_]+'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {T})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def count_tokens(x: str) -> str:
    return rf"(case when coalesce({x}, '') = '' then 0 else greatest(1, len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))) end)::int"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def factual(x: str, stop: str) -> str:
    words = rf"list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_-]+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: regexp_full_match(w, '[a-z0-9_-]{{3,}}')))"
    return f"list_filter({words}, lambda w: not list_contains({stop}, w))"


def answer_text(x: str) -> str:
    """Lower case without punctuation and articles, by words."""
    return rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '' and w not in ('a', 'an', 'the')), ' ')"


STOP = "['" + "','".join("the and for that this with from were been have they which what when where who will more also into some their then there other about after before between under provided documents contain enough information answer question according stated reference based".split()) + "']"
STOP_ANSWERS = STOP[:-1] + ",'does','each']"


def bm25(chunks: str, asked: str, k: int, allowed: str = "") -> str:
    """CTEs: chunks c(chunk_id, text), questions q(query_id, query), ranked list bm(query_id, chunk_id, score, rank)."""
    return f"""
c as ({chunks}), q as ({asked}),
tk as (select chunk_id, {tokens('text')} as tokens from c),
ln as (select chunk_id, len(tokens) as dl from tk),
st as (select count(*) as n, avg(dl) as avgdl from ln),
po as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(tokens) as term from tk) group by all),
df as (select term, count(*) as df from po group by term),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens('query')}) as term from q) group by all),
sc as (select query_id, po.chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
  from qt join po using (term) join df using (term) join ln on ln.chunk_id = po.chunk_id cross join st {allowed} group by all),
bm as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from sc) where rank <= {k})"""


DOCS = "select doc_id as chunk_id, text from documents"
CHANGED_DOCS = "select doc_id as chunk_id, case when lang = 'es' then concat_ws(' ', text, source) else text end as text from documents where lang is distinct from 'fr'"
ITEMS = "select item_id as query_id, text as query from benchmark"
BOTH = "select doc_id as chunk_id, text, source, embedding::double[] as v from documents left join embeddings on doc_id = vec_id"
ASKING = "select chunk_id as query_id, string_split(text, chr(10))[1] as query from c where chunk_id % 50 = 0"
ASK = f"select * from ({ASKING}) where length(query) <= 4096 and trim(query) <> ''"
DENSE = """
dn as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from (
  select a.chunk_id as query_id, b.chunk_id, greatest(0, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) as score
  from c a, c b where a.chunk_id in (select query_id from q) and a.v is not null and b.v is not null)) where rank <= 20)"""


def fused(weights: str, grid: str = "") -> str:
    """CTE rr: the fused list of each configuration."""
    return f"""
pr as (select coalesce(dn.query_id, bm.query_id) as query_id, coalesce(dn.chunk_id, bm.chunk_id) as chunk_id, coalesce(dn.score, 0) as dense_score, dn.rank as dr, bm.score as bm25_score, bm.rank as br
  from dn full join bm on dn.query_id = bm.query_id and dn.chunk_id = bm.chunk_id),
sm as (select *, coalesce(wd / (k + dr), 0) + coalesce(ws / (k + br), 0) as rrf_score from pr cross join ({weights})),
rr as (select * from (select *, row_number() over (partition by {grid} query_id order by round(rrf_score, 12) desc, dr nulls last, br nulls last) as pool from sm) where pool <= 20)"""


def hybrid(k: int, wd: float, ws: float) -> str:
    return f"""with {bm25(BOTH, ASK, 20)}, {DENSE}, {fused(f'select {k} as k, {wd}::double as wd, {ws}::double as ws')}
select query_id, chunk_id, round(dense_score, 6) as dense_score, round(bm25_score, 6) as bm25_score, round(rrf_score, 6) as rrf_score,
  row_number() over (partition by query_id order by round(rrf_score, 6) desc, pool)::int as rank from rr"""


METRICS = "round(avg(case when gold_rank <= {0} then 100.0 else 0 end), 6) as hit_at_{0}"
RR = "round(avg(coalesce(1.0 / gold_rank, 0)), 6) as mrr"
RANKS = f"""{bm25(BOTH, ASK, 20)}, {DENSE}, {fused("select * from (values ('hybrid_k60', 60, 1.0::double, 1.0::double), ('hybrid_k20', 20, 1, 1), ('hybrid_k100', 100, 1, 1), ('weighted_70_30', 60, 0.7, 0.3), ('weighted_30_70', 60, 0.3, 0.7)) as g(configuration, k, wd, ws)", 'configuration,')},
fin as (select configuration, query_id, chunk_id, row_number() over (partition by configuration, query_id order by round(rrf_score, 6) desc, pool)::int as rank from rr
  union all select 'bm25', query_id, chunk_id, row_number() over (partition by query_id order by round(score, 4) desc, rank)::int from bm
  union all select 'dense', query_id, chunk_id, row_number() over (partition by query_id order by round(score, 4) desc, rank)::int from dn),
ranks as (select g.configuration, q.query_id, min(fin.rank) as gold_rank
  from ({ASKING}) q cross join (values ('bm25'), ('dense'), ('hybrid_k60'), ('hybrid_k20'), ('hybrid_k100'), ('weighted_70_30'), ('weighted_30_70')) as g(configuration)
  left join fin on fin.configuration = g.configuration and fin.query_id = q.query_id and fin.chunk_id = q.query_id and fin.rank <= 10 group by all)"""
POOL = f"""{bm25(BOTH, ASK, 20)}, {DENSE}, {fused('select 60 as k, 1.0::double as wd, 1.0::double as ws')},
fin as (select query_id, chunk_id, rrf_score, row_number() over (partition by query_id order by round(rrf_score, 6) desc, pool)::int as rank, count(*) over (partition by query_id) as many from rr),
lx as (select fin.*, case when many = 1 then 1.0 when len(list_distinct({tokens('q.query')})) = 0 then 0.0
  else len(list_intersect(list_distinct({tokens('q.query')}), {tokens('c.text')}))::double / len(list_distinct({tokens('q.query')})) end as rerank_score
  from fin join q using (query_id) join c using (chunk_id)),
pool as (select *, row_number() over (partition by query_id order by round(rerank_score, 4) desc, rank)::int as final_rank from lx)"""
GOLDS = "golds as (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text) where coalesce(b.text, '') <> '')"
CHUNKS = f"""chunks as (
  select doc_id, source, 'structure' as strategy, 1 as page, unnest(range(len(p)))::int as chunk_idx, unnest(p) as text from (select doc_id, source, string_split(text, chr(10)) as p from documents)
  union all select doc_id, source, 'semantic', 1, unnest(range(len(p)))::int, unnest(p) from (select doc_id, source, {sentences('text')} as p from documents))"""
# Entities and their patterns, in order.
PATTERNS = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE_NUMBER", r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMPLOYEE_ID", r"\bEMP-\d{5,7}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[- ]?){3}\d{4}\b"),
    ("PROJECT_CODENAME", r"\b(Phoenix|Titan|Aurora|Nebula|Valkyrie)\b"),
]


def pii(table: str, keep: str) -> str:
    """CTE rd: ``keep``, the original text, the redacted text and a count of each entity."""
    step = f"p0 as (select {keep}, text as original, text from {table})"
    for i, (entity, pattern) in enumerate(PATTERNS):
        step += f", p{i + 1} as (select * replace (regexp_replace(text, '{pattern}', '<{entity}>', 'g') as text), len(regexp_extract_all(text, '{pattern}')) as n{i} from p{i})"
    return step + f", rd as (select *, {' + '.join(f'n{i}' for i in range(len(PATTERNS)))} as redactions from p{len(PATTERNS)})"


ROUTER = """rows as (select *, row_number() over (partition by label order by vec_id) as n from embeddings),
sims as (select a.vec_id as query_id, a.label::varchar as actual, b.label::varchar as intent, list_dot_product(a.embedding::double[], b.embedding::double[]) as s from rows a, rows b where a.n > 28 and b.n <= 28),
scores as (select query_id, actual, intent, avg(s) as score from (select *, row_number() over (partition by query_id, intent order by s desc) as r from sims) where r <= 3 group by all),
best as (select * from (select query_id, actual, intent as best, score as confidence, row_number() over (partition by query_id order by round(score, 9) desc, intent::int) as r from scores) where r = 1)"""
TOP = "top as (select bm.query_id, bm.chunk_id, bm.rank, c.text, d.source, q.query from bm join c using (chunk_id) join documents d on d.doc_id = bm.chunk_id join q using (query_id))"
LEAD = f"{strip('string_split(regexp_replace(' + strip('text') + r', ' + chr(39) + r'([.!?])\s+' + chr(39) + r', ' + chr(39) + r'\1' + chr(39) + r' || chr(1), ' + chr(39) + 'g' + chr(39) + '), chr(1))[1]')}"
REFUSAL = "The provided documents do not contain enough information to answer this question."
ANSWERS = f"""{bm25(DOCS, ITEMS, 3)}, {TOP},
lead as (select query_id, {LEAD} as s from top where rank = 1),
answers as (select q.query_id, q.query, case when coalesce(s, '') = '' then '{REFUSAL}' else case when length(s) > 160 then substr(s, 1, 157) || '...' else s end || ' [1]' end as answer,
  coalesce((select list(text order by rank) from top t where t.query_id = q.query_id), []::varchar[]) as chunks from q left join lead using (query_id))"""
BUDGET = f"""{bm25(DOCS, ITEMS, 5)}, {TOP},
bl as (select *, '[' || rank || '] Source: ' || source || ' (Page 1)' || chr(10) || {strip('text')} as block,
  greatest(0, 3072 - {count_tokens("(chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || chr(10) || 'Answer:')")}) as room from top),
co as (select *, {count_tokens('block')} as cost from bl),
us as (select *, sum(cost) over (partition by query_id order by rank rows unbounded preceding)::bigint as used from co),
fit as (select * from us where used <= room)"""
SAME = "list_sum(list_transform(list_distinct(list_intersect({0}, {1})), lambda t: least(len(list_filter({0}, lambda x: x = t)), len(list_filter({1}, lambda x: x = t)))))"


def f1(a: str, b: str) -> str:
    """F1 of two word lists."""
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else 2.0 * coalesce({SAME.format(a, b)}, 0) / (len({a}) + len({b})) end)"


EM = f"norm as (select query_id, answer, query, chunks, {answer_text('answer')} as na, {answer_text('query')} as nq, {answer_text('chunks[1]')} as nc from answers), words as (select *, list_filter(string_split(na, ' '), lambda w: w <> '') as wa, list_filter(string_split(nq, ' '), lambda w: w <> '') as wq, list_filter(string_split(coalesce(nc, ''), ' '), lambda w: w <> '') as wc from norm)"


def ground(answer: str, chunks: str) -> str:
    mine, theirs = factual(answer, STOP_ANSWERS), factual(f"array_to_string({chunks}, chr(10))", STOP_ANSWERS)
    return f"(case when len({mine}) = 0 then 1.0 else len(list_intersect({mine}, {theirs}))::double / len({mine}) end)"


HEADING = r"^(?:#{1,6}\s+.+|(?:Section\s+)?(?:\d+\.)+\d*\s+[A-Z].+|[A-Z0-9\s_\-:,]{3,60}$)"
LINES = "lines as (select doc_id, unnest(range(len(p)))::int as idx, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents))"
TABLE = "(contains(line, ' | ') or (starts_with(line, '|') and ends_with(line, '|')))"
LIMITED = "select *, row_number() over (partition by conv_id order by turn) as i, row_number() over (partition by conv_id order by turn desc) as j, first_value(role) over (partition by conv_id order by turn) = 'system' as sys from conversations"

HEADED = LINES + r""",
hl as (select *, substr(regexp_replace(line, '[^A-Za-z ]', '', 'g'), 1, 30) as f from lines),
headed as (select doc_id, (idx * 6 + k)::int as idx, ['## ' || f, (idx + 1) || '. ' || upper(substr(f, 1, 1)) || substr(f, 2, 30), upper(f), '1.2 ' || lower(f), '#' || f, line][k + 1] as line from hl cross join range(6) as t(k))"""


def window_end(text: str, begin: str, n: str) -> str:
    """End of the character window of 500 that begins at ``begin``."""
    window = f"substr({text}, {begin} + 1, 500)"
    last = lambda c: f"(500 - strpos(reverse({window}), {c}) - (500 - length({window})))"
    after = strip(f"split_part(substr({text}, {begin} + {last('chr(10)')} + 2), chr(10), 1)")
    line = f"strpos({window}, chr(10)) > 0 and {last('chr(10)')} > 0 and (contains({after}, ' | ') or (starts_with({after}, '|') and ends_with({after}, '|')))"
    return f"(case when {begin} + 500 >= {n} then {begin} + 500 when {line} then {begin} + {last('chr(10)')} when strpos({window}, ' ') > 0 and {last(chr(39) + ' ' + chr(39))} > 0 then {begin} + {last(chr(39) + ' ' + chr(39))} else {begin} + 500 end)"


CHARACTER = f"""with recursive d as (select doc_id, source || '-' || doc_id as source, text, length(text) as n from documents where coalesce({strip('text')}, '') <> ''),
w as (select doc_id, 0::bigint as b, {window_end('text', '0', 'n')}::bigint as e from d
  union all select doc_id, b2, {window_end('text', 'b2', 'n')}::bigint from (select d.doc_id, text, n, greatest(b + 1, e - 50) as b2 from w join d using (doc_id) where greatest(b + 1, e - 50) < n)),
p as (select doc_id, b, source, {strip('substr(text, b + 1, e - b)')} as text from w join d using (doc_id)),
i as (select *, (row_number() over (partition by doc_id order by b) - 1)::int as chunk_idx from p where text <> '')
select source || '_char_p1_' || chunk_idx as chunk_id, doc_id, source, 1 as page, 'character' as strategy, chunk_idx, text from i"""
LIMITER = """with recursive r as (select event_id as request, user_id::varchar as key, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
w as (select request, key, t, i, true as allowed, 0 as retry_after, [t] as log from r where i = 1
  union all select request, key, t, i, len(k) < 2, case when len(k) < 2 then 0 else greatest(1, trunc(k[1] + 3600 - t)::int) end, case when len(k) < 2 then list_append(k, t) else k end
  from (select r.*, list_filter(w.log, lambda x: x > r.t - 3600) as k from w join r on r.key = w.key and r.i = w.i + 1))
select request, key, allowed, retry_after from w"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


REQUESTS = "requests as (select *, case event_id % 20 when 0 then 429 when 1 then 400 else 200 end as code, event_id % 3 as pii_redactions, length(props) as prompt_tokens, event_id % 50 as completion_tokens from events)"
CASES = "cases(id, category, contexts, answer, expected_refusal) as (values " + ", ".join(f"({quoted(i)}, {quoted(c)}, [{', '.join(map(quoted, x))}]::varchar[], {quoted(a)}, {str(c == 'refusal').lower()})" for i, c, x, a in ANSWER_CASES) + ")"
FAITHFUL = rf"""{CASES},
ci as (select *, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int) as cs, contains(answer, '{REFUSAL}') or contains(lower(answer), 'not contain enough information') as refused from cases),
ba as (select *, list_filter(cs, lambda x: x >= 1 and x <= len(contexts)) as ok from ci),
fa as (select *, {factual('answer', STOP)} as mine, array_to_string(case when len(cs) > 0 then list_transform(ok, lambda x: contexts[x]) else contexts end, chr(10)) as base from ba),
lo as (select *, list_filter(mine, lambda w: not list_contains({factual('base', '[]')}, w)) as lost from fa),
marked as (select id, category, expected_refusal, refused, case when refused or len(mine) = 0 then 1.0 else round(1 - len(lost)::double / len(mine), 4) end as grounding, not refused and len(lost) > 0 as flagged, len(cs)::int as citations, len(ok)::int as valid from lo)"""
DOCUMENT_CASES = f"""leads as (select doc_id, text, {LEAD} as s from documents),
facts as (select item_id, text, {LEAD} as s from benchmark),
said as (select item_id, list_filter([f.text, own.text], lambda t: t is not null) as contexts, f.s as mine, other.s as foreign_s
  from facts f left join leads own on own.doc_id = item_id left join leads other on other.doc_id = item_id + 1),
cases as (select item_id || '-' || k as id, k as category, contexts, k = 'refusal' as expected_refusal,
  case when k = 'refusal' or coalesce(t, '') = '' then '{REFUSAL}' else case when length(t) > 160 then substr(t, 1, 157) || '...' else t end || ' [1]' end as answer
  from (select *, case k when 'grounded' then mine when 'hallucination' then foreign_s end as t from said cross join (values ('grounded'), ('hallucination'), ('refusal')) as v(k)))"""
FAITHFUL_DOCUMENTS = FAITHFUL.replace(CASES, DOCUMENT_CASES)
LAST_SAID = "select conv_id as query_id, text as query from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role = 'user') where r = 1 and length(text) <= 4096"
FAITHFUL_SUMS = """count(*) as cases, round(avg(case when not expected_refusal then (citations > 0)::int end) * 100, 2) as citation_presence,
round(coalesce(sum(case when not expected_refusal then valid end) * 100.0 / nullif(sum(case when not expected_refusal then citations end), 0), 100), 2) as citation_precision,
round(avg(grounding) * 100, 2) as grounding, round(avg(case when expected_refusal then refused::int end) * 100, 2) as refusal_accuracy,
round(coalesce(avg(case when category = 'hallucination' then flagged::int end) * 100, 100), 2) as hallucination_sensitivity"""
RESPONSES = f"""{bm25(DOCS, ITEMS + ' where length(text) <= 200', 20)},
fin as (select * from (select *, row_number() over (partition by query_id order by round(score, 4) desc, rank)::int as final from bm) where final <= 3),
ids as (select query_id, count(*)::int as n, string_agg(chunk_id, ',' order by final) as chunk_ids from fin group by query_id)"""
SOURCES = f"""{bm25(DOCS, ITEMS, 20)},
fin as (select * from (select *, row_number() over (partition by query_id order by round(score, 4) desc, rank)::int as final from bm) where final <= 3),
bl as (select query_id, final, chunk_id || '/' || source || '/1' as cited, '[' || final || '] Source: ' || source || ' (Page 1)' || chr(10) || {strip('d.text')} as block from fin join documents d on d.doc_id = chunk_id),
made as (select query_id, count(*)::int as n, string_agg(cited, ',' order by final) as sources, string_agg(block, chr(10) || chr(10) order by final) as context from bl group by query_id),
pr as (select q.query_id, q.query, n, sources, 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' as prompt, case when n is null then '{REFUSAL}' else 'You ask: ' || query end as answer from q left join made using (query_id))"""
UNKNOWN = "select * from (values " + ", ".join(f"({i}, {quoted(''.join(f'zq{w} ' for w in q.split()))})" for i, q in enumerate(UNANSWERABLE)) + ") as u(query_id, query)"


ORACLES: dict[str, str] = {
    "bm25_incremental": f"with {bm25(CHANGED_DOCS, ITEMS, 10)} select query_id, chunk_id, round(score, 6) as score, rank from bm",
    "bm25_topk": f"with {bm25(DOCS, ITEMS, 10)} select query_id, chunk_id, round(score, 6) as score, rank from bm",
    "bm25_scoped_docids": f"with {bm25(DOCS, ITEMS, 5, allowed=chr(32) + 'join documents al on al.doc_id = po.chunk_id and al.lang = ' + chr(39) + 'de' + chr(39))} select query_id, chunk_id, round(score, 6) as score, rank from bm",
    "bm25_term_stats": f"""with tk as (select doc_id, {tokens('text')} as tokens from documents), n as (select count(*) as n from tk),
po as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from tk) group by all)
select term, count(*) as df, sum(tf)::bigint as cf, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from po cross join n group by term""",
    "bm25_corpus_stats": f"select count(*) as n_chunks, sum(len({tokens('text')}))::bigint as total_tokens, round(avg(len({tokens('text')})), 6) as avgdl from documents",
    "dense_topk": "select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from (select a.vec_id as query_id, b.vec_id as chunk_id, greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)) where rank <= 20",
    "dense_scoped": "select query_id, chunk_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)::int as rank from (select a.vec_id as query_id, b.vec_id as chunk_id, greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and b.label = 3)) where rank <= 5",
    "hybrid_rrf_k60": hybrid(60, 1, 1),
    "hybrid_rrf_k20": hybrid(20, 1, 1),
    "hybrid_rrf_k100": hybrid(100, 1, 1),
    "hybrid_weighted_70_30": hybrid(60, 0.7, 0.3),
    "hybrid_weighted_30_70": hybrid(60, 0.3, 0.7),
    "retrieve_final_k": f"""with {bm25(BOTH, ASK, 20)}, {DENSE}, {fused('select 60 as k, 1.0::double as wd, 1.0::double as ws')},
fin as (select *, row_number() over (partition by query_id order by round(rrf_score, 6) desc, pool)::int as rank from rr)
select query_id, chunk_id, md5(c.text) as text_md5, coalesce(c.source, '') as source, 1 as page, round(dense_score, 6) as dense_score, 0.0::double as rerank_score, round(bm25_score, 6) as bm25_score, round(rrf_score, 6) as rrf_score, rank from fin join c using (chunk_id) where rank <= 3""",
    "gold_rank_by_config": f"with {RANKS} select configuration, query_id, gold_rank from ranks",
    "retrieval_metrics_by_config": f"with {RANKS} select configuration, count(*) as queries, {METRICS.format(1)}, {METRICS.format(3)}, {METRICS.format(10)}, {RR}, round(avg(case when gold_rank <= 10 then 1 / log2(gold_rank + 1) else 0 end), 6) as ndcg_at_10 from ranks group by configuration",
    "gold_containment": f"with {GOLDS} select query_id, chunk_id from golds",
    "gold_rank": f"with {bm25(DOCS, ITEMS, 10)}, {GOLDS} select g.query_id, min(bm.rank) as gold_rank from golds g left join bm on bm.query_id = g.query_id and bm.chunk_id = g.chunk_id group by g.query_id",
    "dataset_self_check": f"with {GOLDS} select item_id as query_id from benchmark where item_id not in (select query_id from golds)",
    "gold_closure_sample": f"with {GOLDS} select doc_id, doc_id in (select chunk_id from golds) as gold from documents order by gold desc, md5('42:' || doc_id), doc_id limit 500",
    "rerank_topk": f"with {POOL} select query_id, chunk_id, round(rerank_score, 4) as rerank_score, final_rank from pool where final_rank <= 3",
    "rerank_depth_sweep": f"""with {POOL}, mv as (select depth, query_id, chunk_id, row_number() over (partition by depth, query_id order by rank > depth, case when rank <= depth then -round(rerank_score, 9) end, rank)::int as new_rank from pool cross join (values (3), (5), (10), (20)) as d(depth)),
ranks as (select depth, query_id, min(case when chunk_id = query_id then new_rank end) as gold_rank from mv group by all)
select depth, {METRICS.format(1)}, {METRICS.format(3)}, {RR} from ranks group by depth""",
    "blend_alpha_sweep": f"""with {POOL}, b0 as (select *, min(rrf_score) over (partition by query_id) as lo, max(rrf_score) over (partition by query_id) as hi from pool),
b1 as (select i / 10.0::double as alpha, *, (i / 10.0::double) * ((rrf_score - lo) / case when hi - lo > 1e-9 then hi - lo else 1.0 end) + (1 - i / 10.0::double) * (1 / (1 + exp(-greatest(least(rerank_score, 15), -15)))) as blend from b0 cross join range(11) as g(i)),
mv as (select *, row_number() over (partition by alpha, query_id order by round(blend, 9) desc, rank)::int as new_rank from b1),
ranks as (select alpha, query_id, min(case when chunk_id = query_id then new_rank end) as gold_rank from mv group by all)
select alpha, {METRICS.format(1)}, {METRICS.format(3)}, {RR} from ranks group by alpha""",
    "demotion_analysis": f"""with {POOL}, r as (select query_id, min(case when chunk_id = query_id then rank end) as pre, min(case when chunk_id = query_id then final_rank end) as post from pool group by query_id)
select count(*) as queries, sum((pre is not null)::int)::bigint as in_pool, sum(coalesce((pre = 1 and coalesce(post, 99) > 1)::int, 0))::bigint as demoted, sum(coalesce((coalesce(pre, 99) > 1 and post = 1)::int, 0))::bigint as promoted from r""",
    "rerank_comparison": f"""with {POOL},
      qi as (select query_id, t, i, t[i] as token from (select query_id, {tokens('query')} as t from q), generate_series(1, len(t)) as g(i)),
      wi as (select query_id, i, token, t[i - 1] || ' ' || token as before, token || ' ' || t[i + 1] as after, len(t) as m, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) as idf from qi left join df on df.term = token cross join st),
      ct as (select chunk_id, t, list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]) as b from (select chunk_id, {tokens('text')} as t from c where chunk_id in (select chunk_id from fin))),
      va as (select fin.query_id, fin.chunk_id, fin.rank, fin.many, sum(idf * (2 * list_contains(ct.t, token)::int + (i > 1 and list_contains(ct.b, before))::int + (i < m and list_contains(ct.b, after))::int) / (2 + (i > 1)::int + (i < m)::int)) / nullif(sum(idf), 0) as score
        from fin left join wi on wi.query_id = fin.query_id left join ct on ct.chunk_id = fin.chunk_id group by all),
      vr as (select query_id, chunk_id, rank, row_number() over (partition by query_id order by round(case when many = 1 then 1.0 else coalesce(score, 0) end, 4) desc, rank)::int as final_rank from va),
      al as (select 'lexical' as scorer, query_id, chunk_id, rank, final_rank from pool union all select 'interaction', query_id, chunk_id, rank, final_rank from vr),
      r as (select scorer, query_id, min(case when chunk_id = query_id then rank end) as pre, min(case when chunk_id = query_id then final_rank end) as gold_rank from al group by all)
      select scorer, {METRICS.format(1)}, {METRICS.format(3)}, {RR}, count(*) as queries, sum((pre is not null)::int)::bigint as in_pool,
        sum((coalesce(pre = 1, false) and coalesce(gold_rank, 99) > 1)::int)::bigint as demoted, sum((coalesce(pre, 99) > 1 and coalesce(gold_rank = 1, false))::int)::bigint as promoted from r group by scorer""",
    "demotion_causes": f"""with {POOL}, x as (select lower(gc.source) as g, lower(pc.source) as p, length(gc.text) as gl, length(pc.text) as pl
  from pool a join pool b using (query_id) join c gc on gc.chunk_id = a.chunk_id join c pc on pc.chunk_id = b.chunk_id where a.chunk_id = a.query_id and a.rank = 1 and a.final_rank > 1 and b.final_rank = 1)
select count(*) as demotions, coalesce(sum((contains(g, p) or contains(p, g))::int), 0)::bigint as same_article, coalesce(round(sum((contains(g, p) or contains(p, g))::int) * 100.0::double / count(*), 1), 0) as same_article_percent,
  coalesce(sum((pl > gl)::int), 0)::bigint as longer_preferred, coalesce(sum((pl <= gl)::int), 0)::bigint as shorter_preferred from x""",
    "token_length_stats": f"select round(avg(n), 6) as avg_tokens, max(n) as max_tokens, sum((n > 512)::int)::bigint as over_512, round(quantile_cont(n::double, 0.95), 6) as p95_tokens from (select {count_tokens('text')} as n from documents)",
    "tokenize_counts": f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_distinct, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, {tokens('text')} as t from documents)",
    "sentence_split": f"select doc_id, unnest(range(len(s)))::int as idx, unnest(s) as sentence from (select doc_id, {sentences('text')} as s from documents)",
    "replay_tokens": r"select doc_id, len(t)::int as n_pieces, md5(array_to_string(t, '')) as joined_md5 from (select doc_id, regexp_extract_all(text, '\S+|\s+') as t from documents)",
    "text_normalisers": rf"""select doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {strip('x')}), lambda x: x <> ''), chr(10))) as clean_lines,
md5({strip(r"regexp_replace(lower(text), '\s+', ' ', 'g')")}) as for_match, md5({strip(r"regexp_replace(text, '\s+', ' ', 'g')")}) as collapsed,
md5(regexp_replace({strip('lower(text)')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')) as for_dedup, md5({answer_text('text')}) as as_answer, {count_tokens('text')} as n_tokens from documents""",
    "factual_tokens": f"select doc_id, len(t)::int as n, md5(array_to_string(list_sort(t), ' ')) as tokens_md5 from (select doc_id, {factual('text', STOP_ANSWERS)} as t from documents)",
    "heading_lines": f"with {HEADED} select doc_id, idx, line from headed where regexp_matches({strip('line')}, '{HEADING}')",
    "table_lines": f"with {LINES} select doc_id, count(*) as n_table_lines from lines where {TABLE} group by doc_id",
    "heading_sections": f"""with {HEADED}, s as (select doc_id, idx, {strip('line')} as line from headed), n as (select *, sum(regexp_matches(line, '{HEADING}')::int) over (partition by doc_id order by idx)::bigint as section from s where line <> '')
select doc_id, section, count(*) as n_lines, sum(length(line))::bigint as n_chars from n group by all""",
    "page_split": f"select doc_id, unnest(range(1, len(p) + 1))::int as page, md5(unnest(p)) as text_md5 from (select doc_id, list_filter(list_transform(string_split(text, chr(12)), lambda x: {strip('x')}), lambda x: x <> '') as p from documents)",
    "table_row_serialisation": "select event_id, array_to_string(list_filter(['event: ' || nullif(trim(event_type), ''), 'Col2: ' || trunc(value)::bigint, 'user: ' || user_id], lambda x: x is not null), ' | ') as row from events",
    "scalar_functions": """select event_id, round(1 / (1 + exp(-greatest(least(value, 15), -15))), 6) as sigmoid, round(case when r <= 10 then 1 / log2(r + 1) else 0 end, 6) as gain, round(1.0::double / r, 6) as reciprocal,
round(case when r = 1 then 0 else coalesce(value / (r - 1), 0) end, 6) as ratio, case when r >= 8 then 'length' else 'stop' end as finish, '10.0.0.' || r as ip, props as payload from (select *, event_id % 15 + 1 as r from events)""",
    "pii_redact_documents": f"with {pii('documents', 'doc_id')} select doc_id, md5(text) as text_md5, redactions::int as redactions from rd",
    "pii_counts_by_entity": f"with {pii('documents', 'doc_id')} " + " union all ".join(f"select '{e}' as entity, sum(n{i})::bigint as redactions, sum((n{i} > 0)::int)::bigint as documents from rd" for i, (e, _) in enumerate(PATTERNS)),
    "pii_eval_scores": f"""with {pii('documents', 'doc_id')}, k as (select *, list_filter([{', '.join(f"case when n{i} > 0 then '{e}' end" for i, (e, _) in enumerate(PATTERNS))}], lambda x: x is not null) as kinds from rd),
cs as (select *, case len(kinds) when 0 then 'false_positive' when 1 then 'recall' else 'multi_entity' end as category, case when len(kinds) = 1 then kinds[1] end as expected_entity from k),
ps as (select *, coalesce(case category when 'recall' then redactions >= 1 and contains(text, '<' || expected_entity || '>') when 'false_positive' then redactions = 0 and text = original else redactions >= 2 end, false)::int as ok from cs)
select category, expected_entity, count(*) as cases, sum(ok)::bigint as passed, round(sum(ok)::double / count(*), 6) as rate from ps group by all""",
    "dedup_content_hash": "select sha256(text) as content_hash, min(doc_id) as first_id, count(*) as copies from documents group by 1",
    "dedup_new_documents": "select doc_id from documents where source <> 'src0' and sha256(text) not in (select sha256(text) from documents where source = 'src0')",
    "dedup_refused_documents": "select d.doc_id, e.existing_id from documents d join (select sha256(text) as h, min(doc_id) as existing_id from documents where source = 'src0' group by 1) e on sha256(d.text) = e.h where d.source <> 'src0'",
    "document_inventory": f"with {CHUNKS} select doc_id, max(source) as source, list_sort(list_distinct(list(strategy))) as strategies, count(*) as total_chunks from chunks group by doc_id",
    "chunk_counts_by_strategy": f"with {CHUNKS} select s.strategy, count(c.doc_id) as chunks from (values ('character'), ('structure'), ('semantic')) as s(strategy) left join chunks c on c.strategy = s.strategy group by s.strategy",
    "length_stats_by_strategy": f"with {CHUNKS} select strategy, count(*) as chunks, round(avg(length(text)), 6) as avg_len, min(length(text))::int as min_len, max(length(text))::int as max_len from chunks group by strategy",
    "upsert_chunks": f"with {CHUNKS} select c.doc_id, strategy, page, chunk_idx, md5(case when d.lang = 'fr' then upper(c.text) else c.text end) as text_md5 from chunks c join documents d using (doc_id)",
    "delete_document": f"with {CHUNKS} select doc_id, count(*) as total_chunks from chunks where doc_id <> 7 group by doc_id",
    "router_topk_mean": f"with {ROUTER} select query_id, intent, round(score, 6) as score from scores",
    "router_route": f"with {ROUTER} select query_id, round(confidence, 6) as confidence, confidence < 0.55 as fallback_applied, case when confidence < 0.55 then 'general' else best end as intent, case when confidence >= 0.55 and best = 'rag' then 'rag' else 'hf_local' end as route from best",
    "router_threshold_sweep": f"with {ROUTER}, g as (select round(i * 0.05, 2)::double as threshold from range(6, 17) as r(i)) select threshold, round(avg((case when confidence < threshold then 'general' else best end = actual)::int), 6) as accuracy, sum((confidence < threshold)::int)::bigint as fallbacks from best cross join g group by threshold",
    "router_confusion": f"with {ROUTER}, l as (select i::varchar as l from range(10) as r(i)) select a.l as actual, p.l as predicted, count(b.query_id) as n from l a cross join l p left join best b on b.actual = a.l and b.best = p.l group by all",
    "router_prf": f"""with {ROUTER}, m as (select actual as label, 1 as a, (actual = best)::int as t, 0 as p from best union all select best, 0, 0, 1 from best),
s as (select label, sum(t)::bigint as tp, (sum(p) - sum(t))::bigint as fp, (sum(a) - sum(t))::bigint as fn, sum(a)::bigint as support from m group by label),
r as (select *, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as pr, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as re from s)
select label, tp, fp, fn, support, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end, 6) as f1 from r""",
    "leakage_semi_join": rf"with k as (select *, regexp_replace({strip('lower(text)')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g') as k from documents) select doc_id from k where source <> 'src0' and k in (select k from k where source = 'src0')",
    "adjacent_similarity": "select vec_id, label, round(list_cosine_similarity(embedding::double[], before), 6) as similarity from (select *, lag(embedding::double[]) over (partition by label order by vec_id) as before from embeddings) where before is not null",
    "token_budget_pack": f"with {BUDGET} select query_id, chunk_id, rank, cost, used from fit",
    "context_prompts": f"with {BUDGET}, p as (select query_id, any_value(query) as query, string_agg(block, chr(10) || chr(10) order by rank) as context from fit group by query_id) select query_id, md5(context) as context_md5, md5('Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:') as prompt_md5 from p",
    "answer_stub": f"""with {ANSWERS} select query_id, answer, (contains(lower(answer), 'do not contain enough information') or contains(lower(answer), 'does not contain enough information') or contains(lower(answer), 'not enough information') or contains(lower(answer), 'insufficient information') or contains(lower(answer), 'not mentioned in the provided')) as refused,
(contains(answer, '{REFUSAL}') or contains(lower(answer), 'not contain enough information')) as refused_fully from answers""",
    "answer_em_f1": f"""with {ANSWERS}, {EM} select query_id, (nq <> '' and na = nq)::int::double as em_strict, (nq <> '' and contains(na, nq))::int::double as em_contains, round({f1('wa', 'wq')}, 6) as f1, round(greatest({f1('wa', 'wq')}, {f1('wa', 'wc')}), 6) as f1_two_golds from words""",
    "citation_validity": rf"with {ANSWERS}, ci as (select query_id, len(chunks) as n, list_transform(regexp_extract_all(answer || ' [7] [1, 2]', '\[(\d+)\]', 1), lambda x: x::int) as cs from answers) select query_id, len(cs) > 0 as has_citation, round(len(list_filter(cs, lambda x: x >= 1 and x <= n))::double / len(cs), 6) as validity from ci",
    "grounding_ratio": f"""with {ANSWERS}, v as (select *, query || ' [1] [9]' as cited, case when len(chunks) >= 1 then [chunks[1]] else chunks end as base from answers),
g as (select *, {factual('cited', STOP)} as mine, list_filter({factual('cited', STOP)}, lambda w: not list_contains({factual("array_to_string(base, chr(10))", '[]')}, w)) as lost from v)
select query_id, round({ground('query', 'chunks')}, 6) as grounding, case when len(mine) = 0 then 1.0 else round(1 - len(lost)::double / len(mine), 4) end as cited_grounding, array_to_string(list_sort(lost), ' ') as ungrounded from g""",
    "answer_quality": rf"""with {ANSWERS}, {EM}, m as (select *, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int) as cs, {ground('answer', 'chunks')} as g from words)
select count(*) as answers, round(avg((len(cs) > 0)::int), 6) as citation_presence, round(avg(case when len(cs) > 0 then len(list_filter(cs, lambda x: x >= 1 and x <= len(chunks)))::double / len(cs) end), 6) as citation_precision,
round(avg(g), 6) as grounding, round(avg((contains(lower(answer), 'not contain enough information'))::int), 6) as refusal_rate, round(avg((g < 1)::int), 6) as hallucination_rate, round(avg((nq <> '' and contains(na, nq))::int) * 100, 6) as em_percent, round(avg({f1('wa', 'wq')}) * 100, 6) as f1_percent from m""",
    "conversation_limits": "select conv_id, count(*) as n_messages, count(*) > 4 as too_many, min(case when length(text) > 400 then turn end) as first_too_long from conversations group by conv_id",
    "conversation_redact": f"with {pii('conversations', 'conv_id, turn, role')} select conv_id, turn, role, md5(case when role in ('user', 'system', 'assistant') then text else original end) as text_md5, (case when role in ('user', 'system', 'assistant') then redactions else 0 end)::int as redactions from rd",
    "conversation_trim": f"""with l as (select *, {count_tokens('text')} as tokens, sys and i = 1 as heads from ({LIMITED})),
n as (select *, coalesce(sum(case when heads then tokens end) over (partition by conv_id), 0) + sum(case when heads then 0 else tokens end) over (partition by conv_id order by turn desc rows unbounded preceding) as need from l),
f as (select *, max(case when j = 1 then need end) over (partition by conv_id) <= 300 as fits from n)
select conv_id, turn, role, tokens, fits from f where heads or j = 1 or need <= 300""",
    "last_user_turn": "select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by conv_id",
    "request_metrics": f"with {REQUESTS} select event_type as intent, code as status, count(*) as requests, round(sum(value), 3) as duration_sum, sum(pii_redactions)::bigint as pii_redactions, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens from requests group by all",
    "request_windows": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type as intent, count(*) as requests from events group by all",
    "request_exposition": f"""with {REQUESTS}, n as (select count(*) as n, sum(pii_redactions)::bigint as p, sum(prompt_tokens)::bigint as pt, sum(completion_tokens)::bigint as ct from requests) select * from (
select unnest([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16])::bigint as ord, unnest([
'# HELP gateway_active_requests Current in-flight inference requests.', '# TYPE gateway_active_requests gauge', 'gateway_active_requests 0',
'# HELP gateway_requests_total Total number of chat completions processed.', '# TYPE gateway_requests_total counter',
'# HELP gateway_pii_redactions_total Total number of sensitive PII entities redacted.', '# TYPE gateway_pii_redactions_total counter', 'gateway_pii_redactions_total ' || p,
'# HELP gateway_tokens_total Total tokens processed and generated.', '# TYPE gateway_tokens_total counter', 'gateway_tokens_total{{type="prompt"}} ' || pt, 'gateway_tokens_total{{type="completion"}} ' || ct,
'# HELP gateway_request_duration_seconds Total execution time for chat completion requests.', '# TYPE gateway_request_duration_seconds summary', 'gateway_request_duration_seconds_sum ' || printf('%.6f', n * 0.25::double), 'gateway_request_duration_seconds_count ' || n]) as line from n)
union all select 5, 'gateway_requests_total{{intent="' || event_type || '",status="' || code || '"}} ' || count(*) from requests group by event_type, code""",
    "rate_limit_attempts_window": "select event_id, count(*) over (partition by user_id order by epoch(ts) range between 60 preceding and current row) as attempts from events",
    "chunk_character": CHARACTER,
    "rate_limit_decisions": LIMITER,
    "query_responses": f"with {RESPONSES} select item_id as query_id, case when length(text) > 200 then 400 else 200 end as status, case when length(text) > 200 then 'Query length (' || length(text) || ') exceeds maximum limit of 200 characters.' end as detail, case when length(text) <= 200 then coalesce(n, 0) end as total_retrieved, chunk_ids from benchmark left join ids on query_id = item_id",
    "answer_sources": f"with {SOURCES} select query_id, answer, coalesce(n, 0) as n_sources, sources, case when n is null then 0 else {count_tokens('prompt')} end as prompt_tokens, case when n is null then 0 else {count_tokens('answer')} end as completion_tokens from pr",
    "unanswerable_refusals": f"with {bm25(DOCS, UNKNOWN, 3)} select count(*) as cases, avg(case when query_id in (select query_id from bm) then 0.0 else 100.0 end) as refusal_accuracy from q",
    "faithfulness_documents": f"with {FAITHFUL_DOCUMENTS} select * from marked",
    "faithfulness_documents_by_kind": f"with {FAITHFUL_DOCUMENTS} select category, {FAITHFUL_SUMS} from marked group by category union all select 'all', {FAITHFUL_SUMS} from marked",
    "refusals_by_threshold": f"""with {bm25(DOCS, LAST_SAID, 20)},
      lx as (select query_id, max(case when many = 1 then 1.0 when len(asked) = 0 then 0.0 else len(list_intersect(asked, {tokens('c.text')}))::double / len(asked) end) as best
        from (select *, count(*) over (partition by query_id) as many from bm) b join (select *, list_distinct({tokens('query')}) as asked from q) a using (query_id) join c using (chunk_id) group by query_id)
      select query_id, coalesce(round(best, 4) < 0.6, true) as refused from q left join lx using (query_id)""",
    "requests_in_flight_by_minute": """with ev as (select epoch_us(ts) as s, epoch_us(ts) + floor(value * 1000000)::bigint as e from events where ts is not null and value >= 0),
      ch as (select moment, sum(d)::bigint as d from (select s as moment, 1 as d from ev union all select e, -1 from ev) group by moment),
      fl as (select *, sum(d) over (order by moment)::bigint as flying from ch)
      select strftime(make_timestamp((moment // 60000000) * 60000000), '%Y-%m-%d %H:%M:%S') as unit_start, greatest(max(flying), min_by(flying - d, moment))::bigint as peak, max_by(flying, moment)::bigint as current from fl group by moment // 60000000""",
    "faithfulness_cases": f"with {FAITHFUL} select * from marked",
    "faithfulness_by_kind": f"with {FAITHFUL} select category, {FAITHFUL_SUMS} from marked group by category union all select 'all', {FAITHFUL_SUMS} from marked",
    "downgrade_reasons": "select event_id, case event_id % 11 when 0 then 'rag_service_offline' when 1 then 'rag_timeout' when 2 then 'rag_exception_ValueError' else case when event_id % 5 = 0 then 'rag_status_503' when event_id % 5 = 1 then 'rag_status_404' when event_id % 4 = 0 then 'no_documents_indexed' end end as reason, case when event_id % 2 = 0 then 'http://host/v1/chat/completions' else 'http://host/x/v1/chat/completions' end as url from events",
    "latency_by_type": "select event_type, round(avg(value * 1000), 6) as mean_ms, round(quantile_cont(value * 1000, 0.95), 6) as p95_ms from events group by event_type",
    "hits_by_category": f"with {bm25(DOCS, ITEMS, 10)}, {GOLDS}, r as (select g.query_id, min(bm.rank) as gold_rank from golds g left join bm on bm.query_id = g.query_id and bm.chunk_id = g.chunk_id group by g.query_id), k as (select *, coalesce(gold_rank = 1, false)::int * 100.0 as hit from r join q using (query_id)) select 'bm25' as configuration, round(avg(case when length(query) <= 200 then hit end), 6) as short_hit_at_1, round(avg(case when length(query) > 200 then hit end), 6) as long_hit_at_1, round(avg(case when gold_rank <= 3 then 1.0 / gold_rank else 0 end), 6) as mrr_at_3 from k",
    "router_best_threshold": f"with {ROUTER}, g as (select round(i * 0.05, 2)::double as threshold from range(6, 17) as r(i)), s as (select threshold, avg((case when confidence < threshold then 'general' else best end = actual)::int) as accuracy, sum((confidence < threshold)::int)::bigint as fallbacks from best cross join g group by threshold) select threshold, round(accuracy, 6) as accuracy, fallbacks from s order by round(accuracy, 9) desc, threshold limit 1",
    "routing_results": f"with {ROUTER} select query_id, round(confidence, 4) as confidence, confidence < 0.55 as fallback_applied, case when confidence < 0.55 then 'general' else best end as intent, case when confidence >= 0.55 and best = 'rag' then 'rag' else 'hf_local' end as route, 0.55::double as threshold, case when confidence < 0.55 then 'confidence ' || printf('%.4f', round(confidence, 4)) || ' is below the threshold 0.55' end as warning from best",
    "two_way_containment": rf"with l as (select doc_id, string_split(text, chr(10))[1] as line from documents), n as (select a.doc_id, {strip(r"regexp_replace(lower(a.line), '\s+', ' ', 'g')")} as a, {strip(r"regexp_replace(lower(substr(b.line, 1, 12)), '\s+', ' ', 'g')")} as b from l a join l b on b.doc_id + 1 = a.doc_id) select doc_id, coalesce(contains(a, b) or contains(b, a), false) as contained from n",
}
