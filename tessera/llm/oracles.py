"""DuckDB SQL for the operators that SQL can express."""

MIXING = r"""
with rows as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as language,
         case coalesce(try_cast(regexp_extract(source, '[0-9]+') as bigint), 0) % 3 when 0 then 'web' when 1 then 'books' else 'forum' end as domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens
  from documents),
leaves as (select domain, language, source, sum(n_tokens)::bigint as tokens, (2 * sum(n_tokens))::bigint as room from rows group by all),
d0 as (select domain, sum(room)::bigint as room, case domain when 'web' then 50 when 'books' then 30 when 'forum' then 20 else 10 end as weight,
         (select sum(n_tokens)::bigint from rows) as budget from leaves group by domain),
d1 as (select *, greatest(budget - coalesce(sum(room) over b, 0), 0)::double / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as level
  from d0 window b as (order by room::double / weight, domain rows between unbounded preceding and 1 preceding)),
d2 as (select domain, least(room, floor(weight * max(level) over ())::bigint) as budget from d1),
l0 as (select domain, language, sum(room)::bigint as room, case language when 'en' then 40 when 'fr' then 20 when 'de' then 20 when 'es' then 20 else 10 end as weight, any_value(budget) as budget
  from leaves join d2 using (domain) group by domain, language),
l1 as (select *, greatest(budget - coalesce(sum(room) over b, 0), 0)::double / (sum(weight) over (partition by domain) - coalesce(sum(weight) over b, 0))::double as level
  from l0 window b as (partition by domain order by room::double / weight, language rows between unbounded preceding and 1 preceding)),
l2 as (select domain, language, least(room, floor(weight * max(level) over (partition by domain))::bigint) as budget from l1),
s0 as (select domain, language, source, tokens, room, 1 as weight, budget from leaves join l2 using (domain, language)),
s1 as (select *, greatest(budget - coalesce(sum(room) over b, 0), 0)::double / (sum(weight) over (partition by domain, language) - coalesce(sum(weight) over b, 0))::double as level
  from s0 window b as (partition by domain, language order by room::double / weight, source rows between unbounded preceding and 1 preceding)),
s2 as (select domain, language, source, tokens, least(room, floor(weight * max(level) over (partition by domain, language))::bigint) as quota from s1),
plans as (select *, case when tokens > 0 then quota // tokens else 0 end as whole_epochs from s2),
placed as (
  select r.*, p.whole_epochs, p.quota - p.whole_epochs * p.tokens as rest,
         coalesce(sum(r.n_tokens) over (partition by r.domain, r.language, r.source
           order by md5('7:' || p.whole_epochs::varchar || ':' || coalesce(r.doc_id::varchar, '')), r.doc_id, r.n_tokens rows between unbounded preceding and 1 preceding), 0)::bigint as before_it
  from rows r join plans p using (domain, language, source))
select doc_id, domain, language, source, n_tokens, (whole_epochs + (before_it < rest)::bigint)::bigint as copies,
       (whole_epochs * n_tokens + greatest(0, least(n_tokens, rest - before_it)))::bigint as tokens_taken
from placed
"""

DIVERGENCE = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
c0 as (select doc_id, lang, words, len(words)::bigint as n_words, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  [length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')),
   length(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g')), length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g'))] as k, length(text) as chars from w),
c as (select *, list_append(k, chars - list_sum(k)::bigint) as classes from c0),
win as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from c)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by doc_id, g) as times from win) where times > 1) group by doc_id),
enough as (select lang, count(*) as docs, sum(n_words) as all_words, [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6]), sum(classes[7])] as all_classes from c group by lang having count(*) >= 20),
top as (select * from (select *, row_number() over (partition by lang order by n desc, word) as r from (select lang, word, count(*) as n from (select lang, unnest(words) as word from c) join enough using (lang) group by all)) where r <= 24),
ref as (select lang, word, n::double / all_words as q from top join enough using (lang)
  union all select lang, null, (all_words - coalesce(s, 0))::double / all_words from enough left join (select lang, sum(n) as s from top group by lang) using (lang)),
own as (select doc_id, word, count(*) as n from (select doc_id, lang, unnest(words) as word from c) join top using (lang, word) group by all),
bins as (select c.doc_id, ref.q, coalesce(case when ref.word is null then c.n_words - coalesce(o.s, 0) else own.n end, 0)::double / c.n_words as p
  from c join ref using (lang) left join own on own.doc_id = c.doc_id and own.word = ref.word left join (select doc_id, sum(n) as s from own group by doc_id) o on o.doc_id = c.doc_id where c.n_words >= 40),
cbins as (select doc_id, unnest(classes)::double / chars as p, unnest(all_classes)::double / list_sum(all_classes) as q from c join enough using (lang) where chars >= 300),
dist as (select doc_id, kind, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end / 2 + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end / 2))) as d
  from (select doc_id, 'word' as kind, p, q from bins union all select doc_id, 'char', p, q from cbins) group by all),
j as (select c.*, coalesce(rep.n, 0)::bigint as n_repeat_words, (c.n_words < 10 or 100 * coalesce(rep.n, 0) > 20 * c.n_words) as base_failed, a.d as cd, b.d as wd
  from c left join rep using (doc_id) left join dist a on a.doc_id = c.doc_id and a.kind = 'char' left join dist b on b.doc_id = c.doc_id and b.kind = 'word')
select doc_id, n_words, (chars - classes[2])::bigint as word_chars, classes[5]::bigint as n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and coalesce(cd, 0) <= 0.28 and coalesce(wd, 0) <= 0.42) as kept, round(cd, 6) as char_distance, round(wd, 6) as word_distance from j
"""

NGRAM_JOIN = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i:i + 3], ' ') end as s from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) as i from w where len(words) > 0)),
z as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as h from g group by doc_id),
k as (select h, count(*) as class_size from z group by h),
l as (select a.doc_id as a, b.doc_id as b from g a join g b on a.s = b.s and a.doc_id < b.doc_id join z x on x.doc_id = a.doc_id join z y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id, coalesce(k.class_size, 1) as class_size
from documents d left join z using (doc_id) left join k using (h) left join (select a as doc_id, min(b) as low from r group by a) m using (doc_id)
"""

_ROUND = """
a{r} as materialized (
  select position, x, any_value(weight) as weight,
         min_by(entry, [list_inner_product(c, c) - 2 * list_inner_product(x, c), entry]) as entry
  from parts join b{p} using (position) group by position, x),
m{r} as (
  select position, entry, list(floor_mean order by i) as mean
  from (select position, entry, i, floor(sum(weight * x[i]) / sum(weight)) as floor_mean from a{r}, generate_series(1, 16) as t(i) group by position, entry, i) group by position, entry),
b{r} as materialized (select position, entry, coalesce(mean, c) as c from b{p} left join m{r} using (position, entry)),"""

CODES = (
    """
with usable as (
  select vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::double)) as v from embeddings
  where embedding is not null and list_count(list_filter(embedding, lambda v: isfinite(v))) = len(embedding)),
rows as (select vec_id, label, position, list_slice(v, 16 * position + 1, 16 * position + 16) as x from usable, generate_series(0, 3) as t(position)),
parts as materialized (select position, x, count(*)::double as weight from rows group by all),
b0 as (
  select position, (row_number() over (partition by position order by vec_id) - 1)::bigint as entry, x as c
  from rows where vec_id in (select vec_id from usable order by vec_id limit 256)),"""
    + "".join(_ROUND.format(r=r, p=r - 1) for r in range(1, 5))
    + """
coded as (
  select position, x, min_by([entry::double, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)],
                             [list_inner_product(c, c) - 2 * list_inner_product(x, c), entry]) as found
  from parts join b4 using (position) group by position, x),
each as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', found[1]::bigint), '' order by position) as code, sum(found[2]::bigint)::bigint as error
  from rows join coded using (position, x) group by vec_id),
labels as (select label, sum(error)::bigint as label_error from each group by label)
select vec_id, code, error, label_error,
       (select sha256(string_agg(c[i]::bigint::varchar, ',' order by position, entry, i)) from b4, generate_series(1, 16) as t(i)) as codebooks_sha256
from each join labels on each.label is not distinct from labels.label
"""
)
