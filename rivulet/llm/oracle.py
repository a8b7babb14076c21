"""DuckDB SQL for the queries that SQL can express."""

SHARDING = """
with recursive bits as (
  select i as byte, cast(i as bigint) as v, 0 as k from range(256) t(i)
  union all
  select byte, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
steps as (select list(v order by byte) as step from bits where k = 8),
rows as (select row_number() over () as n, doc_id, text from documents),
sums as (
  select n, doc_id, cast(coalesce(strlen(text), 0) + 8 as bigint) as size,
    cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c // 256, step[(xor(c, b) % 256) + 1])), 4294967295) as bigint) as text_crc32
  from rows, steps),
race as (
  select n, s.shard, -ln((('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || s.shard), 1, 13))::bigint + 0.5::double) / 4503599627370496::double) as t
  from rows, (select cast(range as int) as shard from range(25)) s),
place as (select n, arg_min(shard, t) filter (where shard < 24) as shard, arg_min(shard, t) as grown_shard from race group by n)
select doc_id, size, text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from sums join place using (n)
"""

EMBEDDINGS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select i, j from p union select r.i, p.j from reach r join p on r.j = p.i)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) as component_id, e.vec_id <= coalesce(c.c, e.vec_id) as kept
from embeddings e
left join (select i, count(*) as n from p group by i) n on n.i = e.vec_id
left join (select i, min(j) as c from reach group by i) c on c.i = e.vec_id
"""

NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) as gram
  from w where len(words) > 0),
size as (select doc_id, count(*) as n from g group by doc_id),
pair_counts as (select a.doc_id as i, b.doc_id as j, count(*) as n from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
p as (
  select i, j from pair_counts as b join size a on a.doc_id = i join size s on s.doc_id = j where b.n * 10 >= 8 * (a.n + s.n - b.n)),
reach as (select i, j from p union select r.i, p.j from reach r join p on r.j = p.i)
select d.doc_id, coalesce(n.n, 0) as n_links, least(d.doc_id, coalesce(c.c, d.doc_id)) as component_id, d.doc_id <= coalesce(c.c, d.doc_id) as kept
from documents d
left join (select i, count(*) as n from p group by i) n on n.i = d.doc_id
left join (select i, min(j) as c from reach group by i) c on c.i = d.doc_id
"""

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
long as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    23 + length(role || text) + length(role || text) - length(replace(role || text, '\', ''))
      + len(regexp_extract_all(role, '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + len(regexp_extract_all(text, '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) as chars
  from rows window w as (partition by conv_id order by turn nulls first, role, text)),
prefix as (select *, sum(chars) over (partition by conv_id order by k) as upto, role = 'assistant' as reply from long)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where reply), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (where reply), '')) as loss_sha256,
  cast(sum(upto) filter (where reply or k = n) as bigint) as formatted_chars, count(*) filter (where reply or k = n) as n_examples
from prefix group by conv_id
"""

#: The given pages hold one article element each, of paragraphs with a heading; so its text can be cut out by patterns, without the tree.
MAIN_TEXT = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS x FROM inner_html),
plain AS (SELECT page_id, url, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM bare),
spaced AS (SELECT page_id, url, trim(regexp_replace(x, '[\s\x0b\x85\p{Z}]+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM spaced
"""
