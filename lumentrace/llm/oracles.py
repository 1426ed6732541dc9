"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import line_dedup
from .chat_format import MARKS
from .url_templates import oracle as url_oracle

_WARC = """
with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as owner from pages),
r as (select *, strlen(h) >= 1000 and page_id <> owner as revisit from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest, case when revisit then 'revisit' else 'response' end as record_type, case when revisit then owner end as refers_to from r
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINNOW = f"""
with b as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from (select item_id, w, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)),
hit as (select distinct doc_id, dw.n, i, item_id from dw join win on dw.n = win.n and dw.k = win.k),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by doc_id),
items as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as ids from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join words using (doc_id) left join items using (doc_id)
"""

_SIZE = "length(text) + length(text) - length(regexp_replace(text, '[\\\\\\[\\]<>|]', '', 'g'))"
_MARKED = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in MARKS.items())
_ROLE = _SIZE.replace("text", "role")
_HARD = "</s>[INST] ok [/INST]"
_CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}')),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
  cast(sum({_SIZE} + case role {_MARKED} else {_ROLE} + 11 end) as bigint) as formatted_chars from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

_LINES = rf"""
with l as (select doc_id, i - 1 as pos, ls[i] as line, ls[i + 1] as nxt, i < len(ls) as has_next from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))),
w as (select *, case when trim(line) = '' then 0 else len(string_split_regex(trim(line), '\s+')) end as n,
  has_next and (cast('0x' || substr(md5(line), 1, 7) as bigint) * {line_dedup.FACTOR} + cast('0x' || substr(md5(coalesce(nxt, '')), 1, 7) as bigint)) % {line_dedup.MODULUS} % {1 << line_dedup.MASK_BITS} = 0 as masked,
  has_next and count(*) over (partition by line, nxt, has_next) > 1 as gap, count(*) over (partition by line) > 1 as known from l),
b as (select *, coalesce(lag(gap) over (partition by doc_id order by pos), false) as gap_before, coalesce(lag(masked) over (partition by doc_id order by pos), false) as cut from w),
c as (select *, max(case when not gap_before or cut then pos end) over (partition by doc_id order by pos) as start from b where gap or gap_before or (known and n >= {line_dedup.MIN_WORDS})),
chunk as (select doc_id, pos - (pos - start) % {line_dedup.MAX_LINES} as lo, max(pos) as hi, sum(n) as n, string_agg(line, chr(10) order by pos) as t from c group by 1, 2),
o as (select *, first_value(doc_id) over s as o_doc, first_value(lo) over s as o_lo from chunk window s as (partition by t order by doc_id, lo)),
later as (select *, lag(hi) over s as p_hi, lag(o_doc) over s as p_doc, lag(lo - o_lo) over s as p_off from o where doc_id <> o_doc or lo <> o_lo window s as (partition by doc_id order by lo)),
run as (select *, sum(case when p_hi + 1 = lo and p_doc = o_doc and p_off = lo - o_lo then 0 else 1 end) over (partition by doc_id order by lo) as run from later),
spans as (select doc_id, min(lo) as lo, max(hi) as hi, sum(n) as words from run group by doc_id, run having sum(n) >= {line_dedup.MIN_WORDS}),
gone as (select doc_id, unnest(range(lo, hi + 1)) as pos from spans),
kept as (select l.doc_id, coalesce(string_agg(line, chr(10) order by l.pos) filter (gone.pos is null), '') as text, count(gone.pos) as removed_lines from l left join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id),
total as (select doc_id, cast(sum(words) as bigint) as removed_words from spans group by doc_id)
select d.doc_id, kept.text, coalesce(removed_lines, 0) as removed_lines, coalesce(removed_words, 0) as removed_words from documents d left join kept using (doc_id) left join total using (doc_id)
"""

_HARD = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, cast(list_inner_product(a.v, e.v) as bigint) as score
  from e as a join e on a.vec_id <> e.vec_id where a.vec_id % 50 = 0
),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as integer) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select * from n where rank <= 3
"""

ORACLES: dict[str, str] = {
    "op2_template_tree": url_oracle(),
    "op3_content_addressed_warc": _WARC,
    "op7_line_chunks": _LINES,
    "op8_winnowing": _WINNOW,
    "op9_prefix_target": _CHAT,
    "op13_hard_negatives": _HARD,
}
