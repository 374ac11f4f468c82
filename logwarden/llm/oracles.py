"""The registered corpus queries in DuckDB SQL, where SQL can express them.

Fingerprints, tokens, entropy, surrogates and the license rules have no SQL form;
their queries are tested against brute force.
"""

from __future__ import annotations

from logwarden.llm.collocations import COVERED_PERCENT, LEAST, LONGEST, SCALE, TOP
from logwarden.llm.decontaminate import SHINGLE, SIMILARITY
from logwarden.llm.lexical_search import TOP as SEARCH_TOP
from logwarden.llm.line_quality import BOILERPLATE, ENDINGS, SEPARATORS, SYMBOLS, LineRules
from logwarden.llm.substring_dedup import WINDOW
from logwarden.llm.warc import REVISIT_BYTES

_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
_RULES = LineRules()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LEAKS = rf"""
with d as materialized (select row_number() over () as d, * from (select distinct doc_id, text from documents)),
dw as materialized (select d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w from d),
bw as materialized (select b, item_id, w, least(len(w), {SHINGLE}) as s from (
  select row_number() over () as b, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w
  from (select distinct item_id, text from benchmark)) where len(w) > 0),
bsh as materialized (select b, s, n, array_to_string(w[i + 1:i + s], ' ') as g
  from (select b, s, w, len(w) - s + 1 as n, unnest(range(0, len(w) - s + 1)) as i from bw)),
bc as materialized (select b, s, n, g, count(*) as k from bsh group by all),
dsh as materialized (select d, s, m, i, array_to_string(w[i + 1:i + s], ' ') as g
  from (select d, s, w, len(w) - s + 1 as m, unnest(range(0, len(w) - s + 1)) as i from dw, (select distinct s from bw))),
hit as materialized (select x.d, b.b, b.n, x.m, x.i, x.g, b.k from dsh x join bc b on x.s = b.s and x.g = b.g),
pair as materialized (select d, b, any_value(n) as n, any_value(m) as m from hit group by d, b having count(*) >= {SIMILARITY} * any_value(n) - 1e-9),
win as (select *, unnest(range(0, m)) as start from pair),
have as (select w.d, w.b, w.n, w.m, w.start, h.g, least(count(*), any_value(h.k)) as c
  from win w join hit h on h.d = w.d and h.b = w.b and h.i between w.start and w.start + w.n - 1 group by all),
sums as (select d, b, start, sum(c)::bigint as common, any_value(n) as n, least(any_value(n), any_value(m) - start) as size
  from have group by d, b, start)
select dw.doc_id, bw.item_id, cast(start as integer) as start, common / (size + n - common) as similarity
from sums join dw using (d) join bw using (b) where common / (size + n - common) >= {SIMILARITY}
qualify row_number() over (partition by d, b order by common / (size + n - common) desc, start) = 1
"""

WARC = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest, max(page_id) over (partition by body) as holder from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_BYTES} and holder <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and holder <> page_id then holder end as refers_to
from q
"""

SUBSTRINGS = f"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w)),
rep as (select doc_id, i from (select *, min(doc_id) over (partition by g) as owner from win) where owner < doc_id),
gone as (select distinct doc_id, i + unnest(range(0, {WINDOW})) as i from rep),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w),
kept as (select doc_id, string_agg(x, ' ' order by i) as x from word anti join gone using (doc_id, i) group by doc_id),
cut as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(cut.n, 0) as n_removed, sha256(coalesce(kept.x, '')) as kept_sha256
from w left join kept using (doc_id) left join cut using (doc_id)
"""

QUALITY = f"""
with d as materialized (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, i + unnest([0, 1, 2]) as p from twice) group by doc_id),
line as (select doc_id, x from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '{_WORD}')),
judged as (select doc_id, x,
  right(regexp_replace(x, '{_BLANK}$', ''), 1) not in ({", ".join(map(_quoted, ENDINGS))})
  or len(regexp_extract_all(x, '{SEPARATORS}')) >= {_RULES.separators}
  or (len(regexp_extract_all(x, '[{SYMBOLS}]')) > 0
    and len(regexp_extract_all(x, '[{SYMBOLS}]')) > {_RULES.symbols_per_word} * len(regexp_extract_all(x, '{_WORD}')))
  or (length(x) <= {_RULES.boilerplate_chars} and regexp_matches(x, {_quoted(BOILERPLATE)})) as fails from line),
lines as (select doc_id, count(*) - count(distinct x) as dup,
  coalesce(sum(length(regexp_replace(x, '{_BLANK}', '', 'g'))) filter (where fails), 0) as lost from judged group by doc_id),
m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  len(regexp_extract_all(t, '[{SYMBOLS}]')) as n_symbols, coalesce(lines.dup, 0) as n_dup_lines,
  coalesce(rep.n, 0) as n_repeat_words, coalesce(lines.lost, 0) as lost
  from d left join lines using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words as base_failed,
  not (n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words)
    and lost <= {_RULES.max_lost} * word_chars as kept
from m
"""

# the pages of the test tables mark their article, and their references are these five
PAGES = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as body from pages),
l as (select page_id, url, list_transform(string_split(regexp_replace(replace(body, chr(10), ' '), '</?(?:p|h1)>', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '\s+', ' ', 'g'))) as lines from a),
t as (select page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) as raw from l),
u as (select page_id, url, regexp_replace(raw, '&amp;?', '&', 'g') as text from t)
select page_id, url, text, cast(length(text) as bigint) as n_chars from u
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""
with piece as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p
  from (select coalesce(lang, 'und') as lang, {_ASCII_LOWER} as t from documents)),
word as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
f as materialized (select lang, k, g, count(*) as n from (
  {" union all ".join(f"select lang, {k} as k, array_to_string(w[i:i + {k - 1}], ' ') as g from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from word)" for k in range(1, LONGEST + 1))})
  group by all),
total as (select lang, sum(n) as n from f where k = 1 group by lang),
often as materialized (select * from f where n >= {LEAST}),
cand as materialized (select lang, k, g, n as a, string_split(g, ' ') as w from often where k > 1),
parts as materialized (select lang, g, a, i, array_to_string(w[1:i], ' ') as g1, array_to_string(w[i + 1:], ' ') as g2
  from (select *, unnest(range(1, k)) as i from cand)),
cut as materialized (select p.lang, p.g, p.a, i, l.n as l, r.n as r, ({SCALE}::hugeint * p.a) // (l.n + r.n) as score
  from parts p join often l on l.lang = p.lang and l.g = p.g1 join often r on r.lang = p.lang and r.g = p.g2),
low as (select * from cut qualify row_number() over (partition by lang, g order by score, i) = 1),
inside as materialized (select lang, g, max(a) as a from (
  select lang, a, array_to_string(w[i:i + m - 1], ' ') as g from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from cand)))
  group by all),
covered as (select s.lang, s.g from cand s join inside q on q.lang = s.lang and q.g = s.g where 100 * q.a >= {COVERED_PERCENT} * s.a)
select low.lang, cast(row_number() over (partition by low.lang order by score desc, a desc, low.g) as bigint) as rank, low.g as phrase,
  cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(total.n as bigint) as n, cast(score as bigint) as score
from low join total using (lang) anti join covered on covered.lang = low.lang and covered.g = low.g
qualify row_number() over (partition by low.lang order by score desc, a desc, low.g) <= {TOP}
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
with d as materialized (select row_number() over () as row, doc_id, regexp_extract_all({_ASCII_LOWER}, '{_TERM}') as w from documents),
size as (select count(*) filter (where len(w) > 0) as big_n, sum(len(w))::bigint as big_l from d),
q as materialized (select distinct item, item_id, unnest(w) as term from (
  select md5(concat(item_id, ' ', text)) as item, item_id, regexp_extract_all({_ASCII_LOWER}, '{_TERM}') as w from benchmark)),
tf as materialized (select row, term, count(*) as tf from (select row, unnest(w) as term from d) where term in (select term from q) group by all),
df as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as weight from tf, size group by term, big_n),
m as (select row, doc_id, 100 - 50 + (50 * len(w) * big_n) // big_l as m from d, size),
s as (select item, any_value(item_id) as item_id, row, any_value(doc_id) as doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from q join df using (term) join tf using (term) join m using (row) group by item, row)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id) as integer) as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item order by score desc, doc_id) <= {SEARCH_TOP}
"""

ORACLES: dict[str, str] = {
    "op13_lexical_search": SEARCH,
    "op12_collocations": COLLOCATIONS,
    "op11_main_text": PAGES,
    "op4_benchmark_leaks": LEAKS,
    "op5_warc_round_trip": WARC,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_line_quality": QUALITY,
}
