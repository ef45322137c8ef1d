"""DuckDB text of queries that SQL can say too; plain definitions, for small tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: reach(a, b): b can be reached from a by the links (a, b), a < b, of `links`.
_REACH = """both_ as (select a, b from links union select b, a from links),
reach as (select a, b from both_ union select r.a, k.b from reach r join both_ k on k.a = r.b)"""


def near_documents(words: int, num: int, den: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {words} then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - {words} + 2), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where {den} * k >= {num} * (x.n + y.n - k)),
{_REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as b from reach group by a) m on m.a = d.doc_id"""


def repeated_phrases(window: int) -> str:
    return rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
p as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i, ws from w),
x as (select doc_id, i, word, case when i <= len(ws) - {window - 1} then md5(array_to_string(ws[i:i + {window - 1}], ' ')) end as phrase from p),
l as (select *, phrase is not null and row_number() over (partition by phrase order by doc_id, i) > 1 as later from x),
g as (select doc_id, i, word, bool_or(later) over (partition by doc_id order by i rows between {window - 1} preceding and current row) as gone from l),
k as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from g group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k on k.doc_id = d.doc_id"""


def repeated_bytes(window: int) -> str:
    # Stretches of the text as hexadecimal digits, so that a window is cut from a short string.
    return f"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, unnest(range(0, length(h) // 2, 1024)) as base, h from t),
c as (select doc_id, base, substr(h, 2 * base + 1, 2 * (1024 + {window})) as h, length(h) // 2 - base as rest from s),
p as (select doc_id, base, h, rest, unnest(range(0, least(rest, 1024))) as o from c),
x as (select doc_id, base + o as i, substr(h, 2 * o + 1, 2) as byte, case when o + {window} <= rest then md5(substr(h, 2 * o + 1, {2 * window})) end as string from p),
r as (select *, string is not null and count(*) over (partition by string) > 1 as again from x),
g as (select doc_id, i, byte, bool_or(again) over (partition by doc_id order by i rows between {window - 1} preceding and current row) as gone from r),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as first from g),
k as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where first) as n_spans,
  coalesce(string_agg(byte, '' order by i) filter (where not gone), '') as kept from e group by doc_id)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from documents d left join k on k.doc_id = d.doc_id"""


def near_vectors(threshold: float) -> str:
    return f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= {threshold}),
{_REACH},
m as (select a, min(b) as b from reach group by a),
n as (select a, count(*) as n from both_ group by a),
c as (select d.vec_id, coalesce(n.n, 0) as n_links, least(d.vec_id, coalesce(m.b, d.vec_id)) as component_id
  from embeddings d left join n on n.a = d.vec_id left join m on m.a = d.vec_id)
select vec_id, n_links, component_id, vec_id = component_id as kept from c"""


#: entries: the checksum's table of 256 numbers, from its polynomial.
CRC_TABLE = """crc as (select list(entry order by i) as entries from (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry
  from (select unnest(range(256)) as i)))"""


def crc32(text: str) -> str:
    """The checksum of a text's bytes, folded over them; needs `entries`."""
    return f"""xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode({text})), '..'),
lambda h: cast('0x' || h as bigint))), lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)])), 4294967295)"""


def hard_negatives() -> str:
    return """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) as score
  from v a join v on a.vec_id % 100 = 0 and a.vec_id <> v.vec_id and len(a.e) = len(v.e)),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select anchor_id, positive_id, positive_score, id as negative_id, score as negative_score,
  row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""


def spelling_variants() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive {CRC_TABLE},
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]+')) as run from documents),
g as (select doc_id, run, count(*) as times from r where length(run) >= 5 group by doc_id, run),
h as (select run, times, {crc32("coalesce(cast(doc_id as varchar), 'null') || ':' || run")} as h from g, crc),
w as (select case when h % 97 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, times from h),
v as (select word, cast(sum(times) as bigint) as n from w where length(word) >= 5 group by word having sum(times) >= 3),
c as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
k as (select word, n, i, word[1:i - 1] as head, word[i + 1:] as tail from c),
replaced as (select distinct a.word as a, b.word as b, b.n from k a join k b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word),
dropped as (select distinct k.word as long_, k.n as long_n, v.word as short_, v.n as short_n from k join v on v.word = k.head || k.tail),
near as (select a, b, n from replaced union all select long_, short_, short_n from dropped union all select short_, long_, long_n from dropped),
best as (select a as word, count(*) as n_near, first(b order by n desc, b) as b, max(n) as b_n from near group by a),
x as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when b_n >= 2 * v.n then b end as form, case when b_n >= 2 * v.n then b_n end as form_n from v left join best on best.word = v.word),
chain as (select word, word as here, 0 as step from x union all select chain.word, x.form, step + 1 from chain join x on x.word = chain.here where x.form is not null),
root as (select word, arg_max(here, step) as root from chain group by word)
select x.word, n, n_near, form, form_n, root from x join root on root.word = x.word"""
