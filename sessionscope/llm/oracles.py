"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sessionscope.llm.licenses import PHRASES, LicenseConfig

MIX = """
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast(concat('0x', substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, case i % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s),
o as (select *, 3 * source_size / w as ratio, row_number() over (order by 3 * source_size / w, i) as k, sum(source_size) over () as total from w),
lv as (select k, ratio, (total - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over (order by k rows between current row and unbounded following))::double as level from o),
level as (select level from lv where level <= ratio order by k limit 1),
t as (select source, source_size, least(w * level, (3 * source_size)::double) as target from w, level),
p as (select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end as whole from t),
g as (select *, case when whole >= 3 then 0 else target - whole * source_size end as goal from p),
hs as (select source, h, sum(size) as words from d group by 1, 2),
c as (select hs.*, goal, sum(words) over (partition by hs.source order by h) as upto from hs join g on hs.source is not distinct from g.source),
e as (select source, min(h) as h, arg_min(upto, h) as upto, arg_min(words, h) as words, any_value(goal) as goal from c where upto > goal group by 1),
l as (select g.source, g.source_size, target, whole, case when g.goal <= 0 or e.h is null then 0 when e.upto - g.goal < g.goal - (e.upto - e.words) then e.h + 1 else e.h end as lim
    from g left join e on g.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(size * (whole + case when h < lim then 1 else 0 end) as bigint) as taken from d join l on d.source is not distinct from l.source"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses_sql(config: LicenseConfig = LicenseConfig()) -> str:  # noqa: B008
    """Every block against every template, then windows of the whole text, as wide as twice the template's words, against the templates
    whose words the text holds at all; phrases by their places in the word list."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda x: f"list_filter(string_split_regex(translate({x}, '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    step = config.window // 2
    templates = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(config.templates))
    places = []
    for phrase, _ in PHRASES:
        same = " and ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split()))
        places.append(f"list_filter(range(1, len(ws) + 1), lambda i: {same})")
    at = [f"p{i}" for i in range(len(PHRASES))]
    own = "list_filter([" + ", ".join(f"case when len({p}) > 0 then '{label}' end" for p, (_, label) in zip(at, PHRASES, strict=True)) + "], lambda x: x is not null)"
    return f"""
with w as (select doc_id, md5(coalesce(text, '')) as k5, {words("coalesce(text, '')")} as ws from documents),
b as (select doc_id, k5, len(ws) as n, {', '.join(f'{x} as {p}' for x, p in zip(places, at, strict=True))} from w),
base as (select doc_id, k5, cast(n as bigint) as n_words, flatten([{', '.join(at)}]) as places, list_sort(list_distinct({own})) as own from b),
tpl as (select id, label, len(aw) as k, list_distinct(aw) as tw, ceil({config.theta} * len(list_distinct(aw)) - 1e-9) as need from (select id, label, {words('text')} as aw from (values {templates}) t(id, label, text))),
lines as (select doc_id, k5, {words('line')} as ws from (select doc_id, md5(coalesce(text, '')) as k5, unnest(string_split_regex(coalesce(text, ''), '[\\n\\r]+')) as line from documents)),
blocks as (select doc_id, k5, list_distinct(list_slice(ws, s, s + {config.window - 1})) as bw from (select doc_id, k5, ws, unnest(range(1, greatest(len(ws) - {step}, 1) + 1, {step})) as s from lines where len(ws) > 0)),
met as (select doc_id, k5, label, len(list_intersect(bw, tw)) / len(tw) as share from blocks cross join tpl where len(list_intersect(bw, tw)) >= need),
held as (select doc_id, k5, label, ws, tw, k, need from w cross join tpl where len(list_intersect(list_distinct(ws), tw)) >= need),
windows as (select doc_id, k5, label, tw, need, list_distinct(list_slice(ws, s, s + 2 * k - 1)) as bw from (select *, unnest(range(1, greatest(len(ws) - k, 1) + 1, k)) as s from held)),
wrapped as (select doc_id, k5, label, len(list_intersect(bw, tw)) / len(tw) as share from windows where len(list_intersect(bw, tw)) >= need),
best as (select doc_id, k5, list_distinct(list(label)) as met, max(share) as share from (from met union all from wrapped) group by 1, 2)
select b.doc_id, n_words, cast(len(places) as bigint) as n_base, cast(list_min(places) - 1 as bigint) as first_word, cast(list_max(places) - 1 as bigint) as last_word,
  array_to_string(own, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(met, [])))), ',') as labels, case when len(own) > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from base b left join best m on b.doc_id is not distinct from m.doc_id and b.k5 = m.k5"""


COPIES = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, row_number() over (same order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH = f"""
with docs as (select row_number() over () as d, doc_id, {_WORDS} as ws from documents),
held as (select d, doc_id, len(ws) as n, ws from docs where len(ws) > 0),
c as (select count(*) as docs, cast(sum(n) as bigint) as terms from held),
postings as (select d, term, count(*) as tf from (select d, unnest(ws) as term from held) group by all),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from (select term, count(*) as df from postings group by 1), c),
lengths as (select d, doc_id, 25 + (75 * n * docs) // terms as m from held, c),
items as (select row_number() over () as i, item_id, {_WORDS} as ws from benchmark),
asked as (select i, term, count(*) as r from (select i, unnest(ws) as term from items) group by all),
scores as (select i, d, cast(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from asked join weights using (term) join postings using (term) join lengths using (d) group by all),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls first) as rank from scores join lengths using (d) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked join items using (i) where rank <= 10"""

_TURN = "sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))"

# crc32 of the decimal digits: a byte is eight steps
_DIGITS = "list_transform(range(1, len(cast(conv_id as varchar)) + 1), lambda i: cast(ascii(cast(conv_id as varchar)[i]) as bigint))"
_STEP = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {_DIGITS}), lambda acc, b: {_STEP}), 4294967295)"

TRIE = f"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, {_TURN}) - 1 as pos, {_TURN} as turn, strlen(coalesce(text, '')) as bytes from conversations where conv_id is not null),
convs as (select distinct conv_id, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from conversations where conv_id is not null),
heads as (select c.conv_id, pos, turn, bytes from convs c join turns t on t.conv_id = c.base where pos < h),
n_heads as (select conv_id, count(*) as n from heads group by 1),
rebuilt as (select conv_id, pos + 1 as depth, turn, bytes from heads union all
    select t.conv_id, pos - h + coalesce(n, 0) + 1, turn, bytes from turns t join convs using (conv_id) left join n_heads using (conv_id) where pos >= h),
lists as (select conv_id, list(turn order by depth) as turns, list(bytes order by depth) as sizes from rebuilt group by 1),
whole as (select c.conv_id, coalesce(turns, []) as turns, coalesce(sizes, []) as sizes from convs c left join lists using (conv_id)),
steps as (select conv_id, d, list_slice(turns, 1, d) as prefix, len(turns) = d as ends, case when d > 0 then sizes[d] else 0 end as bytes from (select *, unnest(range(0, len(turns) + 1)) as d from whole)),
nodes as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from steps group by d, prefix),
childs as (select p.d, p.conv_id, count(*) as n from nodes p join nodes c on c.d = p.d + 1 and list_slice(c.prefix, 1, p.d) = p.prefix group by 1, 2),
above as (select s.conv_id, s.d, n.d as top_d, n.conv_id as top from nodes s join steps t on t.conv_id = s.conv_id and t.d <= s.d join nodes n on n.d = t.d and n.prefix = t.prefix),
below as (select top_d, top, cast(sum((n.n_convs - 1) * n.bytes) as bigint) as saved, count(*) filter (where c.n is null) as leaves
    from above a join nodes n on n.d = a.d and n.conv_id = a.conv_id left join childs c on c.d = a.d and c.conv_id = a.conv_id group by 1, 2)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, leaves as n_leaves, saved as saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.d = n.d - 1 and p.prefix = list_slice(n.prefix, 1, n.d - 1) left join childs c on c.d = n.d and c.conv_id = n.conv_id join below b on b.top_d = n.d and b.top = n.conv_id"""

ORACLES = {"op8_hash_mix": MIX, "op9_licenses": licenses_sql(), "op11_extendible_hash": COPIES, "op12_wavelet_search": SEARCH, "op13_prefix_trie": TRIE}
