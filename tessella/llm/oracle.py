"""DuckDB SQL of the queries in ``catalog`` that SQL can express."""

from __future__ import annotations

from tessella.llm import urlfilter

TURN = "length('<|im_start|>') + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + length('<|im_end|>') + 1"

CHAT = f"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized as (
  select *, sum({TURN}) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) as from_end
  from raw
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or from_end = 1 then upto else 0 end) as bigint) as formatted_chars
from sized group by conv_id
"""

WARC = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
t as (select *, max(page_id) over (partition by digest) as top from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < top then top end as refers_to
from t
"""

MIXING = """
with recursive counted as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens from documents
), sums as (
  select source, sum(tokens)::bigint as tokens from counted group by source having sum(tokens) > 0
), shares as (
  select tokens / (select sum(tokens) from sums)::double as p from sums
), bisect(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when ok then lo else (lo + hi) / 2 end, case when ok then (lo + hi) / 2 else hi end
  from (
    select i, lo, hi,
      ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) <= 0.95 * ln(count(*))
      and max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) <= 4.0 as ok
    from bisect, shares where i < 50 group by i, lo, hi
  )
), at_zero as (
  select ln(count(*)) <= 0.95 * ln(count(*)) and max(pow(p, -1)) / count(*) <= 4.0 as ok from shares
), exponent as (
  select case when (select ok from at_zero) then 0 else round(hi, 6) end as a from bisect where i = 50
), planned as (
  select source, tokens, floor(pow(tokens / all_tokens::double, a) / (select sum(pow(p, a)) from shares) * all_tokens + 0.5)::bigint as drawn
  from sums, exponent, (select sum(tokens)::bigint as all_tokens from sums)
), placed as (
  select c.*, p.drawn // p.tokens as passes, p.drawn % p.tokens as rest,
    md5('mix|' || coalesce(c.source, '') || '|' || (p.drawn // p.tokens) || '|' || coalesce(doc_id::varchar, '')) as hash
  from counted c join planned p on c.source is not distinct from p.source
), run as (
  select *, sum(tokens) over (partition by source order by hash range between unbounded preceding and current row) as upto from placed
)
select doc_id, source, unnest(range(0, passes + case when upto <= rest then 1 else 0 end)) as block, tokens as n_tokens from run
"""


#: The default patterns as regular expressions over the lower-cased URL, written out by hand.
BLOCK = r"""
^[^:/?#]*://([^/?#]*[.])?doubleclick[.]net([^0-9a-z_.%-]|$)
^[^:/?#]*://([^/?#]*[.])?adservice[.]
/ads/
/adserver/
/banner/.*/click
/track/pixel
/beacon[.]gif
/wp-login[.]php
/wp-admin/
/xmlrpc[.]php
[?]sessionid=
&sessionid=
;jsessionid=
/cart/checkout
/logout[?]
^[^:/?#]*://([^/?#]*[.])?casino[.]
^[^:/?#]*://([^/?#]*[.])?casino-
/casino/
^[^:/?#]*://([^/?#]*[.])?adult[.]
^[^:/?#]*://([^/?#]*[.])?adult-
^[^:/?#]*://([^/?#]*[.])?spam[.]
^[^:/?#]*://([^/?#]*[.])?spam-
-pills[.]
^[^:/?#]*://([^/?#]*[.])?ads[.]
^[^:/?#]*://([^/?#]*[.])?ads-
^[^:/?#]*://([^/?#]*[.])?track[.]
^[^:/?#]*://([^/?#]*[.])?track-
^[^:/?#]*://([^/?#]*[.])?porn[.]
/porn/
/xxx/
/viagra([^0-9a-z_.%-]|$)
/warez/
[.]exe([^0-9a-z_.%-]|$)
""".split()
ALLOW = [r"^[^:/?#]*://([^/?#]*[.])?example[.]com/ads/policy"]


def _urls(site_rules) -> str:
    """Every rule on every URL, in plain SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    fits = lambda r: f"((host = {quote(r.host)} or ends_with(host, {quote('.' + r.host)})) and starts_with(path, {quote(r.path)}))"
    ordered = sorted(site_rules, key=lambda r: (-len(r.name), r.action != "block", r.name))
    hit = {a: " or ".join(f"regexp_matches(plain, {quote(p)}, 's')" for p in own) for a, own in (("allow", ALLOW), ("block", BLOCK))}
    case = lambda pick: " ".join(f"when {fits(r)} then {quote(pick(r))}" for r in ordered)
    return f"""
with cut as (
  select page_id, coalesce(url, '') as url, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
), low as (
  select page_id, translate(host, '{urlfilter.UPPER}', '{urlfilter.LOWER}') as host, path, translate(url, '{urlfilter.UPPER}', '{urlfilter.LOWER}') as plain from cut
)
select page_id, host, path, case {case(lambda r: r.name)} end as rule,
  case {case(lambda r: r.action)} when {hit["allow"]} then 'allow' when {hit["block"]} then 'block' else 'allow' end as verdict
from low
"""


JACCARD = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), listed as (
  select doc_id, case when len(w) >= 4 then list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as held from split
), single as (
  select doc_id, unnest(held) as shingle from listed
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from single a join single b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
  select a, b from shared s join listed x on x.doc_id = s.a join listed y on y.doc_id = s.b where 100 * n >= 85 * (len(x.held) + len(y.held) - n)
), both_ways as (
  select a, b from links union all select b, a from links
), reached(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reached r join both_ways l on l.a = r.other
)
select doc_id, cast(len(held) as bigint) as n_shingles, (select min(other) from reached r where r.doc_id = l.doc_id) as component_id from listed l
"""

TRIE = r"""
with recursive placed as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), convs as (
  select conv_id, count(*) as own, conv_id - conv_id % 20 as base,
    xor(list_reduce([4294967295::bigint] || [ascii(c)::bigint for c in string_split(conv_id::varchar, '')], lambda crc, byte:
      list_reduce([xor(crc, byte)] || [0::bigint for i in range(8)], lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) % 4 as h
  from placed group by conv_id
), known as (
  select c.*, least(c.h, coalesce(b.own, 0)) as taken from convs c left join convs b on b.conv_id = c.base
), rebuilt as (
  select k.conv_id, pos as depth, role, text from known k join placed p on p.conv_id = k.base and pos <= taken
  union all
  select k.conv_id, pos - h + taken, role, text from known k join placed p on p.conv_id = k.conv_id and pos > h
), paths as (
  select conv_id, depth, text, string_agg(md5(length(role) || ' ' || role || text), '') over (partition by conv_id order by depth rows unbounded preceding) as path from rebuilt
  union all select conv_id, 0, '', '' from convs
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) as saved from paths group by path, depth
), branched as (
  select left(path, 32 * (depth - 1)) as path, count(*) as n_children from nodes where depth > 0 group by 1
), summed as (
  select a.path, sum(case when b.path is null then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens
  from nodes n join paths a on a.conv_id = n.conv_id and a.depth <= n.depth left join branched b on b.path = n.path group by a.path
), last as (
  select conv_id, max(depth) as depth from paths group by conv_id
), ended as (
  select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids from paths join last using (conv_id, depth) group by path
)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n join summed using (path) left join branched using (path) left join ended using (path) left join nodes u on n.depth > 0 and u.path = left(n.path, 32 * (n.depth - 1))
"""


def oracle_sql(site_rules) -> dict[str, str]:
    return {"op1_warc": WARC, "op4_chat_format": CHAT, "op5_mixing": MIXING, "op10_url_filter": _urls(site_rules), "op12_jaccard": JACCARD, "op13_trie": TRIE}
