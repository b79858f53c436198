"""The queries of this package that SQL can express, for DuckDB."""

from __future__ import annotations

EXACT_DEDUP = r"""
with t as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
    from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""


def url_trust(rules, damping: int, tie: float, rounds: int = 200) -> str:
    """Rules by longest fit, then the walks of trust and distrust over host edges; what is left
    after `rounds` is far below `tie`."""
    values = ", ".join(
        f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}', '{r}')" for v, r in rules
    )
    return rf"""
with recursive rules(rule_host, rule_path, verdict, rule) as (values {values}),
u as (
    select page_id, coalesce(html, '') as html,
           case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages
),
p as (
    select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from u
),
best as (
    select p.host, p.path, r.rule, r.verdict from (select distinct host, path from p) p join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
    qualify row_number() over (partition by p.host, p.path order by length(rule_host) desc, length(rule_path) desc) = 1
),
judged as (
    select p.page_id, p.host, p.path, b.rule, b.verdict as rule_verdict
    from p left join best b on p.host = b.host and p.path = b.path
),
labels_of as (select distinct host, string_split(host, '.') as l from p),
chain as (select unnest(range(1, len(l))) as i, l from labels_of),
up as (
    select distinct array_to_string(l[i:], '.') as src, array_to_string(l[i + 1:], '.') as dst
    from chain where i + 1 < len(l)
),
links as (
    select host as src, translate(unnest(regexp_extract_all(html,
        '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from p
),
edges as materialized (
    select src, dst, count(*) as weight from (
        select src, dst from links union all select src, dst from up union all select dst, src from up
    ) where src <> dst and src <> '' and dst <> '' group by all
),
moves as materialized (
    select 'trust' as kind, src as host, dst as "to", weight, (sum(weight) over (partition by src))::bigint as total from edges
    union all
    select 'distrust', dst, src, weight, (sum(weight) over (partition by dst))::bigint from edges
),
counts as (
    select case when rule_verdict = 'allow' then 'trust' else 'distrust' end as kind, host, count(*) as n
    from judged where rule_verdict is not null and host <> '' group by all
),
walk(i, kind, host, mass) as (
    select 0, kind, host, n::double / sum(n) over (partition by kind) from counts
    union all
    select w.i + 1, w.kind, m."to", sum(w.mass * m.weight / m.total * {damping} / 100)
    from walk w join moves m on w.kind = m.kind and w.host = m.host where w.i < {rounds} group by all
),
m as (
    select host, sum(mass) filter (kind = 'trust') as trust, sum(mass) filter (kind = 'distrust') as distrust
    from walk group by host
),
t as (select host, coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust from m)
select j.page_id, j.host, j.path, j.rule,
       coalesce(j.rule_verdict, case when distrust - trust > {tie} * (distrust + trust) then 'block' else 'allow' end) as verdict,
       coalesce(trust > 0, false) as trusted, coalesce(distrust > 0, false) as distrusted
from judged j left join t on j.host = t.host
"""


ARCHIVES = """
with h as (select page_id, sha1(coalesce(html, '')) as x, strlen(coalesce(html, ''))::bigint as n from pages),
d as (
    select page_id, x, n,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))::integer) & 31) + 1), 1)), '') as digest
    from h
)
select page_id, n as payload_bytes, digest as payload_digest,
       case when page_id = min(page_id) over g then 'response' else 'revisit' end as record_type,
       case when page_id <> min(page_id) over g then min(page_id) over g end as refers_to
from d window g as (partition by x, n)
"""


def mixing(repeats: float, seed: str) -> str:
    """Each source at least once and at most `repeats` times; the exponent in closed form."""
    return rf"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents
),
s as (select source, sum(n)::bigint as tokens, sum(n) / sum(sum(n)) over () as share from d group by source),
e as (
    select case when min(share) = max(share) then 0.0
                else greatest(0.0, 1 + ln({repeats}) / ln(min(share) / max(share))) end as a from s
),
w as (select source, tokens, pow(share, a) as p from s, e),
b as (select source, tokens, floor(max(tokens / p) over () * p + 0.5)::bigint as budget from w),
p as (select source, tokens, budget, budget // tokens as passes, budget % tokens as room from b),
r as (
    select d.doc_id, d.source, n, passes, room,
           sum(n) over (partition by d.source order by md5('{seed}|' || passes || '|' || doc_id), n) as upto
    from d join p on d.source = p.source
),
t as (
    select doc_id, source, n, unnest(range(0, passes + (case when upto <= room then 1 else 0 end)))::integer as epoch
    from r
)
select doc_id, source, epoch, n as n_tokens, md5('{seed}|' || epoch || '|' || doc_id) as place from t
"""


CHAT = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
t as (
    select *, length(regexp_replace(text, '[\\#<]', 'xx', 'g'))
              + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + 14 as chars from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from t group by conv_id
"""


REPEATED_PASSAGES = r"""
with d as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
h as materialized (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as window_md5 from p),
f as (select window_md5, min(doc_id) as first_doc from h group by window_md5),
c as (select h.doc_id, unnest(range(h.i, h.i + 50)) as k from h join f using (window_md5) where first_doc < h.doc_id),
g as (select doc_id, list(distinct k) as gone from c group by doc_id),
k as (
    select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed
    from d left join g on d.doc_id = g.doc_id
),
kept as (
    select x.doc_id, string_agg(word, ' ' order by pos) as text from (
        select d.doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d
    ) x anti join c on x.doc_id = c.doc_id and x.pos = c.k group by x.doc_id
)
select k.doc_id, n_words, n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from k left join kept on k.doc_id = kept.doc_id
"""
