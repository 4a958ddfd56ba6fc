"""Check SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

import math

from footbridge.llm import mixing, quality_rules, url_trust

_LIMITS = quality_rules.LIMITS
_SPREADS = quality_rules.SPREADS
_RATIOS = quality_rules.RATIOS
_GAMMA = quality_rules.GAMMA
_WORD = r"[^\x20\x09-\x0D]+"
_BUCKET = f"case when v<=0 then 0 else 1+cast(ceil(ln(cast(v as double))/ln({_GAMMA})) as integer) end"
_VALUE = f"case when bucket=0 then 0.0 else pow({_GAMMA}, bucket-1)*(2/(1+{_GAMMA})) end"


def _fences(keys: str, counts: str) -> str:
    """Limits of a group and measure; ``keys`` is empty or a column list."""
    by = f"{keys}, " if keys else ""
    cases = [f"when '{k}' then high+{times}*greatest(high-low,{least})" for k, (times, least) in _SPREADS.items()]
    cases += [f"when '{k}' then mid*pow(greatest(mid/low,{least}),{power})" for k, (power, least) in _RATIOS.items()]
    part = ", ".join(f"min(case when upto>=size*{q} then val end) {name}" for q, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high")))
    return f"""
      select {by} measure, size, case measure {" ".join(cases)} end lim from (
        select {by} measure, size, {part} from (
          select *, sum(n) over (partition by {by} measure order by bucket) upto, sum(n) over (partition by {by} measure) size, {_VALUE} val
          from (select {by} measure, bucket, sum(n) n from {counts} where bucket>0 or measure not in ({", ".join(f"'{k}'" for k in _RATIOS)}) group by all)) group by all)"""


QUALITY_RULES = rf"""
with w as (select row_number() over () rid, doc_id, lang, source, coalesce(text,'') text, regexp_extract_all(coalesce(text,''), '{_WORD}') words from documents),
l as (select rid, unnest(string_split(text, chr(10))) line from w),
ln as (select rid, count(*) n_lines, count(*)-count(distinct line) n_dup_lines from l where regexp_matches(line, '{_WORD}') group by rid),
tri as (select rid, i, words[i]||' '||words[i+1]||' '||words[i+2] g from (select rid, words, unnest(range(1, len(words)-1)) i from w where len(words)>2)),
rep as (select rid, count(distinct i+k) n_repeat_words from (
  select t.rid, t.i from (select *, count(*) over (partition by rid, g) c from tri) t where c>1), (select unnest([0,1,2]) k) group by rid),
c as (select w.doc_id, lang, source, len(words) n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))),0)::bigint word_chars,
  length(text)-length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_lines,0) n_lines, coalesce(n_dup_lines,0) n_dup_lines, coalesce(n_repeat_words,0) n_repeat_words
  from w left join ln using (rid) left join rep using (rid)),
r as (select *, case when word_chars>0 then cast(floor(n_symbols*1000/word_chars) as bigint) else 0 end symbol_rate,
  case when n_lines>0 then cast(floor(n_dup_lines*1000/n_lines) as bigint) else 0 end line_rate,
  case when n_words>0 then cast(floor(n_repeat_words*1000/n_words) as bigint) else 0 end repeat_rate,
  case when n_words>0 then cast(floor(word_chars*1000/n_words) as bigint) else 0 end word_length from c),
m as (unpivot (select lang, source, {", ".join(_LIMITS)} from r where n_words>=50 and 100*n_repeat_words<=50*n_words) on {", ".join(_LIMITS)} into name measure value v),
s as (select lang, source, measure, {_BUCKET} bucket, count(*) n from m group by all),
fine as ({_fences("lang, source", "s")}), mid as ({_fences("lang", "s")}), every as ({_fences("", "s")}),
lim as (select g.lang, g.source, {", ".join(f"max(case when g.measure='{k}' then coalesce(f.lim, b.lim, e.lim) end) max_{k}" for k in _LIMITS)}
  from (select distinct lang, source, unnest([{", ".join(f"'{k}'" for k in _LIMITS)}]) measure from s) g
  left join (from fine where size>={quality_rules.MIN_GROUP}) f on g.lang is not distinct from f.lang and g.source is not distinct from f.source and g.measure=f.measure
  left join (from mid where size>={quality_rules.MIN_GROUP}) b on g.lang is not distinct from b.lang and g.measure=b.measure
  left join every e on g.measure=e.measure group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed base_failed,
  not failed and {" and ".join(f"{k}<=coalesce(max_{k},'inf'::double)" for k in _LIMITS)} kept
from (select *, n_words<50 or 100*n_repeat_words>50*n_words failed from r) r
left join lim on r.lang is not distinct from lim.lang and r.source is not distinct from lim.source
"""

_BITS = 60 - mixing.BUCKETS.bit_length() + 1
_KEY = f"cast('0x'||substr(md5('{mixing.SEED}:'||coalesce(cast(doc_id as varchar),'')||':'||md5(coalesce(text,''))),1,15) as bigint)"
MIXING = rf"""
with d as (select doc_id, source, {_KEY} key, len(regexp_extract_all(coalesce(text,''), '{_WORD}'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [{", ".join(map(str, mixing.WEIGHTS))}][((row_number() over (order by source nulls last)-1)%{len(mixing.WEIGHTS)}+1)::int] weight from s),
c as (select *, source_size*{mixing.MAX_EPOCHS}::double as cap, source_size*{mixing.MAX_EPOCHS}::double/weight ratio, sum(source_size) over ()*{mixing.SHARE}::double budget from w),
v as (select *, (budget-coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding),0))
  /sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as lvl from c),
f as (select first(lvl order by ratio, lvl desc) lvl, min(ratio) ratio from v where lvl<ratio),
t as (select v.source, source_size, case when f.ratio is null or v.ratio<f.ratio then cap else least(cap, f.lvl*weight) end::double target from v, f),
p as (select *, case when source_size>0 then cast(floor(target/source_size) as bigint) else 0 end whole from t),
a as (select *, coalesce(sum(size) over (partition by source order by key, copy rows between unbounded preceding and 1 preceding),0) ahead
  from (select *, row_number() over (partition by source, key) copy from d))
select doc_id, size, p.source_size, target, ((whole+case when ahead+size/2.0<=target-whole*source_size then 1 else 0 end)*size)::bigint taken
from a join p on a.source is not distinct from p.source
"""

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256*x::double)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double)))=0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score from v q, v c where q.vec_id%50=0 and q.vec_id<>c.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int rank from s)
select query_id, rank, vec_id, score from r where rank<=5
"""

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _trust() -> str:
    rules = ", ".join(f"('{r}', '{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for r, v in RULES)
    lower = f"translate({{}}, '{url_trust.UPPER}', '{url_trust.LOWER}')"
    link = url_trust.LINK.replace("'", "''")
    domain = "array_to_string(string_split({0}, '.')[-2:], '.')"
    # as many rounds as it takes if no mass ends at a host without links
    rounds = math.ceil(math.log(url_trust.SETTLED) / math.log(url_trust.KEEP / 100) / url_trust.CUT_EVERY) * url_trust.CUT_EVERY
    units = f"'{url_trust.UNIT}'::hugeint"
    return f"""
with recursive r(rule, verdict, rule_host, rule_path) as (values {rules}),
p as (select row_number() over () rid, page_id, coalesce({lower.format(f"regexp_extract(url, '{url_trust.URL}', 1)")}, '') host,
  coalesce(regexp_extract(url, '{url_trust.URL}', 2), '') path, coalesce(html, '') html from pages),
f as (select rid, max_by(rule, length(rule)) rule, max_by(verdict, length(rule)) ruling from p, r
  where (host=rule_host or host like '%.'||rule_host) and starts_with(path, rule_path) group by rid),
j as (select p.*, f.rule, f.ruling from p left join f using (rid)),
s as (select case ruling when 'allow' then 'trust' else 'distrust' end kind, host, count(*) n from j where ruling is not null group by all),
m0 as (select kind, host, {units}*n//(sum(n) over (partition by kind))::hugeint walking from s),
away as (select host src, {lower.format("dst")} dst from (select host, unnest(regexp_extract_all(html, '{link}', 1)) dst from p)),
up as (select distinct host src, {domain.format("host")} dst from p),
l as (select distinct src, dst from (select * from away union all select * from up union all select dst, src from up) where src<>dst and src<>'' and dst<>''),
k as (select 'trust' kind, src, dst from l union all select 'distrust', dst, src from l),
e as (select *, count(*) over (partition by kind, src) degree from k),
w as (select 0 i, kind, host, walking from m0
  union all select m.i+1, e.kind, e.dst, sum(m.walking*{url_trust.KEEP}//(e.degree*100))::hugeint from w m join e on e.kind=m.kind and e.src=m.host where m.i<{rounds - 1} group by all),
m as (select kind, host, sum(walking*{100 - url_trust.KEEP}//100) mass from w group by all),
t as (select host, coalesce(sum(mass) filter (kind='trust'),0) trust, coalesce(sum(mass) filter (kind='distrust'),0) distrust from m group by host)
select page_id, j.host, path, rule, coalesce(ruling, case when distrust>trust then 'block' else 'allow' end) verdict from j left join t using (host)
"""


URL_TRUST = _trust()

INFILL = r"""
with d as (select doc_id, coalesce(text,'') t, sha256('7:'||coalesce(cast(doc_id as varchar),'')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, cast('0x'||substr(h,1,8) as bigint) h1, cast('0x'||substr(h,9,8) as bigint) h2,
  cast('0x'||substr(h,17,8) as bigint) h3, cast('0x'||substr(h,25,8) as bigint) h4 from d),
c as (select *, len(u) n, least(h1%(len(u)+1), h2%(len(u)+1)) a, greatest(h1%(len(u)+1), h2%(len(u)+1)) b,
  case when t='' or contains(t,'<P>') or contains(t,'<S>') or contains(t,'<M>') or h3%100>=100 then 'plain' when h4%100<50 then 'spm' else 'psm' end form from u),
p as (select *, coalesce(array_to_string(u[1:a],''),'') pre, coalesce(array_to_string(u[a+1:b],''),'') mid, coalesce(array_to_string(u[b+1:],''),'') suf from c)
select doc_id, n::bigint n, form, case when form<>'plain' then length(pre)::bigint end prefix_chars, case when form<>'plain' then length(mid)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>'||pre||'<S>'||suf||'<M>'||mid else '<S>'||suf||'<P>'||pre||'<M>'||mid end) output_sha256,
  sha256(t) restored_sha256
from p
"""


# CRC-32 of an ASCII string, byte by byte
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: case when c&1=1 then xor(c>>1, 3988292384) else c>>1 end))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c>>8, t[(xor(c, b)&255)+1])), 4294967295)"

_MUCH = 1000000  # what an edit costs that may not be
_NEVER = f"{{'c': {_MUCH}::bigint, 'a': '', 'x': []::varchar[]}}"


def _path(source: str, cost: str, letter: str, line: str = "") -> str:
    """A path (cost, audit, lines) with one edit more, and with the line that it writes."""
    return f"{{'c': {source}.c+({cost}), 'a': {source}.a||'{letter}', 'x': " + (f"list_append({source}.x, {line})}}" if line else f"{source}.x}}")


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _written(source: str, initial: str, role: str) -> list[str]:
    """The row kept, if its initial is this one, or given a role."""
    keep = _path(source, f"extra+case when ini='{initial}' then 0 else {_MUCH} end", "K", "role||':'||text")
    return [keep] + [_path(source, "2+extra", "R", f"'{role}:'||text")] * bool(role)


def _inserted(columns: str, source: str) -> str:
    """States s0 to s3 after up to two inserts behind paths p0 to p3: nothing yet, s, u and a written last."""
    user = _least("p2", *[_path(p, "2", "I", "'user:'") for p in ("p0", "p1", "p3")])
    return f"select {columns}, p0 s0, p1 s1, i2 s2, {_least('p3', _path('i2', '2', 'I', "'assistant:'"))} s3 from (select *, {user} i2 from ({source}))"


_PASSED = ", ".join(
    f"{_least(_path(f's{to}', '3', 'D'), *options)} p{to}"
    for to, options in enumerate(([], _written("s0", "s", ""), [x for q in ("s0", "s1", "s3") for x in _written(q, "u", "user")], _written("s2", "a", "assistant")))
)
TALK_REPAIR = rf"""
with recursive crc as (select {_CRC_TABLE} t),
d as (select conv_id, turn, coalesce(role,' ') role, coalesce(text,' ') text, {_CRC.format("coalesce(conv_id::varchar,' ')||':'||coalesce(turn::varchar,' ')")}%20 k from conversations, crc),
e as (select conv_id, turn, case when k=4 then 'user' else role end role, case k when 1 then '' when 2 then regexp_replace(text,'[.!?]','','g') else text end text
  from (select *, unnest(case when k=3 then [0,1] else [0] end) from d where k<>0)),
f as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) rn, rtrim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) body, left(role,1) ini from e),
g as (select *, case when body='' then 'b' when row_number() over (partition by conv_id, role, text order by rn)>1 then 'd' when right(body,1) not in ('.','!','?') then 't' else '' end fault,
  lag(ini) over (partition by conv_id order by rn) before from f),
h as (select *, case fault when 't' then 1 when '' then 0 else {_MUCH} end extra from g),
step as (
  select * from ({_inserted("conv_id, rn", f"select conv_id, 0::bigint rn, {{'c': 0::bigint, 'a': '', 'x': []::varchar[]}} p0, {_NEVER} p1, {_NEVER} p2, {_NEVER} p3 from (select distinct conv_id from e)")})
  union all
  select * from ({_inserted("conv_id, rn", f"select h.conv_id, h.rn, {_PASSED} from step join h on h.conv_id is not distinct from step.conv_id and h.rn=step.rn+1")})),
best as (select conv_id, rn, {_least("s0", "s3")} r from step),
last as (select conv_id, max(rn) rn from step group by 1),
n as (select conv_id, coalesce(max(turn)-min(turn)+1-count(distinct turn),0) gaps, count(*) filter (fault='b') blank, count(*) filter (fault='d') duplicate, count(*) filter (fault='t') truncated,
  count(*) filter (rn>1 and before||ini not in ('su','ua','au')) illegal from h group by 1)
select c.conv_id, coalesce(gaps,0)::bigint gaps, coalesce(blank,0) blank, coalesce(duplicate,0) duplicate, coalesce(truncated,0) truncated, coalesce(illegal,0) illegal,
  coalesce(r.c,0)::bigint as cost, coalesce(r.a,'') as audit, sha256(coalesce(array_to_string(r.x, chr(10)),'')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id
left join (select best.* from best join last on best.conv_id is not distinct from last.conv_id and best.rn=last.rn) b on b.conv_id is not distinct from c.conv_id
"""
