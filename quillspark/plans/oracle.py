"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..config import GUIDANCE_KEYWORDS

import numpy as np

#: Tables that several queries build on, each after those it needs.
PARTS = {
    "prices": "select l_suppkey as ticker, cast(l_shipdate as date) as date, max(l_extendedprice / l_quantity) as close from lineitem group by 1, 2",
    "filled": """select ticker, date, last_value(close ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row) as close
        from (select ticker, date from (select distinct ticker from prices) cross join (select distinct date from prices)) left join prices using (ticker, date)""",
    "panel": "select * from filled where close is not null",
    "sales": """select l_suppkey as ticker, 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) as quarter, cast(o_orderdate as date) as d, l_discount, l_tax, l_quantity, l_returnflag
        from lineitem join orders on l_orderkey = o_orderkey""",
    "scores": """select ticker, quarter, max(d) as date, round(sum(cast(round(l_discount * 100) as bigint)) / (count(*) * 100e0), 6) as guidance_net,
        round(sum(cast(round(l_tax * 100) as bigint)) / (count(*) * 100e0), 6) as qa_ceo_net, round(sum(cast(round(l_quantity * 100) as bigint)) / (count(*) * 5000e0), 6) as prep_net,
        round(sum(case when l_returnflag = 'R' then 1 else 0 end) / (count(*) * 1e0), 6) as lm_uncertainty from sales group by 1, 2""",
    "ahead": """select ticker, date, round(lead(close, 1) over w / close - 1, 6) as fwd_1d, round(lead(close, 5) over w / close - 1, 6) as fwd_5d, round(lead(close, 20) over w / close - 1, 6) as fwd_20d
        from panel window w as (partition by ticker order by date)""",
    "rets": """select c.ticker, c.date, a.date as t1, fwd_1d, fwd_5d, fwd_20d from (select distinct ticker, date from scores) c asof left join ahead a on c.ticker = a.ticker and c.date < a.date""",
    "sector_of": "select s_suppkey as ticker, n_name as sector from supplier join nation on s_nationkey = n_nationkey where n_nationkey < 20",
}

_COLUMNS = ("guidance_net", "qa_ceo_net", "prep_net", "lm_uncertainty")
PARTS["bounds"] = "select " + ", ".join(f"quantile_cont({c}, 0.025) as {c}_lo, quantile_cont({c}, 0.975) as {c}_hi" for c in _COLUMNS) + " from scores"
PARTS["clipped"] = "select ticker, quarter, date, " + ", ".join(f"round(least(greatest({c}, {c}_lo), {c}_hi), 6) as {c}_w" for c in _COLUMNS) + " from scores cross join bounds"
_Z = "case when coalesce(stddev_samp({c}_w) over (partition by quarter), 0) < 1e-8 then 0e0 else round(({c}_w - avg({c}_w) over (partition by quarter)) / stddev_samp({c}_w) over (partition by quarter), 6) end as {c}_z"
PARTS["standard"] = "select ticker, quarter, date, " + ", ".join(_Z.format(c=c) for c in _COLUMNS) + " from clipped"
PARTS["raw"] = "select *, -0.25e0 * lm_uncertainty_z as raw_signal from standard"
PARTS["composed"] = "select ticker, quarter, date, raw_signal, round((raw_signal - (select avg(raw_signal) from raw)) / ((select stddev_samp(raw_signal) from raw) + 1e-8), 6) as composite_z from raw"


def _buckets(source: str, n: int) -> str:
    """Rows of ``source`` with their bucket, from the sorted list of every quarter's values."""
    edges = []
    for q in (float(x) for x in np.linspace(0, 1, n + 1) * 100 / 100):
        pos = f"((m - 1) * {q!r}::double)"
        lo, hi = f"a[cast(floor({pos}) as bigint) + 1]", f"a[cast(least(floor({pos}) + 1, m - 1) as bigint) + 1]"
        f = f"({pos} - floor({pos}))"
        edges.append(f"case when {f} >= 0.5 then {hi} - ({hi} - {lo}) * (1 - {f}) else {lo} + ({hi} - {lo}) * {f} end")
    over = " + ".join(f"case when composite_z > e[{k + 1}] then 1 else 0 end" for k in range(1, n))
    return f"""select *, cast(case when composite_z is null then null when len(list_distinct(e)) = {n + 1} then 1 + {over} when m = 1 then {(n + 1) // 2} else greatest(1, ceil((rf - 1) * {n} / (m - 1e0))) end as integer) as bucket
        from (select *, [{", ".join(edges)}] as e from (select *, len(a) as m from (select *, list_sort(list(composite_z) filter (composite_z is not null) over (partition by quarter)) as a,
        row_number() over (partition by quarter order by composite_z nulls last, ticker, date) as rf from {source})))"""


def _ranked(source: str, group: str, x: str, y: str) -> str:
    """Average ranks of both columns within complete rows of every group."""
    rank = lambda c: f"rank() over (partition by {group} order by {c}) + (count(*) over (partition by {group}, {c}) - 1) / 2e0"
    return f"select {group}, {rank(x)} as rx, {rank(y)} as ry from {source} where {x} is not null and {y} is not null"


def _ic(group: str, least: int) -> str:
    return f"select {group}, count(*) as n, case when count(*) >= {least} and stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) end as ic from ranked group by {group}"


_ICIR = """round(avg(ic), 4) as mean_ic, round(stddev_samp(ic), 4) as std_ic, round(avg(ic) / (stddev_samp(ic) + 1e-8), 4) as icir,
    round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)) + 1e-8), 4) as t_stat, count(ic) as n_quarters"""
PARTS["quintiles"] = _buckets("composed", 5)
PARTS["rows"] = "select q.*, fwd_1d, fwd_5d, fwd_20d from quintiles q left join rets using (ticker, date)"
PARTS["valid"] = "select ticker, quarter, date, composite_z, fwd_1d, fwd_5d, fwd_20d from rows where abs(composite_z) > 1e-10"
PARTS["tertiles"] = _buckets("valid", 3)
_CHAIN = list(PARTS)


def _sql(body: str, upto: str = "tertiles", **more: str) -> str:
    parts = {k: PARTS[k] for k in _CHAIN[: _CHAIN.index(upto) + 1]} | more
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + body


def _one_ic(ret: str) -> dict[str, str]:
    return {"ranked": _ranked("tertiles", "quarter", "composite_z", ret), "found": _ic("quarter", 4), "series": "select quarter, ic, coalesce(n, 0) as n from (select distinct quarter from tertiles) left join found using (quarter)"}


_LS = "select quarter, max_by(r, bucket) - min_by(r, bucket) as ls from (select quarter, bucket, avg({c}) as r from tertiles where {c} is not null group by 1, 2) group by 1"
_LS_LINE = "round(avg(ls), 4) as mean_ls, round(avg(ls) * 4, 4) as ann_return, round(stddev_pop(ls) * 2, 4) as ann_std, round(avg(ls) * 4 / (stddev_pop(ls) * 2 + 1e-8), 4) as sharpe"
_SPREAD = "round(case when count(*) >= 2 then nullif(max_by(m, bucket) - min_by(m, bucket), 0) end, 4) as spread from (select bucket, avg({c}) as m from tertiles where {c} is not null group by 1)"
_LONG = "select quarter, horizon || '|' || quarter as g, horizon, composite_z, ret from (select quarter, composite_z, fwd_1d, fwd_5d, fwd_20d from {t}) unpivot include nulls (ret for horizon in (fwd_1d, fwd_5d, fwd_20d))"


def _sweep() -> str:
    parts, lines = {}, []
    for c in ("fwd_1d", "fwd_5d", "fwd_20d"):
        parts |= {f"r_{c}": _ranked("tertiles", "quarter", "composite_z", c), f"i_{c}": _ic("quarter", 4).replace("from ranked", f"from r_{c}"), f"l_{c}": _LS.format(c=c)}
        lines.append(f"select '{c}' as horizon, i.*, s.*, l.* from (select {_ICIR} from i_{c}) i cross join (select {_SPREAD.format(c=c)}) s cross join (select {_LS_LINE} from l_{c}) l")
    return _sql(" union all ".join(lines), **parts)


# White space as Unicode has it, with the four separators that scripts treat so.
_WS = r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CLEAN = rf"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"
_WORDS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
_LEXICON = "('of', 'de', 'der', 'a', 'no assurance')"

_LOOKUP = {
    "lines": "select conv_id as doc_id, role, min(turn) as pos from conversations where role is not null group by 1, 2",
    "roles": "select doc_id, lower(role) as key, case role when 'user' then 'analyst' when 'assistant' then 'executive' else 'operator' end as role from lines",
}
_TURNS = _LOOKUP | {
    "said": f"select conv_id as doc_id, case when turn <= 1 then 'prepared_remarks' else 'qa' end as section, turn as place, role, length(text) as size, {_CLEAN} as c from conversations",
    "numbered": "select *, row_number() over (partition by doc_id, section order by place) as turn from said",
    "turns": f"select doc_id, section, turn, role as speaker_name, case role when 'user' then 'analyst' when 'assistant' then 'executive' when 'system' then 'operator' else 'unknown' end as role, c, {_SENTENCES.format(c='c')} as sents from numbered where size > 10 and role <> ''",
    "kept": "select * from turns where role <> 'operator'",
    "sections": """select doc_id, coalesce(flatten(list(sents order by turn) filter (section = 'prepared_remarks' and role = 'executive')), []) as prep, coalesce(flatten(list(sents order by turn) filter (section = 'qa' and role = 'executive')), []) as qa,
        coalesce(flatten(list(sents order by turn) filter (section = 'qa' and role = 'analyst')), []) as ana from kept group by 1""",
    "docs": "select conv_id as doc_id, bool_or(turn <= 1) as has_p, bool_or(turn > 1) as has_q from conversations group by 1",
    "whole": "select d.*, coalesce(prep, []) as prep, coalesce(qa, []) as qa, coalesce(ana, []) as ana from docs d left join sections using (doc_id)",
}


def _with(parts: dict[str, str], body: str) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + body


def _tone() -> str:
    parts = dict(_TURNS)
    parts["long"] = "select doc_id, 'prep' as k, unnest(prep) as s from whole union all select doc_id, 'qa_ceo', unnest(qa) from whole union all select doc_id, 'qa_anal', unnest(ana) from whole union all select doc_id, 'guidance', unnest(list_filter(list_concat(prep, qa), lambda x: regexp_matches(lower(x), '" + "|".join(GUIDANCE_KEYWORDS) + "'))) from whole"
    parts["words"] = "select doc_id, k, list_filter(string_split(lower(s), ' '), lambda w: w <> '') as w from long"
    parts["each"] = "select doc_id, k, len(w) as n, len(list_filter(w, lambda x: x in ('the', 'le', 'der', 'and'))) / len(w) as p, len(list_filter(w, lambda x: x in ('of', 'de', 'die', 'in'))) / len(w) as q from words"
    parts["scored"] = "select doc_id, k, round(sum(n * p) / sum(n), 5) as pos, round(sum(n * q) / sum(n), 5) as neg, round(sum(n * p) / sum(n) - sum(n * q) / sum(n), 5) as net, count(*) as n_sents from (select doc_id, k, greatest(n, 1) as n, p, q from each) group by 1, 2"
    cols = ", ".join(f"coalesce(max({c}) filter (k = '{k}'), {'0' if c == 'n_sents' else '0e0'}) as {k}_{c}" for k in ("prep", "qa_ceo", "qa_anal", "guidance") for c in ("pos", "neg", "net", "n_sents"))
    parts["wide"] = f"select doc_id, {cols} from docs left join scored using (doc_id) group by 1"
    return _with(parts, "select cast(doc_id as varchar) as ticker, * exclude (doc_id), round(qa_ceo_net - prep_net, 5) as qa_delta from wide")


def _bare(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.!?]+$', '', 'g')"


def _kind(x: str) -> str:
    own = f"lower(regexp_replace({x}, '[.!?]+$', ''))"
    return rf"case when regexp_matches({own}, '^[0-9][0-9.,\-]*$') then '##' else {own} end"


def _ratio(k: str, first: str, second: str, n: str) -> str:
    """The log-likelihood ratio of k times ``second`` after ``first``."""
    term = lambda c, p: f"case when {c} <= 0 then 0 else ({c}) * ln(greatest({p}, 1e-300)) end"
    like = lambda p, q: " + ".join((term(k, p), term(f"{first} - {k}", f"1 - {p}"), term(f"{second} - {k}", q), term(f"{n} - {first} - {second} + {k}", f"1 - {q}")))
    even, first_share, rest_share = f"({second} * 1e0 / {n})", f"({k} * 1e0 / {first})", f"(({second} - {k}) * 1e0 / greatest({n} - {first}, 1))"
    return f"-2 * (({like(even, even)}) - ({like(first_share, rest_share)}))"


def _boundaries() -> str:
    special = r"({w} = '##' or regexp_matches({w}, '^\p{{L}}$'))"
    parts = {
        "d": f"select doc_id, list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '') as w from documents",
        "raw": "select doc_id, pos, len(w) as size, w[pos + 1] as raw, w[pos + 2] as after, w[pos] as before from (select doc_id, w, unnest(range(len(w))) as pos from d)",
        "bare": f"select *, {_bare('raw')} as b, {_bare('after')} as a from raw",
        "typed": rf"""select doc_id, pos, size, {_kind("b")} as word, {_kind("a")} as next, raw like '%.' and not raw like '%..' as dot, regexp_matches(raw, '[.!?]$') as stop, regexp_matches(b, '^\p{{Lu}}') as upper, regexp_matches(b, '^\p{{Ll}}') as lower,
            coalesce(not regexp_matches(before, '[.!?]\P{{L}}*$'), false) as inside, regexp_matches(a, '^\p{{Lu}}') as next_upper, regexp_matches(a, '^\p{{Ll}}') as next_lower from bare""",
        "counts": "select word, count(*) as n, count(*) filter (dot) as dots, count(*) filter (lower) as n_lower, count(*) filter (upper and inside) as n_inside from typed where word <> '' group by 1",
        "whole": "select sum(n) as total, least(greatest(sum(dots) / sum(n), 1e-12), 1 - 1e-12) as p from counts",
        "short": rf"""select word from (select *, length(replace(word, '.', '')) as l from counts cross join whole) where dots > 0 and regexp_matches(word, '\p{{L}}') and not {special.format(w="word")}
            and -2 * (dots * ln(p) + (n - dots) * ln(1 - p) - dots * ln(0.99e0) - (n - dots) * ln(0.01e0)) * exp(-l) * (length(word) - l + 1) * pow(greatest(l, 1)::double, -(n - dots)::double) >= 0.3""",
        "stops": f"select t.*, s.word is not null as short, s.word is not null or {special.format(w='t.word')} as doubted from typed t left join short s using (word) where dot and t.word <> '' and next <> ''",
        "ends": "select next, count(*) as k from stops where not doubted group by 1",
        "breaks": "select sum(k) as b from ends",
        "starters": f"select next from ends join counts on next = word cross join whole cross join breaks where k / b > n / total and {_ratio('k', 'b', 'n', 'total')} >= 30",
        "pairs": f"""select x.word, x.next from (select word, next, count(*) as k from stops where doubted group by 1, 2) x join counts c1 on x.word = c1.word join counts c2 on x.next = c2.word cross join whole
            where k > 1 and k / c1.n > c2.n / total and {_ratio('k', 'c1.n', 'c2.n', 'total')} >= 7.88""",
        "joined": r"""select doc_id, pos from stops x left join counts c on x.next = c.word left join starters s on x.next = s.next left join pairs p on x.word = p.word and x.next = p.next where doubted and case
            when p.word is not null and s.next is null then true when short then not (next_upper and (s.next is not null or n_lower > 0 and n_inside = 0)) else next_lower or regexp_matches(x.word, '^\p{L}$') and next_upper and n_lower = 0 end""",
        "found": """select doc_id, count(*) filter (stop and j.pos is null) + count(*) filter (t.pos = size - 1 and not stop) as n_sents, count(*) filter (stop) + count(*) filter (t.pos = size - 1 and not stop) as n_by_rule
            from typed t left join joined j using (doc_id, pos) group by 1""",
    }
    return _with(parts, "select doc_id, coalesce(n_sents, 0) as n_sents, coalesce(n_by_rule, 0) as n_by_rule from documents left join found using (doc_id)")


def _tail(begin: str) -> str:
    """The integral of cos(x) ^ (n - 3) from ``begin`` on."""
    end = f"least(pi() / 2, {begin} + 10 / sqrt(greatest(n - 3, 1e-9)))"
    return f"list_sum(list_transform(range(4097), lambda i: case when i % 4096 = 0 then 1 when i % 2 = 1 then 4 else 2 end * pow(greatest(cos({begin} + i * ({end} - {begin}) / 4096), 0), n - 3))) * ({end} - {begin}) / 12288"


_P = f"case when n < 3 or ic is null then null when abs(ic) >= 1 then 0 else {_tail('asin(abs(ic))')} / ({_tail('0e0')}) end"
_STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def _windowed(starts: str, length: str) -> str:
    """Counts and sums of the events of a user in windows of a length that begin at each of ``starts``."""
    return f"""with w as (select user_id, unnest({starts}) as b, value from events)
        select user_id, {_STAMP.format(x="b")} as start, {_STAMP.format(x=f"b + interval {length}")} as end, count(*) as n, round(sum(value), 4) as total from w group by user_id, b"""


#: Paragraphs beside the heading of a page, as text without tags; one whose bold part is short is a speaker's label.
_PARAGRAPHS = """with inside as (select page_id, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) as x from pages),
    parts as (select page_id, unnest(string_split(x, '<p>')[2:]) as part, unnest(range(1, len(string_split(x, '<p>')))) as place from inside),
    bare as (select page_id, place, starts_with(part, '<b>') as bold, replace(replace(replace(replace(replace(trim(regexp_replace(part, '<[^>]*>', '', 'g')), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&amp;', '&') as text from parts)
    """

_FILINGS = """select lpad(cast(user_id as varchar), 10, '0') as cik, cast(cast(ts as date) as varchar) as date, event_id || '-24-' || coalesce(json_extract_string(props, '$.k'), '') as accession,
        'https://host/data/' || user_id || '/' || event_id || '24' || coalesce(json_extract_string(props, '$.k'), '') || '/' || event_id || '24' || coalesce(json_extract_string(props, '$.k'), '') || '-index.htm' as index_url,
        'https://host/data/' || user_id || '/' || event_id || '24' || coalesce(json_extract_string(props, '$.k'), '') || '/' || event_type || '.htm' as document_url from events where event_type = 'purchase'"""

ORACLE_SQL: dict[str, str] = {
    "pooled_ic_p": _sql(f"select horizon, round(ic, 4) as ic, round({_P}, 4) as p, n from found", long=_LONG.format(t="rows"), ranked=_ranked("long", "horizon", "composite_z", "ret"), found=_ic("horizon", 5)),
    "sliced_returns": _sql("select * from rets", "rets"),
    "loaded_prices": _sql("select ticker, date, close from prices", "prices"),
    "full_backtest": _sweep(),
    "merged_summaries": _sql("select quarter, count(*) as n, true as distinct_near, true as quartiles_near from scores group by 1", "scores"),
    "learnt_sentences": _boundaries(),
    "failed_pages": "select 'P_' || page_id || '_Q1' as name, 'no page' as error from pages where page_id % 9 = 4 or html is null",
    "parsed_pages": _PARAGRAPHS + """select 'P' as ticker, cast(page_id as varchar) as page, 'Q1' as quarter, count(*) filter (length(text) between 4 and 149) as n_participants
        from (select page_id from pages where page_id % 9 <> 4 and html is not null) left join bare using (page_id) group by page_id""",
    "not_landed": r"""with p as (select *, page_id % 5 <> 2 as there, page_id % 9 <> 4 and html is not null as page, regexp_matches(lower(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')), 'the |éa') as marked from pages)
        select cast(page_id % 10 as varchar) as ticker, cast(page_id as varchar) as page, case when not there then 'not fetched' when not page then 'empty page' else 'no transcript' end as error from p where not (there and page and marked)""",
    "event_sessions": f"""with o as (select user_id, ts, value, event_id, case when ts >= lag(ts) over w + interval 6 hours then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
        g as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from o)
        select user_id, {_STAMP.format(x="min(ts)")} as start, {_STAMP.format(x="max(ts) + interval 6 hours")} as end, count(*) as n, round(sum(value), 4) as total from g group by user_id, k""",
    "tumbling_windows": _windowed("[date_trunc('hour', ts)]", "1 hour"),
    "sliding_windows": _windowed("[date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]", "2 hours"),
    "deduplicated_events": "select event_id, user_id, event_type, value from events",
    "page_participants": _PARAGRAPHS + "select page_id, row_number() over (partition by page_id order by place) - 1 as pos, text as line from bare where length(text) between 4 and 149",
    "page_elements": _PARAGRAPHS + """, kind as (select *, bold and length(text) < 120 and length(text) - length(replace(text, '.', '')) <= 1 as is_label from bare where text <> '')
        select page_id, 'prepared_remarks' as section, row_number() over (partition by page_id order by place) - 1 as pos, is_label, case when is_label then text end as label, case when is_label then '' else text end as text from kind""",
    "scored_in_parts": _tone(),
    "call_dates": "select o_orderkey, case o_orderkey % 3 when 0 then cast(o_orderdate as date) end as day from orders",
    "company_keys": "select n_name as ticker, lpad(cast(n_nationkey as varchar), 10, '0') as cik from nation where n_nationkey % 2 = 0",
    "merged_metadata": """with saved as (select page_id as doc_id, case when page_id % 2 = 0 then 'old' end as ticker, 'saved' as source, url from pages where page_id % 3 <> 0),
        named as (select page_id as doc_id, case when page_id % 5 = 0 then '' else 'new' end as ticker from pages where page_id % 4 <> 0)
        select doc_id, case when named.ticker is not null then named.ticker else saved.ticker end as ticker, source, url from saved full join named using (doc_id)""",
    "signal_stats": _sql("""select cast(count(composite_z) as bigint) as n, round(avg(composite_z), 4) as mean, round(stddev_samp(composite_z), 4) as std, round(min(composite_z), 4) as min,
        round(quantile_cont(composite_z, 0.25), 4) as q1, round(quantile_cont(composite_z, 0.5), 4) as median, round(quantile_cont(composite_z, 0.75), 4) as q3, round(max(composite_z), 4) as max from rows""", "rows"),
    "signal_head": _sql("select r.ticker, quarter, r.date, composite_z, bucket as quintile from rows r order by composite_z desc nulls last, r.ticker, r.date limit 5", "rows"),
    "daily_prices": _sql("select ticker, date, close from prices", "prices"),
    "wide_prices": _sql("select cast(ticker % 7 as varchar) as ticker, date, max(close) as close from prices group by 1, 2", "prices"),
    "filled_prices": _sql("select ticker, date, close from panel", "panel"),
    "forward_returns": _sql("select * from rets", "rets"),
    "sector_lookup": _sql("select ticker, quarter, date, coalesce(sector, 'Unknown') as sector from scores left join sector_of using (ticker)", "sector_of"),
    "winsorized": _sql("select ticker, quarter, guidance_net_w, qa_ceo_net_w, prep_net_w, lm_uncertainty_w from clipped", "clipped"),
    "zscores": _sql("select ticker, quarter, guidance_net_z, qa_ceo_net_z, prep_net_z, lm_uncertainty_z from standard", "standard"),
    "signal_rows": _sql("select r.ticker, quarter, r.date, coalesce(sector, 'Unknown') as sector, fwd_1d, fwd_5d, fwd_20d, round(raw_signal, 8) as raw_signal, composite_z, bucket as quintile from rows r left join sector_of s on r.ticker = s.ticker", "rows"),
    "legacy_signal_rows": _sql("select ticker, quarter, round(0.4e0 * guidance_net_z + 0.3e0 * qa_ceo_net_z + 0.2e0 * prep_net_z + -0.1e0 * lm_uncertainty_z, 8) as raw_signal from standard", "standard"),
    "pooled_ic": _sql("select horizon, round(ic, 4) as ic, n from found", long=_LONG.format(t="rows"), ranked=_ranked("long", "horizon", "composite_z", "ret"), found=_ic("horizon", 5)),
    "signal_summary": _sql("select bucket as quintile, round(avg(fwd_5d), 4) as mean_ret from rows where bucket is not null group by 1", "rows"),
    "tertile_rows": _sql("select ticker, quarter, composite_z, bucket as tertile from tertiles"),
    "bucket_distribution": _sql("select quarter, count(*) filter (bucket = 1) as b1, count(*) filter (bucket = 2) as b2, count(*) filter (bucket = 3) as b3 from tertiles group by 1"),
    "quarterly_ic": _sql("select quarter, round(ic, 6) as ic, n from series", **_one_ic("fwd_5d")),
    "icir": _sql(f"select {_ICIR} from series", **_one_ic("fwd_5d")),
    "bucket_returns": _sql("select bucket as quintile, round(avg(fwd_5d), 6) as mean, round(stddev_samp(fwd_5d), 6) as std, count(*) as n from tertiles where fwd_5d is not null group by 1"),
    "factor_decay": _sql(f"select horizon, {_ICIR} from (select split_part(g, '|', 1) as horizon, ic from found) group by 1", long=_LONG.format(t="tertiles"), ranked=_ranked("long", "g", "composite_z", "ret"), found=_ic("g", 4)),
    "long_short": _sql(f"select {_LS_LINE}, count(*) as n_quarters from series", series=_LS.format(c="fwd_5d")),
    "long_short_series": _sql("select quarter, round(ls, 6) as ls from series", series=_LS.format(c="fwd_5d")),
    "bucket_spread": _sql("select " + _SPREAD.format(c="fwd_20d")),
    "horizon_sweep": _sweep(),
    "quarters_by_ticker": _sql("select ticker, array_to_string(list_sort(list(distinct quarter)), ',') as quarters from scores group by 1", "scores"),
    "new_calls": _sql("select ticker, date, quarter from scores where ticker % 2 <> 0", "scores"),
    "union_scores": _sql("select ticker, quarter, case when ticker % 2 = 1 then lm_uncertainty end as lm_uncertainty from scores", "scores"),
    "text_scores": f"""with c as (select doc_id, {_CLEAN} as c, text is null as gone from documents), l as (select *, {_SENTENCES.format(c="c")} as sents from c),
        w as (select *, list_filter(string_split(lower(array_to_string(sents, ' ')), ' '), lambda w: w <> '') as words from l)
        select doc_id, case when not gone then length(c) end as n_clean, len(sents) as n_sents, len(list_filter(sents, lambda s: regexp_matches(lower(s), 'the|que|und'))) as n_guidance, len(words) as n_words,
        case when len(words) > 0 then round(len(list_filter(words, lambda w: w in {_LEXICON})) / len(words), 5) else 0e0 end as uncertainty from w""",
    "role_lookup": _with(_LOOKUP, "select doc_id, key, role from roles"),
    "speaker_turns": _with(_TURNS, "select doc_id, section, turn, speaker_name, role, length(c) as n_chars, len(sents) as n_sents from kept"),
    "transcripts": _with(
        _TURNS,
        """select doc_id, len(prep) as n_prepared_remarks, len(qa) as n_qa_ceo, len(ana) as n_qa_analyst, len(list_filter(string_split(array_to_string(list_concat(prep, qa, ana), ' '), ' '), lambda w: w <> '')) as word_count,
        len(prep) + len(qa) + len(ana) as sentence_count, concat_ws(',', case when not has_p then 'no_prepared_remarks' end, case when not has_q then 'no_qa_section' end, case when len(prep) = 0 and len(qa) = 0 then 'no_executive_sentences' end) as parse_errors from whole""",
    ),
    "transcript_scores": _tone(),
    "file_names": """select o_orderkey, case o_orderkey % 4 when 0 then 'ABC' when 1 then 'DE' when 2 then 'F' else 'lower' end as ticker,
        case o_orderkey % 4 when 1 then (year(o_orderdate) + 1) || strftime(o_orderdate, '-%m-%d') when 2 then '' else strftime(o_orderdate, '%Y-%m-%d') end as date,
        case o_orderkey % 4 when 0 then 'Q' || quarter(o_orderdate) || '-' || year(o_orderdate) when 1 then 'Q' || quarter(o_orderdate) || '-' || (year(o_orderdate) + 1) else '' end as quarter from orders""",
    "url_dates": "select page_id, case when len(string_split(url, '/')) > 4 then string_split(url, '/')[3] || '-' || string_split(url, '/')[4] || '-' || string_split(url, '/')[5] else 'unknown' end as url_date from pages",
    "gated_pages": r"""select page_id from pages where regexp_matches(lower(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')), 'the |éa')""",
    "filing_rows": _FILINGS,
    "read_filings": _FILINGS,
}
