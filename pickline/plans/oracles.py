"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

import re

from pickline.operators.report import HEADLINES

_WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def _id(prefix: str, col: str) -> str:
    return f"'{prefix}' || lpad(cast({col} as varchar), 8, '0')"


def _bucket(category: str, verdict: str, confidence: str) -> str:
    return (f"case when {confidence} = 'high' and {category} <> 'photo' then 'nonphoto' "
            f"when {confidence} = 'high' and {verdict} = 'reject' then 'reject' else 'middle' end")


LATER = "timestamp '2024-02-02 00:00:00'"
EPOCH = "timestamp '2024-01-01 00:00:00'"

VIEWS = {
    "swmet": """select u, list(distinct l) as met from (select least(x.position, y.position) as u,
        greatest(x.position, y.position) as l from pk join rk x on x.asset_id = best_id
        join rk y on y.asset_id = worst_id where n > 1) group by u""",
    "swstep": """select (select list(position order by position) from rk) as free,
        cast(null as bigint) as upper, cast(null as bigint) as lower union all
        select case when taken is null then free[2:] else list_filter(free[2:], lambda z: z <> taken) end,
        case when taken is not null then free[1] end, taken
        from (select free, list_filter(free[2:], lambda z: not coalesce(list_contains(met, z), false))[1]
        as taken from swstep left join swmet on u = free[1] where len(free) > 1)""",
    "hashes": """select vec_id, cast(list_sum(list_transform(range(49), lambda i:
        case when embedding[i + i // 7 + 1] > embedding[i + i // 7 + 2]
        then cast(1 as bigint) << (48 - i) else 0 end)) as bigint) as dhash from embeddings""",
    "a0": f"""select {_id('e', 'event_id')} as id, ts as taken_at,
        'user|' || cast(user_id as varchar) as camera, event_id % (select greatest(1, count(*)) from embeddings) as vec_id,
        cast(floor(value) as int) % 6 as source_rating,
        case when event_id % 3 = 0 then 'mine' end as description, value, event_type, props
        from events""",
    "fr": "select a0.*, dhash from a0 left join hashes using (vec_id)",
    "lk": """select *, case when lag(taken_at) over w is not null
        and epoch_us(taken_at) - epoch_us(lag(taken_at) over w) <= 3600000000
        and coalesce(bit_count(xor(dhash, lag(dhash) over w)) <= 26, true) then 0 else 1 end as brk
        from fr window w as (partition by camera order by taken_at, id)""",
    "ch": """select *, sum(brk) over (partition by camera order by taken_at, id
        rows unbounded preceding) as c from lk""",
    "ps": """select *, row_number() over w - 1 as pos, first_value(id) over w as head,
        count(*) over (partition by camera, c) as len from ch
        window w as (partition by camera, c order by taken_at, id)""",
    "sl": """select id, head, taken_at, pos // 3 as slice, pos % 3 as spos from ps
        where not (pos % 3 = 0 and pos = len - 1)""",
    "gk": """select head, slice, 'b' || substr(sha1(string_agg(id, chr(10) order by id)), 1, 12)
        as burst_id from sl group by head, slice""",
    "ga": """select fr.*, g.burst_id from fr left join (select id, burst_id from sl
        join gk using (head, slice)) g using (id)""",
    "gm": """select burst_id, list(id order by taken_at, id) as member_ids from ga
        where burst_id is not null group by burst_id""",
    "bv": """select ga.burst_id, id, taken_at, event_type,
        id = first_value(id) over (partition by ga.burst_id order by value desc, id desc) as best,
        count(*) over (partition by ga.burst_id) as n from ga where burst_id is not null""",
    "ball": """select burst_id, max(case when best then id end) as winner_id,
        coalesce(list(id order by taken_at, id) filter (not best and event_type <> 'purchase'),
        []) as reject_ids, 'best of ' || cast(max(n) as varchar) as note,
        case when substr(burst_id, 3, 1) < '4' then """ + LATER + """ end as applied_at
        from bv group by burst_id""",
    "br": "select * from ball where substr(burst_id, 2, 1) < '8'",
    "vd": """select l.doc_id, case when toxic = 0 then 'photo' when l.doc_id % 4 = 0 then 'screenshot'
        when l.doc_id % 4 = 1 then 'document' when l.doc_id % 4 = 2 then 'meme'
        else 'other' end as category,
        case when quality = 0 then 'reject' when l.doc_id % 5 = 0 then 'candidate'
        else 'neutral' end as verdict, cast(n_chars % 11 as int) as technical_score,
        case l.doc_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
        case when l.doc_id % 4 <> 0 then text end as caption,
        ['len ' || cast(n_chars % 7 as varchar), 'doc ' || cast(l.doc_id % 9 as varchar)] as reasons,
        case when l.doc_id % 6 = 0 then ['beach', 'k' || cast(l.doc_id % 4 as varchar)] end
        as keywords, case when l.doc_id % 8 = 1 then """ + LATER + """ end as enriched_at
        from labels l join documents d on l.doc_id = d.doc_id""",
    "ve": f"select {_id('e', 'doc_id')} as asset_id, * from vd",
    "vp": f"select {_id('p', 'doc_id')} as asset_id, * from vd",
    "de": f"""select asset_id, case when b = 'middle' and technical_score = 10 then 'five_star'
        when b = 'middle' and technical_score = 9 then 'four_star'
        when b = 'middle' and technical_score = 0 then 'burst_loser' else b end as bucket,
        category, 'b' || cast(doc_id % 10 as varchar) as burst,
        case when doc_id % 7 = 0 then {LATER} end as applied_at
        from (select *, {_bucket('category', 'verdict', 'confidence')} as b from ve)""",
    "rp": """select 'triage_' || asset_id as custom_id, asset_id, doc_id,
        case when doc_id % 11 = 0 then 'errored' end as failed,
        doc_id % 11 <> 0 and doc_id % 7 <> 0 as usable,
        'b' || cast(doc_id % 4 as varchar) as batch_id, category, verdict, technical_score,
        confidence, coalesce(caption, '') as caption, coalesce(keywords, []) as keywords, reasons
        from ve""",
    "ln": """select *, row_number() over (partition by l_orderkey order by l_partkey) - 1 as pos
        from (select l_orderkey, l_partkey, max(l_extendedprice) as quality from lineitem
        group by all)""",
    "mb": f"""select cast(l_orderkey as varchar) || '-' || cast(pos % deals as varchar)
        as set_id, {_id('p', 'l_partkey')} as member, quality from ln
        join (select l_orderkey, cast(ceil(count(*) / 8) as bigint) as deals from ln
        group by l_orderkey) using (l_orderkey)""",
    "pk": """select set_id, arg_max(member, struct_pack(q := quality, m := member)) as best_id,
        arg_min(member, struct_pack(q := quality, m := member)) as worst_id, count(*) as n
        from mb group by set_id""",
    "ip": """select best_id as a, member as b, best_id as winner from mb join pk using (set_id)
        where n >= 2 and member <> best_id union all
        select member, worst_id, member from mb join pk using (set_id)
        where n >= 2 and member <> best_id and member <> worst_id""",
    "it": """select item, sum(case when item = winner then 1.0::double else 0.0::double end) as wins from
        (select a as item, winner from ip union all select b, winner from ip) group by item""",
    "vs": """select i, j, cast(count(*) as double) as n from (select a as i, b as j from ip
        union all select b, a from ip) group by i, j""",
    "dl": """select l_orderkey as o, l_linenumber as line, min(l_suppkey) as k,
        max(l_extendedprice) as p, max(l_quantity) as q from lineitem group by all""",
    "du": f"""select cast(a.o as varchar) || '-' || cast(a.line as varchar) as duel_id,
        a.line, {_id('s', 'a.k')} as a_id, {_id('s', 'b.k')} as b_id,
        case when a.p > b.p then 'A' when a.p < b.p then 'B' else 'tie' end as forward_pick,
        case when b.q > a.q then 'A' when b.q < a.q then 'B' else 'tie' end as reverse_pick
        from dl a join dl b on a.o = b.o and b.line = a.line + 1 where a.k <> b.k""",
    "dp": """select a_id, b_id, case forward_pick when 'A' then a_id when 'B' then b_id
        else 'tie' end as winner, case when line % 2 = 1 then 'finals' else 'rank' end as stage
        from du""",
    "sc": f"""select {_id('p', 'p_partkey')} as asset_id, p_retailprice / 1000.0 as bt_score,
        case when p_size % 7 = 0 then 5 when p_size % 7 = 1 then 4 end as stars,
        case when p_size % 11 = 0 then 5 end as source_rating, p_name as filename, p_size,
        p_brand from part""",
    "pd": """select asset_id, case when p_size % 7 = 0 then 'five_star'
        when p_size % 7 = 1 then 'four_star' when p_brand = 'Brand#1' then 'reject'
        else 'middle' end as bucket from sc""",
    "rk": """select *, row_number() over (order by bt_score desc, asset_id) - 1 as position,
        count(*) over () as total from sc""",
    "fb": """select *, case when position < greatest(1, round_even(total * 0.05, 0)) then 5
        when position < greatest(1, round_even(total * 0.05, 0)) + round_even(total * 0.15, 0)
        then 4 end as band from rk""",
    "pf": """select *, coalesce(stars = 5, false) as prior,
        coalesce(source_rating = 5, false) and not coalesce(stars = 5, false) as external from fb""",
    "pt": """select *, case when prior then 5 when external and coalesce(band, 0) < 5 then null
        else band end as final, prior and coalesce(band, 0) < 5 as protected from pf""",
    "us": """select case role when 'user' then 'alpha-2-mini-2024' when 'assistant' then 'alpha-2'
        else 'beta' end as model, length(text) as input_tokens, turn * 10 + 1 as output_tokens,
        conv_id % 2 = 0 as batch from conversations""",
    "pr": """select * from (values ('alpha', 1.0, 5.0), ('alpha-2', 3.0, 15.0),
        ('alpha-2-mini', 5.0, 25.0)) t(prefix, price_in, price_out)""",
    "pm": """select model, arg_max(prefix, length(prefix)) as prefix,
        cast(arg_max(price_in, length(prefix)) as double) as price_in,
        cast(arg_max(price_out, length(prefix)) as double) as price_out
        from (select distinct model from us) join pr on starts_with(model, prefix)
        group by model""",
    "qi": """select custom_id, batch_id from rp union all
        select distinct 'burst_' || burst_id, 'b2' from ga where burst_id like '%0'""",
    "fl": "select custom_id from qi where batch_id >= 'b2'",
    "pb": """select burst_id from gm where len(member_ids) >= 2
        and burst_id not in (select burst_id from br)
        and 'burst_' || burst_id not in (select custom_id from fl)""",
    "sg": """select id from (select id from ga where burst_id is null union
        select ga.id from ga join gm using (burst_id) where len(member_ids) < 2 union
        select ga.id from ga join br using (burst_id) where not list_contains(reject_ids, id))
        where id not in (select asset_id from ve)
        and 'triage_' || id not in (select custom_id from fl)""",
    "ud": """select asset_id, caption, keywords, description from ve join a0 on id = asset_id
        where enriched_at is null and (caption is not null or keywords is not null)""",
    "dall": """select asset_id, bucket, category, burst, applied_at from de union all
        select asset_id, bucket, null, null, null from pd""",
    # one row per operation of an asset's decision
    "ao": """select 0 as stage, asset_id as sort_key, bucket, asset_id, o.op_no, o.op, o.rating,
        o.visibility, o.is_favorite, o.tag from dall, lateral (select unnest(
        case bucket when 'reject' then [
            {'op_no': 0, 'op': 'update_asset', 'rating': -1, 'visibility': 'archive',
             'is_favorite': null::boolean, 'tag': null::varchar},
            {'op_no': 1, 'op': 'tag', 'rating': null, 'visibility': null, 'is_favorite': null,
             'tag': 'reject'}]
        when 'nonphoto' then [
            {'op_no': 0, 'op': 'update_asset', 'rating': null, 'visibility': 'archive',
             'is_favorite': null, 'tag': null},
            {'op_no': 1, 'op': 'tag', 'rating': null, 'visibility': null, 'is_favorite': null,
             'tag': coalesce(category, 'nonphoto')}]
        when 'burst_loser' then [
            {'op_no': 0, 'op': 'tag', 'rating': null, 'visibility': null, 'is_favorite': null,
             'tag': 'burst-loser'}]
        when 'five_star' then [
            {'op_no': 0, 'op': 'update_asset', 'rating': 5, 'visibility': null,
             'is_favorite': true, 'tag': null},
            {'op_no': 1, 'op': 'tag', 'rating': null, 'visibility': null, 'is_favorite': null,
             'tag': 'best'}]
        when 'four_star' then [
            {'op_no': 0, 'op': 'update_asset', 'rating': 4, 'visibility': null,
             'is_favorite': null, 'tag': null}]
        else [] end) as o) t where applied_at is null""",
    "st": """select burst_id, [winner_id] || list_filter(reject_ids,
        lambda r: list_contains(member_ids, r)) as ids from br join gm using (burst_id)
        where applied_at is null and list_contains(member_ids, winner_id)
        and len(list_filter(reject_ids, lambda r: list_contains(member_ids, r))) > 0""",
    "tc": f"""select *, regexp_replace(coalesce(caption, ''), '^{_WS}|{_WS}$', '', 'g') as tcap
        from ud""",
    "eo": """select asset_id as sort_key, 'update_asset' as op, tcap as description,
        null as tag, 0 as op_no from tc where tcap <> '' and description is null union all
        select asset_id, 'tag', null, 'kw/' || k,
        i - 1 + case when tcap <> '' and description is null then 1 else 0 end
        from (select asset_id, tcap, description, unnest(keywords) as k,
        generate_subscripts(keywords, 1) as i from tc where keywords is not null)""",
    "al": "select asset_id from dall where bucket = 'five_star'",
    # all operations with their outcome
    "oo": """select 0 as stage, asset_id as action_asset, bucket, op, asset_id, tag,
        not ((op = 'tag' and asset_id like '%7') or (op = 'update_asset' and asset_id like '%3'))
        as ok from ao union all
        select 2, sort_key, 'enrich', op, sort_key, tag,
        not ((op = 'tag' and sort_key like '%7') or (op = 'update_asset' and sort_key like '%3'))
        from eo""",
    "oa": """select action_asset as asset_id, bool_and(ok) as ok,
        bool_or(bucket = 'enrich') as has_enrich, bool_or(bucket <> 'enrich') as has_decision
        from oo group by action_asset""",
    # merged groups: ordinals, components, slices
    "dg": """select doc_id as member, min(doc_id) over (partition by text) as group_id,
        count(*) over (partition by text) as n from documents""",
    "g1": "select doc_id // 2 as g, doc_id as member from documents",
    "g2": "select group_id as g, member from dg where n >= 2",
    "od": """select member, row_number() over (order by s1 nulls last, g nulls last, s2, member) - 1
        as v from (select member, min(g1.member) as s1, min(g2.g) as g, min(g2.member) as s2
        from g1 full join g2 using (member) group by member)""",
    "ed": """select a.v as a, b.v as b from (
        select member, min(member) over (partition by g) as hub from g1 union all
        select member, min(member) over (partition by g) from g2) x
        join od a on a.member = x.member join od b on b.member = x.hub where a.v <> b.v""",
    "rc": """select v, v as w from od union
        select rc.v, e.b from rc join (select a, b from ed union all select b, a from ed) e
        on rc.w = e.a""",
    "ro": "select v, min(w) as root from rc group by v",
    "mg": """select member, root, row_number() over (partition by root order by v) - 1 as p,
        count(*) over (partition by root) as n from od join ro using (v)""",
    "sizes": """select (select count(*) from a0) as assets, (select count(*) from ve) as triage,
        (select count(*) from br) as bursts, (select count(*) from pk) as bws_sets,
        (select count(*) from du) as pairs, (select count(*) from sc) as scores,
        (select count(*) from de) as decisions, (select count(distinct batch_id) from rp) as batches,
        (select count(*) from rp) as batch_items, (select count(*) from gm) as burst_groups,
        (select count(*) from a0 where id not in (select asset_id from ve)) as untriaged,
        (select count(applied_at) from de) as applied,
        (select count(*) from de where applied_at is null) as unapplied,
        (select count(distinct batch_id) from rp where batch_id >= 'b2') as open_batches""",
}


def _needed(text: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b(from|join)\s+{name}\b|,\s*{name}\b", text):
            seen_before = list(seen)
            seen.append(name)  # guards the recursive view against itself
            inner: list[str] = list(seen)
            _needed(VIEWS[name], inner)
            fresh = [n for n in inner if n not in seen]
            seen[:] = seen_before + fresh + [name]


def sql(text: str) -> str:
    """``text`` with the views it reads as common table expressions, in order."""
    names: list[str] = []
    _needed(text, names)
    if not names:
        return text
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {'recursive ' if {'rc', 'swstep'} & set(names) else ''}{ctes} {text}"


def _sweeps(count: int) -> str:
    """Normalized sweeps of the strength fit, one chain of expressions per sweep."""
    parts = ["s0 as (select item, 1.0::double as s from it)"]
    for k in range(count):
        parts.append(
            f"u{k} as (select it.item, greatest((any_value(wins) + 0.5) / (1.0 / (any_value(a.s) + 1.0)"
            f" + sum(vs.n / (a.s + b.s))), 1e-12) as u from it join s{k} a on a.item = it.item "
            f"join vs on vs.i = it.item join s{k} b on b.item = vs.j group by it.item)")
        parts.append(
            f"s{k + 1} as (select item, greatest(u / exp((select avg(ln(u)) from u{k})), 1e-12) as s "
            f"from u{k})")
    base = sql("select * from it join vs on true")
    ctes = base[: base.rindex("select * from it")].rstrip()
    return f"{ctes}, {', '.join(parts)} select item, round(s, 6) as strength from s{count}"


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

ORACLES: dict[str, str] = {
    "read_assets": f"""select {_id('e', 'event_id')} as id, 'IMG_' || cast(event_id as varchar)
        as filename, epoch_us(date_trunc('millisecond', ts)) as taken_at,
        case when event_id % 2 = 0 or event_id % 3 = 0 then
        (case when event_id % 2 = 0 then 'maker' || cast(user_id % 5 as varchar) else '' end) || '|'
        || (case when event_id % 3 = 0 then 'm' || cast(user_id as varchar) else '' end)
        else '' end as camera, case when event_id % 2 = 0 then null else 'text' end as description,
        400 as width, 300 as height, case when event_id % 2 = 0 then 4 else 2 end as source_rating,
        event_id as dhash from events where event_type not in ('error', 'view')""",
    "read_assets_window": f"""select {_id('e', 'event_id')} as id, 'IMG_' || cast(event_id as varchar)
        as filename, epoch_us(date_trunc('millisecond', ts)) as taken_at,
        case when event_id % 2 = 0 or event_id % 3 = 0 then
        (case when event_id % 2 = 0 then 'maker' || cast(user_id % 5 as varchar) else '' end) || '|'
        || (case when event_id % 3 = 0 then 'm' || cast(user_id as varchar) else '' end)
        else '' end as camera, case when event_id % 2 = 0 then null else 'text' end as description,
        400 as width, 300 as height, case when event_id % 2 = 0 then 4 else 2 end as source_rating,
        event_id as dhash from events where event_type not in ('error', 'view')
        and date_trunc('millisecond', ts) >= timestamp '2024-01-10'
        and date_trunc('millisecond', ts) < timestamp '2024-01-20'""",
    "hash_images": """select vec_id, cast(sum(case when this > next then bit else 0 end) as bigint) as dhash from (
        select vec_id, floor((cast(embedding[i + 1] as double) + 1) * 127.5) as this, floor((cast(embedding[i - i % 8 + (i + 1) % 8 + 1] as double) + 1) * 127.5) as next,
        case when i = 0 then -9223372036854775808::hugeint else 1::hugeint << (63 - i) end as bit
        from embeddings, range(64) t(i)) group by vec_id""",
    "time_window": """select event_id, user_id, epoch_us(ts) as ts from events
        where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'""",
    "lookup": f"""select id, camera, epoch_us(taken_at) as taken_at from a0
        where id in (select {_id('e', 'doc_id')} from labels)""",
    "capture_time": f"""select o_orderkey, epoch_us(case when o_orderkey % 5 = 0 then
        date_trunc('day', o_orderdate)
        when o_orderkey % 5 = 1 then date_trunc('day', o_orderdate) + interval 36672500 milliseconds
        when o_orderkey % 5 = 2 then date_trunc('day', o_orderdate) + interval 29472 seconds
        when o_orderkey % 2 = 0 then date_trunc('day', o_orderdate) + interval 3723 seconds end)
        as taken_at from orders""",
    "camera_key": """select p_partkey, case when p_size % 4 = 0 then '' else p_brand || '|' ||
        case when p_size % 4 > 1 then p_type else '' end end as camera from part""",
    "iso_bound": f"""select o_orderkey, case when o_orderkey % 3 = 0 then {_DAY} || 'T05:00:00Z'
        else {_DAY} || 'T00:00:00.000Z' end as bound,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') as moment from orders""",
    "interval_seconds": """select event_id, case when user_id % 40 - 2 <= 0 or event_id % 7 = 6
        then null else cast(user_id % 40 - 2 as double) * case event_id % 7 when 0 then 1.0
        when 1 then 60.0 when 2 then 3600.0 when 3 then 86400.0 when 4 then 604800.0 else 1.0 end end
        as seconds from events""",
    "dhash_bits": "select vec_id, dhash from hashes",
    "hamming": """select h.vec_id, bit_count(xor(h.dhash, g.dhash)) as distance
        from hashes h join hashes g on g.vec_id = h.vec_id + 1""",
    "normalize_keywords": f"""select doc_id, coalesce(string_agg(w, '|' order by i)
        filter (r <= 8), '') as keywords from (select doc_id, w, i,
        row_number() over (partition by doc_id order by i) as r from (
        select d.doc_id, x.w, min(x.i) as i from documents d left join (select doc_id, i,
        regexp_replace(regexp_replace(lower(w), '{_WS}', ' ', 'g'), '^ +| +$', '', 'g') as w
        from (select doc_id, unnest(string_split(text, ' ')) as w,
        generate_subscripts(string_split(text, ' '), 1) as i from documents)) x
        on x.doc_id = d.doc_id and x.w <> '' group by d.doc_id, x.w)) group by doc_id""",
    "group_key": """select burst_id, burst_id as group_key, burst_id as reversed_key from gk""",
    "triage_bucket": f"select asset_id, {_bucket('category', 'verdict', 'confidence')} as bucket "
                     "from ve",
    "work_ids": """select c_custkey, case when ok then k || '_' || t end as custom_id,
        case when ok and k <> 'zip' then k else 'triage' end as kind,
        case when ok then case when k = 'zip' then k || '_' || t else t end end as work_key
        from (select *, regexp_full_match(k || '_' || t, '[a-zA-Z0-9_-]{1,64}') as ok from (
        select c_custkey, (['triage', 'burst', 'bws', 'pair', 'zip'])[c_custkey % 5 + 1] as k,
        case when c_custkey % 4 = 0 then 'a:' || c_name
        else regexp_replace(c_name, '[^a-zA-Z0-9_-]', '-', 'g') end as t from customer))""",
    "decode_detail": """select event_id, case when event_id % 4 <> 0 then
        cast(json_extract_string(props, '$.k') as int) end as k,
        case when event_id % 4 = 0 then event_type end as raw from events""",
    "parse_replies": """select custom_id, case when usable then category end as category,
        case when usable then verdict end as verdict,
        case when usable then technical_score end as technical_score,
        case when usable then confidence end as confidence,
        case when usable then caption else '' end as caption,
        case when usable then array_to_string(keywords, ',') else '' end as keywords,
        case when usable then array_to_string(reasons, ',') end as reasons, usable
        from rp where failed is null""",
    "validate_verdicts": """select asset_id, case when reasons[2] = 'doc 8' then 'unknown verdict'
        when technical_score + case when confidence = 'low' then 2 else 0 end > 10
        then 'technical_score outside 0-10' end as error from ve""",
    "validate_set_picks": """select case when b not between 1 and 7 then 'best_index out of range'
        when w not between 1 and 7 then 'worst_index out of range'
        when b = w then 'best_index equals worst_index' else '' end as error, count(*) as n
        from (select cast(floor(l_quantity) as int) % 9 as b, l_suppkey % 9 as w from lineitem)
        group by 1""",
    "validate_burst_picks": """select 'strict' as mode, case when b not between 1 and 4
        then 'best_index out of range' when r not between 1 and 4
        then 'reject index out of range' when b = r or b = 2 then 'best_index is also rejected' end
        as error, count(*) as n from (select cast(floor(l_quantity) as int) % 6 as b,
        l_suppkey % 6 as r from lineitem) group by 2 union all
        select 'loose', case when b not between 1 and 4 then 'best_index out of range' end,
        count(*) from (select cast(floor(l_quantity) as int) % 6 as b from lineitem) group by 2""",
    "report_captions": """select pd.asset_id, pd.bucket, coalesce(nullif(filename, ''), pd.asset_id)
        as title, concat_ws(' · ', case when stars is not null then repeat('★', stars) end,
        'rank ' || cast(stars as varchar), 'score ' || printf('%.3f', bt_score)) as score_line,
        case when vp.asset_id is null then '' else concat_ws(' · ', verdict,
        'score ' || cast(technical_score as varchar) || '/10', confidence || ' confidence') end
        as verdict_line, coalesce(array_to_string(reasons, '; '), '') as reasons_line
        from pd join sc using (asset_id) left join vp using (asset_id)""",
    "unjudged": "select id from ga where burst_id is null and id not in (select asset_id from ve)",
    "unjudged_with_groups": "select id from a0 where id not in (select asset_id from ve)",
    "unjudged_bursts": "select burst_id from gm where burst_id not in (select burst_id from br)",
    "inflight": "select custom_id from rp where batch_id >= 'b2'",
    "pending_bursts": "select burst_id from pb",
    "pending_singles": "select id from sg",
    "work_queue": """select kind, key, kind || '_' || key as custom_id from (
        select 'burst' as kind, null as taken_at, burst_id as key from pb union all
        select 'triage', taken_at, id from sg join a0 using (id))
        order by kind, taken_at nulls first, key limit 500""",
    "candidates": """select asset_id, technical_score from ve join de using (asset_id)
        where ve.category = 'photo' and (verdict = 'candidate' or technical_score >= 8)
        and bucket not in ('reject', 'burst_loser')""",
    "unenriched": """select asset_id, caption, array_to_string(keywords, ',') as keywords,
        description from ud""",
    "rejudge_targets": """select asset_id from ve join de using (asset_id) join a0 on id = asset_id
        where caption is null and bucket = 'middle' and taken_at >= timestamp '2024-01-01 06:00:00'
        and taken_at < timestamp '2024-01-02'""",
    "forget_triage": """select 'triage' as t, asset_id as k from ve where asset_id not in
        (select asset_id from de where bucket = 'reject') union all
        select 'bursts', burst_id from br where burst_id not in (select burst_id from ga
        join de on asset_id = id where bucket = 'reject' and burst_id is not null)""",
    "forget_rank": """select 0 as n_sets, (select count(*) from dp where stage <> 'rank') as n_pairs,
        0 as n_scored, (select count(stars) from sc) as n_starred""",
    "forget_finals": """select stage, count(*) as n from dp where stage <> 'finals'
        group by stage""",
    "known_duplicates": """select group_id, member from (select *, count(*) over
        (partition by group_id) as k from dg where n >= 2
        and member in (select doc_id from labels)) where k >= 2""",
    "unplanned_sets": """select set_id, 'x,' || k as member_ids from (select p_partkey as set_id,
        cast(p_partkey // 2 as varchar) as k, row_number() over (partition by p_partkey // 2
        order by p_partkey) as r from part) left join (select cast(c_custkey // 3 as varchar) as k,
        count(*) as done from customer group by 1) using (k) where r > coalesce(done, 0)""",
    "price_join": """select model, prefix, price_in, price_out, count(*) as n from us
        left join pm using (model) group by all""",
    "decision_filter": """select asset_id, bucket from de where bucket = 'middle'
        and applied_at is null""",
    "burst_chains": "select id, head, pos, pos = len - 1 as last from ps",
    "burst_chains_by_time": """select min(id) as head, count(*) as frames from (select id, camera,
        sum(brk) over (partition by camera order by taken_at, id) as c from (select *,
        case when epoch_us(taken_at) - epoch_us(lag(taken_at) over (partition by camera
        order by taken_at, id)) <= 3600000000 then 0 else 1 end as brk from a0))
        group by camera, c""",
    "split_groups": "select id, head, slice, spos as pos from sl",
    "merge_groups": """select root as component, p // 3 as slice, p % 3 as pos, member from mg
        where not (p % 3 = 0 and p = n - 1)""",
    "assign_groups": "select id, burst_id from ga",
    "group_members": "select burst_id, array_to_string(member_ids, ',') as member_ids from gm",
    "pack_batches_caps": """select count(*) as items, cast(sum(n_chars) as bigint) as bytes,
        0 as over_cap from documents""",
    "summary": "unpivot (select * from sizes) on * into name metric value value",
    "breakdown": """select 'verdict' as what, verdict as value, count(*) as n from ve group by 2
        union all select 'category', category, count(*) from ve group by 2""",
    "triage_stats": f"""select nb as bursts_judged, losers as burst_losers, count(*)
        as singles_judged, count(*) filter (b = 'reject') as rejects,
        count(*) filter (b = 'nonphoto') as nonphotos,
        count(*) filter (verdict = 'candidate') as candidates,
        count(*) filter (b = 'middle') as middles,
        (select count(*) from rp where failed is not null) as errors,
        cast(coalesce(sum(length(caption)), 0) + 7 * nb as bigint) as input_tokens,
        cast(sum(technical_score) + 2 * nb as bigint) as output_tokens
        from (select *, {_bucket('category', 'verdict', 'confidence')} as b from ve),
        (select count(*) as nb, cast(sum(len(reject_ids)) as bigint) as losers from br)
        group by nb, losers""",
    "cost_by_model": """select model, cast(sum(input_tokens) as bigint) as input_tokens,
        cast(sum(output_tokens) as bigint) as output_tokens,
        round(sum((input_tokens / 1e6::double * price_in + output_tokens / 1e6::double * price_out)
        * case when batch then 0.5::double else 1.0::double end), 4) as cost
        from us left join pm using (model) group by model""",
    "tally_items": "select item, wins from it",
    "tally_versus": "select i, j, n from vs",
    "tally_errors": """select 'winner is neither side' as error, count(*) as n from dp
        where a_id > b_id""",
    "fold_tags": """select distinct 'pickline/' || tag as tag, asset_id from ao where op = 'tag'
        union select distinct tag, sort_key from eo where op = 'tag'""",
    "fold_updates": """select asset_id, max(rating) as rating, max(visibility) as visibility,
        max(is_favorite) as is_favorite, max(description) as description from (
        select asset_id, rating, visibility, is_favorite, null as description from ao
        where op = 'update_asset' union all select sort_key, null, null, null, description
        from eo where op = 'update_asset') group by asset_id""",
    "build_sets": """select r.round, s as n_sets, n // s as least,
        n // s + case when n % s > 0 then 1 else 0 end as most, n as members from
        (select unnest([1, 2, 3, 4]) as round) r, (select count(*) as n,
        cast(ceil(count(*) / 8) as bigint) as s from part)""",
    "build_sets_appearances": "select asset_id as member, 4 as n, 4 as rounds from sc",
    "set_rounds": """select p_partkey as set_id, cast(p_partkey // greatest(1,
        (select count(*) from part) // 4) + 1 as int) as round from part""",
    "expand_sets": "select a, b, winner, count(*) as n from ip group by all",
    "expand_members": "select a, b, winner, count(*) as n from ip group by all",
    "collect_pairs": """select winner, count(*) as n from (select winner from ip union all
        select winner from dp) group by winner""",
    "bradley_terry_sweeps": _sweeps(3),
    "rank_scores": """select asset_id as item, bt_score as strength,
        dense_rank() over (order by bt_score desc) as rank from sc""",
    "merge_scores": """select coalesce(sc.asset_id, f.item) as asset_id,
        round(coalesce(f.strength, sc.bt_score), 6) as bt_score,
        case when f.item is not null then 1 end as rank, stars,
        case when f.item is not null then epoch_us(""" + LATER + """) end as updated_at
        from sc full join (select substr(asset_id, 1, 8) || '9' as item,
        max(bt_score * 2) as strength from sc where stars is null group by 1) f
        on f.item = sc.asset_id""",
    "cap_candidates": """select asset_id from sc where stars is not null union all
        select asset_id from (select asset_id, row_number() over (order by bt_score desc, asset_id)
        - 1 as p, count(*) over () as n from sc where stars is null)
        where n <= 37 or p in (select cast(round_even(k * (n - 1) / 36, 0) as bigint)
        from range(37) t(k))""",
    "top_pool": """select asset_id, bt_score from rk
        where position < greatest(50, 2 * greatest(1, round_even(total * 0.05, 0)))""",
    "pair_history": """select distinct least(a_id, b_id) as a, greatest(a_id, b_id) as b from dp
        where stage = 'finals'""",
    "swiss_pairs": """select x.asset_id as a, y.asset_id as b, x.position as place from rk x
        join rk y on y.position = x.position + 1 where x.position % 2 = 0""",
    "swiss_pairs_history": """select x.asset_id as a, y.asset_id as b, upper as place from swstep
        join rk x on x.position = upper join rk y on y.position = lower""",
    "reconcile_orders": """select duel_id, a_id, b_id, case when f = r then f else 'tie' end
        as winner, f = r as agreed from (select *, case forward_pick when 'A' then a_id
        when 'B' then b_id else 'tie' end as f, case reverse_pick when 'A' then b_id
        when 'B' then a_id else 'tie' end as r from du)""",
    "star_bands": """select asset_id, position, case when position < 25 then 5
        when position < 25 + floor((total - 25) * 0.3) then 4 end as stars from rk""",
    "fraction_bands": "select asset_id, position, coalesce(band, 3) as stars from fb",
    "protect_fives": "select asset_id, final as stars, protected from pt",
    "retract_stars": """select asset_id, case when gone then null else pt.stars end as stars,
        case when gone and bucket in ('five_star', 'four_star') then null else bucket end as bucket
        from (select *, final is null and not prior and not external as gone from pt) pt
        join pd using (asset_id)""",
    "star_tail": """select asset_id, technical_score, case when technical_score >= 5 then 2 else 1 end
        as stars from ve where category = 'photo' and asset_id not in
        (select asset_id from de where bucket <> 'middle')""",
    "merge_upsert": f"""select coalesce(a0.id, u.id) as id, camera, description,
        coalesce(u.r, source_rating) as source_rating from a0 full join (
        select {_id('e', 'l_partkey')} as id, arg_max(cast(floor(l_quantity) as int) % 6,
        struct_pack(s := l_orderkey * 100 + l_linenumber, k := l_suppkey, p := l_extendedprice))
        as r from lineitem group by 1) u on u.id = a0.id""",
    "merge_triage": f"""select asset_id, case when confidence = 'high' then 'neutral' else verdict end
        as verdict, case when confidence <> 'high' then caption end as caption,
        case when confidence <> 'high' then epoch_us(enriched_at) end as enriched_at,
        array_to_string(keywords, ',') as keywords from ve""",
    "merge_bursts": """select burst_id, winner_id, case when burst_id like '%7' then ''
        else array_to_string(reject_ids, ',') end as reject_ids,
        case when substr(burst_id, 2, 1) < '8' and (burst_id not like '%7' or len(reject_ids) = 0)
        then epoch_us(applied_at) end as applied_at from ball""",
    "merge_decisions": """select asset_id, case when hit then case when bucket = 'reject' then 'reject'
        else 'nonphoto' end else bucket end as bucket,
        case when not hit or bucket in ('reject', 'nonphoto') then epoch_us(applied_at) end
        as applied_at from (select *, burst = 'b3' as hit from de)""",
    "resolve_bursts": """select burst_id, winner_id, array_to_string(reject_ids, ',') as reject_ids,
        note, case when substr(burst_id, 2, 1) < '8' then epoch_us(applied_at) end as applied_at
        from ball""",
    "resolve_bursts_decisions": """select id as asset_id, 'burst_loser' as bucket from ga
        join ball using (burst_id) where list_contains(reject_ids, id)""",
    "mark_done": f"""select asset_id, case when asset_id in (select {_id('e', 'doc_id')} from labels
        where quality = 1) then epoch_us({EPOCH}) else epoch_us(applied_at) end as applied_at
        from de""",
    "count_done": f"""select count(*) as changed from de where asset_id in
        (select {_id('e', 'doc_id')} from labels where quality = 1)""",
    "clear_decisions": """select asset_id, bucket from de where asset_id not in
        (select asset_id from ve where verdict = 'candidate')""",
    "ingest_results": """select 'triage' as kind, count(*) as n,
        count(*) filter (not usable) as errors from rp""",
    "ingest_results_tables": f"""select asset_id, category, verdict,
        {_bucket('category', 'verdict', 'confidence')} as bucket, nullif(caption, '') as caption
        from rp where usable""",
    "ingest_results_items": """select batch_id, count(*) filter (usable) as results,
        count(*) filter (not usable) as errors, 'ingested' as status from rp group by batch_id""",
    "register_batch": """select batch_id, kind, count(*) as n, count(result) as results,
        case when batch_id < 'b2' then 'ingested' else 'submitted' end as status from (
        select batch_id, 'triage' as kind, 'old' as result from rp
        where not (category = 'photo' and verdict = 'reject') union all
        select 'b9', case when verdict = 'reject' then 'triage' else 'burst' end, null from rp
        where category = 'photo') group by batch_id, kind""",
    "set_batch_status": f"""select batch_id, case when batch_id > 'b0' then 'ingested' else 'ingested'
        end as status, case when batch_id > 'b0' then epoch_us({EPOCH}) else epoch_us({LATER}) end
        as ingested_at from (select distinct batch_id from rp)""",
    "asset_actions": """select ao.sort_key, case bucket when 'reject' then 'reject'
        when 'nonphoto' then 'nonphoto' when 'burst_loser' then 'stacks' else 'stars' end as "group",
        ao.bucket, case when bucket = 'burst_loser' then burst end as burst_id, op_no, op, asset_id,
        rating, visibility, is_favorite, 't/' || tag as tag,
        asset_id || case bucket when 'reject' then
        ' rejected: archived, rated -1, tagged t/reject'
        when 'nonphoto' then ' is no photograph but ' || coalesce(nullif(category, ''),
        'unknown') || ': archived, tagged t/' || coalesce(category, 'nonphoto')
        when 'burst_loser' then ' lost in its group: tagged t/burst-loser'
        when 'five_star' then ' among the best: rated 5, made a favorite, tagged t/best'
        else ' rated 4' end as line
        from aoall ao join dall using (asset_id, bucket)""",
    "stack_actions": """select burst_id, 'stacks' as "group", array_to_string(ids, ',') as asset_ids
        from st""",
    "enrich_actions": "select sort_key, op_no, op, description, tag from eo",
    "album_action": """select 'stars' as "group", 'album' as op, 'Best' as name, asset_id from pd
        where bucket in ('five_star', 'four_star')""",
    "plan": """select stage, "group", bucket, count(*) as n, cast(sum(ops) as bigint) as ops,
        min(k) as first, max(k) as last from (
        select 0 as stage, case bucket when 'reject' then 'reject' when 'nonphoto' then 'nonphoto'
        when 'burst_loser' then 'stacks' else 'stars' end as "group", bucket, sort_key as k,
        count(*) as ops from ao group by all union all
        select 1, 'stacks', 'burst_stack', burst_id, 1 from st union all
        select 2, 'enrich', 'enrich', sort_key, count(*) from eo group by sort_key union all
        select 3, 'stars', 'album', asset_id, 1 from al) group by all""",
    "select_groups": """select 'reject' as "group", count(*) as n from dall where bucket = 'reject'
        and applied_at is null union all
        select 'enrich', count(distinct sort_key) from eo""",
    "reconcile": """select 'selected' as counter, (select count(distinct sort_key) from ao)
        + (select count(*) from st) + (select count(distinct sort_key) from eo) as value union all
        select 'assets_done', count(*) from oa where ok union all
        select 'assets_failed', count(*) from oa where not ok union all
        select 'assets_updated', count(*) from (select asset_id, bool_and(ok) as ok from oo
        where op = 'update_asset' group by asset_id) where ok union all
        select 'assets_tagged', count(*) from (select tag, asset_id, bool_and(ok) as ok from oo
        where op = 'tag' group by tag, asset_id) where ok union all
        select 'stacks_created', count(*) from st union all select 'stacks_failed', 0 union all
        select 'album_assets', count(*) from al union all
        select 'enriched', count(*) from oa where ok and has_enrich""",
    "reconcile_stamps": """select 'decision' as what, asset_id from oa where ok and has_decision
        union all select 'enrich', asset_id from oa where ok and has_enrich""",
    "write_actions": """select 'decision' as what, asset_id from oa where ok and has_decision
        union all select 'enrich', asset_id from oa where ok and has_enrich""",
    "report_keepers": """select asset_id, bucket, bt_score, null as rank, sc.stars, filename,
        array_to_string(reasons, '; ') as reasons from pd join sc using (asset_id)
        left join vp using (asset_id) where bucket in ('five_star', 'four_star')""",
    "report_rejects": """select asset_id, ve.category, verdict, technical_score, confidence,
        array_to_string(reasons, '; ') as reasons, null as filename from de
        join ve using (asset_id) where bucket = 'reject'""",
    "report_nonphotos": """select asset_id, ve.category, verdict, technical_score, confidence,
        array_to_string(reasons, '; ') as reasons, null as filename from de
        join ve using (asset_id) where bucket = 'nonphoto'""",
    "report_bursts": """select burst_id, epoch_us(taken_at) as taken_at, id as asset_id,
        case when id = winner_id then 'winner' when list_contains(reject_ids, id) then 'loser' end
        as role, note from ga left join br using (burst_id) where burst_id is not null""",
}
ORACLES["stream_bursts"] = ORACLES["split_groups"]
ORACLES["watch"] = ORACLES["unjudged_with_groups"]
ORACLES["stream_results"] = f"""select asset_id, {_bucket('category', 'verdict', 'confidence')}
    as bucket from rp where usable"""
ORACLES["judge_with"] = """select doc_id, case when said then case when n_chars % 3 <> 0 then 'photo'
    else 'meme' end end as category, case when said then n_chars % 12 end as technical_score,
    case when said and n_chars % 12 < 11 then n_chars else 0 end as input_tokens,
    case when said and n_chars % 12 < 11 then 7 else 0 end as output_tokens,
    said and n_chars % 12 < 11 as usable from (select *, n_chars % 13 <> 0 and n_chars % 17 <> 0
    and n_chars % 19 <> 0 as said from documents)"""
VIEWS["aoall"] = VIEWS["ao"].replace(" where applied_at is null", "")
ORACLES["report_summary"] = " union all ".join(
    f"select {i + 1} as ord, '{label}' as label, "
    + (f"(select count(*) from de where bucket = '{metric[7:]}')" if metric.startswith("bucket:")
       else f"(select {metric} from sizes)") + " as value"
    for i, (label, metric) in enumerate(HEADLINES)
)


def oracle_sql() -> dict[str, str]:
    """SQL per query name."""
    return {name: text if name == "bradley_terry_sweeps" else sql(text)
            for name, text in ORACLES.items()}
