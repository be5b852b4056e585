"""DuckDB SQL that says independently what each query of ``queries`` returns."""

from __future__ import annotations

from tidestore.model import Match, TagMatcher, duration_us
from tidestore.plans.queries import FIND, FLAGSHIP, PARTITIONS

EV = "ev as (select 'events/user/' || user_id as resource_id, event_type as name, ts as time, value, user_id from events)"
LI = "li as (select 'lineitem/supplier/' || l_suppkey as resource_id, 'qty_' || l_returnflag as name, l_shipdate as time, l_quantity as value from lineitem)"
TAGS = """
ser as (select distinct user_id, event_type, 'name=' || event_type || ',resourceId=events/user/' || user_id as metric_key from events),
tags as (
  select metric_key, 'intrinsic' as tag_type, 'name' as tag_key, event_type as tag_value from ser
  union all select metric_key, 'intrinsic', 'resourceId', 'events/user/' || user_id from ser
  union all select metric_key, 'meta', 'mtype', case when event_type in ('purchase', 'signup') then 'count' else 'gauge' end from ser
  union all select metric_key, 'meta', 'host', 'myHost' || (user_id % 10) from ser where user_id % 7 <> 0
  union all select metric_key, 'meta', null, 'keyless' from ser where user_id % 5 = 0
  union all select metric_key, 'external', 'band', 'band-' || (user_id % 3) from ser)"""
KEYS = "keys as (select distinct metric_key from tags)"
RANGE = "time > timestamp '2024-01-05' and time < timestamp '2024-01-12 06:30:00'"
POINT = "resource_id, name, epoch_us(time) as time_us, value"


def _matcher(m: TagMatcher) -> str:
    value = m.value.replace("'", "''")
    test = {
        Match.EQUALS: f"t.tag_value = '{value}'",
        Match.NOT_EQUALS: f"t.tag_value <> '{value}'",
        Match.EQUALS_REGEX: f"regexp_full_match(t.tag_value, '{value}')",
        Match.NOT_EQUALS_REGEX: f"not regexp_full_match(t.tag_value, '{value}')",
    }[m.type]
    key = "null" if m.key is None else f"'{m.key}'"
    return f"exists (select 1 from tags t where t.metric_key = k.metric_key and t.tag_type in ('intrinsic', 'meta') and t.tag_key is not distinct from {key} and {test})"


def _found(matchers: list[TagMatcher]) -> str:
    return "select k.metric_key from keys k where " + " and ".join(map(_matcher, matchers))


FLAG = f"with {EV}, {TAGS}, {KEYS}, hit as ({_found(FLAGSHIP)}) select s.metric_key, {POINT} from ev join ser s on s.user_id = ev.user_id and s.event_type = ev.name join hit using (metric_key) where {RANGE}"
ARRAYS = """list_aggregate(list_sort(list(coalesce(tag_key, '') || '=' || tag_value) filter (tag_type = '{0}')), 'string_agg', ';')"""


def _label(us: int, shape: str, column: str) -> str:
    return f"strftime(make_timestamp((epoch_us({column}) - ((epoch_us({column}) % {us}) + {us}) % {us})::bigint), '{shape}')"


def _encode(e: str) -> str:
    char = "case when regexp_full_match(c, '[A-Za-z0-9._-]') then c else regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') end"
    return f"case when {e} = '.' then '%2E' when {e} = '..' then '%2E%2E' else list_aggregate(list_transform(string_split({e}, ''), lambda c : {char}), 'string_agg', '') end"


SHARD = f"coalesce(list_aggregate(list_transform(list_filter(string_split(resource_id, '/'), lambda e : e <> ''), lambda e : {_encode('e')}), 'string_agg', '/'), '')"
EXPIRED = "strptime(p, '%Y-%m-%d') + interval 1 day <= timestamp '2001-01-01' - interval 365 day"
LINE_PARTS = f"with {LI}, parts as (select strftime(time, '%Y-%m-%d') as p, count(*) as n from li group by 1)"

CELL = """case when ((s_suppkey * 31 + {arch} * 17 + i * 7 + d * 5) % 101) % 13 = 0 then null else ((s_suppkey * 31 + {arch} * 17 + i * 7 + d * 5) % 101)::double end"""
ARCH = f"""
arch(pos, cf, k, n) as (values (0::bigint, 'MAX', 1::bigint, 20::bigint), (1, 'AVERAGE', 1, 12), (2, 'AVERAGE', 4, 15), (3, 'AVERAGE', 12, 10), (4, 'MIN', 4, 8)),
a as (
  select s_suppkey as file, pos, cf, k, n, 300 * k as w, 1700000000 + s_suppkey * 77 as u, s_suppkey,
         u - u % w as last_ts, last_ts - w * (n - 1) as first_ts
  from supplier, arch),
sel as (
  select * from a
  qualify row_number() over (partition by file, k order by case when k = 1 then -n else 0 end, pos) = 1 and (k = 1 or cf = 'AVERAGE')),
chosen as (select * from a where pos in (0, 2, 3)),
b as (
  select *, case when lead(w) over o is null then first_ts else (ceil(first_ts / (lead(w) over o)::double))::bigint * lead(w) over o end as begin_ts,
         case when lag(k) over o is not null then ceil((u - (lag(k) over o) * 300 * (lag(n) over o)) / w::double)::bigint * w end as until_ts
  from chosen window o as (partition by file order by k)),
cell as (
  select file, k, w, pos, begin_ts, until_ts, i, d, first_ts + w * i as ts, last_ts, {CELL.format(arch='pos')} as v
  from b, lateral (select unnest(range(n)) as i), (values (0), (1)) as ds(d)),
win as (
  select file, ts, max(k) as k from (select distinct file, k, ts, begin_ts, until_ts from cell) where ts >= begin_ts and (until_ts is null or ts < until_ts) group by file, ts)"""
CELL_SUM = f"""
arch(pos, cf, k, n) as (values (0::bigint, 'MAX', 1::bigint, 20::bigint), (1, 'AVERAGE', 1, 12), (2, 'AVERAGE', 4, 15), (3, 'AVERAGE', 12, 10), (4, 'MIN', 4, 8)),
cell as (select s_suppkey as file, d, {CELL.format(arch='pos')} as v from supplier, arch, lateral (select unnest(range(n)) as i), (values (0), (1)) as ds(d))"""
INCOMING = """
m as (select *, user_id as u from ser),
inc as (
  select metric_key, 'host=renamed' || case when u % 6 = 0 then '2' else '1' end as meta from m where u % 3 = 0
  union all select 'new:' || metric_key, null from m where u = 1)"""

RRD_COUNTER = f"""
with recursive {ARCH},
start as (
  select c.file, c.k, c.w, c.i as n, c.ts, (file * 1000003 % 9000000)::double as raw from cell c where d = 1 and ts = last_ts),
walk as (
  select file, k, w, n as i, ts, raw - raw % w as prev, true as known from start
  union all
  select walk.file, walk.k, walk.w, walk.i - 1, walk.ts - walk.w,
         case when prev - coalesce(c.v, 0) * walk.w < 0 then prev - coalesce(c.v, 0) * walk.w + pow(2, 64) else prev - coalesce(c.v, 0) * walk.w end, c.v is not null
  from walk join cell c on c.file = walk.file and c.k = walk.k and c.d = 1 and c.i = walk.i where walk.i > 0)
select file, ts, prev as value from walk join win using (file, ts, k) where known"""
ORACLE_SQL: dict[str, str] = {
    **{name: f"with {TAGS}, {KEYS} {_found(matchers)}" for name, matchers in FIND.items()},
    **{name: f"with {EV} select 'p=' || {_label(duration_us(duration), shape, 'time')} as p, count(*) as n from ev group by 1" for name, (duration, shape) in PARTITIONS.items()},
    "find_by_tag_rows": f"with {TAGS}, {KEYS} {_found(FLAGSHIP)}",
    "find_external_excluded": f"with {TAGS}, {KEYS} select count(*) as n from ({_found([TagMatcher('band', 'band-1')])})",
    "fetch_many": FLAG,
    "store_fetch": FLAG,
    "fetch_one": f"with {EV} select epoch_us(time) as time_us, value from ev where user_id = 3 and name = 'click' and time > timestamp '2024-01-05' and time < timestamp '2024-01-21 06:30:00'",
    "range_read": f"with {EV} select epoch_us(time) as time_us, value from ev where resource_id = 'events/user/8' and name = 'error' and {RANGE}",
    "range_read_bounds": f"with {EV} select {POINT} from ev qualify time > min(time) over (partition by resource_id, name) and time < max(time) over (partition by resource_id, name)",
    "read_duplicates": f"with {LI} select {POINT} from li where time > timestamp '1996-01-01' and time < timestamp '1997-01-01'",
    "read_deleted": f"with {EV} select {POINT} from ev where name = 'view' and {RANGE} and not (user_id % 7 <> 0 and user_id % 10 = 2)",
    "samples_with_metric": f"with {EV} select 'name=click,resourceId=events/user/3' as metric_key, epoch_us(time) as time_us, value, 2 as n_intrinsic, 2 as n_meta from ev where user_id = 3 and name = 'click' and {RANGE}",
    "partition_parse": """
with e as (
  select event_id, event_id % 6 as k, case event_id % 6 when 0 then 'p=' || strftime(ts, '%Y-%m-%d') when 1 then 'p=' || strftime(ts, '%Y-%m-%d-%H')
    when 2 then 'p=' || strftime(ts, '%Y-%m-%d-%H-%M') when 3 then strftime(ts, '%Y-%m-%d') when 4 then 'p=' || strftime(ts, '%Y') || '-13-40' else 'p=not-a-date' end as name from events)
select event_id, name, epoch_us(coalesce(try_strptime(name, 'p=%Y-%m-%d'), try_strptime(name, 'p=%Y-%m-%d-%H'), try_strptime(name, 'p=%Y-%m-%d-%H-%M'))) as start_us from e""",
    "shard_path": f"""
with r as (
  select page_id as id, url as resource_id from pages
  union all select doc_id, '/' || source || '//../' || regexp_replace(text, '[/\\n]', ' ', 'g') from documents)
select id, resource_id, {SHARD} as shard from r""",
    "partition_path": f"with {EV} select distinct resource_id || '/p=' || strftime(time, '%Y-%m-%d') as path from ev",
    "epoch_micros": "select epoch_us(ts) as time_us, 0::bigint as lost from events",
    "resource_path_ops": """
with p as (select page_id, string_split(regexp_replace(url, '/+$', ''), '/') as e from pages)
select page_id, len(e) as depth, e[-1] as last, case when len(e) > 1 then array_to_string(e[1:-2], '/') end as parent,
       case when e[1] = 'http:' and e[2] = '' then len(e) - 2 else -1 end as below, array_to_string(e, '/') || '/x' as child from p""",
    "path_sanitize": "select page_id, regexp_replace(url, '[^a-zA-Z0-9.-]', '_', 'g') as name, regexp_replace(url, '\\.[^.]*$', '') as stem from pages",
    "node_remap": """
select s_suppkey, case when s_suppkey % 3 = 0 then case when n.n_nationkey is not null then 'snmp/fs/req' || n_regionkey || '/' || n_name || '/eth0' end
       when s_suppkey % 3 = 1 then 'snmp/fs/a/' || s_name else 'response/' || s_name end as path
from supplier left join nation n on n_nationkey = s_nationkey and n_nationkey % 3 <> 0""",
    "catalog_rebuild": f"with {TAGS} select metric_key, {', '.join(f'coalesce({ARRAYS.format(t)}, {chr(39) * 2}) as {t}' for t in ('intrinsic', 'meta', 'external'))} from tags group by metric_key",
    "catalog_explode": f"with {TAGS} select metric_key, tag_type, coalesce(tag_key, '') as tag_key, tag_value from tags",
    "catalog_keys": f"with {TAGS} select metric_key, metric_key as derived, 'events/user/' || user_id as resource_id, event_type as name from ser",
    "catalog_upsert": f"""
with {TAGS}, {INCOMING}, old as (select metric_key, coalesce({ARRAYS.format('meta')}, '') as meta from tags group by metric_key)
select metric_key, coalesce(inc.meta, old.meta) as meta from old left join inc using (metric_key)
union all select inc.metric_key, old.meta from inc join old on inc.metric_key = 'new:' || old.metric_key""",
    "catalog_diff": f"""
with {TAGS}, {INCOMING}
select metric_key, case when metric_key like '%/4' then 'removed' else 'changed' end as change from m where metric_key like '%/4' or u % 3 = 0
union all select metric_key, 'new' from inc where metric_key like 'new:%'""",
    "catalog_prune": f"with {TAGS} select metric_key from ser where user_id in (select user_id from events where ts > timestamp '2024-01-29')",
    "bulk_partition_counts": f"with {EV} select resource_id, strftime(time, '%Y-%m-%d') as p, count(*) as n from ev group by 1, 2",
    "flush_batches": f"""
with {EV}, r as (select resource_id, strftime(time, '%Y-%m-%d') as p, row_number() over (partition by resource_id, strftime(time, '%Y-%m-%d') order by time, name, value) - 1 as i from ev)
select resource_id, p, i // 4 as batch, count(*) as n from r group by 1, 2, 3""",
    "compact_purge": f"with {EV} select {POINT} from ev where name <> 'signup'",
    "compact_candidates": f"select {_label(duration_us('PT6H'), '%Y-%m-%d-%H', 'ts')} as p, count(distinct event_id % 40) as files from events group by 1 having files >= 2",
    "retention_expired": f"{LINE_PARTS} select p, n from parts where {EXPIRED}",
    "retention_kept": f"{LINE_PARTS} select p, n from parts where not ({EXPIRED})",
    "lz4_roundtrip": f"with {EV} select {POINT}, strftime(time, '%Y-%m-%d') as p from ev",
    "compact_merge": f"with {EV} select {POINT} from ev",
    "store_delete_purge": f"with {EV} select name, count(*) as n from ev where not (user_id = 3 and name = 'click') group by 1",
    "store_retention": f"""
with {LI}, parts as (select make_timestamp((epoch_us(time) - epoch_us(time) % 2592000000000)::bigint) as start, count(*) as n from li group by 1)
select strftime(start, '%Y-%m-%d') as p, n from parts where start + interval 30 day > timestamp '2001-01-01' - interval 365 day""",
    "stats": f"""
with {TAGS} select 'catalog_size' as measure, count(*) as value from ser union all select 'partitions', count(distinct ts::date) from events union all select 'samples_written', count(*) from events""",
    "stream_ingest_equals_batch": f"with {EV} select {POINT}, strftime(time, '%Y-%m-%d') as p from ev",
    "rrd_number_parse": """
select event_id, case event_id % 6 when 3 then event_id::double when 4 then 1500.0 end as number,
       case event_id % 6 when 1 then true when 2 then true when 3 then false when 4 then false end as infinite,
       case event_id % 6 when 1 then 9223372036854775807 when 2 then -9223372036854775807 - 1 when 3 then event_id end as whole from events""",
    "rrd_window": f"with {ARCH} select file, pos, k, n, first_ts, last_ts from a",
    "rrd_select": f"with {ARCH} select file, pos, cf, k from sel",
    "rrd_stitch": f"with {ARCH} select file, k, begin_ts, until_ts from b",
    "rrd_gauge": f"with {ARCH} select c.file, c.ts, c.v as value from cell c join win using (file, ts, k) where d = 0 and v is not null",
    "rrd_counter": RRD_COUNTER,
    "rrd_import": RRD_COUNTER.replace("select file, ts, prev as value from walk join win using (file, ts, k) where known", """
select 'snmp/' || file || '/net' as resource_id, 'octets' as name, ts * 1000000 as time_us, prev as value, 'mtype=count' as meta from walk join win using (file, ts, k) where known
union all select 'snmp/' || c.file || '/net', 'load', c.ts * 1000000, c.v, 'mtype=gauge' from cell c join win using (file, ts, k) where d = 0 and v is not null"""),
    "rrd_split": f"with {CELL_SUM} select file, case d when 0 then 'load' else 'octets' end as ds, sum(coalesce(v, 0))::double as total from cell group by file, d",
    "rrd_merge": f"with {CELL_SUM} select file, sum(coalesce(v, 0))::double as total from cell group by file",
}
