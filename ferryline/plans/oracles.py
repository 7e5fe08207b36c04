"""For each registered query, SQL over the same tables that gives the same rows."""

from __future__ import annotations

from ferryline.operators import bundled_specs
from ferryline.operators.flatten import FlatField
from ferryline.plans.queries import looked_up

ORACLES: dict[str, str] = {}

# --- topics ------------------------------------------------------------------------------------------------

_OFFSETS = "(select max(event_id) * 2 // 10 lo, max(event_id) * 6 // 10 hi from events)"
_TIMES = """(select a + (b - a) * 2 // 10 lo, a + (b - a) * 6 // 10 hi
             from (select min((epoch_us(ts) // 1000)) a, max((epoch_us(ts) // 1000)) b from events))"""
_SLICED = """(select cast((event_id * 8) // (select max(event_id) + 1 from events) as int) p, event_id o,
                     (epoch_us(ts) // 1000) t, props from events)"""
_DISORDERED = """(select cast(user_id % 4 as int) p, event_id o,
                         (epoch_us(ts) // 1000) + case when event_id % 97 = 0 then 259200000 else 0 end t from events)"""
_TIME_ROWS = f"""
    with e as (select * from {_DISORDERED}, {_TIMES}),
    s as (select p, min(o) so, arg_min(t, o) st, any_value(lo) lo, any_value(hi) hi from e where t >= lo group by p
          having arg_min(t, o) // 1000 = any_value(lo) // 1000 or arg_min(t, o) <= any_value(hi)),
    x as (select e.p, e.o, e.t, bool_or(e.t > e.hi) over (partition by e.p order by e.o rows unbounded preceding) bad
          from e join s on e.p = s.p and e.o >= s.so)
"""

ORACLES["topic_range_report"] = f"""
select cast(user_id % 4 as int) "partition", count(*) n,
       cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) sum_k,
       min(event_id) first_offset, max(event_id) last_offset, max((epoch_us(ts) // 1000)) last_ts
from events, {_OFFSETS} where event_id between lo and hi group by 1
"""
ORACLES["topic_offset_range"] = f"""
select p "partition", o "offset", props as value, t ts_ms from {_SLICED}, {_OFFSETS} where o between lo and hi
"""
ORACLES["stream_offset_range"] = ORACLES["topic_offset_range"]
ORACLES["topic_offset_resolution"] = f"""
select p "partition", min(o) beginning, greatest(min(o), any_value(lo)) start_offset, any_value(hi) + 1 stop_offset,
       min(o) <= any_value(hi) qualifies
from {_SLICED}, {_OFFSETS} group by p
"""
ORACLES["topic_time_range"] = f"""
{_TIME_ROWS} select p "partition", o "offset", t ts_ms from x where not bad
"""
ORACLES["stream_time_range"] = ORACLES["topic_time_range"]
ORACLES["topic_time_summary"] = f"""
{_TIME_ROWS} select p "partition", count(*) n, min(o) first_off, max(o) last_off from x where not bad group by p
"""
ORACLES["topic_time_resolution"] = f"""
select p "partition", min(o) beginning, cast(min(o) filter (t >= lo) as varchar) start_offset,
       cast(arg_min(t, o) filter (t >= lo) as varchar) start_ms, cast(min(o) filter (t > hi) as varchar) stop_offset,
       coalesce(min(o) filter (t >= lo) is not null
                and (arg_min(t, o) filter (t >= lo) // 1000 = any_value(lo) // 1000
                     or arg_min(t, o) filter (t >= lo) <= any_value(hi)), false) qualifies
from {_SLICED}, {_TIMES} group by p
"""
ORACLES["offset_tracker"] = f"""
select p "partition", coalesce(min(o) filter (o between lo and hi), -1) first_offset,
       coalesce(arg_min(t, o) filter (o between lo and hi), -1) first_ts,
       coalesce(max(o) filter (o between lo and hi), -1) last_offset,
       coalesce(arg_max(t, o) filter (o between lo and hi), -1) last_ts
from {_SLICED}, {_OFFSETS} group by p
"""

# --- codecs ------------------------------------------------------------------------------------------------

ORACLES["codec_long"] = """
select o_orderkey, printf('%016X', o_orderkey) plain,
       case when o_orderkey = 0 then printf('%016X', 0)
            else printf('%016X', 18446744073709551616::hugeint - o_orderkey) end negative,
       -o_orderkey back
from orders
"""
ORACLES["codec_int"] = """
select o_orderkey, printf('%08X', o_custkey) plain,
       case when o_custkey = 0 then '00000000' else printf('%08X', 4294967296 - o_custkey) end negative,
       cast(-o_custkey as int) back
from orders
"""
_DASHED = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
ORACLES["codec_uuid"] = f"""
select o_orderkey, d plain, s swapped, {_DASHED.format('s')} read_as_plain, {_DASHED.format('d')} read_as_swapped
from (select o_orderkey, d, substr(d, 17, 16) || substr(d, 1, 16) s
      from (select o_orderkey, md5(cast(o_orderkey as varchar)) d from orders))
"""
ORACLES["codec_string"] = """
select doc_id, cast(strlen(text) as int) n_bytes, md5(text) digest, 1 same from documents
"""
# Eight characters read as one big-endian number.
_AS_LONG = " + ".join(f"cast(ascii(substr(props, {i + 1}, 1)) as bigint) * {256 ** (7 - i)}" for i in range(8))
ORACLES["codec_bad_length"] = f"""
select event_id "offset", {_AS_LONG} decoded from events where strlen(props) = 8
"""
ORACLES["codec_dead_letters"] = """
select event_id "offset", cast(strlen(props) as int) n_bytes from events where strlen(props) <> 8
"""

# --- flattening --------------------------------------------------------------------------------------------

_HAS_CUSTOMER = "o_orderpriority <> '1-URGENT'"
ORACLES["flatten_struct"] = f"""
select o_orderkey id, o_orderstatus status, o_orderstatus status_again,
       case when {_HAS_CUSTOMER} then o_custkey else -1 end customer,
       case when {_HAS_CUSTOMER} then cast(o_custkey % 7 as int) else 0 end zone,
       case when o_orderstatus = 'F' then 1 else 0 end done
from orders
"""
ORACLES["flatten_defaults_function_only"] = f"""
select o_orderkey id, o_orderstatus status, o_orderstatus status_again,
       case when {_HAS_CUSTOMER} then cast(o_custkey as varchar) end customer,
       case when {_HAS_CUSTOMER} then cast(o_custkey % 7 as varchar) end zone,
       case when o_orderstatus = 'F' then 1 else 0 end done
from orders
"""
ORACLES["flatten_to_json"] = f"""
select o_orderkey as key, '{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","status_again":"' || o_orderstatus
       || '","customer":' || case when {_HAS_CUSTOMER} then cast(o_custkey as varchar) else 'null' end
       || ',"zone":' || case when {_HAS_CUSTOMER} then cast(o_custkey % 7 as varchar) else 'null' end
       || ',"done":' || case when o_orderstatus = 'F' then 1 else 0 end || '}}' flat
from orders
"""
ORACLES["flatten_array"] = """
select doc_id, w[1] first_word, w[13] word_12, cast(len(w) as int) n_words, md5(array_to_string(w, ',')) joined_digest
from (select doc_id, string_split(text, ' ') w from documents)
"""
_K = "cast(json_extract_string(props, '$.k') as bigint)"
ORACLES["flatten_json_path"] = f"""
select event_id, {_K} k, user_id, event_id % 10 as second, cast(null as varchar) past_end,
       cast(null as varchar) below_scalar, {_K} passed_through, cast(null as varchar) missing
from events
"""
ORACLES["flatten_json_spec"] = f"""
select event_id, {_K} k, json_extract_string(props, '$.k') k_text, 'none' as label, cast(0.5 as double) rate from events
"""


def _spec_leaf(field: FlatField) -> str:
    shift = len(field.path)
    if isinstance(field.default, bool):
        return "event_type = 'click'"
    if isinstance(field.default, str):
        return f"'{shift}:' || event_type"
    if isinstance(field.default, float):
        return f"cast(event_id + {shift} as double)"
    return f"case when (event_id + {shift}) % 2 = 0 then event_id + {shift} else 0 end"


def _spec_lookup(field: FlatField) -> str:
    entry, metric = field.selectors.split("=")
    _, names, metrics = looked_up("ad_feedback_flatted_default")
    at, n = names.index(entry), metrics.index(metric) + 1
    return f"case when (event_id + {at}) % 2 = 0 then cast(event_id + {100 * n + at} as double) else 0.0::double end"


def _spec_sql(name: str) -> str:
    columns = []
    for field in bundled_specs.bundled().get(name).fields:
        if field.function == "searchCoecsInArray":
            value = _spec_lookup(field)
        elif field.function:
            value = "event_id || ',' || user_id"
        else:
            value = _spec_leaf(field)
        columns.append(f'{value} as "{field.out}"')
    return f"select event_id, {', '.join(columns)} from events"


ORACLES["flatten_video_ad_spec"] = _spec_sql("video_ad_flatted")
ORACLES["flatten_ad_feedback_spec"] = _spec_sql("ad_feedback_flatted_default")
ORACLES["array_lookup"] = """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax tax, l_tax * 2 tax_expected, l_discount discount,
       cast(0.0 as double) surcharge
from lineitem
"""

# --- scalar functions --------------------------------------------------------------------------------------

_MAYBE_TAX = "case when l_returnflag <> 'N' then l_tax else 0.0::double end"
ORACLES["sum_float"] = f"""
select l_orderkey, l_linenumber, l_partkey, cast(0.0::double + l_quantity + l_discount + {_MAYBE_TAX} as float) total
from lineitem
"""
ORACLES["multiply_float"] = f"""
select l_orderkey, l_linenumber, l_partkey, cast(1.0::double * l_quantity * l_extendedprice as float) amount,
       cast(1.0::double * l_quantity * {_MAYBE_TAX} as float) with_null
from lineitem
"""
ORACLES["bool_to_int"] = """
select event_id, case when event_type <> 'view' and value > 10 then 1 else 0 end flag from events
"""
ORACLES["hour_of_day"] = "select event_id, cast(hour(ts) as int) as hour from events"
ORACLES["micros_timestamp"] = """
select event_id, epoch_us(ts) micros, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') utc from events
"""
ORACLES["same_second"] = """
select event_id, case when (epoch_us(ts) // 1000) // 1000 = ((epoch_us(ts) // 1000) + 300) // 1000 then 1 else 0 end near,
       case when (epoch_us(ts) // 1000) // 1000 = ((epoch_us(ts) // 1000) - 999) // 1000 then 1 else 0 end as before
from events
"""
ORACLES["url_query"] = """
with q as (select page_id, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) own from pages),
f as (select page_id, own, nullif(regexp_extract('&' || own, '&page=([^&]*)', 1), '') page,
             nullif(regexp_extract('&' || own, '&ref=([^&]*)', 1), '') ref,
             nullif(regexp_extract('&' || own, '&utm_source=([^&]*)', 1), '') utm_source from q)
select page_id,
       5 + (case when page is not null then 1 else 0 end) + (case when ref is not null then 1 else 0 end)
         + (case when utm_source is not null then 1 else 0 end) n,
       cast(page_id + 1 as varchar) id, page, ref, utm_source, 'a b&c' escaped, cast(null as varchar) empty_value,
       1 has_empty, 1 has_bare, 1 has_lead, 0 has_fragment
from f
"""
ORACLES["strip_slashes"] = """
select page_id, ltrim('/' || regexp_replace(url, '^https?:/', '') || '//', '/') no_lead,
       rtrim('//' || regexp_replace(url, '^https?:/', '') || '//', '/') no_end
from pages
"""
ORACLES["join_nullable"] = """
select p_partkey, concat_ws('-', p_name, case when p_size > 25 then p_brand end, p_type) joined,
       case when p_size % 2 = 0 then concat_ws('-', p_name, case when p_size > 25 then p_brand end, p_type)
            else 'null' end joined_or_null
from part
"""
ORACLES["is_blank"] = """
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
           from documents),
p as (select doc_id, line, case when pos % 5 = 1 then ' ' when pos % 5 <> 2 then line end padded from l)
select doc_id, cast(count(*) as int) as lines,
       cast(count(*) filter (padded is null or regexp_full_match(padded, '\\s*')) as int) blank,
       cast(count(*) filter (not regexp_full_match(line, '\\s*')) as int) written
from p group by doc_id
"""
ORACLES["size_parse"] = """
with u as (select p_partkey, p_size, ['B', 'kB', 'MiB', 'gb', 'Tib', 'KIB', '', 'Wb'][p_partkey % 8 + 1] unit from part)
select p_partkey, chr(9) || p_size || case when p_partkey % 3 = 0 then '  ' else '' end || unit || ' ' as text,
       cast(case unit when 'B' then cast(p_size as bigint) when 'kB' then p_size * 1024::bigint
                      when 'MiB' then p_size * 1048576::bigint when 'gb' then p_size * 1073741824::bigint
                      when 'Tib' then p_size * 1099511627776::bigint end as varchar) bytes
from u
"""
ORACLES["size_format"] = """
select doc_id, s // 1024 kb, s // 1048576 mb, s || 'B' b_text, (s // 1048576) || 'MB' mb_text
from (select doc_id, cast(strlen(text) as bigint) * 1000 s from documents)
"""
ORACLES["duration_parse"] = """
with u as (select p_partkey, p_size, ['d', 'days', 'hours', 'min', 'm', 'sec', 'ms', 'millisec', 'micros', 'us', 'nanos',
                                      'Days', 'fortnight'][p_partkey % 13 + 1] unit from part)
select p_partkey, p_size || case when p_partkey % 2 = 0 then ' ' else '' end || unit as text,
       cast(p_size * case unit when 'd' then 86400000000000 when 'days' then 86400000000000 when 'hours' then 3600000000000
                     when 'min' then 60000000000 when 'm' then 60000000000 when 'sec' then 1000000000
                     when 'ms' then 1000000 when 'millisec' then 1000000 when 'micros' then 1000 when 'us' then 1000
                     when 'nanos' then 1::bigint end as varchar) nanos
from u
"""

# --- feature lines -----------------------------------------------------------------------------------------

_ZONE = f"case when {_HAS_CUSTOMER} then o_custkey % 7 else 0 end"
_CUST = f"case when {_HAS_CUSTOMER} then o_custkey else 0 end"
_DONE = "case when o_orderstatus = 'F' then 1 else 0 end"
ORACLES["feature_lines"] = f"""
select o_orderkey as key,
       {_DONE} || '|a s' || o_orderstatus || ':1.0 zone:' || {_ZONE} || '|b cust:' || {_CUST} || ' id=' || o_orderkey
         || '|a o' || o_orderkey || ':1.0' line,
       {_DONE} || ' |a s' || o_orderstatus || ':1.0 zone:' || {_ZONE} || ' |b cust:' || {_CUST} || ' id=' || o_orderkey
         || ' |a o' || o_orderkey || ':1.0' spaced
from orders
"""
ORACLES["feature_lines_json"] = f"""
select event_id, '|p k' || {_K} || ':1.0 total:' || 2 * {_K} line from events
"""

# --- protobuf ----------------------------------------------------------------------------------------------

_REQUEST = "case when event_id % 3 = 0 then '' else props end"
ORACLES["proto_roundtrip"] = f"""
select event_id, (epoch_us(ts) // 1000) as timestamp, event_id % 5 "randomId", event_type "impressionId", {_REQUEST} "requestId",
       event_id "abTestId", user_id % 4 "zoneId", user_id "userId", case when event_type = 'click' then 1 else 0 end clicked
from events
"""
ORACLES["proto_to_json"] = f"""
select event_id, cast((epoch_us(ts) // 1000) as varchar) as timestamp, cast(nullif(event_id % 5, 0) as varchar) "randomId",
       event_type "impressionId", nullif({_REQUEST}, '') "requestId", cast(nullif(event_id, 0) as varchar) "abTestId",
       cast(nullif(user_id % 4, 0) as varchar) "zoneId", cast(nullif(user_id, 0) as varchar) "userId",
       case when event_type = 'click' then 'true' end clicked
from events
"""
ORACLES["proto_flat_json"] = f"""
select event_id, cast((epoch_us(ts) // 1000) as varchar) flat_timestamp, cast(event_id % 5 as varchar) "flat_randomId",
       event_type "flat_impressionId", {_REQUEST} "flat_requestId", cast(event_id as varchar) "flat_abTestId",
       cast(user_id % 4 as varchar) "flat_zoneId", cast(user_id as varchar) "flat_userId",
       case when event_type = 'click' then 'true' else 'false' end flat_clicked
from events
"""
ORACLES["json_to_proto"] = """
select o_orderkey, o_orderpriority as name, cast(o_orderkey % 10 as int) humidity,
       case when o_orderstatus = 'F' then 'OPEN' else 'CLOSED' end door, cast(o_custkey as int) x, cast(-o_custkey as int) y,
       1 no_event
from orders
"""
ORACLES["convert_with_trailer"] = """
select event_id, upper(props) as value from events
union all
select max(event_id), event_type from events group by event_type
"""

# --- splits and segments -----------------------------------------------------------------------------------

ORACLES["even_split"] = """
select o_orderkey, cast(((row_number() over (order by o_orderkey) - 1) * 7) // count(*) over () as int) split from orders
"""
ORACLES["even_split_listing"] = """
select split, count(*) n, min(url) as first, max(url) as last
from (select url, cast(((row_number() over (order by url) - 1) * 6) // count(*) over () as int) split from pages)
group by split
"""
ORACLES["first_orders"] = """
select o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by 3, 1 limit 100
"""
ORACLES["segment_count"] = """
select worker, segment_id, count(*) n, min(l_orderkey) first_key, max(l_orderkey) last_key
from (select l_suppkey % 4 worker, l_orderkey,
             (row_number() over (partition by l_suppkey % 4 order by l_orderkey, l_linenumber) - 1) // 500 segment_id
      from lineitem)
group by 1, 2
"""
_WORKER = "cast(case when doc_id % 10 < 4 then 0 else doc_id % 10 - 4 end as int)"


def _segments(full: str) -> str:
    return f"""
with recursive t as (select {_WORKER} worker, row_number() over (partition by {_WORKER} order by doc_id) rn, strlen(text) len
                     from documents),
r as (select worker, rn, 0::bigint seg, 2 + len sz, 1 n, len from t where rn = 1
      union all
      select t.worker, t.rn, case when {full} then r.seg + 1 else r.seg end,
             case when {full} then 2 + t.len else r.sz + 2 + t.len end,
             case when {full} then 1 else r.n + 1 end, t.len
      from r join t on t.worker = r.worker and t.rn = r.rn + 1)
select worker, seg segment_id, count(*) n, cast(sum(len) as bigint) as bytes from r group by 1, 2
"""


ORACLES["segment_size"] = _segments("r.sz >= 20000")
ORACLES["segment_size_over_chunks"] = _segments("r.sz >= 60000")
ORACLES["segment_size_or_count"] = _segments("r.sz >= 20000 or r.n >= 12")
ORACLES["segment_unlimited"] = f"""
select {_WORKER} worker, 0::bigint segment_id, count(*) n, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1
"""
ORACLES["file_names"] = """
select count(*) n, printf('job-1/sink/%d/job-1-%d-%d.json', worker, worker, seg) path,
       printf('job-1-%d-%d', worker, seg) object_key
from (select o_custkey % 3 worker, (row_number() over (partition by o_custkey % 3 order by o_orderkey) - 1) // 400 seg
      from orders)
group by worker, seg
"""

# --- file sinks and sources --------------------------------------------------------------------------------

ORACLES["json_array_roundtrip"] = "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders"
ORACLES["json_array_lines_roundtrip"] = ORACLES["json_array_roundtrip"]
ORACLES["parquet_roundtrip"] = ORACLES["json_array_roundtrip"]
ORACLES["parquet_segments"] = """
select o_orderkey, o_orderstatus,
       printf('orders-%d-%d.parquet', o_custkey % 3,
              (row_number() over (partition by o_custkey % 3 order by o_orderkey) - 1) // 700) as file
from orders
"""
ORACLES["object_bytes_roundtrip"] = "select page_id, cast(strlen(html) as int) n_bytes, md5(html) digest from pages"
ORACLES["listed_bytes_roundtrip"] = """
    select case page_id % 3 when 0 then '_' when 1 then '.' else '' end || page_id || '.html' as name,
      cast(strlen(body) as bigint) size, cast(strlen(body) as int) n_bytes, md5(body) digest, page_id % 4 = 0 as at_root
    from (select page_id, case when page_id % 5 = 0 then '' else html end body from pages)"""
ORACLES["file_scan"] = "select o_orderkey, o_custkey, o_orderstatus from orders"
_LISTING = """(select url as key, regexp_extract(url, '[^/]*$') as name, page_id * 1000 modified_ms,
                      cast(strlen(html) as bigint) size from pages),
              (select max(page_id) * 1000 // 10 lo, max(page_id) * 1000 * 9 // 10 hi from pages)"""
ORACLES["listing_objects"] = " union all ".join(
    f"select key, name, modified_ms, size from {_LISTING} where modified_ms between lo and hi and starts_with(key, '{p}')"
    for p in ("https://", "https://blog.", "http://www")
)
ORACLES["listing_objects_once"] = f"""
select key, name, modified_ms, size from {_LISTING}
where modified_ms between lo and hi
  and (starts_with(key, 'https://') or starts_with(key, 'https://blog.') or starts_with(key, 'http://www'))
"""
ORACLES["listing_files"] = f"""
select key, name, modified_ms, size from {_LISTING}
where modified_ms between lo and hi and (starts_with(name, '1') or starts_with(name, '2') or starts_with(name, '45'))
"""

# --- topic sink and jobs -----------------------------------------------------------------------------------

ORACLES["topic_round_robin"] = """
select [2, 0, 1][((rn // 40) % 3) + 1] "partition", props as value, count(*) n, min(cast(t as varchar)) first_ts, 1 no_key
from (select props, (epoch_us(ts) // 1000) t, row_number() over (partition by user_id % 4 order by event_id) - 1 rn from events)
group by 1, 2
"""
ORACLES["job_topic_to_files"] = f"""
select props as value, count(*) n from events, {_OFFSETS} where event_id between lo and hi group by 1
"""
ORACLES["job_proto_topic_to_topic"] = f"""
select nullif(event_id, 0) event_id, cast((epoch_us(ts) // 1000) as varchar) as timestamp, cast((epoch_us(ts) // 1000) as varchar) ts_ms
from (select e.*, min(event_id) filter ((epoch_us(ts) // 1000) >= lo) over w so, min(event_id) filter ((epoch_us(ts) // 1000) > hi) over w sx
      from events e, {_TIMES} window w as (partition by user_id % 4))
where event_id >= so and (sx is null or event_id < sx)
"""

# --- run audit ---------------------------------------------------------------------------------------------

_JOB_EVENTS = """(select 'job-' || user_id job_id, event_id event_time,
    case when event_type = 'click' then event_id % 8 + 1 end parallelism,
    case when event_type = 'error' then props end error,
    case when event_type = 'view' then 'KAFKA' when event_type = 'click' then 'S3' end source_type,
    case when event_type = 'purchase' then (epoch_us(ts) // 1000) end finish_time from events)"""
_CURRENT = f"""select job_id, arg_max(parallelism, event_time) filter (parallelism is not null) parallelism,
       arg_max(error, event_time) filter (error is not null) error,
       arg_max(source_type, event_time) filter (source_type is not null) source_type,
       arg_max(finish_time, event_time) filter (finish_time is not null) finish_time, max(event_time) event_time
from {_JOB_EVENTS} group by job_id"""
_SHOWN = "cast(c.parallelism as varchar) parallelism, c.error, c.source_type, cast(c.finish_time as varchar) finish_time"
ORACLES["audit_current"] = f"select c.job_id, {_SHOWN}, c.event_time from ({_CURRENT}) c"
_COUNTERS = """(select 'job-' || user_id job_id, case when event_type = 'view' then 1 else 0 end side,
    '_read_records_' || (event_id % 4) as name, user_id * 10 + case when event_type = 'view' then 1 else 0 end counter_val
    from events)"""
ORACLES["audit_lookup"] = f"""
select c.job_id, {_SHOWN}, m.kind, m.name, m.state, cast(m.counter_val as varchar) counter_val
from ({_CURRENT}) c
left join (select distinct 'job-' || user_id job_id, 'worker_event' kind,
                  case when event_id % 2 = 0 then 'source' else 'sink' end || '-' || (event_id % 3) as name,
                  upper(event_type) state, cast(null as bigint) counter_val from events
           union
           select job_id, 'counter', name, null, counter_val from {_COUNTERS}) m on m.job_id = c.job_id
where c.job_id = 'job-7'
"""
ORACLES["merge_counters"] = f"""
select job_id, name, arg_max(counter_val, side) counter_val from {_COUNTERS} group by job_id, name
"""
ORACLES["counters_by_worker"] = f"""
select worker, count(*) counter_val, worker || '_read_records' as name
from (select cast(user_id % 4 % 2 as int) worker from events) group by worker
"""
ORACLES["counters_by_partition"] = """
select '_read_records_' || (user_id % 4) as name, count(*) counter_val from events group by 1
"""
ORACLES["capacity_rollup"] = """
select cast(sum(o_custkey % 2) as bigint) executing, cast(sum(o_custkey % 3) as bigint) execution_capacity,
       cast(sum(o_custkey % 4) as bigint) available_execution_slots, cast(sum(o_custkey % 5) as bigint) waiting,
       cast(sum(o_custkey % 6) as bigint) waiting_queue_size, cast(sum(o_custkey % 7) as bigint) available_queue_slots
from orders
"""
_INSTANCES = """(select o_orderkey as instance,
    list_append(string_split(regexp_replace(o_orderpriority, '[0-9]-', ''), ' '), cast(o_custkey as varchar)) jobs from orders)"""
ORACLES["running_jobs"] = f"select instance, unnest(jobs) job_id from {_INSTANCES}"
ORACLES["holder_of_job"] = f"select instance from {_INSTANCES} where list_contains(jobs, '77')"
ORACLES["merge_latest"] = """
select o_custkey, max(o_orderkey) o_orderkey, arg_max(o_orderstatus, o_orderkey) o_orderstatus,
       arg_max(o_orderpriority, o_orderkey) o_orderpriority
from orders group by o_custkey
"""

# --- streaming ---------------------------------------------------------------------------------------------

ORACLES["stream_to_json_arrays"] = "select props as value, count(*) n from events group by 1"
ORACLES["stream_job"] = f"""
select cast(epoch_us(ts) // 1000 as varchar) as timestamp, cast(nullif(event_id, 0) as varchar) "abTestId",
       case when event_type = 'click' then 'true' end clicked
from events, {_OFFSETS} where event_id between lo and hi
"""
