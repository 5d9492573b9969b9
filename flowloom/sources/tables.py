"""Packets and frames derived from plain tables (the test inputs of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The projections of FIXTURES.md as SQL select lists.
EVENT_PACKETS_SQL = """
with e as (select event_id, user_id, event_type, value,
    1704067200000000 + (unix_micros(cast(ts as timestamp)) - 1704067200000000) div 2000 as ts_us,
    case when user_id % 2 = 0 then user_id % 8 else user_id end as dst_id from {events})
select event_id as frame_no, ts_us,
  cast(167772160 + (user_id * 7919 + event_id) % 65536 as bigint) as src_ip_int,
  cast(3232235776 + dst_id as bigint) as dst_ip_int,
  cast(1024 + event_id % 50000 as int) as src_port,
  cast(case when dst_id % 3 = 0 then 53 else 443 end as int) as dst_port,
  cast(case when dst_id % 5 = 0 then 17 else 6 end as int) as protocol,
  cast(case when dst_id % 5 = 0 then 28 when event_type = 'signup' then 60 else 40 end as int) as header_len,
  cast(case when event_type in ('signup', 'error') and dst_id % 5 <> 0 then 0 else floor(value * 3) end as int) as payload_len,
  cast(case when dst_id % 5 = 0 then 0 else
    case event_type when 'signup' then 2 when 'error' then 20 when 'click' then 24 when 'view' then 16 else 17 end
    + case when event_id % 11 = 0 then 32 else 0 end + case when event_id % 13 = 0 then 192 else 0 end end as int) as tcp_flags,
  (event_id * 7 + user_id) % 3 <> 0 as is_fwd
from e
"""

LINEITEM_PACKETS_SQL = """
select (l_orderkey * 8 + l_linenumber) * 33554432
    + (l_partkey * 1024 + l_suppkey + cast(round(l_extendedprice * 100) as bigint) * 7) % 33554432 as frame_no,
  1704067200000000 + (l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000 as ts_us,
  cast(167772160 + l_partkey as bigint) as src_ip_int,
  cast(3232235776 + l_suppkey % 16 as bigint) as dst_ip_int,
  cast(1024 + l_partkey % 50000 as int) as src_port,
  cast(case when l_suppkey % 2 = 0 then 443 else 80 end as int) as dst_port,
  6 as protocol, 40 as header_len,
  cast(l_quantity * 10 as int) as payload_len,
  case when l_returnflag = 'R' then 2 else 16 end as tcp_flags,
  l_linenumber % 2 = 1 as is_fwd
from {lineitem}
"""

FRAME_BYTES_SQL = """
select frame_no, ts_us, cast(case frame_no % 4 when 0 then 1 when 1 then 12 when 2 then 113 else 0 end as int) as linktype,
  unhex(concat(
    case frame_no % 4 when 0 then concat('020000000001020000000002', case when frame_no % 8 = 0 then '8100000A' else '' end, '0800')
      when 1 then '' when 2 then '00000001000602000000000100000800' else '02000000' end,
    '4500', lpad(hex(header_len + payload_len), 4, '0'), '0000000040', lpad(hex(protocol), 2, '0'), '0000',
    lpad(hex(src_ip_int), 8, '0'), lpad(hex(dst_ip_int), 8, '0'), lpad(hex(src_port), 4, '0'), lpad(hex(dst_port), 4, '0'),
    case when protocol = 17 then concat(lpad(hex(8 + payload_len), 4, '0'), '0000')
      else concat('0000000000000000', case when header_len = 60 then 'A0' else '50' end, lpad(hex(tcp_flags), 2, '0'),
                  '200000000000', case when header_len = 60 then repeat('00', 20) else '' end) end)) as raw
from {packets}
"""


def packets_from_table(table: DataFrame, projection_sql: str, name: str) -> DataFrame:
    """Run a packet projection over any DataFrame; ``name`` is its placeholder in the SQL."""
    return table.sparkSession.sql(projection_sql, **{name: table})


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENT_PACKETS_SQL, "events")


def packets_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), LINEITEM_PACKETS_SQL, "lineitem")


def frames_from_packets(packets: DataFrame) -> DataFrame:
    """Header-only frames whose bytes encode the given packets, over four link types."""
    frames = packets_from_table(packets, FRAME_BYTES_SQL, "packets")
    return frames.withColumn("caplen", F.length("raw")).select("frame_no", "ts_us", "linktype", "caplen", "raw")
