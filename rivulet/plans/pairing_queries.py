"""Queries of joins between streams, and of streaming counterparts run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import pairing, windows
from rivulet.operators.packets import captions, event_packets, events
from rivulet.plans.common import DAY, T0, Registry
from rivulet.streaming import operators as streaming

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
_KINDS = ("click", "view", "error")


@query("j1_align_tiles", "with t as (select user_id as pid, epoch_us(ts) // 1000 // 3600000 as hour, event_type, max(value) as v from events group by all) select b.pid, b.hour, c.v as click, v.v as view from (select pid, hour from t where event_type = 'signup') b left join t c on c.pid = b.pid and c.hour = b.hour and c.event_type = 'click' left join t v on v.pid = b.pid and v.hour = b.hour and v.event_type = 'view'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).groupBy("pid", F.floor(F.col("cts") / 3_600_000).alias("hour"), "event_type").agg(F.max("value").alias("v"))
    part = lambda kind: t.where(F.col("event_type") == kind)
    return pairing.align_on_time(part("signup").select("pid", "hour"), {"click": part("click"), "view": part("view")}, ["pid", "hour"], "v")


@query("j2_gather_layers", f"select user_id as pid, epoch_us(ts) // 1000 // {DAY} as day, string_agg(distinct event_type, '>' order by event_type) as layers from events group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).select("pid", F.floor(F.col("cts") / DAY).alias("day"), "event_type").distinct()
    return pairing.gather_layers(t, ["pid", "day"], "event_type", "event_type").withColumn("layers", F.concat_ws(">", "layers"))


@query("j3_as_of_forward", "with {P}, f as (select * from p where event_type = 'view'), c as (select * from p where event_type = 'click') select c.event_id as id, arg_min(f.event_id, (f.cts, f.event_id)) as matched from c left join f on f.pid = c.pid and f.cts >= c.cts group by c.event_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("pid", F.col("event_id").alias("id"), F.col("cts").alias("ts"))
    right = e.where("event_type = 'view'").select("pid", F.col("cts").alias("ts"), "event_id")
    return pairing.as_of(left, right, "event_id", forward=True).select("id", "matched")


@query("j3_as_of_backward", f"with {{P}}, f as (select * from p where event_type = 'view'), c as (select * from p where event_type = 'click') select c.event_id as id, case when c.cts - max(f.cts) <= {DAY} then arg_max(f.event_id, (f.cts, f.event_id)) end as matched from c left join f on f.pid = c.pid and f.cts <= c.cts group by c.event_id, c.cts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("pid", F.col("event_id").alias("id"), F.col("cts").alias("ts"))
    right = e.where("event_type = 'view'").select("pid", F.col("cts").alias("ts"), "event_id")
    return pairing.as_of(left, right, "event_id", tolerance=DAY).select("id", "matched")


_ATTACHED = f"""with recursive {{P}},
c as (select pid, cts, props as text, row_number() over (partition by pid order by cts, props) as k from p where event_type = 'click'),
f as (select pid, event_id as id, cts as ts, row_number() over (partition by pid order by cts, event_id) as n from p where event_type = 'view'),
a as (select f.pid, f.id, f.ts, f.n, count(c.k) as arrived from f left join c on c.pid = f.pid and c.cts <= f.ts group by all),
r as (select pid, id, ts, n, least(arrived, 1) as taken, case when arrived > 0 then ts end as since, arrived > 0 as shown from a where n = 1
  union all select a.pid, a.id, a.ts, a.n, least(a.arrived, r.taken + 1), case when a.arrived > r.taken then a.ts else r.since end,
    a.arrived > r.taken or r.shown and a.ts - r.since <= {DAY} from r join a on a.pid = r.pid and a.n = r.n + 1)
select r.pid, r.id, r.ts, case when shown then c.text end as text from r left join c on c.pid = r.pid and c.k = r.taken"""


@query("j3_attach_captions", _ATTACHED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    frames = e.where("event_type = 'view'").select("pid", F.col("event_id").alias("id"), F.col("cts").alias("ts"))
    return pairing.attach_captions(frames, e.where("event_type = 'click'").select("pid", F.col("cts").alias("ts"), F.col("props").alias("text")), DAY)


@query("j4_clear_events", "with c as (select conv_id as pid, turn * 2000 as s, turn * 2000 + case when turn % 2 = 0 then 2000 else 1000 end as e, text from conversations) select pid, s as ts, text from c union all select distinct pid, e as ts, '' as text from c where not exists (select 1 from c d where d.pid = c.pid and d.s = c.e)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captions(spark, sf_dir).withColumn("end", F.col("start") + F.when(F.col("seq") % 2 == 0, 2000).otherwise(1000))
    return pairing.clear_events(c)


@query("j5_sample_at", "with {P}, q as (select pid, event_id as id, cts + 5000 as ts from p where event_type = 'error') select q.id, case when q.ts <= (select max(cts) from p x where x.pid = q.pid) then max(p.seq) end as sample from q left join p on p.pid = q.pid and p.cts <= q.ts group by q.id, q.ts, q.pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_packets(spark, sf_dir)
    times = p.where("event_type = 'error'").select("pid", F.col("event_id").alias("id"), (F.col("cts") + 5000).alias("ts"))
    return pairing.sample_at(times, p.select("pid", F.col("cts").alias("ts"), F.col("seq").alias("number"))).select("id", "sample")


@query("j6_sync_neighbours", "with {P} select event_id, coalesce(last_value(case when sap > 0 then seq end ignore nulls) over (partition by pid order by seq rows between unbounded preceding and current row), seq) as prev_sync, coalesce(first_value(case when sap > 0 then seq end ignore nulls) over (partition by pid order by seq rows between current row and unbounded following), seq) as next_sync from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.sync_neighbours(event_packets(spark, sf_dir), windows.ORDER).select("event_id", "prev_sync", "next_sync")


@query("w7_round_starts", "with {P}, s as (select distinct pid, cts + 60000 as start from p where event_type = 'error'), y as (select pid, cts from p where sap > 0), m as (select s.pid, s.start, max(cts) filter (cts <= s.start) as b, min(cts) filter (cts >= s.start) as a from s left join y on y.pid = s.pid group by all) select pid, start, b as before, a as after, case when a is null or start - b <= a - start then coalesce(b, a) else a end as closest from m")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return windows.round_starts(e, e.where("event_type = 'error'").select("pid", (F.col("cts") + 60_000).alias("start")).distinct())


@query("j7_on_segments", f"with e as (select user_id as pid, event_id as id, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 1 + cast(floor(value * 1000000) as bigint) as e from events), g as (select *, unnest(generate_series((s - {T0}) // {DAY}, (e - 1 - {T0}) // {DAY})) as seg from e) select pid, id, seg, greatest(s, {T0} + seg * {DAY}) as start, least(e, {T0} + seg * {DAY} + {DAY}) as \"end\" from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("pid", F.col("event_id").alias("id"), F.col("cts").alias("start"), (F.col("cts") + 1 + F.floor(F.col("value") * 1_000_000)).alias("end"))
    return pairing.on_segments(e, DAY, T0)


@query("j7_fill_gaps", f"with e as (select user_id as pid, event_id as id, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 1 + cast(floor(value * 1000000) as bigint) as e from events), r as (select *, max(e) over (partition by pid order by s, e, id rows between unbounded preceding and 1 preceding) as r from e), g as (select pid, coalesce(r, {T0}) as s, s as e from r union all select pid, max(e), {T0 + 40 * DAY} from e group by pid) select pid, s as start, e as \"end\", id from e union all select pid, s, e, null from g where s < e")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("pid", F.col("event_id").alias("id"), F.col("cts").alias("start"), (F.col("cts") + 1 + F.floor(F.col("value") * 1_000_000)).alias("end"))
    return pairing.fill_gaps(e, T0, T0 + 40 * DAY, DAY)


@query("j8_through_edits", f"with d(number, a, b, m, r) as (values (0, 0, {5 * DAY}, -1, 1), (1, {5 * DAY}, {15 * DAY}, 1000, 1), (2, {15 * DAY}, {20 * DAY}, 777, 0)), {{P}}, t as (select event_id, cts - {T0} as ts from p) select event_id as id, case when m >= 0 then m + case when r = 0 then 0 else ts - a end end as media_ts from t left join d on ts >= a and ts < b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    times = e.select("pid", F.col("event_id").alias("id"), (F.col("cts") - T0).alias("ts"))
    edit = lambda number, duration, media, rate: F.struct(F.lit(number).alias("number"), F.lit(duration).cast("long").alias("duration"), F.lit(media).cast("long").alias("media"), F.lit(rate).alias("rate"))
    edits = e.select("pid").distinct().select("pid", F.explode(F.array(edit(0, 5 * DAY, -1, 1), edit(1, 10 * DAY, 1000, 1), edit(2, 5 * DAY, 777, 0))).alias("e")).select("pid", "e.*")
    return pairing.through_edits(times, edits).select("id", "media_ts")


@query("j10_semi_anti", "select event_id from events e where exists (select 1 from orders o where o.o_custkey = e.user_id) and not exists (select 1 from supplier s where s.s_suppkey = e.user_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("pid"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("pid"))
    return e.join(orders, "pid", "left_semi").join(suppliers, "pid", "left_anti").select("event_id")


@query("j11_utc", "with {P}, n as (select *, case when sap = 1 then cts + 5000 end as ntp_ms, case when sap = 2 then cts + 3000 end as utc from p) select event_id, coalesce(ntp_ms, utc, last_value(coalesce(ntp_ms, utc) - cts ignore nulls) over (partition by pid order by cts, event_id rows between unbounded preceding and current row) + cts) as mapped from n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ntp_ms", F.when(F.col("sap") == 1, F.col("cts") + 5000)).withColumn("utc", F.when(F.col("sap") == 2, F.col("cts") + 3000))
    return pairing.utc_of(e, windows.ORDER).select("event_id", "mapped")


@query("j12_lookup", "select c.c_custkey, n.n_name, r.r_name from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("j13_remap_streams", "with a as (select p_brand as t, p_partkey as pid, row_number() over (partition by p_brand order by p_partkey) as r from part where p_size < 20), b as (select p_brand as t, p_partkey as pid, row_number() over (partition by p_brand order by p_partkey) as r from part where p_size >= 20) select a.t as stream_type, a.pid, b.pid as out_pid from a left join b on a.t = b.t and a.r = b.r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("stream_type"), F.col("p_partkey").alias("pid"), "p_size")
    return pairing.remap_streams(p.where("p_size < 20"), p.where("p_size >= 20"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streaming.read(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("pid"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.length("props").cast("long").alias("size"), "event_type")


_SEGMENTS = """select user_id as pid, (epoch_us(ts) - 600000000) // 86400000000 * 86400000 + 600000 as start_ms, count(*) as packets,
  cast(sum(length(props)) as bigint) as bytes from events group by all"""


@query("t5_stream_segments", _SEGMENTS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.flushed(streaming.segments(_stream(spark, sf_dir), "1 day", "10 minutes"), "segments")
    return out.select("pid", F.unix_millis("start").alias("start_ms"), "packets", "bytes")


_SESSIONS = """with e as (select user_id as pid, event_id, epoch_us(ts) as t from events),
g as (select *, case when t - lag(t) over (partition by pid order by t, event_id) < 21600000000 then 0 else 1 end as new from e),
n as (select *, sum(new) over (partition by pid order by t, event_id) as s from g)
select pid, min(t) // 1000 as start_ms, (max(t) + 21600000000) // 1000 as end_ms, count(*) as packets from n group by pid, s"""


@query("t6_stream_sessions", _SESSIONS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.flushed(streaming.sessions(_stream(spark, sf_dir), "6 hours"), "sessions")
    return out.select("pid", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "packets")


@query("t10_stream_repeats", "select min(event_id) as event_id, event_type, user_id as pid from events group by event_type, user_id, ts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet arrives twice; the first arrival stays."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = streaming.drain(streaming.without_repeats(twice, ["event_id"], "40 days"), "repeats")
    return out.select("event_id", "event_type", "pid")


_JOINED = """with c as (select user_id as pid, event_id, ts from events where event_type = 'click'),
v as (select user_id as pid, event_id, ts from events where event_type = 'view')
select c.event_id, v.event_id as other from c left join v on c.pid = v.pid and v.ts >= c.ts and v.ts <= c.ts + interval 6 hour"""


@query("t4_stream_join", _JOINED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the views of six hours after; those without one come out alone, also at the end of input."""
    s = _stream(spark, sf_dir)
    left = s.where("event_type = 'click'").select("pid", "ts", "event_id")
    right = s.where("event_type = 'view'").select(F.col("pid").alias("r_pid"), F.col("ts").alias("r_ts"), F.col("event_id").alias("other"))
    return streaming.drain_join(left, right, "40 days", "6 hours", "joined").select("event_id", "other")


_REORDERED = """with n as (select event_id % 16 as pid, event_id, xor(event_id // 16, 1) as place from events) select pid, place % 65536 as seq, place from n"""


@query("t3_stream_reorder", _REORDERED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen streams in which every two neighbours arrive swapped; what waits at the end of input is given out."""
    seq = F.expr("(event_id div 16) ^ 1") % 65536
    s = _stream(spark, sf_dir).select((F.col("event_id") % 16).alias("pid"), seq.alias("seq"), "ts", "event_id")
    return streaming.drain_reordered(s, 100, "reordered", arrival=F.col("event_id")).select("pid", "seq", "place")


_DELAYED = """select event_id % 16 as pid, (event_id // 16) % 65536 as seq, event_id // 16 as place from events where event_id // 16 % 10 <> 3"""


@query("t3_reorder_by_delay", _DELAYED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that lack every tenth packet: what follows a gap is given out once it is a day old."""
    s = _stream(spark, sf_dir).where("event_id div 16 % 10 <> 3")
    s = s.select((F.col("event_id") % 16).alias("pid"), (F.expr("event_id div 16") % 65536).alias("seq"), "ts", "event_id")
    return streaming.drain_reordered(s, 1 << 30, "delayed", DAY, F.col("event_id")).select("pid", "seq", "place")
