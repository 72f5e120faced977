"""Queries of filters, aggregates and sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import props
from rivulet.operators import aggregates, concat, container, select, windows
from rivulet.operators.packets import captions, event_packets, events, order_packets
from rivulet.operators.scan import scan
from rivulet.plans.common import DAY, T0, Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
KEY = ["pid", "event_id", "cts"]
GAP = 1_800_000
_SEGMENTED = "s as (select *, sum(cut) over (partition by pid order by cts, event_id) as segment from (select *, case when lag(cts) over w <> 0 and (cts < lag(cts) over w or cts > lag(cts) over w + {gap}) then 1 else 0 end as cut from {of} window w as (partition by pid order by cts, event_id)))"
_COUNTERS = "count(*) as packets, cast(sum(size) as bigint) as bytes, min(cts) as first_cts, max(cts + dur) as end_cts, round(count(*) * 1000.0 / nullif(max(cts + dur) - min(cts), 0), 4) as packet_rate, round(cast(sum(size) as bigint) * 8000.0 / nullif(max(cts + dur) - min(cts), 0), 4) as bit_rate"


@query("flagship_segment_rates", "with {P}, f as (select * from p where sap in (1, 2) and cts >= %d and cts + dur <= %d), %s select pid, cast(segment as bigint) as segment, %s from s group by all" % (T0 + 2 * DAY, T0 + 28 * DAY, _SEGMENTED.format(gap=GAP * 8, of="f"), _COUNTERS))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-access packets in a time range, in gap segments, with rates."""
    chosen = select.in_range(select.keep_saps(event_packets(spark, sf_dir), 1, 2), T0 + 2 * DAY, T0 + 28 * DAY)
    return aggregates.counters(windows.gap_segments(chosen, GAP * 8), "pid", "segment")


@query("f1_keep_saps", "with {P} select pid, event_id, cts, sap from p where sap = 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.keep_saps(events(spark, sf_dir), 2).select(*KEY, "sap")


@query("f2_references", "select pid, event_id, cts from (with {P} select *, value > 50 as depended_on from p) where depended_on")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.keep_references(events(spark, sf_dir).withColumn("depended_on", F.col("value") > 50)).select(*KEY)


@query("f3_frames", "with {P} select pid, event_id, seq from p where seq in (0, 4) or seq % 7 = 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.keep_frames(event_packets(spark, sf_dir), 1, 5, -7).select("pid", "event_id", "seq")


@query("f4_time_range", f"with {{P}} select pid, event_id, cts, dur from p where not cts < {T0 + 3 * DAY} and not cts + dur > {T0 + 9 * DAY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.in_range(event_packets(spark, sf_dir), T0 + 3 * DAY, T0 + 9 * DAY).select(*KEY, "dur")


@query("f5_seek_range", f"with {{P}} select pid, event_id, cts, greatest({T0 + 3 * DAY} - cts, 0) as skip_begin, least(dur, {T0 + 9 * DAY} - cts) as dur from p where cts + dur > {T0 + 3 * DAY} and cts < {T0 + 9 * DAY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.seek_range(event_packets(spark, sf_dir), T0 + 3 * DAY, T0 + 9 * DAY).select(*KEY, "skip_begin", "dur")


@query("f6_predicate", "with {P} select pid, event_id, cts from p where (nullif(sap, 0) is null or nullif(sap, 0) <> 1) and value > 20 and value < 80 and event_type in ('click', 'view', 'error')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("sap", F.nullif("sap", F.lit(0)))
    return e.where(props.predicate("sap=!1#value+20#value-80#event_type=click|view|error#nothing=1", e.columns)).select(*KEY)


@query("f7_conditional", "select event_id, case event_type when 'click' then 'A' when 'view' then 'B' else 'Z' end as mark from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", props.conditional("(event_type=click)A,(event_type=view)B,()Z").alias("mark"))


@query("f8_template", "with {P} select event_id, printf('user%d_%s_%05d_%d', pid, event_type, seq, seq * 3 + 10) as name from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark, sf_dir).select("event_id", props.template("user$pid$_$event_type$_$num%05d$_$GINC(10,3)$").alias("name"))


@query("f9_loose_equality", "select p_partkey, p_type = 'STANDARD' or list_contains(string_split(p_brand || '|' || p_type, '|'), p_brand) as same from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", (props.text_matches(F.col("p_type"), F.lit("STANDARD")) | props.text_matches(F.col("p_brand"), F.concat_ws("|", "p_brand", "p_type"))).alias("same"))


@query("f13_property_map", "select event_id, cast(json_extract_string(props, '$.k') as varchar) as k, 'new' as extra, 2 as n from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("m", F.from_json("props", "map<string,string>"))
    m = props.without(props.merge(F.col("m"), F.create_map(F.lit("extra"), F.lit("new"), F.lit("gone"), F.lit("x"))), "gone")
    return e.select("event_id", props.get(m, "k").alias("k"), props.get(m, "extra").alias("extra"), F.size(m).alias("n"))


@query("a1_counters", f"with {{P}} select pid, {_COUNTERS} from p group by pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counters(event_packets(spark, sf_dir), "pid")


@query("a2_bit_rates", f"with w as (select user_id as pid, epoch_us(ts) // 1000 // {DAY} as w, cast(sum(length(props)) as bigint) * 8000 / {DAY} as rate from events group by all) select pid, round(avg(rate), 4) as avg_rate, round(max(rate), 4) as max_rate, count(*) as windows from w group by pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.bit_rates(events(spark, sf_dir), DAY)


@query("a3_reassembly", "select doc_id, md5(text) as digest, cast(length(text) as bigint) as n from documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.sources.synthetic import split_blocks

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), F.lit(0).alias("cts"), F.lit(1).alias("dur"), F.lit(1).alias("flags"))
    whole = aggregates.reassemble(split_blocks(d), "doc_id").where("byte_offset = 0")
    return whole.select("doc_id", F.md5("payload").alias("digest"), F.length(F.decode("payload", "UTF-8")).cast("long").alias("n"))


@query("a4_fragment_index", f"with {{P}}, g as (select *, (cts - {T0}) // {DAY} as frag from p) select pid, frag, count(*) as samples, cast(sum(dur) as bigint) as duration, min(cts) as earliest, arg_min(cts + dur, cts) filter (sap > 0) as first_sap_end, case when min(dur) = max(dur) then min(dur) else 0 end as default_dur, case when min(size) = max(size) then min(size) else 0 end as default_size, count(*) filter (sap > 0) as saps from g group by pid, frag")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fragments(event_packets(spark, sf_dir).withColumn("frag", F.floor((F.col("cts") - T0) / DAY)), "pid", "frag")


@query("a6_least_duration", "with {P} select pid, event_id, min(case when dur > 0 then dur end) over (partition by pid order by cts, event_id rows between unbounded preceding and 1 preceding) as least_dur from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.least_duration(event_packets(spark, sf_dir), windows.ORDER).select("pid", "event_id", "least_dur")


@query("a10_digests", "with {P}, b as (select pid, seq // 50 as block, sha1(string_agg(props, '' order by cts, event_id)) as digest from p group by all) select pid, sha1(string_agg(digest, '' order by block)) as digest, count(*) as blocks from b group by pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_packets(spark, sf_dir)
    return aggregates.stream_digests(aggregates.block_digests(p, F.floor(F.col("seq") / 50), F.col("props"), windows.ORDER))


_SEQ16 = "(seq * 13 + event_id % 3) % 65536"


@query("a11_losses", f"with {{P}}, n as (select pid, (({_SEQ16}) - lag({_SEQ16}) over (partition by pid order by cts, event_id) + 131072) % 65536 - 1 as gap from p) select pid, count(*) as received, cast(coalesce(sum(gap) filter (gap between 0 and 32767), 0) as bigint) as lost from n group by pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.losses(event_packets(spark, sf_dir).withColumn("n16", F.expr(_SEQ16)), "n16", windows.ORDER)


_JITTER = """with recursive {P}, r as (
  select pid, seq, event_id % 40 as t, cast(0 as bigint) as j from p where seq = 0
  union all select p.pid, p.seq, p.event_id % 40, r.j + abs(p.event_id % 40 - r.t) - ((r.j + 8) >> 4) from r join p on p.pid = r.pid and p.seq = r.seq + 1)
select pid, arg_max(j, seq) >> 4 as jitter from r group by pid"""


@query("a12_jitter", _JITTER)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_packets(spark, sf_dir).withColumn("arrival", F.col("cts") + F.col("event_id") % 40).withColumn("ts", F.col("cts"))
    return aggregates.jitter(p, windows.ORDER)


@query("a13_common_start", "select round(max(s), 6) as start from (select min((epoch_us(ts) // 1000) / (1000 + user_id % 3)) as s from events group by user_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.latest_start(events(spark, sf_dir).select("pid", F.col("cts").alias("ts"), (1000 + F.col("pid") % 3).alias("timescale")))


@query("a14_manifest", "select cast(p_size as bigint) as period, count(distinct p_brand) as sets, count(*) as qualities, max(p_retailprice) as best from part group by p_size")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("long").alias("period"), F.col("p_brand").alias("set"), F.col("p_partkey").alias("quality"), F.col("p_retailprice").alias("bandwidth"))
    flat = F.flatten(F.transform("sets", lambda s: s["qualities"]))
    return aggregates.manifest(p).select("period", F.size("sets").cast("long").alias("sets"), F.size(flat).cast("long").alias("qualities"), F.array_max(F.transform(flat, lambda q: q["bandwidth"])).alias("best"))


@query("a16_mix", f"select epoch_us(ts) // 1000 // {DAY} as day, round(sum(value), 4) as mixed, count(distinct user_id) as streams from events group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.mix(events(spark, sf_dir).withColumn("day", F.floor(F.col("cts") / DAY)), "day", "value")


@query("a9_kinds", "select event_type, count(*) as count, cast(sum(length(props)) as bigint) as total from events group by event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.kinds(events(spark, sf_dir), "event_type", "size")


@query("s7_best_quality", "with g as (select p_brand, coalesce(arg_max(p_partkey, (p_retailprice, p_partkey)) filter (p_retailprice <= 1200), arg_min(p_partkey, (p_retailprice, p_partkey))) as chosen from part group by p_brand) select * from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.col("p_partkey").alias("quality"), F.col("p_retailprice").alias("bandwidth"))
    return aggregates.best_quality(p, F.lit(1200), "p_brand")


@query("w1_frame_index", "with {P} select event_id, seq from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark, sf_dir).select("event_id", "seq")


@query("w2_gap_segments", "with {P}, %s select event_id, cast(segment as bigint) as segment from s" % _SEGMENTED.format(gap=GAP * 4, of="p"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gap_segments(events(spark, sf_dir), GAP * 4).select("event_id", F.col("segment").cast("long").alias("segment"))


_ALIGN = """with recursive {P}, r as (
  select pid, seq, event_id, cts as out_ts, case when dur > 0 then dur end as least_dur from p where seq = 0
  union all select p.pid, p.seq, p.event_id,
    case when least_dur is not null and abs(p.cts - (r.out_ts + least_dur)) > 60000 then r.out_ts + least_dur else p.cts end,
    case when p.dur > 0 then least(coalesce(least_dur, p.dur), p.dur) else least_dur end from r join p on p.pid = r.pid and p.seq = r.seq + 1)
select pid, event_id, out_ts from r"""


@query("w3_align", _ALIGN)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.align(event_packets(spark, sf_dir), 60_000)


@query("w4_rewind", "with {P}, g as (select *, sum(case when sap > 0 then 1 else 0 end) over (partition by pid order by cts, event_id) as gop from p), n as (select *, row_number() over (partition by pid, gop order by cts, event_id) - 1 as k, count(*) over (partition by pid, gop) as n, min(seq) over (partition by pid, gop) as f from g) select event_id, cast(gop as bigint) as gop, f + k - k % 4 + least(4, n - (k - k % 4)) - 1 - k % 4 as out_seq from n")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rewind(event_packets(spark, sf_dir), buffer=4).select("event_id", F.col("gop").cast("long").alias("gop"), "out_seq")


@query("w5_split_duration", f"with {{P}} select event_id, (cts - min(cts) over (partition by pid)) // {2 * DAY} as part from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_duration(events(spark, sf_dir), 2 * DAY).select("event_id", "part")


_GREEDY = """with recursive {{P}}, r as (
  select pid, seq, event_id, cast(0 as bigint) as part, {0} as held from p where seq = 0
  union all select p.pid, p.seq, p.event_id, case when held > 0 and held + p.{0} > {1} then part + 1 else part end,
    case when held > 0 and held + p.{0} > {1} then p.{0} else held + p.{0} end from r join p on p.pid = r.pid and p.seq = r.seq + 1)
select pid, event_id as {2}, part as {3} from r"""


@query("w5_split_size", _GREEDY.format("size", 100, "event_id", "part"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_size(events(spark, sf_dir), 100)


@query("w6_ranges", "with r as (select user_id as pid, event_id as start, case when event_type = 'click' then cast(null as bigint) else event_id + cast(floor(value) as bigint) - 20 end as e from events) select pid, start, case when coalesce(e, lead(start) over w) > start then coalesce(e, lead(start) over w) end as \"end\" from r window w as (partition by pid order by start)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    end = F.when(F.col("event_type") != "click", F.col("event_id") + F.floor("value") - 20)
    return windows.ranges(e.select("pid", F.col("event_id").alias("start"), end.alias("end")))


@query("w8_merge_intervals", f"with iv as (select user_id as pid, epoch_us(ts) // 1000 as s, epoch_us(ts) // 1000 + 1 + cast(floor(value * 100000) as bigint) as e from events), m as (select *, max(e) over (partition by pid order by s, e rows between unbounded preceding and 1 preceding) as r from iv), i as (select *, sum(case when r is null or s >= r then 1 else 0 end) over (partition by pid order by s, e) as island from m) select pid, min(s) as start, max(e) as \"end\", count(*) as n from i group by pid, island")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = events(spark, sf_dir).select("pid", F.col("cts").alias("start"), (F.col("cts") + 1 + F.floor(F.col("value") * 100000)).alias("end"))
    return windows.merge_intervals(iv, DAY)


@query("w9_merge_ranges", "with iv as (select l_orderkey as pid, l_partkey as s, l_partkey + cast(l_quantity as bigint) as e from lineitem), m as (select *, max(e) over (partition by pid order by s, e rows between unbounded preceding and 1 preceding) as r from iv), i as (select *, sum(case when r is null or s >= r + 300 then 1 else 0 end) over (partition by pid order by s, e rows unbounded preceding) as island from m) select pid, min(s) as start, max(e) as \"end\", count(*) as n from i group by pid, island")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return windows.merge_intervals(li.select(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")), 100_000, 300)


@query("w10_changed", "with {P}, l as (select *, lag(event_type) over (partition by pid order by cts, event_id) as was from p) select event_id, event_type from l where was is null or was <> event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.changed(events(spark, sf_dir), F.col("event_type")).select("event_id", "event_type")


@query("w12_resample", f"with {{P}}, b as (select *, min(cts) over (partition by pid) as b, lead(cts) over (partition by pid order by cts, event_id) as nx from p), g as (select pid, event_id, b, cts, unnest(generate_series(cast(ceil((cts - b) / {DAY / 4}) as bigint), cast(ceil((coalesce(nx, cts + 1) - b) / {DAY / 4}) as bigint) - 1)) as n from b) select pid, n, b + n * {DAY // 4} as out_ts, event_id as src from g")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.resample(events(spark, sf_dir), 1, 21_600, 1000)


@query("w13_next_durations", "with {P} select event_id, coalesce(lead(cts) over w - cts, cts - lag(cts) over w) as span from p window w as (partition by pid order by cts, event_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.next_durations(events(spark, sf_dir)).select("event_id", "span")


@query("w14_run_lengths", "with {P}, l as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as new from p window w as (partition by pid order by cts, event_id)), r as (select *, sum(new) over (partition by pid order by cts, event_id) as run from l) select pid, cast(run as bigint) as run, event_type as value, count(*) as count from r group by all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_lengths(events(spark, sf_dir), "event_type").withColumn("run", F.col("run").cast("long"))


@query("w14_expand", "select user_id as pid, event_type, cast(place as bigint) as place from (select user_id, event_type, unnest(range(count(*))) as place from events group by user_id, event_type)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = events(spark, sf_dir).groupBy("pid", "event_type").count()
    return windows.expand_runs(runs).withColumn("place", F.col("place").cast("long"))


@query("w15_roll_up", "select conv_id as pid, turn as seq, string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 2 preceding and current row) as shown from conversations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.roll_up(captions(spark, sf_dir), 3, ["seq"]).select("pid", "seq", "shown")


@query("w16_unwrap", "with {P} select event_id, seq * 1500 as unwrapped from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unwrap_sequence(event_packets(spark, sf_dir).withColumn("n16", F.expr("seq * 1500 % 65536")), "n16").select("event_id", "unwrapped")


@query("restamp_clock", "with {P}, k as (select *, case when sap = 1 then cts + 7 * seq end as clock from p) select event_id, cts + last_value(clock - cts ignore nulls) over (partition by pid order by cts, event_id rows between unbounded preceding and current row) as restamped from k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_packets(spark, sf_dir).withColumn("clock", F.when(F.col("sap") == 1, F.col("cts") + 7 * F.col("seq")))
    return windows.from_clock(p).select("event_id", "restamped")


@query("restamp_rate", "with {P} select event_id, cts * 24 // 25 + 40 as cts, dur * 24 // 25 as dur from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.restamp(event_packets(spark, sf_dir), 40, 24, 25).select("event_id", "cts", "dur")


@query("u1_concatenate", "with s as (select user_id as pid, event_id, epoch_us(ts) // 1000 as cts, cast(length(props) as bigint) as dur, case event_type when 'click' then 0 when 'view' then 1 else 2 end as src from events), o as (select src, min(cts) as f, sum(max(cts + dur) - min(cts)) over (order by src rows between unbounded preceding and 1 preceding) as off from s group by src) select event_id, s.src, cast(coalesce(off, 0) + cts - f as bigint) as cts from s join o on s.src = o.src")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("dur", F.col("size"))
    sources = [e.where("event_type = 'click'"), e.where("event_type = 'view'"), e.where("event_type not in ('click', 'view')")]
    return concat.concatenate(sources).select("event_id", "src", "cts")


@query("u2_loop", "with e as (select *, epoch_us(ts) // 1000 as cts from events), l as (select max(cts + 10) - min(cts) as len from e) select event_id, cast(turn as bigint) as turn, cts + turn * len as cts from e, l, range(3) t(turn)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.loop(events(spark, sf_dir).withColumn("dur", F.lit(10)), 3).select("event_id", F.col("turn").cast("long").alias("turn"), "cts")


_CUT = T0 + 10 * DAY


_KEPT = f"""with e as (select *, epoch_us(ts) // 1000 as cts from events),
o as (select min(cts) as f, max(cts + 10) - min(cts) as len from e where event_type = 'error')
select event_id, case when event_type = 'error' then cts - f + {_CUT} when cts < {_CUT} then cts else cts + coalesce(len, 0) end as cts,
  event_type = 'error' as spliced from e, o"""


@query("u3_splice", _KEPT)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of every stream put in, all others kept: those behind the cut follow."""
    e = events(spark, sf_dir).withColumn("dur", F.lit(10))
    return concat.splice(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), _CUT, keep=True).select("event_id", "cts", "spliced")


@query("u3_splice_all", f"with e as (select *, epoch_us(ts) // 1000 as cts from events), o as (select min(cts) as f, max(cts + 10) - min(cts) as len from e where event_type = 'error'), i as (select event_id, cts - f + {_CUT} as cts, true as spliced from e, o where event_type = 'error') select event_id, cts, false as spliced from e, o where event_type <> 'error' and (cts < {_CUT} or cts >= {_CUT} + coalesce(len, 0)) union all select * from i")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events of every stream spliced in."""
    e = events(spark, sf_dir).withColumn("dur", F.lit(10))
    return concat.splice(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), _CUT).select("event_id", "cts", "spliced")


@query("s2_reorder", "with {P}, d as (select pid, event_id, cts, seq + case when event_id % 2 = 0 then 1 else 0 end as n from p), f as (select *, row_number() over (partition by pid, n order by cts, event_id) as r from d) select event_id, n as place from f where r = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_packets(spark, sf_dir).withColumn("n16", F.expr("(seq + int(event_id % 2 = 0)) % 65536"))
    return concat.reorder(p, "n16", windows.ORDER).select("event_id", "place")


@query("s3_file_order", "select p_partkey, row_number() over (partition by p_brand order by length(p_name), p_name, p_partkey) as place from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(*concat.file_order("p_name"), "p_partkey"))
    return p.select("p_partkey", place.cast("long").alias("place"))


@query("s4_merged", "with {P} select pid, seq, cts as dts, 1000 + pid % 3 as timescale from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.merged(event_packets(spark, sf_dir).select("pid", "seq", F.col("cts").alias("dts"), (1000 + F.col("pid") % 3).alias("timescale")))


@query("s5_interleave", _GREEDY.format("dur", DAY, "id", "chunk"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.interleave(event_packets(spark, sf_dir).withColumn("id", F.col("event_id")), DAY, ["cts", "id"])


@query("s6_slice", "with {P} select event_id, seq from p where seq between 9 and 19")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.slice_rows(event_packets(spark, sf_dir), 10, 20).select("event_id", "seq")


@query("s6_first_ticks", f"with {{P}} select event_id, cts from (select *, min(cts) over (partition by pid) as b from p) where cts - b <= {3 * DAY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_ticks(events(spark, sf_dir), 3 * DAY).select("event_id", "cts")


@query("c3_remove_samples", "with {P} select event_id, row_number() over (partition by pid order by seq) - 1 as number from p where event_type <> 'error'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).withColumnRenamed("seq", "number")
    return container.remove_samples(s, s.where("event_type = 'error'").select("pid", "number")).select("event_id", "number")


@query("c2_update_samples", "with {P} select event_id, case when event_type = 'error' then 0 else size end as size from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).withColumnRenamed("seq", "number")
    return container.update_samples(s, s.where("event_type = 'error'").select("pid", "number", F.lit(0).cast("long").alias("size")), "size").select("event_id", "size")


@query("c4_run_length_times", "with {P} select pid, seq as number, dur, cts - min(cts) over (partition by pid) as ts from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).withColumnRenamed("seq", "number")
    return container.expand_times(container.compact_times(s)).select("pid", "number", "dur", "ts")


@query("c5_sample_offsets", "with {P} select event_id, seq // 5 as chunk, cast(sum(size) over (partition by pid order by seq) - size as bigint) as \"offset\" from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.sample_offsets(event_packets(spark, sf_dir).withColumnRenamed("seq", "number"), 5).select("event_id", "chunk", "offset")


@query("c8_merge_fragments", "with {P}, r as (select pid, event_id, seq as number, seq // 10 as frag, case when sap = 1 then cast(floor(value) as bigint) end as dur from p), m as (select *, coalesce(dur, case when frag % 2 = 0 then frag * 3 + 1 end, 7) as d from r) select event_id, d as dur, cast(sum(d) over (partition by pid order by number) - d as bigint) as start from m")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_packets(spark, sf_dir).select("pid", "event_id", F.col("seq").alias("number"), F.floor(F.col("seq") / 10).alias("frag"), F.when(F.col("sap") == 1, F.floor("value")).alias("dur"))
    frag = r.select("pid", "frag").distinct().withColumn("dur", F.when(F.col("frag") % 2 == 0, F.col("frag") * 3 + 1))
    return container.merge_fragments(r, frag, r.select("pid").distinct().withColumn("dur", F.lit(7).cast("long")), "dur").select("event_id", "dur", "start")


_SAP_SEGMENTS = f"with {{P}}, d as (select *, (cts - min(cts) over (partition by pid)) // {DAY} as due from p), x as (select *, max(case when sap > 0 then due end) over (partition by pid order by cts, event_id rows between unbounded preceding and 1 preceding) as done from d), s as (select *, sum(case when sap > 0 and due > coalesce(done, 0) then 1 else 0 end) over (partition by pid order by cts, event_id) as segment from x) "


@query("segment_ids", _SAP_SEGMENTS + "select event_id, cast(segment as bigint) as segment from s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.segments(events(spark, sf_dir), DAY).select("event_id", F.col("segment").cast("long").alias("segment"))


@query("segment_index", _SAP_SEGMENTS + "select pid, cast(segment as bigint) as segment, min(cts) as start, max(cts + dur) - min(cts) as duration, cast(sum(size) as bigint) as bytes, count(*) as packets, arg_min(sap, (cts, event_id)) > 0 as starts_with_sap from s group by pid, segment")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.segment_index(container.segments(event_packets(spark, sf_dir), DAY)).withColumn("segment", F.col("segment").cast("long"))


@query("tile_rates", "select s_suppkey as pid, cast(tile as bigint) as tile, case when tile = 0 then 10000 else (cast(floor(s_acctbal) as bigint) + 90000) // 4 end as rate from (select s_suppkey, s_acctbal, unnest(range(5)) as tile from supplier)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("pid"), (F.floor("s_acctbal") + 100_000).alias("bandwidth"))
    return container.tile_rates(s, 4).select("pid", F.col("tile").cast("long").alias("tile"), "rate")


@query("override_metadata", "select p_partkey, p_size, 'new' as p_brand from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return container.override(p, p_size=-1, p_brand=F.lit("new")).select("p_partkey", "p_size", "p_brand")


@query("retrack", "select p_partkey, row_number() over (partition by p_brand order by p_partkey) as track from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("stream_type", F.col("p_brand"))
    return container.retrack(p, ["p_partkey"]).select("p_partkey", F.col("track").cast("long").alias("track"))


@query("order_segments", f"with o as (select l_orderkey as pid, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) // 1000 as cts from lineitem) select pid, count(*) as packets, max(cts) + {DAY} - min(cts) as span from o group by pid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = aggregates.counters(order_packets(spark, sf_dir), "pid")
    return c.select("pid", "packets", (F.col("end_cts") - F.col("first_cts")).alias("span"))


@query("hot_stream_scan", "with {P} select event_id, row_number() over (order by cts, event_id) as place, cast(sum(size) over (order by cts, event_id) as bigint) as bytes from p")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packets as one stream: numbers and running sums over chunks of six hours, each in its own task."""
    from rivulet.operators.packets import chunk_of

    one = events(spark, sf_dir).withColumn("pid", F.lit(0))
    return scan(one, ["pid"], windows.ORDER, chunk_of(F.col("cts")), sums={"place": F.lit(1), "bytes": F.col("size")}).select("event_id", F.col("place").cast("long").alias("place"), "bytes")
