"""Queries of sample tables, items, sources, property lists, dates and byte fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import binary, props, text, timeline, vectors
from rivulet.operators import aggregates, concat, container, select, windows
from rivulet.operators.packets import event_packets, events
from rivulet.plans.common import DAY, Registry
from rivulet.sources import files, framing
from rivulet.sources.scratch import shared_dir

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("f11_source_prefix", "select p_partkey, p_type like 'STA%' as begins, p_type = 'STANDARD' as same from part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, kind = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_type")
    return p.select("p_partkey", props.source_matches(kind, "STA*").alias("begins"), props.source_matches(kind, "STANDARD").alias("same"))


@query("f12_forward", "select event_id from events where event_id % 3 <> 0 and event_id % 4 <= 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear packets of the lower layers."""
    e = events(spark, sf_dir).withColumn("encrypted", F.col("event_id") % 3 == 0).withColumn("layer", F.col("event_id") % 4)
    return select.forward(e, False, 2).select("event_id")


_LAYERS = "select user_id * 1000 + event_id % 4 as pid, count(*) as packets, cast(sum(length(props)) as bigint) as bytes from events group by all"


@query("c14_split_layers", _LAYERS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = select.split_layers(events(spark, sf_dir).withColumn("layer", F.col("event_id") % 4))
    return e.groupBy("pid").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


@query("a5_count_value", "select user_id as pid, count(*) filter (event_type = 'click') as count from events group by user_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_value(events(spark, sf_dir), "event_type", "click", "pid")


_DURATIONS = "with {P}, d as (select pid, max(cts + dur) - min(cts) as duration from p group by pid) select pid, duration, max(duration) over () as total from d"


@query("a8_durations", _DURATIONS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.durations(event_packets(spark, sf_dir))


_FIELDS = """with f as (select unnest(json_keys(props)) as field, props from events),
v as (select field, json_extract_string(props, '$.' || field) as value from f)
select field, count(*) as rows, count(distinct value) as "values", max(length(value)) as longest from v group by field"""


@query("a15_field_statistics", _FIELDS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("m", F.from_json("props", "map<string,string>"))
    return aggregates.field_statistics(e, "m").withColumn("longest", F.col("longest").cast("long"))


_BUFFER = "select event_id, least(1.0, greatest(0.0, (value - 20) / 50)) as rate_cap from events"


@query("abr_rate_cap", _BUFFER)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("buffer", F.col("value"))
    return aggregates.next_quality(e, windows.ORDER, 20, 50).select("event_id", "rate_cap")


_PRESENTED = """with e as (select user_id as pid, event_id, epoch_us(ts) // 1000 + event_id % 5 * 40000000 as cts from events)
select event_id, row_number() over (partition by pid order by cts, event_id) - 1 as place from e"""


@query("s1_presentation_order", _PRESENTED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = events(spark, sf_dir).withColumn("cts", F.col("cts") + F.col("event_id") % 5 * 40_000_000)
    return concat.presentation_order(sent).select("event_id", "place")


_FILES = """select p_partkey, row_number() over (partition by p_brand order by p_size, length(p_name), p_name, p_partkey) as by_size,
  row_number() over (partition by p_brand order by p_partkey % 7, length(p_name), p_name, p_partkey) as by_date from part"""


@query("s3_file_order_by", _FILES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("size", F.col("p_size")).withColumn("date", F.col("p_partkey") % 7)
    place = lambda by: F.row_number().over(Window.partitionBy("p_brand").orderBy(*concat.file_order("p_name", by), "p_partkey")).cast("long")
    return p.select("p_partkey", place("size").alias("by_size"), place("date").alias("by_date"))


_SEVERAL = """select c_custkey as pid, c_acctbal as balance, c_mktsegment as segment, 0 as src from customer
union all select s_suppkey, s_acctbal, null, 1 from supplier"""


@query("u4_several_sources", _SEVERAL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("pid"), F.col("s_acctbal").alias("balance"))
    return concat.several([c, s])


_APPENDED = """with s as (select user_id as pid, event_id, epoch_us(ts) // 1000 as cts, case event_type when 'click' then 0 when 'view' then 1 end as src from events),
a as (select * from s where src = 0), b as (select * from s where src = 1),
e as (select pid, max(cts + 10) as e from a group by pid), f as (select pid, min(cts) as f from b group by pid)
select event_id, cts, src from a union all select event_id, cts - f + coalesce(e, 0), src from b join f using (pid) left join e using (pid)"""


@query("u5_append_unaligned", _APPENDED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("dur", F.lit(10))
    return concat.append(e.where("event_type = 'click'"), e.where("event_type = 'view'"), aligned=False).select("event_id", "cts", "src")


@query("u6_fan_out", "select event_type, count(*) as n, min(event_id) as first from events group by event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "fan")
    concat.fan_out(events(spark, sf_dir).select("event_id", "event_type"), "event_type", path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("u7_destinations", "select event_id, d as destination from events, (values ('file'), ('net'), ('screen')) v(d)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat.to_destinations(events(spark, sf_dir), ["file", "net", "screen"]).select("event_id", "destination")


_AT_SYNC = """with recursive {P}, r as (
  select pid, seq, event_id, cast(0 as bigint) as part, size as held from p where seq = 0
  union all select p.pid, p.seq, p.event_id, case when p.sap > 0 and held >= 100 then part + 1 else part end,
    case when p.sap > 0 and held >= 100 then p.size else held + p.size end from r join p on p.pid = r.pid and p.seq = r.seq + 1)
select event_id, part from r"""


@query("w5_split_size_at_sync", _AT_SYNC)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split_by_size_at_sync(events(spark, sf_dir), 100).select("event_id", "part")


_INSERTED = """with {P}, s as (select pid, event_id, seq, 1 as new from p union all select pid, -event_id, seq, 0 from p where event_type = 'error')
select event_id, row_number() over (partition by pid order by seq, new) - 1 as number from s"""


@query("c1_insert_samples", _INSERTED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).select("pid", "event_id", F.col("seq").alias("number"), "event_type")
    new = s.where("event_type = 'error'").select("pid", (-F.col("event_id")).alias("event_id"), "number")
    return container.insert_samples(s.drop("event_type"), new).select("event_id", "number")


_SHADOWED = """with {P} select a.event_id, b.event_id as shadow_event_id, b.size as shadow_size
from p a left join p b on a.event_type = 'error' and b.pid = a.pid and b.seq = a.seq // 10 * 10"""


@query("c6_shadow_samples", _SHADOWED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).select("pid", F.col("seq").alias("number"), "event_id", "size", "event_type")
    shadows = s.where("event_type = 'error'").select("pid", "number", F.expr("number div 10 * 10").alias("shadow"))
    return container.shadowed(s.drop("event_type"), shadows, "event_id", "size").select("event_id", "shadow_event_id", "shadow_size")


_STORED = f"""with {{P}} select event_id, cast(sum(size) over (order by pid, seq) - size as bigint) as flat,
  cast(sum(size) over (order by cts // {DAY}, pid, seq) - size as bigint) as interleaved from p"""


@query("c9_storage_offsets", _STORED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_packets(spark, sf_dir).select("pid", "event_id", F.col("seq").alias("number"), "cts", "size")
    flat = container.storage_offsets(s).select("event_id", F.col("offset").alias("flat"))
    return flat.join(container.storage_offsets(s, DAY).select("event_id", F.col("offset").alias("interleaved")), "event_id")


_ITEMS = """with i as (select p_partkey as item_id, p_brand as kind from part where p_size >= 20 and p_partkey % 10 <> 0
  union all select p_partkey, 'new' from part where p_partkey % 10 = 0)
select kind as "group", count(*) as members, min(item_id) as first from i group by kind"""


@query("c10_item_groups", _ITEMS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("kind"), "p_size")
    new = own.where("item_id % 10 = 0").select("item_id", F.lit("new").alias("kind"))
    return container.item_groups(container.change_items(own.drop("p_size"), own.where("p_size < 20"), new), F.col("kind"))


_REFERRED = """select s_suppkey as item_id, s_suppkey = 7 as is_primary, count(l.l_suppkey) as referred
from supplier left join lineitem l on l.l_suppkey = s_suppkey group by s_suppkey"""


@query("c10_item_references", _REFERRED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("item_id"))
    refs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    return container.items(container.primary_item(s, 7), refs)


_CHAPTERS = "select s_suppkey as pid, i as number, (s_suppkey % 9 * 3600 + i * 60 + 5) * 1000 + s_suppkey % 1000 as start, 'Part ' || s_name as name from supplier, range(3) t(i)"


@query("c17_chapters", _CHAPTERS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    line = lambda i: F.concat(timeline.clock((k % 9 * 3600 + i * 60 + 5) * 1000 + k % 1000), F.lit(" Part "), F.col("s_name"))
    own = s.select(k.alias("pid"), F.concat_ws("\n", *[line(i) for i in range(3)], F.lit("no chapter")).alias("text"))
    return container.chapters(own).select("pid", F.col("number").cast("long").alias("number"), "start", "name")


@query("list_operations", """with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as w from conversations)
select conv_id, turn, array_to_string(list_concat(w[1:2], ['new'], w[3:]), ' ') as inserted, array_to_string(list_concat(w[1:1], w[3:]), ' ') as removed,
  case when len(w) > 2 then array_to_string(list_concat([w[3], w[2], w[1]], w[4:]), ' ') else array_to_string(w, ' ') end as swapped,
  coalesce(list_position(w, 'the'), 0) - 1 as place from w""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = spark.read.parquet(f"{sf_dir}/conversations.parquet"), text.tokens(F.col("text"))
    said = lambda x: F.concat_ws(" ", x)
    changed = [said(props.list_insert(w, 2, F.lit("new"))).alias("inserted"), said(props.list_remove_at(w, 1)).alias("removed"), said(props.list_swap(w, 0, 2)).alias("swapped")]
    return c.select("conv_id", "turn", *changed, props.list_find(w, F.lit("the")).alias("place"))


_CALENDAR = "select o_orderkey, epoch_us(o_orderdate) // 1000 as ms from orders"


@query("calendar_to_utc", _CALENDAR)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, d = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderdate")
    parts = [F.year(d), F.month(d), F.dayofmonth(d), F.hour(d), F.minute(d), F.second(d)]
    return o.select("o_orderkey", timeline.utc_ms(*parts).alias("ms"))


_DATES = "select event_id, epoch_us(ts) // 1000 as iso, epoch_us(ts) // 1000000 * 1000 as mail, epoch_us(ts) // 1000 - 19800000 as zoned, cast(null as bigint) as none from events"


@query("parse_dates", _DATES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO and as mail dates, with and without a zone, and back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    shown = lambda form: F.date_format("ts", form)
    read = {
        "iso": shown("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "mail": shown("EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        "zoned": shown("yyyy-MM-dd'T'HH:mm:ss.SSS'+05:30'"),
        "none": shown("yyyy/MM/dd"),
    }
    return e.select("event_id", *[timeline.parse_date(c).alias(n) for n, c in read.items()])


_SPECS = """select event_id, case event_id % 6 when 0 then 'F' when 1 then 'D' when 2 then 'S' when 3 then 'T' when 4 then 'TC' else 'SAP' end as kind,
  case event_id % 6 when 0 then event_id when 1 then event_id * 1000 when 2 then event_id * 1000 when 3 then event_id % 50 * 1000 + 250
    when 4 then event_id % 50 * 25 + 7 end as value from events"""


@query("range_specs", _SPECS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = events(spark, sf_dir), F.col("event_id")
    n, two = i.cast("string"), F.format_string("%02d", i % 50)
    kinds = [F.concat(F.lit("F"), n), F.concat(F.lit("D"), n, F.lit("s")), F.concat(F.lit("S"), n, F.lit("k")), F.concat(F.lit("T0:0:"), two, F.lit(".250")), F.concat(F.lit("TC00:00:"), two, F.lit(":07")), F.lit("SAP")]
    spec = timeline.range_spec(F.get(F.array(*kinds), (i % 6).cast("int")))
    return e.select("event_id", spec["kind"].alias("kind"), spec["value"].alias("value"))


@query("unit_numbers", "select event_id, event_id * 1000::double as k, event_id * 60000::double as min, event_id::double as hex from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    made = {"k": F.concat(n, F.lit("K")), "min": F.concat(n, F.lit("min")), "hex": F.concat(F.lit("0x"), F.hex("event_id"))}
    return events(spark, sf_dir).select("event_id", *[timeline.parse_number(c).alias(k) for k, c in made.items()])


_TAGS = """select doc_id, case lang when 'en' then 'eng' when 'fr' then 'fra' when 'de' then 'deu' when 'es' then 'spa' end as three,
  case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when 'es' then 'Spanish' end as name from documents"""


@query("language_tags", _TAGS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = text.language(F.concat(F.upper("lang"), F.lit("-XX")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tag["three"].alias("three"), tag["name"].alias("name"))


_LEGAL = """with d as (select doc_id, strlen(text) as n, hex(encode(text)) as h from documents)
select doc_id, n <= 9 or h[19:19] not in ('8', '9', 'A', 'B') as legal from d"""


@query("utf8_legality", _LEGAL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first nine bytes are whole characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.is_legal_utf8(F.substring(F.encode("text", "UTF-8"), 1, 9)).alias("legal"))


_BITS = """with e as (select event_id, printf('%04X', (event_id % 8) * 8192 + (user_id % 32) * 256 + length(props) % 256) as packed, hex(encode(lpad(props, 8, 'x'))) as h from events)
select event_id, packed, cast('0x' || h[1:16] as bigint) as big from e"""


@query("bit_writer", _BITS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    packed = binary.write_bits([(F.col("event_id") % 8, 3), (F.col("pid") % 32, 5), (F.col("size") % 256, 8)])
    return e.select("event_id", F.hex(packed).alias("packed"), binary.read_long(F.encode(F.lpad("props", 8, "x"), "UTF-8"), 0).alias("big"))


_CODES = "with p as (select p_partkey, p_type[1:4] as c from part) select p_partkey, ord(c[1]) * 16777216 + ord(c[2]) * 65536 + ord(c[3]) * 256 + ord(c[4]) as number, c as back from p"


@query("four_character_codes", _CODES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, code = spark.read.parquet(f"{sf_dir}/part.parquet"), F.substring("p_type", 1, 4)
    number = binary.fourcc_number(code)
    return p.select("p_partkey", number.alias("number"), binary.fourcc(number).alias("back"))


_PCM = """with d as (select doc_id as pid, hex(encode(text)) as h from documents where strlen(text) > 0),
f as (select pid, h, unnest(range((length(h) + 8191) // 8192)) as frame from d)
select pid, frame, frame * 1024 * 48000 // 44100 as cts, md5(h[frame * 8192 + 1 : frame * 8192 + 8192]) as digest from f"""


@query("pcm_frames", _PCM)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as raw stereo audio of 16 bits, 1024 samples a frame."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pid"), F.encode("text", "UTF-8").alias("data"))
    return framing.pcm_frames(d, 1024, 2, 2, 44100, 48000).select("pid", F.col("frame").cast("long").alias("frame"), "cts", F.md5(F.hex("data")).alias("digest"))


@query("start_code_units", "select conv_id, turn, strlen(text) + 13 as n, hex(encode(text)) as second from conversations where text <> ''")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two units between start codes, and on end after their lengths."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text <> ''")
    stream = F.concat(F.lit(b"\0\0\0\1first\0\0\1"), F.encode("text", "UTF-8"))
    units = framing.start_code_units(stream)
    return c.select("conv_id", "turn", F.length(framing.length_prefixed(units)).cast("long").alias("n"), F.get(units, F.lit(1)).alias("second"))


_FILE_BYTES = "select conv_id, strlen(text) + 1 as size, hex(encode(text || chr(10)))[5:14] as part from conversations where turn = 0"


@query("file_byte_ranges", _FILE_BYTES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' first turns as files, and five bytes of each from the third on."""
    path = shared_dir(spark, "texts")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    c.select("conv_id", "text").write.partitionBy("conv_id").text(path)
    found = files.read_bytes(spark, f"{path}/*/part-*", 2, 5)
    conv = F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long")
    return found.select(conv.alias("conv_id"), "size", F.hex("data").alias("part"))


@query("encrypted_files", "select conv_id, turn, text as back, false as plain from conversations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, key = shared_dir(spark, "encrypted"), F.lit(b"0123456789abcdef")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    files.write_encrypted(c, path, key)
    sent = spark.read.parquet(path).select("conv_id", "turn", F.col("data").alias("sent"))
    back = files.read_encrypted(spark, path, key).join(sent, ["conv_id", "turn"])
    return back.select("conv_id", "turn", F.decode("data", "UTF-8").alias("back"), (F.col("sent") == F.col("data")).alias("plain"))


_COLOURS = """select p_partkey, (200 + cast(floor((p_partkey % 256 - 200) * 0.25) as bigint)) * 65536 + cast(floor((p_size - 0) * 0.25) as bigint) * 256 as mixed from part"""


@query("colour_lerp", _COLOURS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    other = F.shiftleft(F.col("p_partkey") % 256, 16).bitwiseOR(F.shiftleft(F.col("p_size").cast("long"), 8))
    return p.select("p_partkey", vectors.colour_lerp(F.lit(200 << 16).cast("long"), other, 0.25).alias("mixed"))


_EVENTS = "select event_id, user_id as presentation_time, length(props) as duration, 'a & <b> ' || event_type as message from events"


@query("manifest_events", _EVENTS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest an event, and what its <Event> element says."""
    from rivulet.sources import subtitles

    head = F.format_string('<EventStream timescale="1000"><Event presentationTime="%d" duration="%d" id="%d">', "pid", "size", "event_id")
    m = events(spark, sf_dir).select("pid", F.concat(head, text.escape_entities(F.concat(F.lit("a & <b> "), F.col("event_type"))), F.lit("</Event></EventStream>")).alias("text"))
    return subtitles.event_stream(m).select(F.col("id").alias("event_id"), "presentation_time", "duration", "message")


_OBJECTS = """with d as (select doc_id as toi, text, strlen(text) as n, (strlen(text) + 999) // 1000 as parts from documents where strlen(text) > 0),
g as (select toi, i from d, range(1000) r(i) where i < parts and (toi + i) % 7 <> 0),
s as (select d.toi, d.n, d.parts, any_value(d.text) as text, count(g.i) as have, sum(least(1000, d.n - g.i * 1000)) as received from d join g using (toi) group by all)
select toi, cast(received as bigint) as received, have = parts as complete, case when have = parts then md5(text) end as digest from s"""


@query("gathered_objects", _OBJECTS)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects in parts of 1000 bytes, of which every seventh is lost and every third comes twice."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''").select(F.col("doc_id").alias("pid"), F.encode("text", "UTF-8").alias("data"), F.octet_length("text").alias("total"))
    parts = framing.fixed_frames(d, 1000, 1, 1, 1).join(d.select("pid", "total"), "pid").where("(pid + frame) % 7 <> 0")
    copies = F.explode(F.when(F.col("frame") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    sent = parts.withColumn("copy", copies).select(F.lit(1).alias("tsi"), F.col("pid").alias("toi"), (F.col("frame") * 1000).alias("first"), "data", "total")
    return aggregates.gather_objects(sent).select("toi", "received", "complete", F.md5("data").alias("digest"))


_WALK = """with p as (select p_size as pid, p_partkey as period, cast(floor(p_retailprice) as bigint) as duration from part),
s as (select *, sum(duration) over (partition by pid order by period) - duration as b from p)
select pid, period, n as number, cast(b + n * 400 as bigint) as start, least(400, duration - n * 400) as duration from s, range(100) r(n) where n < ceil(duration / 400.0)"""


@query("manifest_walk", _WALK)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    periods = p.select(F.col("p_size").alias("pid"), F.col("p_partkey").alias("period"), F.floor("p_retailprice").alias("duration"))
    return aggregates.walk_manifest(periods, 400)


_SAMPLES = """with c as (select conv_id as pid, turn as number, turn * 2000 as s, turn * 2000 + 1500 + turn % 3 * 1500 as e, text from conversations),
b as (select distinct pid, t from (select pid, s as t from c union all select pid, e from c)),
i as (select pid, t, lead(t) over (partition by pid order by t) as u from b)
select i.pid, i.t as start, i.u as "end", coalesce(string_agg(c.text, chr(10) order by c.s, c.number), '') as text
from i left join c on c.pid = i.pid and c.s <= i.t and c.e > i.t where i.u is not null group by all"""


@query("cue_samples", _SAMPLES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.operators.packets import captions
    from rivulet.sources import subtitles

    c = captions(spark, sf_dir).select("pid", F.col("seq").alias("number"), "start", (F.col("start") + 1500 + F.col("seq") % 3 * 1500).alias("end"), "text")
    return subtitles.cue_samples(c)
