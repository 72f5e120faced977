"""Shared helpers of the training-data operators: input columns, scratch folders, word and shingle hashing."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text that a kernel handles at once (a single longer text is taken whole).
CHUNK_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string), so that other columns can't clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and its size is known to the planner."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Removes the folders behind tables that `cut` has made, once nothing reads them any more. Other folders stay."""
    for df in frames:
        for path in {at for f in df.inputFiles() if re.search(r"-[0-9a-f]{32}$", at := f.rsplit("/", 1)[0])}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(docs: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of docs has (columns are told apart without regard to case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A group that holds a thousandth of all rows or more is hot. There are a thousand of them at most, so they can be broadcast.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows with the columns of groups, one row for each value of `on` (not null) with its number of rows in `size`.

    groups: a table that `cut` has made. Rows of hot groups meet theirs by broadcast where they are; the others are shuffled,
    and no value of them is frequent."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    bound = max(total, HOT_SHARE)
    hot, cold = groups.where(F.col(size) * HOT_SHARE >= bound), groups.where(F.col(size) * HOT_SHARE < bound)
    if not hot.take(1):
        return rows.join(cold, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


#: Words of 64 bits in a sieve's bitmap: 2 MB of bits, whatever the input's size.
SIEVE_WORDS = 1 << 18


def sieved(rows: DataFrame, value: Column, members: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column `flag`: false only where `value` is certainly none of members' (one long column).

    A bitmap of bounded size is broadcast, so that what a join by ids doesn't concern is told apart without a shuffle. It lets
    more through as members grow, and the join behind it stays exact."""
    word, bits = unused(rows, f"{flag}_word"), unused(rows, f"{flag}_bits")
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(64 * SIEVE_WORDS))
    one = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), (place(v) % 64).cast("int"))
    own = F.col(members.columns[0])
    marks = members.groupBy(F.floor(place(own) / 64).alias(word)).agg(F.bit_or(one(own)).alias(bits))
    joined = rows.withColumn(word, F.floor(place(value) / 64)).join(F.broadcast(marks), word, "left")
    return joined.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(one(value)) != 0, F.lit(False))).drop(word, bits)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs, all columns as they were, without the rows whose doc_id is in ids (one long column; null is a value of its own).
    Only rows that the sieve lets through take part in a shuffle."""
    flag, own = unused(docs, "_may"), unused(docs, "_drop")
    marked = sieved(docs, F.col("doc_id").cast("long"), ids, flag)
    drop = ids.select(F.col(ids.columns[0]).alias(own))
    left = marked.where(F.col(flag)).join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti")
    return marked.where(~F.col(flag)).unionByName(left).select(*docs.columns)


def crc_mod(doc_id: object, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each, or one row."""
    ends = np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64, batch.num_rows + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of `rows` at most for what runs inside, and then as they were: with Spark's 10,000 whole texts, buffers of a
    task come to hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """df's batches through make()(part) -> columns; make runs once a task. Only one part is held at a time."""
    fields = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    target = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch):
                out = work(part)
                made = [out[f.name] if isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(made, schema=target)

    return df.mapInArrow(run, schema)


# ---- hashing of words and shingles, over whole Arrow buffers ----

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column on end, and the offsets of its rows."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


#: Bytes of a word that are hashed column by column, for all words at once; longer ones take the rest by themselves.
_COLUMNS = 256


def word_hashes(flat: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all rows in order, and the bounds of each row's words."""
    rows = len(offsets) - 1
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_IS_SEP[flat]
    cuts = np.zeros(len(flat) + 1, bool)  # where a word can't go on from the byte before
    cuts[offsets] = True
    cuts[0] = cuts[-1] = True
    cuts[:-1] |= np.append(True, ~inside[:-1])
    ends_at = np.append(~inside[1:], True) | cuts[1:]
    starts = np.flatnonzero(inside & cuts[:-1])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    ends = np.flatnonzero(inside & ends_at) + 1
    bounds = np.searchsorted(starts, offsets)
    size = ends - starts
    # longest words first, so that those with a byte in a column are always the first ones
    order = np.argsort(_COLUMNS - np.minimum(size, _COLUMNS).astype(np.int16), kind="stable")
    many = len(size) - np.cumsum(np.bincount(np.minimum(size, _COLUMNS), minlength=_COLUMNS + 1))[:-1]
    table, at, found = (_BYTE[_LOWER] if lower else _BYTE) * _POWER, starts[order], np.zeros(len(size), np.uint64)
    for n in many.tolist():
        if not n:
            break
        found[:n] += table[flat[at[:n]]]
        at[:n] += 1
        table = table * _POWER
    hashes = np.empty(len(size), np.uint64)
    hashes[order] = found
    long = np.flatnonzero(size > _COLUMNS)
    if len(long):
        powers = np.cumprod(np.full(int(size[long].max()), _POWER), dtype=np.uint64)
        for w in long.tolist():
            rest = flat[starts[w] + _COLUMNS : ends[w]]
            hashes[w : w + 1] += ((_BYTE[_LOWER[rest]] if lower else _BYTE[rest]) * powers[_COLUMNS : size[w]]).sum(dtype=np.uint64)
    return mix(hashes), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row (fewer words: the whole sequence as one; none: none) and their bounds."""
    n = len(words)
    out, ends = [], np.zeros(len(bounds), np.int64)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            full += words[i : n - k + 1 + i] * _STEP[i % 5] * np.uint64(2 * (i // 5) + 1)
        full = mix(full)
    for r in range(len(bounds) - 1):
        a, b = int(bounds[r]), int(bounds[r + 1])
        if b - a >= k:
            own = np.sort(full[a : b - k + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = mix(mix((words[a:b] * _STEP[np.arange(b - a) % 5]).sum(dtype=np.uint64, keepdims=True)) + np.uint64(b - a))
        else:
            own = words[:0]
        out.append(own)
        ends[r + 1] = ends[r] + len(own)
    return (np.concatenate(out) if out else words[:0]), ends


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
