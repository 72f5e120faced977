"""Operator 1, n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document is its sorted array of distinct 64-bit shingle hashes. Equal sets are one class from the start. Documents meet in
tiles: those that share a rare shingle (or a min-hash) and whose sizes lie in one band or the next. Within a tile, parity
bitmaps are compared first: sets that differ in d shingles differ in at most d bits, so the bit count bounds the overlap
from above, and only pairs that could reach the threshold go on. Those are intersected exactly, from their texts.

Rounds keep every link that matters without listing all pairs of a group, as only reachability is asked for. The first
links each document with the first one of its min-hash tiles; verified links form components. Then the prefix of every set
is indexed (the shingles of which any set within the threshold must share one, common shingles last), and only tiles that
hold two components are looked at. Hub rounds link each of their documents with one document that each tile draws, so their
pairs grow with the rows; documents with many verified links are drawn more often, as the original of many copies has them.
The last round is complete: documents of different components that are left in a tile and a band meet if their sizes and
the places of the shared shingle in both prefixes still allow the overlap; then bitmaps, then exact intersection.

Defined cases: null and empty texts, and texts without words, have no shingles and link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are one node; a row with a null doc_id gets the smallest doc_id of
its class, or null; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import (
    cut, documents, forget, id_text, join_groups, map_texts, mix, shingle_hashes, sieved, slices, small_batches, text_bytes, without_ids, word_hashes,
)

#: Two sets link at 100 * |intersection| >= PERCENT * |union|.
PERCENT, WORDS = 80, 5
#: Rounds that compare each document of a tile with one other only, before the complete round: so many at most, none after
#: one that verified fewer than PRODUCTIVE of the pairs that it compared, and only for tiles of more than FEW documents.
#: The last round is complete whatever they do.
HUB_ROUNDS, PRODUCTIVE, FEW = 3, 0.25, 8
#: Bands of the complete round are so many steps of the sizes' largest ratio wide; one document in so many is in two bands.
BAND_STEPS = 3
#: Bits of a bitmap for each shingle, at least: enough to tell sets a little below the threshold from sets above it.
BITS_EACH = 4
#: Counters of the frequency sketch: bounded, 4 MB on the driver and in each task.
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 13
#: Min-hashes of round 1.
MINS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(*text_bytes(texts)), words)


def sketch(rows: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall to each of 2^SKETCH_BITS counters; summed by blocks on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                sets, _ = shingle_sets(part.column("text"))
                count += np.bincount((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(count))
        if count.any():
            blocks = count.reshape(-1, SKETCH_BLOCK).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"block": np.arange(len(blocks), dtype=np.int32), "counts": [b.tobytes() for b in blocks]})

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for b in parts["counts"]:
            total += np.frombuffer(b.as_buffer(), np.int32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    sums = rows.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in sums.collect():  # 2^SKETCH_BITS counters, whatever the input
        total[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def levels(count: np.ndarray) -> np.ndarray:
    """Rank of each counter for the prefix order: 0 for what chance explains, then doublings above it."""
    mean = count.mean()
    over = count - mean - 6 * np.sqrt(mean + 1) - 32
    return np.where(over > 0, np.log2(np.maximum(over, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall to each bit; a power of two of bits, no fewer than BITS_EACH a shingle."""
    bits = max(64, 1 << (BITS_EACH * len(own) - 1).bit_length()) if len(own) else 64
    odd = (np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """A bitmap of a quarter of the bits: each one the parity of the four that fall together."""
    return np.bitwise_xor.reduce(bits.reshape(4, -1)) if len(bits) >= 4 else bits


def digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def signatures(rows: DataFrame, level: np.ndarray) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), bits, few (bits, folded), mins, keys (prefix, in order) of every row."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def work(part: pa.RecordBatch) -> dict:
            sets, ends = shingle_sets(part.column("text"))
            out: dict[str, list] = {k: [] for k in ("n", "d1", "d2", "bits", "few", "mins", "keys")}
            rank = level[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own, n = sets[a:b], b - a
                d1, d2 = digest(own).tolist()
                out["n"].append(n)
                out["d1"].append(d1)
                out["d2"].append(d2)
                out["bits"].append(bitmap(own))
                out["few"].append(folded(out["bits"][-1]))
                out["mins"].append(np.array([mix(own ^ c).min() for c in MINS]).view(np.int64) if n else [])
                prefix = n - -(-PERCENT * n // 100) + 1 if n else 0
                order = np.argsort(rank[a:b], kind="stable")[:prefix]  # by level, then by hash
                out["keys"].append(own[order].view(np.int64))
            return out | {"doc_id": part.column("doc_id")}

        return work

    return map_texts(rows, "doc_id long, n int, d1 long, d2 long, bits array<long>, few array<long>, mins array<long>, keys array<long>", make)


def may_link(a: str, b: str) -> str:
    """SQL: whether sizes and bitmaps allow the pair; a and b prefix the columns n and bits."""
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"
    fold = lambda x, y: f"if(size({x}) > size({y}), {half(x)}, {x})"
    na, nb, ba, bb = f"{a}n", f"{b}n", f"{a}bits", f"{b}bits"
    sizes = f"100 * least({na}, {nb}) >= {PERCENT} * greatest({na}, {nb})"
    # overlap <= (na + nb - differing bits) / 2, and the threshold is overlap * (100 + PERCENT) >= PERCENT * (na + nb)
    bits = f"aggregate(zip_with({fold(ba, bb)}, {fold(bb, ba)}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"
    return f"if({sizes}, cast({na} + {nb} as long) * {100 - PERCENT} >= cast({100 + PERCENT} as long) * {bits}, false)"


def band_of(n: Column, steps: int = 1, ahead: int = 0) -> Column:
    """The size band of n, or of a size one largest ratio ahead; bands are `steps` such ratios wide."""
    # a step is a little wider than the sizes' largest ratio, so that rounding can't set a pair two steps apart
    place = F.log(n.cast("double")) / float(np.log(1.0001 * 100 / PERCENT))
    return F.floor((place + ahead) / steps).cast("int")


def banded(n: Column, steps: int = 1) -> Column:
    """The bands of n and of the largest size that n may link with: the smaller of two sets is in the larger one's band."""
    return F.explode(F.array_distinct(F.array(band_of(n, steps), band_of(n, steps, 1))))


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Texts go once to the ids asked for, then to the pairs' first ids."""
    need = pairs.select("a", F.col("b").alias("doc_id")).unionByName(pairs.select("a", F.col("a").alias("doc_id")).distinct())
    asked = sieved(rows, F.col("doc_id"), need.select("doc_id").distinct(), "asked").where("asked").drop("asked")
    texts = need.join(asked, "doc_id")
    left = texts.where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    right = texts.where("doc_id = a").select("a", F.col("text").alias("a_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for part in slices(batch, "b_text") if batch.num_rows else ():
                ids = part.column("a").to_pylist()
                sets, ends = shingle_sets(part.column("b_text"))
                keep = []
                for i, a in enumerate(ids):
                    if a != last:
                        last, own = a, shingle_sets(part.column("a_text").slice(i, 1))[0]
                    other = sets[ends[i] : ends[i + 1]]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(own) + len(other) - both) and both > 0)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    return left.join(right, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc_id, root (smallest id that it reaches) of all ids on edges (a, b), by alternating large and small stars."""
    now = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges")
    told = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select("y", "m").distinct()
        small = large.groupBy("y").agg(F.min("m").alias("r"))
        joined = large.join(small, "y")
        new = cut(joined.where("m <> r").select(F.col("r").alias("u"), F.col("m").alias("v")).unionByName(small.select(F.col("r").alias("u"), F.col("y").alias("v"))).distinct(), "edges")
        count = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        forget(now)
        if count == told:
            return new.select(F.col("v").alias("doc_id"), F.col("u").alias("root"))
        now, told = new, count


def merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """root (doc_id, root) after verified links between ids of any components."""
    of = lambda c: root.select(F.col("doc_id").alias(c), F.col("root").alias(f"{c}_root"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    top = components(across)
    whole = root.join(top.select(F.col("doc_id").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut(whole.select("doc_id", F.coalesce("top", "root").alias("root")).unionByName(top.join(root, "doc_id", "left_anti")), "roots")


def degrees(links: DataFrame) -> DataFrame:
    """doc_id and its number of verified links."""
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id")))
    return ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"))


def allowed(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link, folded bitmaps first; written. Only bitmaps that a pair may ask
    for are moved."""
    pairs = cut(pairs, "pairs")
    for which in ("few", "bits"):
        asked = sieved(bits, F.col("doc_id"), pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "asked").where("asked")
        side = lambda x: asked.select(F.col("doc_id").alias(x), F.struct("n", F.col(which).alias("bits")).alias(f"s{x}"))  # noqa: B023, E731
        pairs = cut(pairs.join(side("b"), "b").join(side("a"), "a").where(may_link("sa.", "sb.")).select("a", "b").distinct(), "candidates")
    return pairs


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def drawn(turn: int) -> Column:
    """The document that a tile draws: each has a chance in proportion to its links (plus one), by its hash."""
    chance = (F.pmod(F.xxhash64("doc_id", "key", F.lit(turn)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.min(F.struct((-F.log(chance) / (1 + F.coalesce("links", F.lit(0)))).alias("h"), "doc_id", "comp", "n", "pos")).alias("hub")


def reach(x: str, y: str) -> Column:
    """Whether sizes, and places of a shared shingle, allow the overlap, if no shingle before it in either set is shared."""
    sizes = f"100 * least({x}n, {y}n) >= {PERCENT} * greatest({x}n, {y}n)"
    places = f"{100 + PERCENT} * cast(least({x}n - {x}pos, {y}n - {y}pos) as long) >= {PERCENT} * (cast({x}n as long) + {y}n)"
    return F.expr(f"{sizes} and {places}")


def all_pairs(tiles: DataFrame) -> DataFrame:
    """(a, b): documents of different components that share a tile and a band, as far as sizes and places allow."""
    # a pair that shares two bands is taken in the larger set's own one, once
    many = tiles.withColumn("own", band_of(F.col("n"), BAND_STEPS)).withColumn("band", banded(F.col("n"), BAND_STEPS))
    side = lambda x: many.select("key", "band", *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "comp", "own", "n", "pos")])
    x, y = side("x"), side("y")
    one = (x["key"] == y["key"]) & (x["band"] == y["band"]) & F.expr("x_comp < y_comp") & (x["band"] == F.greatest("x_own", "y_own"))
    return x.join(y, one & reach("x_", "y_")).select(*ordered("x_doc_id", "y_doc_id")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    with small_batches(docs.sparkSession):  # all that moves texts runs before this returns
        return _components_of(docs)


def _components_of(docs: DataFrame) -> DataFrame:
    rows = id_text(docs)
    level = levels(sketch(rows))
    sig = cut(signatures(rows, level), "signatures")
    plain = sig.select("doc_id", "n", "d1", "d2")
    classes = cut(plain.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    grouped = join_groups(plain.where("n > 0"), classes, ["n", "d1", "d2"], "copies").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    member = cut(grouped.unionByName(plain.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "classes")
    gone = cut(member.where("n > 0").groupBy("doc_id").agg(F.max(F.expr("doc_id = rep")).alias("stays")).where("not stays").select("doc_id"), "copies")
    one = sig.where("n > 0 and doc_id is not null").join(gone, "doc_id", "left_anti")
    bits = one.select("doc_id", "n", "few", "bits")

    # first round: each document with the first one of its min-hash tiles
    tile = one.select("doc_id", "n", F.explode("mins").alias("m")).select("doc_id", "n", "m", banded(F.col("n")).alias("band"))
    first_of = tile.groupBy("m", "band").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    firsts = cut(first_of, "groups")
    sized = f"doc_id > hub.doc_id and 100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)"
    near = join_groups(tile, firsts, ["m", "band"], "c").where(sized).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = allowed(near, bits)
    links = cut(verified(pairs, rows), "links")
    root = components(links)

    # prefix tiles that hold two components: hub rounds, then all pairs that are left
    def told(df: DataFrame) -> DataFrame:
        now = root.join(degrees(links), "doc_id")
        return df.join(now, "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")

    def mixed(df: DataFrame, *more: Column) -> DataFrame:
        groups = df.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"), *more)
        return cut(groups.where("lo < hi").drop("lo", "hi"), "groups")

    whole = told(one.select("doc_id", "n", "keys")).select("doc_id", "n", "comp", "links", F.posexplode("keys").alias("pos", "key"))
    groups = mixed(whole)  # most prefix shingles are in one component alone, so that few rows go to the tiles
    shared = sieved(whole, F.col("key"), groups.select("key"), "shared").where("shared").drop("shared")
    tiles = cut(join_groups(shared, groups, ["key"], "c"), "tiles")
    crowded = tiles.where(f"c > {FEW}").drop("c")
    sizes = f"100 * least(n, hub.n) >= {PERCENT} * greatest(n, hub.n)"
    spent = [pairs, links, firsts, classes, gone, groups, tiles]
    for turn in range(HUB_ROUNDS):
        groups = mixed(crowded, drawn(turn))
        apart = join_groups(crowded, groups, ["key"], "c").where("comp <> hub.comp").where(sizes)
        pairs = allowed(apart.select(*ordered("doc_id", "hub.doc_id")).distinct(), bits)
        fresh = cut(verified(pairs, rows), "links")
        spent += [groups, pairs, fresh, root]
        root, links = merged(root, fresh), links.unionByName(fresh)
        if fresh.count() <= PRODUCTIVE * pairs.count():
            break
        crowded = cut(told(crowded.drop("comp", "links")), "tiles")
        spent.append(crowded)
    now = cut(told(tiles.drop("comp", "links", "c")), "tiles")
    groups = mixed(now)
    tiles = cut(join_groups(now, groups, ["key"], "c").drop("c"), "tiles")
    spent += [groups, root, now]
    pairs = allowed(all_pairs(tiles), bits)
    root = merged(root, verified(pairs, rows))
    forget(sig, tiles, pairs, *spent)
    end = root.select(F.col("doc_id").alias("rep"), "root")
    return member.join(end, "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with the smallest doc_id of each group, all columns as they were; rows without a doc_id stay."""
    found = cut(jaccard_components(docs), "components")
    return without_ids(docs, cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


ORACLE_SQL = r"""
with recursive
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from w),
n as (select doc_id, cast(len(s) as bigint) as n from s),
e as (select doc_id, hash(unnest(s)) as g from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as hits from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * hits >= 80 * (na.n + nb.n - hits)),
r as (select doc_id as x, doc_id as root from n union select l.b, r.root from r join l on l.a = r.x)
select n.doc_id, n.n as n_shingles, min(r.root) as component_id from n join r on r.x = n.doc_id group by all
"""
