"""Operator 10, LM scoring by an Elias-Fano n-gram trie.

Counting covers every training document: unigrams first, which give each word a number (in the order of its hash), then
bigrams of numbers, then trigrams of bigrams' places. The trie is cut into shards by the first word's hash; each is built by
one task and written to the shared folder as plain arrays that every worker memory-maps. Below the unigrams, a level is two
Elias-Fano sequences (low bits packed, high bits in unary, sampled for selection): pointers, which tell for each node of the
level above where its successors start, and the successors, raised by the last one of the node before so that they ascend. A
trigram's successor is stored relative to its context: as its rank among the successors of the word before it, of which
there are far fewer than words. Each node has one quantised smoothed log probability, and one back-off.

Smoothing: interpolated absolute discounting over add-one unigrams, log10 in 256 steps that reach down to the least
probability that the counts allow, so that nothing is clipped.

The folder of spark.checkpoint.dir must be one that executors can open as files (local, NFS, or mounted).
Defined cases: a null or empty text is the end token alone; without training rows N and V are 0 and every score is 0;
a null doc_id is neither held out nor trained on; repeated rows count as often as they occur; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, documents, id_text, shared_dir, signed, slices, small_batches, text_bytes, word_hashes

DISCOUNT = 0.75
#: Files of shards that a worker keeps open at once.
MAX_OPEN = 4096
#: Words and tokens of a shard, about; bytes of text that are hashed at once; tokens that a task looks up together, and tokens
#: whose counts it merges before it sends them.
SHARD_WORDS, SHARD_TOKENS, PART_BYTES, PART_TOKENS, MERGE_ROWS = 1 << 17, 1 << 22, 1 << 18, 1 << 19, 1 << 21
#: Numbers that a sequence is written or read by at a time.
BLOCK = 1 << 16
ONE = np.uint64(1)
#: For sums within a 64-bit word: alternate bits, pairs and halves of bytes, and each byte's lowest and highest bit.
EACH = [np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80)]
#: Place of the k-th one of a byte b, at 8 * b + k.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)
#: The end token's hash; the lowest bit of a word's is cleared by `token_hashes`.
END = np.uint64(0x45E4D)


def quantise(log10p: np.ndarray, step: float) -> np.ndarray:
    return np.rint(-log10p / step).astype(np.uint8)


def put(words: np.ndarray, place: np.ndarray, bits: np.ndarray) -> None:
    """Sets the bits from each place (ascending) on, as far as they are within its word."""
    word = place >> 6
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[first]] |= np.bitwise_or.reduceat(bits << (place & 63).astype(np.uint64), first)


class EliasFano:
    """A sorted sequence of distinct 64-bit numbers, as the arrays low, high, zeros and ones, and three scalars.
    For `access`, numbers may repeat."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shape: np.ndarray, ones: np.ndarray | None = None) -> None:
        self.low, self.high, self.zeros, self.ones = low, high, zeros, ones
        self.n, self.bits, self.buckets = (int(x) for x in shape)

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """values: sorted uint64 below universe."""
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        buckets = (int(universe - 1) >> bits) + 1 if universe else 1
        high, low = np.zeros((n + buckets) // 64 + 2, np.uint64), np.zeros(n * bits // 64 + 2, np.uint64)
        for i in range(0, n, BLOCK):  # memory for a block, whose low bits are whole words
            own, rank = values[i : i + BLOCK], np.arange(i, min(n, i + BLOCK))
            put(high, (own >> np.uint64(bits)).astype(np.int64) + rank, np.full(len(own), ONE))
            if bits:
                rest, place = own & np.uint64((1 << bits) - 1), rank * bits
                put(low, place, rest)
                over = np.flatnonzero((place & 63) + bits > 64)  # one of a word at most
                low[(place[over] >> 6) + 1] |= rest[over] >> (np.uint64(64) - (place[over] & 63).astype(np.uint64))
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        zeros = 64 * np.arange(len(high), dtype=np.int64)
        zeros[1:] -= ones[:-1]
        before = np.append(0, ones[:-1])
        return {"low": low, "high": high, "zeros": zeros, "ones": before, "shape": np.array([n, bits, buckets], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * self.bits
        word = place >> 6
        place &= 63
        shift = place.view(np.uint64)
        got = self.low[word] >> shift
        word += 1
        got |= (self.low[word] << ONE) << (np.uint64(63) - shift)
        got &= np.uint64((1 << self.bits) - 1)
        return got

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        return self._select(k, self.zeros, ~np.uint64(0))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i, all of which are there."""
        if not len(i):
            return np.zeros(0, np.int64)
        if len(i) > BLOCK:
            return np.concatenate([self.access(i[a : a + BLOCK]) for a in range(0, len(i), BLOCK)])
        top = self._select(i, self.ones, np.uint64(0)) - i
        return (top << self.bits) | self._low(i).view(np.int64)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places i and i + 1, all of which are there."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self._select(i, self.ones, np.uint64(0))
        ahead = self._ahead(at + 1)
        gap = np.bitwise_count((ahead & (~ahead + ONE)) - ONE).astype(np.int64)  # zeros before the next one
        after = at + gap - i  # of the next one: its place less its rank
        far = np.flatnonzero(gap == 64)
        after[far] = self._select(i[far] + 1, self.ones, np.uint64(0)) - i[far] - 1
        at -= i
        return (at << self.bits) | self._low(i).view(np.int64), (after << self.bits) | self._low(i + 1).view(np.int64)

    def _ahead(self, place: np.ndarray) -> np.ndarray:
        """The 64 high bits from each place on."""
        word, shift = place >> 6, (place & 63).view(np.uint64)
        got = self.high[word] >> shift
        word += 1
        got |= (self.high[word] << ONE) << (np.uint64(63) - shift)
        return got

    def _select(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).view(np.uint64)
        w = self.high[word] ^ flip
        # ones up to the end of each byte; then the byte, and the place in it by table
        sums = w - ((w >> ONE) & EACH[0])
        sums = (sums & EACH[1]) + ((sums >> np.uint64(2)) & EACH[1])
        sums = ((sums + (sums >> np.uint64(4))) & EACH[2]) * EACH[3]
        shift = np.bitwise_count((((left * EACH[3]) | EACH[4]) - sums) & EACH[4]).astype(np.uint64) << np.uint64(3)
        left -= ((sums << np.uint64(8)) >> shift) & np.uint64(255)
        byte = ((w >> shift) & np.uint64(255)) << np.uint64(3) | left
        word <<= 6
        word += shift.view(np.int64)
        word += IN_BYTE[byte.view(np.int64)]
        return word

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each number of x in the sequence, -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        ask = np.flatnonzero((top >= 0) & (top < self.buckets))
        top = top[ask]
        start = np.zeros(len(top), np.int64)  # among the high bits
        inner = np.flatnonzero(top)
        start[inner] = self._zero(top[inner] - 1) + 1
        ahead = self._ahead(start)
        run = np.bitwise_count(ahead ^ (ahead + ONE)).astype(np.int64) - 1
        lo = start - top
        hi = lo + run
        far = np.flatnonzero(run == 63)
        hi[far] = self._zero(top[far]) - top[far]
        some = np.flatnonzero(hi > lo)
        lo, hi, ask = lo[some], hi[some], ask[some]
        want = x[ask] & np.uint64((1 << self.bits) - 1)
        # the low bits ascend within a bucket, and are about even: places are guessed from the values at both ends, and every
        # third time the middle is taken, so that uneven ones don't take long
        under, over, turn = np.zeros(len(lo)), np.full(len(lo), float(1 << self.bits)), 0
        while len(lo):
            turn += 1
            if turn % 3:
                mid = lo + ((want - under) / (over - under) * (hi - lo)).astype(np.int64)
                np.clip(mid, lo, hi - 1, out=mid)
            else:
                mid = (lo + hi) >> 1
            got = self._low(mid)
            same = got == want
            out[ask[same]] = mid[same]
            less = got < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            live = np.flatnonzero((lo < hi) & ~same)
            less, got = less[live], got[live].astype(np.float64)
            under, over = np.where(less, got + 1, under[live]), np.where(less, over[live], got)
            lo, hi, want, ask = lo[live], hi[live], want[live], ask[live]
            np.maximum(over, under + 1, out=over)
        return out


class Children:
    """Successors of the nodes of a level: pointers to where each node's start, and one ascending sequence of them all."""

    KEYS = ("low", "high", "zeros", "ones", "shape")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.pointers, self.values = (EliasFano(*[arrays[kind + k] for k in ("low", "high", "zeros", "shape", "ones")]) for kind in ("at_", ""))

    @staticmethod
    def arrays(node: np.ndarray, value: np.ndarray, nodes: int) -> dict[str, np.ndarray]:
        """node and value: sorted by both, distinct; nodes: their number, those without successors too."""
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(node)))
        raised = np.cumsum(value[first + sizes - 1] + 1)
        values = value + np.repeat(np.append(0, raised)[:-1], sizes) if len(node) else value
        starts = np.searchsorted(node, np.arange(nodes + 1))
        pointers = EliasFano.arrays(starts.astype(np.uint64), len(node) + 1)
        return EliasFano.arrays(values.astype(np.uint64), int(raised[-1]) if len(node) else 1) | {f"at_{k}": a for k, a in pointers.items()}

    def starts(self, node: np.ndarray) -> np.ndarray:
        return self.pointers.access(node)

    def _raised(self, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        inner = np.flatnonzero(start > 0)
        out[inner] = self.values.access(start[inner] - 1) + 1
        return out

    def find(self, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each node's successor (-1: none), and where the node's start. Fastest where equal nodes stand together."""
        if not len(node):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.append(True, node[1:] != node[:-1])
        own, back = node[new], np.cumsum(new) - 1
        start, end = self.pointers.access_two(own)
        raised = self._raised(start)[back]
        raised += value
        start, end = start[back], end[back]
        at = np.full(len(node), -1, np.int64)
        ask = np.flatnonzero(end > start)
        at[ask] = self.values.find(raised[ask].view(np.uint64))
        at[(at < start) | (at >= end)] = -1
        return at, start

    def all_values(self, nodes: int) -> np.ndarray:
        """The successors of all nodes, as they were before they were raised."""
        starts = self.starts(np.arange(nodes + 1))
        sizes = np.diff(starts)
        some = np.flatnonzero(sizes)
        return self.values.access(np.arange(self.values.n)) - np.repeat(self._raised(starts[:-1][some]), sizes[some])


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file, which is put in place whole under a name of its own first, so that attempts of a task on several
    machines may write at once: they write the same."""
    os.makedirs(folder, exist_ok=True)
    at, places = 0, {}
    for key, a in arrays.items():
        places[key] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).data)
            f.write(bytes(-a.nbytes % 8))
    os.replace(own, f"{folder}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    data = np.asarray(np.memmap(f"{folder}/{name}", np.uint8, "r"))
    at = 8 + int(data[:8].view(np.int64)[0])
    return {k: data[at + a : at + a + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, a) in json.loads(data[8:at].tobytes()).items()}


def token_hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row followed by END, and the rows' bounds."""
    words, bounds = word_hashes(*text_bytes(part.column("text")))
    words &= ~ONE
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def token_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Hashes and bounds of about PART_TOKENS tokens at a time (a single longer row is taken whole), and the rows without text.
    Texts are hashed in small slices and not held."""
    held, rows = [], 0

    def out() -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
        hashes, bounds, parts = zip(*held, strict=True)
        at = np.cumsum([0, *(len(h) for h in hashes)])
        held.clear()
        return np.concatenate(hashes), np.concatenate([[0], *(b[1:] + a for b, a in zip(bounds, at, strict=False))]), list(parts)

    for batch in batches:
        for part in slices(batch, most=PART_BYTES) if batch.num_rows else ():
            hashes, bounds = token_hashes(part)
            held.append((hashes, bounds, part.drop_columns(["text"])))
            rows += len(hashes)
            if rows >= PART_TOKENS:
                yield out()
                rows = 0
    if held:
        yield out()


def distinct(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, all below `most`, and the place of each key's among them. Keys are sorted with their places in the
    lowest bits, which is much faster than sorting places by keys. Of keys that are too long for that (hashes, spread evenly),
    the highest bits are taken, and if two differ in the others alone, the plain way is gone."""
    n = len(keys)
    width = np.uint64(max(1, (n - 1).bit_length()))
    keys = keys.view(np.uint64)
    cut_off = np.uint64(max(0, int(most - 1).bit_length() + int(width) - 64))
    packed = ((keys >> cut_off) << width) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((ONE << width) - ONE)).view(np.int64)
    ordered = keys[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    if cut_off:
        packed >>= width
        if (new[1:] & (packed[1:] == packed[:-1])).any():
            return np.unique(keys, return_inverse=True)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with how often they occur; keys are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def packed_run(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte plane by byte plane, without the highest planes that are empty: compresses well."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    most = int(numbers.max()) if len(numbers) else 0
    return planes[: max(1, -(-most.bit_length() // 8))].tobytes()


def unpacked_run(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<i8")


def counted(df: DataFrame, keys_of: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Rows of a 64-bit key and its count c, merged within each task before they are sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in tallies(batches, keys_of()):
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_pydict({"key": signed(keys[i : i + (1 << 18)]), "c": counts[i : i + (1 << 18)]})

    return df.mapInArrow(run, "key long, c long")


def tallies(batches: Iterator[pa.RecordBatch], work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all tokens with their counts, merged over MERGE_ROWS tokens at a time."""
    held, rows = [], 0
    for hashes, bounds, _ in token_parts(batches):
        held.append(work(hashes, bounds))
        rows += len(held[-1])
        if rows >= MERGE_ROWS:
            keys = np.concatenate(held)
            held.clear()
            rows = 0
            yield tallied(keys)
    if held:
        keys = np.concatenate(held)
        held.clear()
        yield tallied(keys)


RUN = "shard int, n int, keys binary, counts binary"


def counted_runs(df: DataFrame, keys_of: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], shard_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Sorted runs of keys with their counts, one row for each shard and merge: keys as steps from each to the next, so that they
    take few bytes in a shuffle. shard_of ascends with the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in tallies(batches, keys_of()):
            shard = shard_of(keys)
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            rows: list[tuple] = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                steps = keys[a:b].copy()
                steps[1:] -= keys[a : b - 1]
                rows.append((int(shard[a]), b - a, packed_run(steps), packed_run(counts[a:b])))
            names, kinds = ("shard", "n", "keys", "counts"), (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(run, RUN)


def from_runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all runs of a shard, with the sums of their counts."""
    sizes = rows["n"].to_pylist()
    keys, extra, by, at = np.empty(sum(sizes), np.int64), [], [], 0
    for n, k, c in zip(sizes, rows["keys"], rows["counts"], strict=True):
        own = np.cumsum(unpacked_run(k.as_buffer(), n), out=keys[at : at + n])
        counts = unpacked_run(c.as_buffer(), n)
        more = np.flatnonzero(counts > 1)
        extra.append(own[more])
        by.append(counts[more] - 1)
        at += n
    # most counts are 1, so that keys are sorted alone and what counts have beyond 1 is added
    keys, counts = tallied(keys)
    np.add.at(counts, np.searchsorted(keys, np.concatenate(extra)), np.concatenate(by))
    return keys, counts


class Model:
    """The trie's files, opened when asked for. bits: of a hash that number a word's shard; firsts: each shard's first word number."""

    def __init__(self, folder: str, bits: int, firsts: list[int], tokens: int) -> None:
        self.folder, self.bits, self.firsts, self.tokens = folder, bits, np.array(firsts, np.int64), tokens
        self.words = firsts[-1]
        # (c - DISCOUNT) / total, DISCOUNT * kinds / total and add-one shares are all a quarter of 1 / (N + V + 1) at least
        self.step = float(np.log10(4 * (tokens + self.words + 1))) / 255
        #: The number of each shard's first bigram, and of the most successors that a word has; set once bigrams are built.
        self.pair_firsts, self.most = np.zeros(1, np.int64), 1
        self.order = 2
        self.open: OrderedDict[tuple[str, int], dict] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": OrderedDict()}

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def level(self, kind: str, shard: int) -> dict:
        if (kind, shard) in self.open:
            self.open.move_to_end((kind, shard))
        else:
            if len(self.open) >= MAX_OPEN:
                self.open.popitem(last=False)
            name = f"{kind}-{shard}"
            got = load(self.folder, name) if os.path.exists(f"{self.folder}/{name}") else {}
            if got:
                got["keys"] = EliasFano(got["low"], got["high"], got["zeros"], got["shape"]) if kind == "word" else Children(got)
            self.open[kind, shard] = got
        return self.open[kind, shard]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number (-1: unknown) and count of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if not self.words:
            return number, count
        shard = self.shard_of(hashes)
        edges = np.searchsorted(shard, np.arange(len(self.firsts)))
        for s in np.flatnonzero(np.diff(edges)):
            if own := self.level("word", int(s)):
                a, b = edges[s], edges[s + 1]
                at = own["keys"].find(hashes[a:b] & np.uint64((1 << (64 - self.bits)) - 1) if self.bits else hashes[a:b])
                ok = at >= 0
                number[a:b][ok] = at[ok] + self.firsts[s]
                count[a:b][ok] = own["count"][at[ok]]
        return number, count

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted word numbers."""
        out, edges = np.zeros(len(numbers), np.int64), np.searchsorted(numbers, self.firsts)
        for s in np.flatnonzero(np.diff(edges)):
            a, b = edges[s], edges[s + 1]
            out[a:b] = self.level("word", int(s))["count"][numbers[a:b] - self.firsts[s]]
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.words + 1))

    def pairs(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Keys context * (V + 1) + successor of all rows' token pairs; the context before a row is V. All words known."""
        known, place = distinct(hashes, 1 << 64)
        number = self.numbers(known)[0][place]
        return self._before(number, bounds) * (self.words + 1) + number

    def _before(self, number: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[bounds[:-1]] = self.words
        return before

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        """The shard of the context; that of the row start (number V) is the last."""
        context = keys.astype(np.int64) // (self.words + 1)
        return np.minimum(np.searchsorted(self.firsts, context, "right") - 1, len(self.firsts) - 2)

    def build(self, shard: int, keys: np.ndarray, counts: np.ndarray) -> int:
        """Writes the bigrams of a shard, sorted keys with their counts; gives the most successors of a word."""
        wide = self.words + 1
        context, word = keys // wide, keys % wide
        order = np.argsort(word, kind="stable")
        low = np.empty(len(keys))
        low[order] = 10 ** self.base(self.counts_of(word[order]))
        at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        kinds = np.diff(np.append(at, len(keys)))
        total = np.add.reduceat(counts, at)
        back = DISCOUNT * kinds / total
        p = (counts - DISCOUNT) / np.repeat(total, kinds) + np.repeat(back, kinds) * low
        first, places = int(self.firsts[shard]), self.places(shard)
        backs = np.zeros(places, np.uint8)
        backs[context[at] - first] = quantise(np.log10(back), self.step)
        arrays = Children.arrays(context - first, word, places)
        save(self.folder, f"pair-{shard}", arrays | {"code": quantise(np.log10(p), self.step), "back": backs})
        return int(kinds.max())

    def places(self, shard: int) -> int:
        """Contexts of a shard of bigrams; the last one holds the row start too."""
        return int(self.firsts[shard + 1] - self.firsts[shard]) + (shard == len(self.firsts) - 2)

    def _pairs_of(self, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a token's context and the token, as context * (V + 1) + token, and each token's among them."""
        key, where = distinct(self._before(number, bounds) * (self.words + 1) + number, (self.words + 1) ** 2)
        return key.view(np.int64), where

    def triples(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Keys bigram * most + rank of all rows' token triples, the row start counted as a token. All bigrams known."""
        known, place = distinct(hashes, 1 << 64)
        number = self.numbers(known)[0]
        key, where = self._pairs_of(number[place], bounds)
        at, rank = self.linked(key // (self.words + 1), key % (self.words + 1))[:2]
        later = np.ones(len(place), bool)
        later[bounds[:-1]] = False
        i = np.flatnonzero(later)
        return at[where[i - 1]] * self.most + rank[where[i]]

    def triple_shard(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pair_firsts, keys.astype(np.int64) // self.most, "right") - 1

    def build_triples(self, shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """Writes the trigrams of a shard: sorted keys with their counts."""
        pairs = self.level("pair", shard)["keys"]
        nodes = pairs.values.n
        bigram, rank = keys // self.most - self.pair_firsts[shard], keys % self.most
        middle = pairs.all_values(self.places(shard))[bigram]
        order = np.argsort(middle)
        edges = np.searchsorted(middle[order], self.firsts)
        low, share = np.empty(len(keys)), 10 ** (-self.step * np.arange(256))
        for s in np.flatnonzero(np.diff(edges)):
            own, mine = self.level("pair", int(s)), order[edges[s] : edges[s + 1]]
            word = middle[mine] - self.firsts[s]
            new = np.append(True, word[1:] != word[:-1])
            low[mine] = share[own["code"][own["keys"].starts(word[new])[np.cumsum(new) - 1] + rank[mine]]]
        at = np.flatnonzero(np.append(True, bigram[1:] != bigram[:-1]))
        kinds = np.diff(np.append(at, len(keys)))
        total = np.add.reduceat(counts, at)
        back = DISCOUNT * kinds / total
        p = (counts - DISCOUNT) / np.repeat(total, kinds) + np.repeat(back, kinds) * low
        backs = np.zeros(nodes, np.uint8)
        backs[bigram[at]] = quantise(np.log10(back), self.step)
        save(self.folder, f"triple-{shard}", Children.arrays(bigram, rank, nodes) | {"code": quantise(np.log10(p), self.step), "back": backs})

    def linked(self, context: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of a context (-1: unknown, V: row start; ascending) and a word number (-1: unknown): the bigram's number and
        its rank among its context's (-1: no such bigram), its log10 probability, and the context's back-off."""
        place, rank = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        p, back = np.zeros(len(context)), np.zeros(len(context))
        shard = np.minimum(np.searchsorted(self.firsts, context, "right") - 1, len(self.firsts) - 2)
        shard[context == self.words] = len(self.firsts) - 2
        edges = np.searchsorted(shard, np.arange(-1, len(self.firsts)))
        for s in range(len(self.firsts) - 1):
            a, b = edges[s + 1], edges[s + 2]
            if a == b or not (own := self.level("pair", s)):
                continue
            local = context[a:b] - self.firsts[s]
            back[a:b] = -self.step * own["back"][local]
            ask = np.flatnonzero(number[a:b] >= 0)
            at, start = own["keys"].find(local[ask], number[a:b][ask])
            ok = at >= 0
            p[a:b][ask[ok]] = -self.step * own["code"][at[ok]]
            rank[a:b][ask[ok]] = (at - start)[ok]
            place[a:b][ask[ok]] = at[ok] + self.pair_firsts[s]
        return place, rank, p, back

    def longer(self, place: np.ndarray, rank: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probabilities after two words, from the bigram before (its number, ascending but for -1: unknown), the rank of the bigram that
        follows (-1: unknown) and that one's log10 probability."""
        out = p.copy()
        known = np.flatnonzero(place >= 0)
        node, rank = place[known], rank[known]
        edges = np.searchsorted(node, self.pair_firsts)
        for s in np.flatnonzero(np.diff(edges)):
            if not (own := self.level("triple", int(s))):
                continue
            a, b = edges[s], edges[s + 1]
            local = node[a:b] - self.pair_firsts[s]
            out[known[a:b]] -= self.step * own["back"][local]
            ask = np.flatnonzero(rank[a:b] >= 0)
            at = own["keys"].find(local[ask], rank[a:b][ask])[0]
            ok = np.flatnonzero(at >= 0)
            out[known[a:b][ask[ok]]] = -self.step * own["code"][at[ok]]
        return out

    def score(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: tokens known, base score and model score."""
        known, place = distinct(hashes, 1 << 64)
        number, count = self.numbers(known)
        base = self.base(count)
        lower = -self.step * quantise(base, self.step)
        before = self._before(number[place], bounds)
        # each distinct pair is asked for once, sorted, and so by shard
        pair, where = distinct((before + 1) * len(known) + place, (self.words + 2) * len(known))
        context, word = (x.view(np.int64) for x in np.divmod(pair, np.uint64(len(known))))
        context = context - 1
        p = lower[word].astype(np.float64)
        token = p[where]
        if self.words:
            at, rank, seen, back = self.linked(context, number[word])
            p = np.where(at >= 0, seen, p + back)
            token = p[where]
            if self.order > 2:
                later = np.ones(len(place), bool)
                later[bounds[:-1]] = False
                i = np.flatnonzero(later)
                both, here = distinct(where[i - 1] * len(pair) + where[i], len(pair) ** 2)
                first, last = (x.view(np.int64) for x in np.divmod(both, np.uint64(len(pair))))
                token[i] = self.longer(at[first], rank[last], p[last])[here]
        rows = bounds[:-1]
        return np.add.reduceat((count > 0)[place].astype(np.int64), rows), np.add.reduceat(base[place], rows), np.add.reduceat(token, rows)


def local_path(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the trie's files need a shared folder that executors can open as files, not {uri}")
    return parts.path


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts all rows of docs (doc_id, text), and writes the trie of two orders or three."""
    with small_batches(docs.sparkSession):
        return _train(docs, order)


def _train(docs: DataFrame, order: int) -> Model:
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark, "trie"))
    words = cut(counted(docs.select("text"), lambda: lambda hashes, bounds: hashes).groupBy("key").agg(F.sum("c").alias("c")), "words")
    n, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    bits = max(n // SHARD_WORDS, tokens // SHARD_TOKENS).bit_length()

    def write_words(key: tuple, rows: pa.Table) -> pa.Table:
        h, c = rows["key"].to_numpy().view(np.uint64), rows["c"].to_numpy()
        order = np.argsort(h)
        h = h[order] & np.uint64((1 << (64 - bits)) - 1) if bits else h[order]
        save(folder, f"word-{key[0].as_py()}", EliasFano.arrays(h, 1 << (64 - bits)) | {"count": c[order]})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(h)], pa.int64())})

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    written = words.withColumn("shard", shard).groupBy("shard").applyInArrow(write_words, "shard long, n long")
    sizes = {r["shard"]: r["n"] for r in written.collect()}  # one row a shard
    firsts = [0, *np.cumsum([sizes.get(s, 0) for s in range(1 << bits)]).tolist()]
    model = Model(folder, bits, firsts, tokens)
    if not n:
        return model

    def keys_of() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return model.pairs

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = from_runs(rows)
        most = model.build(key[0].as_py(), keys, counts)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "most": pa.array([most], pa.int64())})

    pairs = counted_runs(docs.select("text"), keys_of, model.pair_shard)
    made = {r["shard"]: r for r in pairs.groupBy("shard").applyInArrow(build, "shard int, n long, most long").collect()}  # one row a shard
    model.pair_firsts = np.append(0, np.cumsum([made[s]["n"] if s in made else 0 for s in range(1 << bits)])).astype(np.int64)
    model.most = max(r["most"] for r in made.values())
    model.order = order
    if order < 3:
        return model

    def triples_of() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        return model.triples

    def build_triples(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = from_runs(rows)
        model.build_triples(key[0].as_py(), keys, counts)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    triples = counted_runs(docs.select("text"), triples_of, model.triple_shard)
    triples.groupBy("shard").applyInArrow(build_triples, "shard int, n long").collect()  # one row a shard
    return model


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows that aren't held out. order: words
    of the longest n-grams, 2 or 3."""
    with small_batches(docs.sparkSession):
        return cut(_scores(docs, order), "scores")


def _scores(docs: DataFrame, order: int) -> DataFrame:
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 7 = 2"), F.lit(False))
    rows = id_text(docs)
    model = _train(rows.where(F.expr("crc32(cast(doc_id as string)) % 7 <> 2")), order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, bounds, parts in token_parts(batches):
            known, base, score = model.score(hashes, bounds)
            ids = pa.Table.from_batches(parts).combine_chunks()
            doc, out = (ids[c].combine_chunks() for c in ("doc_id", "held_out"))
            yield pa.RecordBatch.from_arrays([doc, out, pa.array(np.diff(bounds)), pa.array(known), pa.array(np.full(len(known), model.tokens, np.int64)), pa.array(base), pa.array(score)], names=names)

    return rows.withColumn("held_out", held).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), 3)
