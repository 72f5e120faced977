"""Operator 8, byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes streams.

The merges compile to this automaton: after any prefix of a pre-token exactly one vocabulary token ends its encoding, and a
token may follow another if and only if the two stay apart when merged alone. A state holds the live starts: for each place
where a token may still be under way, the token before it and the trie node reached. States and steps are made when first
met and kept (up to a bound), so common text runs on table look-ups. A token is emitted once all live starts agree on it,
at the latest one longest token later.

Defined cases: a null or empty text has no ids; any Unicode text is encoded; repeated rows give repeated results; an empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, id_text, map_texts

#: Steps and pre-tokens that a worker keeps.
MAX_STEPS, MAX_PIECES = 600_000, 500_000


#: A space beside other white space.
_RUN = regex.compile(r" \s|\s ")


class Transducer:
    """BPE encoding of pre-tokens by the ranks of a vocabulary whose ranks are its ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]  # the token that a trie node spells
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][b]
            self.ends[node] = rank
        self.apart: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)  # (bytes back to the start, token before it, trie node)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        self.steps: dict[int, int] = {}  # (state, byte) to (state, token), each pair in one number

    def merged(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token, None for a single byte; (-1, -1) if merging its bytes never makes it."""
        if token not in self.split:
            data = self.bytes[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self.split[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it in) of what stands at the token's left (0) or right (1) edge over time."""
        key = (token, side)
        if key not in self.edges:
            out, taken = [], 1 << 60
            while True:
                out.append((token, taken))
                if (parts := self.halves(token)) is None:
                    break
                token, taken = parts[side], token
            self.edges[key] = out
        return self.edges[key]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether no merge reaches across the two: it would need both edges at a time when neither was taken in yet."""
        key = (before, token)
        if (known := self.apart.get(key)) is not None:
            return known
        if len(self.apart) > 4 * MAX_STEPS:
            self.apart.clear()
        size, ok = self.bytes, True
        for x, x_taken in self.edge(before, 1):
            for y, y_taken in self.edge(token, 0):
                across = self.ranks.get(size[x] + size[y])
                if across is not None and across < x_taken and across <= y_taken and (across > x or len(size[x]) == 1) and (across > y or len(size[y]) == 1):
                    ok = False
        self.apart[key] = ok
        return ok

    def _step(self, state: int, b: int) -> int:
        """The next state, and the token that ends the encoding of the prefix read so far."""
        live, last = [], -1
        for back, before, node in self.states[state]:
            if (to := self.child[node].get(b)) is not None:
                end = self.ends[to]
                if last < 0 and end >= 0 and self.halves(end) != (-1, -1) and (before < 0 or self.may_follow(before, end)):
                    last = end
                if self.child[to]:
                    live.append((back + 1, before, to))
        live.append((0, last, 0))
        key = tuple(live)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        self.steps[(state << 8) | b] = got = (self.number[key] << 24) | last
        return got

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one pre-token, each emitted as soon as all live starts agree on it."""
        if len(self.steps) > MAX_STEPS:
            self._reset()
        state, lasts = 0, []  # lasts[i]: the token that ends the prefix up to byte i + 1 of what isn't emitted yet
        steps = self.steps
        for b in data:
            got = steps.get((state << 8) | b) or self._step(state, b)
            state = got >> 24
            lasts.append(got & 0xFFFFFF)
            if len(lasts) % 64 == 0:
                starts = {len(lasts) - back for back, _, _ in self.states[state]}
                at = self._common(lasts, starts)
                yield from self._back(lasts, at)
                del lasts[:at]
        yield from self._back(lasts, len(lasts))

    def short(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is held whole."""
        if len(self.steps) > MAX_STEPS:
            self._reset()
        state, lasts, steps = 0, [], self.steps
        for b in data:
            got = steps.get((state << 8) | b)
            if got is None:
                got = self._step(state, b)
            state = got >> 24
            lasts.append(got & 0xFFFFFF)
        size, at, out = self.sizes, len(data), []
        while at > 0:
            last = lasts[at - 1]
            out.append(last)
            at -= size[last]
        return out[::-1]

    def _common(self, lasts: list[int], starts: set[int]) -> int:
        """The last place that the encodings up to all of the starts pass."""
        while len(starts) > 1:
            last = max(starts)
            starts = starts - {last} | {last - len(self.bytes[lasts[last - 1]])}
        return starts.pop()

    def _back(self, lasts: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(lasts[at - 1])
            at -= len(self.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Ids of texts: the pattern's matches, each through the transducer, with a bounded memory of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def piece(self, piece: str) -> str:
        got = self.pieces.get(piece)
        if got is None:
            data = piece.encode()
            ids = self.machine.short(data) if len(data) <= 64 else self.machine.stream(data)
            got = self.pieces[piece] = "".join([f",{i}" for i in ids])
        return got

    def joined(self, text: str) -> str:
        """The ids in decimal, each after a comma.

        A space between two characters that are not white space always starts a match (each alternative takes one space
        at most in front of what it matches, and white space runs leave their last space), so the text falls apart there."""
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        if not text or text[0].isspace() or text[-1].isspace() or _RUN.search(text):
            words = self.split(text)
        else:
            head, *tail = text.split(" ")
            words = [head, *[" " + p for p in tail]]
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = "".join(map(self.piece, self.split(w)))
        return "".join(map(known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.joined(text)[1:].split(",")] if text else []


class Utf8Stream:
    """Decodes byte strings as they come; an unfinished character waits for its rest, a faulty byte becomes U+FFFD."""

    #: State after a lead byte: continuation bytes to come, and the range of the first of them.
    _NEED = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # an unfinished character begins in the last three bytes
            if need := self._NEED.get(data[-back]):
                tail = data[len(data) - back + 1 :]
                if need[0] >= back and all(need[1] <= c <= need[2] if i == 0 else 0x80 <= c <= 0xBF for i, c in enumerate(tail)):
                    keep = back
                break
            if not 0x80 <= data[-back] <= 0xBF:
                break
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode_bytes(machine: Transducer, ids: Iterable[int]) -> bytes:
    return b"".join(map(machine.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int)."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        own = encoder(path, pattern)
        return lambda part: {"doc_id": part.column("doc_id"), "ids": [own.encode(t) for t in part.column("text").to_pylist()]}

    return map_texts(id_text(docs), "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of (doc_id, ids), decoded in pieces of 4096 ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = encoder(path, pattern).machine
        for frame in frames:
            texts = []
            for ids in frame["ids"]:
                stream = Utf8Stream()
                texts.append("".join([*(stream.feed(decode_bytes(machine, ids[i : i + 4096])) for i in range(0, len(ids), 4096)), stream.end()]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInPandas(run, "doc_id long, text string")


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again. No shuffle."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        own = encoder(path, pattern)
        spelled = {str(i): t for i, t in own.machine.bytes.items()}

        def work(part: pa.RecordBatch) -> dict:
            n, sha, back = [], [], []
            for text in part.column("text").to_pylist():
                ids = own.joined(text)[1:]
                stream, out, listed = Utf8Stream(), hashlib.sha256(), ids.split(",") if ids else []
                for i in range(0, len(listed), 65_536):
                    out.update(stream.feed(b"".join(map(spelled.__getitem__, listed[i : i + 65_536]))).encode())
                out.update(stream.end().encode())
                n.append(len(listed))
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(out.hexdigest())
            return {"doc_id": part.column("doc_id"), "n_tokens": n, "ids_sha256": sha, "decoded_sha256": back}

        return work

    return map_texts(id_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
