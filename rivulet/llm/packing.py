"""Operator 5, best-fit packing: token pieces into sequences of fixed length by the sum-of-squares rule.

Every text is encoded by a public tokenizer and ends with id 0; longer documents are cut into full pieces. Each piece
goes where the sum over residual gaps g of (open sequences with gap g)^2 becomes smallest.

Defined cases: a null or empty text is one piece that holds the end id alone; rows that repeat are packed as often as
they occur; an empty table gives no row; extra columns are ignored; a null doc_id is packed and stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, documents, id_text, map_texts, small_batches

#: A worker forgets the words that it has encoded beyond so many, those that haven't come up again for longest first.
CACHE_WORDS = 100_000
#: Share of a sequence that may stay empty without its pieces being packed once more.
OPEN = 1 / 64
#: Words of these characters are lower-cased and split alike by any Unicode version; all other words go to the library.
_PLAIN = re.compile(r"[\n\t!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Little-endian 32-bit ids of a text by a word-end BPE in a tokenizers file, word by word with a bounded memory.

    A word's merges run in tiktoken over bytes and an end mark (0xFF). That equals merging by the file's pair list if each
    token's own merges give that token back, which is checked for the whole vocabulary; else the library encodes every word.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte, vocab, end = _byte_symbols(), model["vocab"], model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            marked = bool(end) and token.endswith(end)
            return bytes(byte[c] for c in (token[: -len(end)] if marked else token)) + b"\xff" * marked

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rules = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        ranks: dict[bytes, int] = {}
        self.ids: list[int] = []
        for c, b in sorted(byte.items(), key=lambda x: x[1]):
            ranks[bytes([b])] = len(self.ids)
            self.ids.append(vocab.get(c, -1))
        for c, b in sorted(byte.items(), key=lambda x: x[1]):
            if b != 255:
                ranks[bytes([b, 255])] = len(self.ids)
                self.ids.append(vocab.get(c + end, -1))
        singles = set(ranks)
        for a, b in pairs:
            if raw(a + b) not in ranks:
                ranks[raw(a + b)] = len(self.ids)
                self.ids.append(vocab[a + b])

        def whole(token: bytes) -> bool:
            parts = [token[i : i + 1] for i in range(len(token))]
            if token[-1:] == b"\xff" and len(token) > 1:
                parts[-2:] = [token[-2:]]
            while len(parts) > 1:
                rank, i = min((rules.get((parts[i], parts[i + 1]), 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    return False
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return True

        self.fast = bool(end) and all(t in singles or whole(t) for t in ranks)
        self.bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.raw = [i.to_bytes(4, "little") if i >= 0 else None for i in self.ids]
        # what the last texts needed, and what was known before: a word that is still in use is taken over
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_parts, self.old_words = self.parts, self.words

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            if got is None:
                raw = self.raw
                got = b"".join([raw[r] for r in self.bpe.encode_single_piece(part.encode() + b"\xff")])
            self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        if self.fast and word.isascii() and word.isalpha():  # one part
            return self._part(word.lower())
        if not self.fast or not _PLAIN.fullmatch(word):
            return np.array(self.slow.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self._part(p) for p in _PARTS.findall(word.lower())])

    def encode(self, text: str) -> bytes:
        """The text's ids. Spaces end words for the tokenizer, so words between them are encoded each by itself."""
        words = text.split(" ")
        if 2 * len(self.words) > CACHE_WORDS:
            self.words, self.old_words = {}, self.words
        if 2 * len(self.parts) > CACHE_WORDS:
            self.parts, self.old_parts = {}, self.parts
        known, old = self.words, self.old_words
        for w in set(words).difference(known):
            got = old.get(w)
            known[w] = self._word(w) if got is None else got
        return b"".join(map(known.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, seq_len: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; no shuffle, and texts don't leave their tasks."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordIds(tokenizer)
        encode = _LOADED[tokenizer].encode

        def work(part: pa.RecordBatch) -> dict:
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    own = ids[at : at + 4 * seq_len]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True), strict=True))

        return work

    return map_texts(id_text(docs), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def sum_of_squares(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    count = np.zeros(seq_len + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(seq_len + 1)]
    seq, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        # cost of taking a sequence from gap g to gap g - s; gap 0 is full and no longer counted
        cost = np.where(count[s:] > 0, 2 * (count[: seq_len + 1 - s] - count[s:]) + 2, far)
        if count[s] > 0:
            cost[0] = 1 - 2 * count[s]
        cost[-1] = 2 * count[seq_len - s] + 1 if s < seq_len else 0
        gap = s + int(np.argmin(cost))
        if gap == seq_len:
            own, used = used, used + 1
        else:
            own = open_at[gap].pop()
            count[gap] -= 1
        seq[i], offset[i] = own, seq_len - gap
        if gap > s:
            open_at[gap - s].append(own)
            count[gap - s] += 1
    return seq, offset


def dealt(found: DataFrame, seq_len: int, groups: int, first: int) -> DataFrame:
    """Pieces with sequence_id, offset and gap (what their sequence leaves empty): dealt by hash into `groups` groups, numbered
    from `first` on, each packed by one task from lengths alone, the longest pieces first. Arrow tables keep ids as they are."""
    import pyarrow.compute as pc

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"]
    order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, order))
        lengths = rows["length"].to_numpy()
        seq, offset = sum_of_squares(lengths, seq_len)
        gap = seq_len - np.bincount(seq, lengths, int(seq.max()) + 1).astype(np.int64)
        made = [pa.array((int(key[0].as_py()) << 32) + seq), pa.array(offset), pa.array(gap[seq])]
        return pa.Table.from_arrays([*(rows[c] for c in names[:5]), *made], names=names)

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)) + F.lit(first)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long"
    return found.select(*names[:5], group.alias("_group")).groupBy("_group").applyInArrow(run, schema)


def pack(found: DataFrame, seq_len: int, group_rows: int = 32_768) -> DataFrame:
    """Adds sequence_id and offset. Pieces are packed in groups of about group_rows, so that no group grows with the input.
    If there are several, the pieces of sequences that are left with more than OPEN of their length are packed once more, in
    groups of their own, so that the number of sequences hardly depends on how pieces were dealt."""
    groups = max(1, -(-found.count() // group_rows))
    once = dealt(found, seq_len, groups, 0)
    if groups > 1:
        once = cut(once, "packed")
        still = F.col("gap") > int(OPEN * seq_len)
        again = once.where(still)
        once = once.where(~still).unionByName(dealt(again, seq_len, max(1, -(-again.count() // group_rows)), groups))
    return once.drop("gap")


def best_fit_packing(docs: DataFrame, tokenizer: str, seq_len: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0)."""
    with small_batches(docs.sparkSession):
        found = cut(pieces(docs, tokenizer, seq_len), "pieces")
    return pack(found, seq_len)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
