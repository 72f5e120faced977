"""Operator 7, edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves hold the characters and tokens of blocks of pre-tokens, inner nodes their sums. An edit replaces characters; only the
blocks that it touches, with one block of context on either side, are split and encoded anew. They are cut out of the tree and
the new ones put in by splitting and joining it, which renews the sums of a few paths (the tree stays balanced by chance, as
a join draws its root in proportion to sizes). The context grows until pre-token borders before and behind agree again, so
counts equal a full encoding. Trees are kept between calls as tables of blocks: `build_trees`, then `edit_trees`.

Defined cases: a null or empty text has no tokens; edits are clipped to the text, in order of seq (ties: start, end, new text),
each in coordinates of the text that the edits before it left; a document without edits keeps its count; edits of unknown
documents are ignored; repeated doc_ids each get all edits of that id; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, id_text, map_texts

#: Characters of a leaf, about.
LEAF_CHARS = 256
MAX_PIECES = 400_000


class Counter:
    """Token counts of pre-tokens by a rank file, with a bounded memory."""

    def __init__(self, path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("count", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(pattern).finditer
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) > MAX_PIECES:
                self.known.clear()
            got = self.known[piece] = len(self.bpe.encode_single_piece(piece.encode()))
        return got


class Node:
    """A block and what stands before and behind it: sums of characters, tokens and blocks of the whole subtree."""

    __slots__ = ("text", "own", "left", "right", "chars", "tokens", "count")

    def __init__(self, text: str, own: int) -> None:
        self.text, self.own = text, own
        self.left: Node | None = None
        self.right: Node | None = None
        self.chars, self.tokens, self.count = len(text), own, 1


class Tree:
    """Blocks of whole pre-tokens with their texts and token counts, in a tree of sums."""

    def __init__(self, text: str, counter: Counter, blocks: list[tuple[str, int]] | None = None) -> None:
        self.counter = counter
        self.encoded = self.touched = 0  # characters encoded, and nodes whose sums were made anew
        self.draw = random.Random(1).random
        self.root = self._built(self._blocks(text) if blocks is None else blocks)

    def _blocks(self, text: str) -> list[tuple[str, int]]:
        """(text, tokens) of blocks that end with pre-tokens."""
        out, start, tokens, count = [], 0, 0, self.counter.count
        for m in self.counter.find(text):
            tokens += count(m[0])
            if m.end() - start >= LEAF_CHARS:
                out.append((text[start : m.end()], tokens))
                start, tokens = m.end(), 0
        if start < len(text):
            out.append((text[start:], tokens))
        self.encoded += len(text)
        return out

    def _renewed(self, node: Node) -> Node:
        self.touched += 1
        node.chars, node.tokens, node.count = len(node.text), node.own, 1
        for side in (node.left, node.right):
            if side:
                node.chars += side.chars
                node.tokens += side.tokens
                node.count += side.count
        return node

    def _built(self, blocks: list[tuple[str, int]]) -> Node | None:
        if not blocks:
            return None
        mid = len(blocks) // 2
        node = Node(*blocks[mid])
        node.left, node.right = self._built(blocks[:mid]), self._built(blocks[mid + 1 :])
        return self._renewed(node)

    def _split(self, node: Node | None, at: int) -> tuple[Node | None, Node | None]:
        """The blocks that end at or before character at, and the others."""
        if node is None:
            return None, None
        before = node.left.chars if node.left else 0
        if before + len(node.text) <= at:
            node.right, rest = self._split(node.right, at - before - len(node.text))
            return self._renewed(node), rest
        first, node.left = self._split(node.left, at)
        return first, self._renewed(node)

    def _joined(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if self.draw() * (a.count + b.count) < a.count:
            a.right = self._joined(a.right, b)
            return self._renewed(a)
        b.left = self._joined(a, b.left)
        return self._renewed(b)

    @staticmethod
    def _outer(node: Node, first: bool) -> Node:
        while (side := node.left if first else node.right) is not None:
            node = side
        return node

    def _listed(self, node: Node | None) -> list[tuple[str, int]]:
        return [] if node is None else [*self._listed(node.left), (node.text, node.own), *self._listed(node.right)]

    @property
    def blocks(self) -> list[tuple[str, int]]:
        return self._listed(self.root)

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end by new."""
        start = max(0, min(start, self.chars))
        end = max(start, min(end, self.chars))
        left, rest = self._split(self.root, start)
        if left:  # one block of context, and more where white space, which looks ahead, ends the one before
            at = left.chars - len(self._outer(left, False).text)
            while True:
                left, more = self._split(left, at)
                rest = self._joined(more, rest)
                if left is None or not (last := self._outer(left, False).text)[-1].isspace():
                    break
                at = left.chars - len(last)
        before = left.chars if left else 0
        middle, right = self._split(rest, end - before)
        old, taken = "".join(t for t, _ in self._listed(middle)), 0
        while right:
            # the block that holds the end, one of context, and then until the border before the next one still holds
            text = old[: start - before] + new + old[end - before :]
            ahead = self._outer(right, True).text
            if taken >= 2 and self._border(text, ahead):
                break
            old, taken = old + ahead, taken + 1
            _, right = self._split(right, len(ahead))
        text = old[: start - before] + new + old[end - before :]
        self.root = self._joined(self._joined(left, self._built(self._blocks(text))), right)

    def _border(self, text: str, ahead: str) -> bool:
        """Whether a pre-token ends where text does when ahead follows."""
        at = 0
        for m in self.counter.find(text + ahead):
            at = m.end()
            if at >= len(text):
                break
        return at == len(text)


_LOADED: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Counter(path, pattern)
    return _LOADED[path, pattern]


def in_order(changes: list[dict] | None) -> list[tuple[int, int, str]]:
    """(start, end, new) of edits by seq; null fields count as 0 or empty, null edits as none."""
    full = [(e["seq"] or 0, e["start"] or 0, e["end"] or 0, e["new"] or "") for e in changes or [] if e is not None]
    return [e[1:] for e in sorted(full)]


def count_with_edits(docs: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens (of the text), n_tokens_edited (after the edits), n_encoded (characters encoded for the edits).

    edits: an array column of structs (seq, start, end, new) over docs. To use a table of edits, gather it by doc_id and
    join it to docs first (`gathered`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), edits.alias("edits"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        own = counter(path, pattern)

        def work(part: pa.RecordBatch) -> dict:
            before, after, encoded = [], [], []
            for text, changes in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True):
                tree = Tree(text, own)
                before.append(tree.tokens)
                tree.encoded = 0
                for e in in_order(changes):
                    tree.edit(*e)
                after.append(tree.tokens)
                encoded.append(tree.encoded)
            return {"doc_id": part.column("doc_id"), "n_tokens": before, "n_tokens_edited": after, "n_encoded": encoded}

        return work

    return map_texts(rows, "doc_id long, n_tokens long, n_tokens_edited long, n_encoded long", make)


_BLOCKS = "blocks array<struct<text:string,tokens:int>>"


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and blocks: what is kept of each document's tree, to be written as a table."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        own = counter(path, pattern)

        def work(part: pa.RecordBatch) -> dict:
            trees = [Tree(text, own) for text in part.column("text").to_pylist()]
            blocks = [[{"text": t, "tokens": n} for t, n in tree.blocks] for tree in trees]
            return {"doc_id": part.column("doc_id"), "n_tokens": [t.tokens for t in trees], "blocks": blocks}

        return work

    return map_texts(id_text(docs), f"doc_id long, n_tokens long, {_BLOCKS}", make)


def edit_trees(trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """The table of build_trees after edits (doc_id, seq, start, end, new), with n_encoded: the characters encoded for them.
    Trees without edits pass by; the others are read from their blocks, so only edited regions are encoded."""
    listed = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(F.struct("seq", "start", "end", "new")).alias("edits"))
    joined = trees.select("doc_id", "n_tokens", "blocks").join(listed, "doc_id", "left")
    plain = joined.where("edits is null").select("doc_id", "n_tokens", "blocks", F.lit(0).cast("long").alias("n_encoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree("", own, [(b["text"], b["tokens"]) for b in row["blocks"] or []])
                tree.encoded = 0
                for e in in_order(row["edits"]):
                    tree.edit(*e)
                out = {"doc_id": row["doc_id"], "n_tokens": tree.tokens, "blocks": [{"text": t, "tokens": n} for t, n in tree.blocks], "n_encoded": tree.encoded}
                yield pa.RecordBatch.from_pylist([out], schema=target)

    schema = f"doc_id long, n_tokens long, {_BLOCKS}, n_encoded long"
    block = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int32())]))
    target = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("blocks", block), ("n_encoded", pa.int64())])
    return plain.unionByName(joined.where("edits is not null").mapInArrow(run, schema))


def gathered(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text) with column edits from a table (doc_id, seq, start, end, new)."""
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "end", "new")).alias("edits"))
    return id_text(docs).join(own, "doc_id", "left")


def sample_edits(text: Column) -> Column:
    """Three edits of any text, as a reviser would make them: its middle 12 characters rewritten, a sentence put in at a
    third, and the last 20 characters deleted."""
    n = F.length(text)
    edit = lambda seq, start, end, new: F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))
    half, third = F.floor(n / 2), F.floor(n / 3)
    return F.array(edit(1, half, half + 12, " rewritten"), edit(2, third, third, " An added sentence, don't you think?\n"), edit(3, n - 8, n + 12, ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_with_edits(documents(spark, sf_dir), sample_edits(F.coalesce("text", F.lit(""))), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
