"""Operator 2, language identification by a linear-chain conditional random field over words.

Each word's emission scores sum learned weights of its affixes, character n-grams and lexicon entry; learned transitions link
neighbours. A token of more than PIECE characters (text without spaces) is as many words as it has pieces, with all its n-grams. Forward-backward gives every word's language probabilities, so code-switched text gets both its languages; the
document's language has the largest mean probability, which is its score.

Training is on a bounded sample of labelled rows (SAMPLE_DOCS windows of SAMPLE_WORDS words, shared among the languages, rows
of smallest hash in each), some spliced from two languages so that the transitions learn to switch.

Defined cases: a null text, and a text without a letter, is `und` with score 0; without labelled rows everything is `und`;
a null doc_id is neither held out nor learned from; repeated rows give repeated results; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, id_text, map_texts

SAMPLE_DOCS, SAMPLE_WORDS = 3000, 80
BUCKETS, LEXICON_WORDS = 1 << 15, 4000
CACHE_WORDS = 200_000
#: Characters of a token that are one place in the chain, at most.
PIECE = 24
#: Words in a block of the chain that is handled in step with others.
BLOCK = 32


def features(piece: str, lexicon: dict[str, int]) -> list[int]:
    """Indices of a lower-cased token's affixes, n-grams and lexicon entry, or of one of its pieces (see `pieces`): those
    n-grams that begin in it, the prefixes if it is the first and the suffixes if it is the last."""
    crc = zlib.crc32
    if " " in piece:
        first, (own, more, after) = piece[0] != " ", piece.lstrip(" ").partition(" ")
        w, s = f"^{own}" if first else own if more else f"{own}$", own + after
    else:
        first, own, more, w, s = True, piece, "", f"^{piece}$", piece
    out = [crc(w[:k].encode()) % BUCKETS for k in (2, 3, 4)] if first else []
    out += [crc(w[-k:].encode(), 1) % BUCKETS for k in (2, 3, 4)] if not more else []
    out += [crc(s[i : i + 2].encode(), 2) % BUCKETS for i in range(min(len(own), len(s) - 1))]
    out += [crc(s[i : i + 3].encode(), 3) % BUCKETS for i in range(min(len(own), len(s) - 2))]
    if (at := lexicon.get(piece)) is not None:
        out.append(BUCKETS + at)
    return out


def pieces(word: str) -> list[str]:
    """A token of more than PIECE characters in pieces of nearly equal length, each a place in the chain. A piece that goes on
    from another begins with a space; one that another follows ends with a space and the next two characters."""
    n = -(-len(word) // PIECE)
    if n <= 1:
        return [word]
    cuts = [len(word) * i // n for i in range(n + 1)]
    return [" " * (a > 0) + word[a:b] + (f" {word[b : b + 2]}" if b < len(word) else "") for a, b in zip(cuts, cuts[1:], strict=False)]


def tokens(text: str) -> list[str]:
    words = text.lower().split()
    return words if max(map(len, words), default=0) <= PIECE else [p for w in words for p in pieces(w)]


def _blocks(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and row of blocks of at most `size` words."""
    n = -(-np.diff(bounds) // size)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[:-1][row] + k * size
    return start, np.minimum(size, bounds[1:][row] - start), row


def posteriors(scores: np.ndarray, bounds: np.ndarray, chain: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Forward-backward label probabilities of the words of many rows. scores: words x labels, chain: labels x labels, logs.

    Exact: all blocks' transfer matrices come first, in step; they carry the forward and backward vectors over each row's
    block borders; then all blocks run forward and backward in step."""
    start, length, row = _blocks(bounds, size)
    nb, k = len(start), scores.shape[1]
    if not nb:
        return np.zeros((0, k))
    a = np.exp(chain - chain.max())
    inside = np.arange(size)[None, :] < length[:, None]
    place = np.where(inside, start[:, None] + np.arange(size)[None, :], 0)
    e = np.exp(scores - scores.max(1, keepdims=True))[place]
    first = np.append(True, row[1:] != row[:-1])
    matrix = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(size):
        on = inside[:, t]
        # a row's first word follows nothing, and so no transition leads to it
        step = np.where((first[on] & (t == 0))[:, None, None], matrix[on], matrix[on] @ a) * e[on, t][:, None, :]
        matrix[on] = step / step.sum((1, 2), keepdims=True)
    ahead, back = np.full((nb, k), 1 / k), np.full((nb, k), 1 / k)
    order = np.arange(nb) - np.maximum.accumulate(np.where(first, np.arange(nb), 0))
    by_order = np.argsort(order, kind="stable")
    cuts = np.searchsorted(order[by_order], np.arange(order.max() + 2))
    for j in range(1, len(cuts) - 1):
        own = by_order[cuts[j] : cuts[j + 1]]
        v = np.einsum("bi,bij->bj", ahead[own - 1], matrix[own - 1])
        ahead[own] = v / v.sum(1, keepdims=True)
    for j in range(len(cuts) - 2, 0, -1):
        own = by_order[cuts[j] : cuts[j + 1]]
        v = np.einsum("bij,bj->bi", matrix[own], back[own])
        back[own - 1] = v / v.sum(1, keepdims=True)
    forward = np.empty((nb, size, k))
    v = ahead
    for t in range(size):
        step = (np.where(first[:, None], v, v @ a) if t == 0 else v @ a) * e[:, t]
        v = np.where(inside[:, t, None], step / step.sum(1, keepdims=True), v)
        forward[:, t] = v
    v = back
    for t in range(size - 1, -1, -1):
        forward[:, t] *= v
        step = (v * e[:, t]) @ a.T
        v = np.where(inside[:, t, None], step / step.sum(1, keepdims=True), v)
    out = forward[inside]
    return out / out.sum(1, keepdims=True)


def expected_pairs(scores: np.ndarray, bounds: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring labels under the model: forward vector, transition and backward vector of each pair.
    Rows run in step, padded to the longest, so it is for training windows."""
    n, size, k = len(bounds) - 1, int(np.diff(bounds).max(initial=0)), scores.shape[1]
    inside = np.arange(size)[None, :] < np.diff(bounds)[:, None]
    e = np.ones((n, size, k))
    e[inside] = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else e[inside]
    a = np.exp(chain - chain.max())
    forward, backward = np.empty((n, size, k)), np.ones((n, size, k))
    for t in range(size):
        v = e[:, t] * (forward[:, t - 1] @ a if t else 1.0)
        forward[:, t] = v / v.sum(1, keepdims=True)
    for t in range(size - 2, -1, -1):
        v = (e[:, t + 1] * backward[:, t + 1]) @ a.T
        backward[:, t] = np.where(inside[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
    joint = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    return (joint * inside[:, 1:, None, None]).sum((0, 1))


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        found = [features(w, self.lexicon) for w in words]
        ends = np.cumsum([0, *map(len, found)])
        flat = np.fromiter((i for f in found for i in f), np.int64, ends[-1])
        return np.add.reduceat(self.weights[flat], ends[:-1]) if len(words) else np.zeros((0, len(self.labels)))


def fit(samples: list[tuple[str, list[str]]], epochs: int = 8, rate: float = 0.3, seed: int = 5) -> Crf:
    """A CRF from (label, words) windows, by AdaGrad on the conditional log-likelihood."""
    labels = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(labels)}
    count: dict[str, int] = {}
    for _, words in samples:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w))[:LEXICON_WORDS])}
    crf = Crf(labels, lexicon, np.zeros((BUCKETS + LEXICON_WORDS, len(labels))), np.zeros((len(labels), len(labels))))
    rng, vocabulary = np.random.default_rng(seed), {w: i for i, w in enumerate(count)}
    found = [features(w, lexicon) for w in vocabulary]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter((i for f in found for i in f), np.int64, ends[-1])
    owner = np.repeat(np.arange(len(found)), np.diff(ends))
    seqs = [(np.array([vocabulary[w] for w in words]), np.full(len(words), number[lang])) for lang, words in samples if words]
    grown, grown_chain = np.full_like(crf.weights, 1e-6), np.full_like(crf.chain, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for i in range(0, len(order), 256):
            batch = [seqs[j] for j in order[i : i + 256]]
            # a third of the windows are spliced from two
            batch = [tuple(np.append(x[: len(x) // 2], y[len(y) // 2 :]) for x, y in zip(b, batch[j - 1], strict=True)) if j % 3 == 0 and j else b for j, b in enumerate(batch)]
            ids, gold = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            bounds = np.cumsum([0, *(len(b[0]) for b in batch)])
            scores = np.add.reduceat(crf.weights[flat], ends[:-1])[ids]
            p = posteriors(scores, bounds, crf.chain)
            error = -p
            error[np.arange(len(ids)), gold] += 1
            by_word = np.stack([np.bincount(ids, error[:, k], len(found)) for k in range(len(labels))], 1)
            grad = np.stack([np.bincount(flat, by_word[owner, k], len(crf.weights)) for k in range(len(labels))], 1) / len(batch) - 1e-4 * crf.weights
            grown += grad**2
            crf.weights += rate * grad / np.sqrt(grown)
            inner = np.ones(len(ids), bool)
            inner[bounds[:-1]] = False
            at = np.flatnonzero(inner)
            seen = np.zeros_like(crf.chain)
            np.add.at(seen, (gold[at - 1], gold[at]), 1)
            step = (seen - expected_pairs(scores, bounds, crf.chain)) / len(batch) - 1e-3 * crf.chain
            grown_chain += step**2
            crf.chain += rate * step / np.sqrt(grown_chain)
    return crf


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many of `most` rows each language gives: equal shares, and what small ones leave goes to the others; one at least."""
    out: dict[str, int] = {}
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], (most - sum(out.values())) // (len(counts) - i)))
    return out


def sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """(lang, words) windows of `most` rows or so: of each language its rows of smallest hash, repeated rows once.

    Only rows below a hash bound of their language are looked at: about half as many again as it gives."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where("crc32(cast(doc_id as string)) % 5 <> 0 and lang is not null and text is not null and text rlike '\\\\S'").withColumn("h", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    quota = shares({k: n + n // 5 + 1 for k, n in counts.items()}, most)
    bounds = docs.sparkSession.createDataFrame([(k, min(1 << 31, int((1.5 * quota[k] + 100) / max(1, n) * (1 << 31)))) for k, n in counts.items()], "lang string, bound long")
    near = rows.join(F.broadcast(bounds), "lang").where(F.pmod("h", F.lit(1 << 31)) < F.col("bound")).select("lang", "h", "text")

    def make() -> Callable[[pa.RecordBatch], dict]:
        def work(part: pa.RecordBatch) -> dict:
            out = []
            for text, h in zip(part.column("text").to_pylist(), part.column("h").to_pylist(), strict=True):
                words = tokens(text)
                at = h % max(1, len(words) - SAMPLE_WORDS + 1)
                out.append("\n".join(words[at : at + SAMPLE_WORDS]))
            return {"lang": part.column("lang"), "h": part.column("h"), "words": out}

        return work

    found = map_texts(near, "lang string, h long, words string", make).groupBy("lang", "h").agg(F.min("words").alias("words")).collect()
    own: dict[str, list[tuple[int, int, str]]] = {}
    for r in found:
        own.setdefault(r["lang"], []).append((r["h"] % (1 << 31), r["h"], r["words"]))
    return [(lang, words.split("\n")) for lang in sorted(own) for _, _, words in sorted(own[lang])[: quota[lang]] if words]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf | None:
    """From rows with text, lang and doc_id; None if none is labelled."""
    samples = sample(docs, sample_docs)
    return fit(samples) if samples else None


def predictor(crf: Crf) -> Callable[[list[str | None]], tuple[list[str], list[float], list[str]]]:
    """texts -> languages, scores and word-level languages in runs; keeps words' emissions, up to CACHE_WORDS."""
    known: dict[str, int] = {}
    table = np.zeros((0, len(crf.labels)))

    def run(texts: list[str | None]) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
        nonlocal table
        if len(known) > CACHE_WORDS:
            known.clear()
            table = table[:0]
        rows = [tokens(t or "") for t in texts]
        new = sorted({w for r in rows for w in r if w not in known})
        known.update((w, len(table) + i) for i, w in enumerate(new))
        table = np.concatenate([table, crf.emissions(new)])
        bounds = np.cumsum([0, *map(len, rows)])
        ids = np.fromiter((known[w] for r in rows for w in r), np.int64, bounds[-1])
        p = posteriors(table[ids], bounds, crf.chain)
        langs, scores = [], []
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds))[:, None]
        best = mean.argmax(1)
        for i, t in enumerate(texts):
            letters = t is not None and any(map(str.isalpha, t))
            langs.append(crf.labels[best[i]] if letters else "und")
            scores.append(min(1.0, float(mean[i, best[i]])) if letters else 0.0)
        return langs, scores, p, bounds

    return run


def identify(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. No shuffle beyond the bounded sample."""
    crf = crf or train(docs)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if crf is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        predict = predictor(crf)

        def work(part: pa.RecordBatch) -> dict:
            langs, scores, _, _ = predict(part.column("text").to_pylist())
            return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": langs, "score": scores}

        return work

    return map_texts(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
