"""Operator 9, secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

All models are character bigram chains with add-one smoothing, trained from labelled samples: one chain for each kind of random
string (drawn from a seeded generator over an alphabet that keys use) and one of ordinary identifiers (words, joined words,
file and variable names and numbers, built from a bounded sample of the corpus). What the fixed patterns leave of a run of
key characters, of any length, is a secret if its log-likelihood ratio for some kind passes the thresholds per character and
in sum; if not, so is each stretch of it that passes them.

Defined cases: a null or empty text has no span; spans of different kinds may overlap, spans of kind markov overlap no other;
repeated rows give repeated results; an empty table gives no row; extra columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, documents, forget, id_text, map_texts, slices

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of characters that keys are made of.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What joins names and keys to a run, and what stands between.
_MARKS = "/=_-"
_PART = re.compile(r"[A-Za-z0-9+]+")
#: Words that ordinary identifiers are made of.
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))

#: Words that the ordinary model is trained on, at most, and random strings of each kind.
SAMPLE_WORDS, SAMPLE_RANDOM = 20_000, 10_000
#: Mean log-likelihood ratio per character, and its sum, that a secret reaches.
MIN_MEAN, MIN_SUM = 0.35, 12.0
#: Share of an ordinary word's characters that the corpus sample need not explain.
FLAT, SAME = 0.1, 0.8
#: Runs whose keys a worker remembers, and the longest of them (longer ones are judged each time).
CACHE_RUNS, LONG_RUN = 100_000, 256
#: Alphabets of random strings.
_HEXADECIMAL = "0123456789abcdef"
RANDOM_KINDS = (_ALPHABET[:64], _ALPHABET[:62], _ALPHABET[:26] + _ALPHABET[52:62], _ALPHABET[26:62], _ALPHABET[:26], _ALPHABET[26:52], _HEXADECIMAL)


def chain(samples: Iterable[str], flat: float = 0.0) -> np.ndarray:
    """Log transition probabilities [previous or start, next] of a character chain, add-one smoothed. flat: the share of
    characters that follow no sample, for words of languages that the samples lack; SAME of them are of the kind before."""
    n = len(_ALPHABET)
    count = np.ones((n + 1, n))
    for s in samples:
        code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        code = code[code >= 0]
        if len(code):
            np.add.at(count, (np.append(n, code[:-1]), code), 1)
    kind = np.array([c.islower() + 2 * c.isupper() + 4 * c.isdigit() for c in _ALPHABET])
    same = np.append((kind[:, None] == kind) / (kind[:, None] == kind).sum(1, keepdims=True), np.full((1, n), 1 / n), 0)
    return np.log((1 - flat) * count / count.sum(1, keepdims=True) + flat * (SAME * same + (1 - SAME) / n))


def random_samples(alphabet: str, n: int, seed: int = 7) -> list[str]:
    """Labelled random strings of 12 to 64 characters."""
    rng, letters = np.random.default_rng(seed), np.array(list(alphabet))
    return ["".join(letters[rng.integers(0, len(letters), rng.integers(12, 65))]) for _ in range(n)]


def ordinary_samples(words: list[str], seed: int = 11) -> list[str]:
    """Labelled identifiers: the words in three cases, joined as snake, kebab, camel and path names, some with a number, and
    numbers and dates."""
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "index", "name"]
    rng = np.random.default_rng(seed)
    out = [*words, *map(str.upper, words), *map(str.title, words)]
    for i in range(len(words)):
        some = [words[j].lower() for j in rng.integers(0, len(words), rng.integers(2, 5))]
        number = int(rng.integers(0, 10 ** rng.integers(1, 13)))
        camel = some[0] + "".join(map(str.title, some[1:]))
        kinds = ("_".join(some), "-".join(some), camel, "/".join(some), "_".join(some).upper(), f"{some[0]}_{number}", f"{some[0]}{number % 1000}")
        out += (kinds[i % 7], str(number), f"20{number % 100:02d}-{number % 12 + 1:02d}-{number % 28 + 1:02d}")
    return out


#: Bits of a word's hash by which words are counted before the driver takes any.
_COUNT_BITS = 12


def smallest_words(texts: DataFrame, most: int) -> list[str]:
    """The `most` distinct words of all texts with the smallest hashes (CRC-32, then the word). Each task keeps that many of
    its own and sends no more. Words are counted by the first bits of their hash, and only those up to the one that makes
    `most` full come to the driver: about `most`, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        bound = 1 << 32
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                for text in part.column("text").to_pylist():
                    for w in set(_WORD.findall(text)):
                        if w not in kept and (h := zlib.crc32(w.encode())) <= bound:
                            kept[w] = h
                    if len(kept) > 2 * most:
                        kept = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[:most])
                        bound = max(kept.values())
        own = sorted((h, w) for w, h in kept.items())[:most]
        if own:
            yield pa.RecordBatch.from_pydict({"h": pa.array([h for h, _ in own], pa.int64()), "w": [w for _, w in own]})

    found = cut(id_text(texts).select("text").mapInArrow(run, "h long, w string").distinct(), "words")
    high = F.shiftright("h", 32 - _COUNT_BITS)
    counts = {r["k"]: r["n"] for r in found.groupBy(high.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 2^_COUNT_BITS rows
    total, last = 0, -1
    for last in sorted(counts):
        total += counts[last]
        if total >= most:
            break
    own = sorted((r["h"], r["w"]) for r in found.where(high <= last).collect())[:most]
    forget(found)
    return sorted(w for _, w in own)


def train(docs: DataFrame, sample_words: int = SAMPLE_WORDS) -> np.ndarray:
    """Log-likelihood ratios [kind, previous or start, next]; ordinary identifiers come from sample_words distinct words of the
    whole corpus."""
    ordinary = chain(ordinary_samples(smallest_words(docs, sample_words)), FLAT)
    return np.stack([chain(random_samples(alphabet, SAMPLE_RANDOM)) - ordinary for alphabet in RANDOM_KINDS])


def gains(model: np.ndarray, s: str) -> np.ndarray:
    """Log-likelihood ratio of each character of s, for each kind."""
    code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    return model[:, np.append(len(_ALPHABET), code[:-1]), code]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def is_key(model: np.ndarray, s: str) -> bool:
    """Whether s as a whole passes; the kinds share the evidence that each of them might be the one."""
    best = float(gains(model, s).sum(1).max()) - float(np.log(len(model)))
    return best >= MIN_SUM and best >= MIN_MEAN * len(s)


def free_parts(a: int, b: int, base: Iterable[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans of base leave of [a, b)."""
    out = []
    for x, _, y in base:
        if x >= b:
            break
        if y > a:
            if x > a:
                out.append((a, x))
            a = y
    return out + [(a, b)] if a < b else out


def maximal_stretches(gains: list[float]) -> list[tuple[int, int, float]]:
    """All disjoint stretches of largest sum (Ruzzo and Tompa), with their sums, in linear time."""
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum with it, nearest one that begins lower
    total = 0.0
    for i, g in enumerate(gains):
        first, low = i, total
        total += g
        if g <= 0:
            continue
        at = len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= low:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= total:
                break
            first, _, low, _, before = kept[at]
            del kept[at:]
            at = before
        kept.append((first, i + 1, low, total, at))
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def keys_within(s: str, model: np.ndarray) -> list[tuple[int, int]]:
    """Where keys stand in a run: the whole run; or else its parts between marks, and the stretches that gain MIN_SUM over
    MIN_MEAN, as far as the next marks if that is still a key."""
    each = gains(model, s) - MIN_MEAN
    sums = np.concatenate([np.zeros((len(model), 1)), np.cumsum(each, 1)], 1)
    if (sums - np.minimum.accumulate(sums, 1)).max() < MIN_SUM:  # no stretch gains enough, and so neither does a part
        return [(0, len(s))] if is_key(model, s) else []
    if is_key(model, s):
        return [(0, len(s))]
    found = [m.span() for m in _PART.finditer(s) if is_key(model, m[0])]
    for own in each:
        for a, b in ((a, b) for a, b, gain in maximal_stretches(own.tolist()) if gain >= MIN_SUM):
            wide = (max(s.rfind(c, 0, a) for c in _MARKS) + 1, min(x if (x := s.find(c, b)) >= 0 else len(s) for c in _MARKS))
            found += next(([w] for w in (wide, (a, b)) if is_key(model, s[slice(*w)])), [])
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Scanner:
    """Spans of texts; keeps the keys of runs that it has seen, up to CACHE_RUNS."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, list[tuple[int, int]]] = {}

    def keys(self, run: str) -> list[tuple[int, int]]:
        got = self.known.get(run)
        if got is None:
            got = keys_within(run, self.model)
            if len(run) <= LONG_RUN:
                self.known[run] = got
        return got

    def learn(self, runs: set[str]) -> None:
        """Remembers in one step the runs that hold no key because even their gaining characters alone don't reach MIN_SUM."""
        if len(self.known) >= CACHE_RUNS:
            self.known.clear()
        new = [r for r in runs if r not in self.known and len(r) <= LONG_RUN]
        if not new:
            return
        ends = np.cumsum([0, *map(len, new)])
        code = _CODE[np.frombuffer("".join(new).encode("ascii"), np.uint8)]
        before = np.append(0, code[:-1])
        before[ends[:-1]] = len(_ALPHABET)
        most = np.max([np.add.reduceat(np.maximum(m[before, code], 0), ends[:-1]) for m in self.model], 0)
        self.known.update((new[i], []) for i in np.flatnonzero(most < MIN_SUM).tolist())

    def markov(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Keys in what the fixed patterns (sorted) leave of each run."""
        runs = set(_CANDIDATE.findall(text))
        self.learn(runs)
        if not base and not any(map(self.keys, runs)):
            return []
        out, at = [], 0
        for m in _CANDIDATE.finditer(text):
            while at < len(base) and base[at][2] <= m.start():
                at += 1
            for a, b in free_parts(*m.span(), (base[i] for i in range(at, len(base)))):
                out += [(a + x, 3, a + y) for x, y in self.keys(text[a:b])]
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(start, kind, end) of the fixed patterns, and of the models."""
        base = base_spans(text)
        return base, self.markov(text, base)


def markov_spans(text: str, base: list[tuple[int, int, int]], model: np.ndarray) -> list[tuple[int, int, int]]:
    return Scanner(model).markov(text, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """text with every stretch that spans cover replaced once."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += (text[at:a], by)
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov. One pass, no shuffle beyond training."""
    model = train(docs) if model is None else model

    def make() -> Callable[[pa.RecordBatch], dict]:
        scanner = Scanner(model)

        def work(part: pa.RecordBatch) -> dict:
            rows = []
            for text in part.column("text").to_pylist():
                base, more = scanner.spans(text)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            return {"doc_id": part.column("doc_id")} | dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"), zip(*rows, strict=True), strict=True))

        return work

    return map_texts(id_text(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long", make)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced, n_chars (if there) made anew, other columns as they were."""
    model, names = train(docs), docs.columns
    packed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*[c for c in names if c != "text"]).alias("rest"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        scanner = Scanner(model)

        def work(part: pa.RecordBatch) -> dict:
            texts = []
            for text in part.column("text").to_pylist():
                base, more = scanner.spans(text)
                texts.append(redact(text, base + more))
            return {"redacted": texts, "rest": part.column("rest")}

        return work

    out = map_texts(packed, f"redacted string, rest {packed.schema['rest'].dataType.simpleString()}", make)
    own = {"text": F.col("redacted")} | ({"n_chars": F.length("redacted").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
