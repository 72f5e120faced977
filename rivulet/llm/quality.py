"""Operator 6, quality rules: line-first cleaning.

Every line is judged by itself: punctuation, navigation and boilerplate rules, in four languages, and lines that the corpus
itself shows to be furniture: short ones that stand behind many different lines, as menus and notices do (a line of a text
that is copied as a whole always stands behind the same one). Failing lines are removed, and a document goes if it then has
lost too much of its text, or if it fails the base rules.

A line with no word is neutral: it stays, and counts for nothing. Defined cases: a null or empty text has no words and so
fails the base; repeated rows are each judged alike; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import documents, id_text, map_texts

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[^\w\s]|_")
# What opens a line of navigation, and what a notice says, in English, French, German and Spanish.
NAVIGATION = (
    "home", "menu", "skip to", "next", "previous", "back to top", "read more", "click here", "share this", "login", "log in", "sign in", "sign up", "subscribe",
    "accueil", "lire la suite", "cliquez ici", "partager", "se connecter", "s'inscrire", "retour en haut", "page suivante", "page précédente",
    "startseite", "weiterlesen", "mehr lesen", "hier klicken", "teilen", "anmelden", "registrieren", "nach oben", "nächste seite", "vorherige seite",
    "inicio", "leer más", "haga clic aquí", "compartir", "iniciar sesión", "registrarse", "volver arriba", "página siguiente", "página anterior",
)
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "uses cookies", "copyright ©", "copyright (c)",
    "lorem ipsum", "javascript is disabled", "javascript is required", "javascript disabled", "javascript required", "powered by", "licensed under the",
    "tous droits réservés", "conditions d'utilisation", "mentions légales", "politique de confidentialité", "utilise des cookies", "propulsé par",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "verwendet cookies", "bereitgestellt von",
    "todos los derechos reservados", "condiciones de uso", "aviso legal", "política de privacidad", "utiliza cookies", "desarrollado por",
)


def _any(phrases: tuple[str, ...]) -> str:
    return "|".join(re.escape(p) for p in phrases)


_PHRASES = NAVIGATION + NOTICES
#: What the rules below the marks' need at least, but for phrases: a symbol, two capitals in a row, or a character beyond Latin-1.
_SUSPECT = re.compile(r"[#*$%&|<>»©]|[A-ZÀ-Þ][\W\d_]*[A-ZÀ-Þ]|[^\x00-ÿ]")
#: Lines that open with a phrase of navigation and hardly go on; bars that part a line.
_NAVIGATION = re.compile(rf"^\s*(?:{_any(NAVIGATION)})\b.{{0,60}}$", re.IGNORECASE)
_BAR = re.compile(r" [|>»](?= )")
_BOILERPLATE = re.compile(rf"\b(?:{_any(NOTICES)})", re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    symbol_share: float = 0.10  #: symbols `#*$%&|<>` per character of a line beyond which it fails
    mark_share: float = 0.25  #: punctuation per character beyond which it fails,
    least_marks: int = 3  #: with as many marks at least, so that a short sentence stays
    shouted_share: float = 0.6  #: upper-case letters per letter beyond which a line of ten letters or more fails
    lost_share: float = 0.5  #: share of the word characters in removed lines at which the document goes
    furniture_chars: int = 200  #: characters of a line beyond which the corpus can't make it furniture
    furniture_share: float = 1 / 5000  #: lines that it stands behind, for each document of the corpus, at which it is furniture,
    furniture_least: int = 20  #: and so many at least
    min_words: int = 50
    repeat_percent: int = 50


def has_phrase(text: str) -> bool:
    """Whether a phrase of navigation or of a notice is anywhere in a text, letter case aside."""
    low = text.lower()
    return any(p in low for p in _PHRASES)


def line_fails(line: str, rules: Rules, phrases: bool = True) -> bool:
    """Whether a line that has a word is noise. phrases: false if its text is known to hold none."""
    n, marks = len(line), len(_MARK.findall(line))
    if marks >= rules.least_marks and marks > rules.mark_share * n:
        return True
    told = phrases and has_phrase(line)
    if not told and not _SUSPECT.search(line):
        return False
    if len(_SYMBOL.findall(line)) > rules.symbol_share * n:
        return True
    letters = sum(map(str.isalpha, line))
    if letters >= 10 and sum(map(str.isupper, line)) > rules.shouted_share * letters:
        return True
    return bool(told and (_NAVIGATION.search(line) or _BOILERPLATE.search(line)) or len(_BAR.findall(line)) > 1)


def furniture(docs: DataFrame, rules: Rules) -> frozenset[int]:
    """Hashes of the short lines that stand behind many different lines of all documents, counted in two steps: distinct
    pairs of a line and the one before it, then pairs by line. There are at most 1 / furniture_share times the mean number of
    distinct lines of a document."""
    least = max(rules.furniture_least, int(rules.furniture_share * docs.count()))
    own = F.col("text")
    lines = F.transform(F.split(own, "\n"), lambda line: F.btrim(line, F.lit(" \t\r")))
    hashed = F.transform(lines, lambda line: F.struct(F.xxhash64(line).alias("h"), F.length(line).alias("n")))
    paired = F.transform("l", lambda x, i: F.struct(x["h"].alias("h"), x["n"].alias("n"), F.when(i > 0, F.get("l", i - 1)["h"]).alias("before")))
    pairs = id_text(docs).select(hashed.alias("l")).select(F.explode(paired).alias("p")).where(f"p.n > 0 and p.n <= {rules.furniture_chars}")
    many = pairs.select("p.h", "p.before").distinct().groupBy("h").count().where(f"count >= {least}")
    return frozenset(r["h"] for r in many.select("h").collect())


def line_hash(line: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (h >> 63 << 64)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    again = []
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        at = first.setdefault(w, i)
        if at != i:
            again += (at, i)
    if not again:
        return 0
    hit = np.zeros(len(words), bool)
    at = np.array(again)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def judge(text: str, rules: Rules, common: frozenset[int] = frozenset()) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    words = _WORD.findall(text)
    chars = sum(map(len, words))
    repeat = repeated_words(words)
    base = len(words) < rules.min_words or 100 * repeat > rules.repeat_percent * len(words)
    seen: set[str] = set()
    dups = lost = 0
    good, phrases = [], has_phrase(text)
    for line in text.split("\n"):
        if not _WORD.search(line):
            good.append(line)
            continue
        dups += line in seen
        seen.add(line)
        bare = line.strip(" \t\r")
        if line_fails(line, rules, phrases) or common and len(bare) <= rules.furniture_chars and line_hash(bare) in common:
            lost += sum(map(len, _WORD.findall(line)))
        else:
            good.append(line)
    kept = not base and lost < rules.lost_share * chars
    return len(words), chars, len(_SYMBOL.findall(text)), dups, repeat, base, kept, text if not lost else "\n".join(good)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")


def _mapper(rules: Rules, common: frozenset[int], names: tuple[str, ...]) -> Callable[[], Callable[[pa.RecordBatch], dict]]:
    def make() -> Callable[[pa.RecordBatch], dict]:
        def work(part: pa.RecordBatch) -> dict:
            cols = dict(zip(_NAMES, zip(*(judge(t or "", rules, common) for t in part.column("text").to_pylist()), strict=True), strict=True))
            return {n: cols[n] if n in cols else part.column(n) for n in names}

        return work

    return make


_COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def line_first_cleaning(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and, if asked for, clean_text. Only hashes of lines are shuffled."""
    schema = _COUNTS + ", clean_text string" * with_text
    return map_texts(id_text(docs), schema, _mapper(rules, furniture(docs, rules), ("doc_id", *_NAMES[: 7 + with_text])))


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with their columns; text is the cleaned text and n_chars (if there) its length."""
    names = docs.columns
    packed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*[c for c in names if c != "text"]).alias("rest"))
    rest = packed.schema["rest"].dataType.simpleString()
    out = map_texts(packed, f"kept boolean, clean_text string, rest {rest}", _mapper(rules, furniture(docs, rules), ("kept", "clean_text", "rest")))
    own = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.where("kept").select(*[(own[c] if own.get(c) is not None else F.col("rest").getField(c)).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_cleaning(documents(spark, sf_dir))
