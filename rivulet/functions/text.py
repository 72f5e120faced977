"""Text: tokens, fuzzy words, URLs, entities and subtitle format sniffing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def tokens(text: Column, separators: str = " \t\r\n") -> Column:
    """Non-empty tokens between any of the separators."""
    kind = "[" + "".join(f"\\x{ord(c):02x}" for c in separators) + "]+"
    return F.filter(F.split(text, kind), lambda t: t != "")


def stripped_tokens(text: Column, separators: str, strip: str = " \t") -> Column:
    return F.filter(F.transform(tokens(text, separators), lambda t: F.btrim(t, F.lit(strip))), lambda t: t != "")


def find_word(text: Column, word: str) -> Column:
    """1-based place of word between characters that are no word characters; 0 if there is none."""
    return F.regexp_instr(text, F.lit(rf"(?<!\w)\Q{word}\E(?!\w)"))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    """The last rule of `similar_words`: characters taken, and how many of their takers follow on."""

    def one(a: str | None, b: str | None) -> bool:
        if not a or not b:
            return False
        free: dict[str, list[int]] = {}
        for j in range(len(a) - 1, -1, -1):
            free.setdefault(a[j], []).append(j)
        taken = [0] * len(a)
        for i, c in enumerate(b, 1):
            if places := free.get(c):
                taken[places.pop()] = i
        matched = len(a) - taken.count(0)
        run = sum(by == before + 1 for before, by in zip([0, *taken], taken))
        return 2 * matched >= len(a) and (len(a) <= 4 and run >= 2 or 2 * run >= max(len(a), len(b)))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def similar_words(a: Column | str, b: Column | str) -> Column:
    """Whether word b is alike enough to be suggested for a. Never null: two nulls, and two equal words, are alike.

    A word of three characters or more that begins the other is alike. If b is more than twice as long, it has to contain a
    (letter case aside), and both or neither hold a colon. Else one that holds the other, of three or more, is alike. Else each
    character of b takes the first equal one of a that is still free: half of a's must be taken, and then as many must follow
    on (their takers are neighbours in b, or the first is b's first) as half of either word, or two if a has four at most."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n, m, low_a, low_b = F.length(a), F.length(b), F.lower(a), F.lower(b)
    begins = ((n >= 3) & (n < m) & b.startswith(a)) | ((m >= 3) & (m < n) & a.startswith(b))
    far = (F.contains(a, F.lit(":")) == F.contains(b, F.lit(":"))) & F.contains(low_b, low_a)
    holds = ((m >= 3) & F.contains(low_a, low_b)) | ((n >= 3) & F.contains(low_b, low_a))
    near = _near(a, b)
    told = F.when(a.eqNullSafe(b), True).when(a.isNull() | b.isNull() | (n == 0) | (m == 0), False)
    return told.when(begins, True).when(2 * n < m, far).when(holds, True).otherwise(near)


#: What marks a URL with a scheme.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def url_is_local(url: Column) -> Column:
    return ~url.rlike(_SCHEME) | url.startswith("file://")


def url_is_relative(url: Column) -> Column:
    return ~url.rlike(_SCHEME) & ~url.startswith("/") & ~url.startswith("data:")


def url_join(base: Column, url: Column) -> Column:
    """url against base: absolute URLs stay, `/x` goes to the host, anything else to the folder; `./` and `x/../` vanish, however
    deep. A query or fragment stays as it is."""
    host = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "/")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = F.when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, url))
    tail = F.regexp_extract(joined, r"[?#].*$", 0)
    path = F.substring(F.regexp_replace(joined, r"[?#].*$", ""), F.length(host) + 1, F.length(joined))

    def step(done: Column, part: Column) -> Column:
        inner = (F.size(done) > 0) & ~F.coalesce(F.element_at(done, -1), F.lit("")).isin("", "..")
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when((part == "..") & inner, up).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(host, F.concat_ws("/", parts), tail)
    return F.when(url_is_relative(url) | url.startswith("/"), joined).otherwise(url)


def url_base_name(url: Column) -> Column:
    """The last part of the path, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/\\]*)$", 1)


def url_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(url_base_name(url), r"\.([^.]+)$", 1))


def url_escape(url: Column) -> Column:
    """Escapes spaces, bytes from 0x80 up, and a `%` followed by two characters that aren't both hexadecimal; no more."""
    text = F.regexp_replace(url, r"(?s)%(?![0-9A-Fa-f]{2})(?=..)", "%25")
    text = F.replace(text, F.lit(" "), F.lit("%20"))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0)), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")).otherwise(t))
    return F.concat_ws("", quoted)


def url_unescape(url: Column) -> Column:
    """%xx as bytes of UTF-8; `+` stays, as does a % that no two digits follow."""
    return F.url_decode(F.replace(F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


#: The entities that XML itself defines.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def unescape_entities(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape_entities(text: Column) -> Column:
    for name, char in reversed(ENTITIES.items()):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def subtitle_format(text: Column) -> Column:
    """srt, vtt, ttml, ssa, sub, m3u8, or null, from a file's first characters."""
    head = F.ltrim(F.regexp_replace(F.substring(text, 1, 512), "^﻿", ""))
    return (
        F.when(head.startswith("WEBVTT"), "vtt")
        .when(head.startswith("#EXTM3U"), "m3u8")
        .when(head.rlike(r"^(?:<\?xml[^>]*>\s*)?<(?:\w+:)?tt[\s>]"), "ttml")
        .when(head.startswith("[Script Info]"), "ssa")
        .when(head.rlike(r"^\{\d+\}\{\d+\}"), "sub")
        .when(head.rlike(r"^\d+\s*\r?\n\d{1,2}:\d{2}:\d{2}[,.]\d{3}\s*-->"), "srt")
    )


def decode_utf16(data: Column) -> Column:
    """Bytes as text: by their byte-order mark, else as UTF-8."""
    rest = lambda n: F.substring(data, F.lit(n), F.length(data))
    head = F.hex(F.substring(data, 1, 3))
    return F.when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE")).when(head == "EFBBBF", F.decode(rest(4), "UTF-8")).otherwise(F.decode(data, "UTF-8"))


#: Language names and codes of two and three letters (fixed values; pass a map of your own for more).
LANGUAGES = {
    "en": ("eng", "English"), "fr": ("fra", "French"), "de": ("deu", "German"), "es": ("spa", "Spanish"), "it": ("ita", "Italian"),
    "pt": ("por", "Portuguese"), "nl": ("nld", "Dutch"), "sv": ("swe", "Swedish"), "pl": ("pol", "Polish"), "ru": ("rus", "Russian"),
    "zh": ("zho", "Chinese"), "ja": ("jpn", "Japanese"), "ko": ("kor", "Korean"), "ar": ("ara", "Arabic"), "hi": ("hin", "Hindi"),
}


def language(code: Column, languages: dict[str, tuple[str, str]] = LANGUAGES) -> Column:
    """struct(two, three, name) of a language given by either code or its name, region and letter case aside; null if unknown."""
    entries = {k.lower(): (two, three, name) for two, (three, name) in languages.items() for k in (two, three, name)}
    table = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.struct(*[F.lit(c).alias(n) for c, n in zip(v, ("two", "three", "name"), strict=True)]))])
    return F.try_element_at(table, F.lower(F.regexp_extract(code, "^[^-_]*", 0)))


def is_legal_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))
