"""Property maps and the small languages over them: predicates, conditional values and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(first: Column, second: Column) -> Column:
    """Both maps' entries; the second's values win."""
    return F.map_concat(F.map_filter(F.coalesce(first, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(second, k), F.lit(False))), F.coalesce(second, F.create_map().cast("map<string,string>")))


def without(props: Column, *names: str) -> Column:
    return F.map_filter(props, lambda k, _: ~k.isin(*names))


def get(props: Column, name: str) -> Column:
    return F.try_element_at(props, F.lit(name))


def maps_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def text_matches(a: Column, b: Column) -> Column:
    """Loose equality of text: `*` on either side, and `x|y` for alternatives, match."""
    return (a == b) | (a == "*") | (b == "*") | F.array_contains(F.split(b, r"\|"), a) | F.array_contains(F.split(a, r"\|"), b)


def lists_match(a: Column, b: Column) -> Column:
    """Text lists: as many entries, and each entry of one is in the other exactly once; order doesn't count."""
    once = F.forall(a, lambda x: F.size(F.filter(b, lambda y: y == x)) == 1)
    return (F.size(a) == F.size(b)) & once


#: Kinds that a predicate may start with.
KINDS = ("audio", "video", "text", "scene", "file")
_PART = re.compile(r"(?P<name>\w+)(?P<op>=!|=|-|\+)(?P<value>.+)")


def predicate(text: str, columns: list[str], kind: str = "stream_type", rank: str = "kind_rank") -> Column:
    """A stream predicate: parts joined by `#`, all of which must hold.

    `name=value`, `name=!value`, `name-value` (below), `name+value` (above), `audio` or `audio2` (second of its kind). A value
    that names a column stands for it. A property that is missing (null, or no such column) matches."""
    out = F.lit(True)
    for part in filter(None, text.split("#")):
        if m := re.fullmatch(rf"({'|'.join(KINDS)})(\d*)", part):
            out = out & (F.col(kind) == m[1]) & ((F.col(rank) == int(m[2])) if m[2] else F.lit(True))
            continue
        m = _PART.fullmatch(part)
        if not m:
            raise ValueError(f"not a predicate: {part}")
        if m["name"] not in columns:
            continue
        left, value = F.col(m["name"]), m["value"]
        right = F.col(value) if value in columns else F.lit(float(value) if re.fullmatch(r"-?\d+(\.\d+)?", value) else value)
        test = {"=": text_matches(left, F.lit(value)) if value not in columns and re.search(r"[*|]", value) else left == right, "=!": left != right, "-": left < right, "+": left > right}[m["op"]]
        out = out & (left.isNull() | right.isNull() | test)
    return out


def conditional(text: str) -> Column:
    """`(name=value)RESULT,(name=value)RESULT,()DEFAULT`: the first that matches; null without a default."""
    out, default = None, F.lit(None).cast("string")
    for name, value, result in re.findall(r"\((?:(\w+)=([^)]*))?\)([^,]*)", text):
        if not name:
            default = F.lit(result)
            break
        test = F.col(name).cast("string") == value
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return default if out is None else out.otherwise(default)


def template(text: str, index: str = "seq") -> Column:
    """`$Name$` is a column's value, `$num%05d$` the row's number in a format, `$GINC(start,step)$` start + number * step."""
    parts = []
    for i, piece in enumerate(text.split("$")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif m := re.fullmatch(r"GINC\((-?\d+),(-?\d+)\)", piece):
            parts.append((F.col(index) * int(m[2]) + int(m[1])).cast("string"))
        elif m := re.fullmatch(r"num(%0?\d*d)?", piece):
            parts.append(F.format_string(m[1] or "%d", F.col(index)))
        else:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
    return F.concat(*parts)


def assign(df: DataFrame, **values: Column | None) -> DataFrame:
    """Sets columns; None removes one."""
    return df.withColumns({k: v for k, v in values.items() if v is not None}).drop(*[k for k, v in values.items() if v is None])


def source_matches(name: Column, pattern: str) -> Column:
    """A source name against a pattern: `AB*` takes what begins with AB, `*` all, and anything else itself."""
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def list_insert(values: Column, at: int, value: Column) -> Column:
    """values with one more at a 0-based place; beyond the end it comes last."""
    return F.concat(F.slice(values, 1, at), F.array(value), F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))))


def list_remove_at(values: Column, at: int) -> Column:
    return F.filter(values, lambda _, i: i != at)


def list_swap(values: Column, a: int, b: int) -> Column:
    """values with two 0-based places exchanged, if both are there."""
    other = lambda x, i: F.when(i == a, F.get(values, F.lit(b))).when(i == b, F.get(values, F.lit(a))).otherwise(x)
    return F.when(F.size(values) > max(a, b), F.transform(values, other)).otherwise(values)


def list_find(values: Column, value: Column) -> Column:
    """0-based place of the first equal value, -1 if there is none."""
    return F.array_position(values, value) - 1
