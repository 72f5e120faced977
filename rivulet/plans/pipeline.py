"""Chains of operators by name, with a registry of user operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rivulet.operators.scan import arrow_schema

Operator = Callable[..., DataFrame]


class Pipeline:
    """A graph of named steps, each a function of DataFrames; nothing runs until a result is asked for an action.

    >>> p = Pipeline().add("in", lambda: df).add("keep", keep_saps, "in", 1).add("cut", gap_segments, "keep", threshold=1000)
    >>> p["cut"]
    """

    def __init__(self) -> None:
        self.steps: dict[str, tuple[Operator, tuple[str, ...], tuple, dict]] = {}
        self.made: dict[str, DataFrame] = {}

    def add(self, name: str, operator: Operator, inputs: str | tuple[str, ...] = (), *args: object, **options: object) -> Pipeline:
        """inputs: names of steps that were added before."""
        inputs = (inputs,) if isinstance(inputs, str) else tuple(inputs)
        if missing := [i for i in inputs if i not in self.steps]:
            raise KeyError(f"{name} reads {missing}, which no step makes")
        if name in self.steps:
            raise KeyError(f"there is a step {name} already")
        self.steps[name] = (operator, inputs, args, options)
        return self

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            operator, inputs, args, options = self.steps[name]
            self.made[name] = operator(*[self[i] for i in inputs], *args, **options)
        return self.made[name]

    def remove(self, name: str) -> Pipeline:
        if users := [k for k, s in self.steps.items() if name in s[1]]:
            raise KeyError(f"{users} read {name}")
        del self.steps[name]
        self.made.pop(name, None)
        return self

    def describe(self) -> list[tuple[str, str, tuple[str, ...]]]:
        """name, operator and inputs of each step."""
        return [(k, getattr(s[0], "__name__", "?"), s[1]) for k, s in self.steps.items()]


def scripted(df: DataFrame, process: Callable[[dict], dict | list[dict] | None], schema: str) -> DataFrame:
    """A user's function over packets: a row in; none, one or many rows out. Rows pass in Arrow batches."""
    target = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                got = process(row)
                out += [got] if isinstance(got, dict) else got or []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)

    return df.mapInArrow(run, schema)


def inspect(df: DataFrame) -> DataFrame:
    """One row per column: name, type, values that aren't null, least and largest as text. One pass over the rows."""
    from pyspark.sql import functions as F

    plain = [f for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    parts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("present"), F.min(f.name).cast("string").alias("least"), F.max(f.name).cast("string").alias("largest")) for f in plain]
    return df.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
