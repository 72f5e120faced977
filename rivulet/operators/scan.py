"""Running values along streams, in two levels, so that a stream that holds a large share of all rows spreads over tasks.

A stream's rows are cut into chunks by a column that grows with their order (such as hours of time). Windows run within
(stream, chunk); one row per chunk carries sums, maxima and edge values over the chunks; the two are joined. All rows are
shuffled once, by (stream, chunk), and the chunks' table is smaller by the rows that a chunk holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Named = dict[str, Column]


def scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    chunk: Column,
    sums: Named | None = None,
    before_max: Named | None = None,
    lasts: Named | None = None,
    lags: Named | None = None,
    nexts: Named | None = None,
    leads: Named | None = None,
) -> DataFrame:
    """df with running columns, in the total order `order` within `by`; chunk must not fall along that order.

    sums: up to and with the row. before_max: of the rows before. lasts and nexts: the nearest value that isn't null at or
    before (after) the row; lags and leads: strictly before (after). Null stream ids are one stream."""
    sums, before_max, lasts, lags, nexts, leads = (x or {} for x in (sums, before_max, lasts, lags, nexts, leads))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    own = Window.partitionBy(*by, "_chunk").orderBy(*order)
    place = F.struct(*order)
    rows = df.withColumn("_chunk", chunk)
    local, carry, total = {}, {}, {}
    edge = lambda pick, c: pick(F.when(c.isNotNull(), F.struct(place.alias("o"), c.alias("v"))))["v"]
    for n, c in sums.items():
        local[n], total[n] = F.sum(c).over(own.rowsBetween(first, 0)), F.sum(c)
        carry[n] = (F.sum, (first, -1))
    for n, c in before_max.items():
        local[n], total[n] = F.max(c).over(own.rowsBetween(first, -1)), F.max(c)
        carry[n] = (F.max, (first, -1))
    for group, reach in ((lasts, 0), (lags, -1)):
        for n, c in group.items():
            local[n], total[n] = F.last(c, True).over(own.rowsBetween(first, reach)), edge(F.max, c)
            carry[n] = (lambda x: F.last(x, True), (first, -1))
    for group, reach in ((nexts, 0), (leads, 1)):
        for n, c in group.items():
            local[n], total[n] = F.first(c, True).over(own.rowsBetween(reach, last)), edge(F.min, c)
            carry[n] = (lambda x: F.first(x, True), (1, last))
    totals = rows.groupBy(*by, "_chunk").agg(*[c.alias(f"_t_{n}") for n, c in total.items()])
    along = Window.partitionBy(*by).orderBy("_chunk")
    ahead = totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_chunk")], *[f(F.col(f"_t_{n}")).over(along.rowsBetween(*span)).alias(f"_c_{n}") for n, (f, span) in carry.items()])
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, "_chunk")]
    both = rows.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()]).join(ahead, on)
    made = {}
    for n in local:
        here, brought = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        made[n] = F.coalesce(here + brought, here, brought) if n in sums else F.greatest(here, brought) if n in before_max else F.coalesce(here, brought)
    return both.select(*[c for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def count_marks(df: DataFrame, by: list[str], order: list[str], chunk: Column, values: Named, mark: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """df with `name`: the sum of mark(before, own) over all rows up to and with each, in the order of `scan`. before and own
    are structs of `values` of the row before (null for a stream's first) and of the row itself.

    One step where a scan of the row before and another of its marks would be two: a chunk's first mark is made in the chunks'
    table, where the last row of the chunk before is known."""
    own = Window.partitionBy(*by, "_chunk").orderBy(*order)
    held = F.struct(*[c.alias(n) for n, c in values.items()])
    rows = df.withColumn("_chunk", chunk).withColumn("_own", held)
    rows = rows.withColumn("_before", F.lag("_own").over(own)).withColumn("_place", F.row_number().over(own))
    inner = F.when(F.col("_place") > 1, mark(F.col("_before"), F.col("_own"))).otherwise(F.lit(0))
    rows = rows.withColumn("_sum", F.sum(inner.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy(*by, "_chunk").agg(F.max_by("_sum", "_place").alias("_all"), F.min_by("_own", "_place").alias("_head"), F.max_by("_own", "_place").alias("_tail"))
    along = Window.partitionBy(*by).orderBy("_chunk")
    first = F.coalesce(mark(F.lag("_tail").over(along), F.col("_head")), F.lit(0)).cast("long")
    edges = edges.withColumn("_first", first)
    behind = F.coalesce(F.sum(F.col("_all") + F.col("_first")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = edges.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_chunk")], (behind + F.col("_first")).alias("_base"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, "_chunk")]
    return rows.join(ahead, on).select(*[c for c in df.columns if c != name], (F.col("_sum") + F.col("_base")).alias(name))


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def ordered_fold(df: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, list[dict]]], schema: str, end: Callable[[object], list[dict]] | None = None) -> DataFrame:
    """For rules whose next output depends on the last one: step(state, row) -> (state, rows out) in each stream's order,
    and end(state) when a stream ends. Streams are spread over tasks and sorted there (with spill); a task holds one batch
    and one state at a time, so a long stream needs time but no memory. Rows pass in Arrow batches, so that whole numbers
    stay whole beside nulls."""
    target = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[b] for b in by)
                if now != key:
                    if now is not None and end:
                        out += end(state)
                    now, state = key, start()
                state, more = step(state, row)
                out += more
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if now is not None and end and (rest := end(state)):
            yield pa.RecordBatch.from_pylist(rest, schema=target)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
