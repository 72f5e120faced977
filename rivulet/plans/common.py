"""What the query modules share: the registry, and the packet table in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: 2024-01-01 in ms, and a day.
T0, DAY = 1_704_067_200_000, 86_400_000

#: The packet table of `events` as a common table expression.
P = """p as (
  select user_id as pid, event_id, epoch_us(ts) // 1000 as cts, case event_type when 'signup' then 1 when 'click' then 2 else 0 end as sap,
         cast(length(props) as bigint) as size, event_type, value, props, row_number() over w - 1 as seq,
         coalesce(lead(epoch_us(ts) // 1000) over w - epoch_us(ts) // 1000, 0) as dur
  from events window w as (partition by user_id order by epoch_us(ts) // 1000, event_id))"""


class Registry:
    """Collects queries and their SQL; `{P}` in SQL stands for the packet table."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql.replace("{P}", P)
            return f

        return keep
