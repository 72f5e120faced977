"""Every query with SQL against DuckDB, and every other against a plain version."""

import os
from collections import Counter

import duckdb
import pytest

from rivulet.plans import catalog


@pytest.fixture(scope="session")
def duck(sf_dir):
    def run(sql):
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'").fetchall()
        return con.sql(sql)

    return run


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), duck(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    pick = lambda names, rows: Counter(tuple(r[names.index(c)] for c in cols) for r in rows)
    assert pick(got.columns, map(tuple, got.collect())) == pick(want.columns, want.fetchall())


def streams(spark, sf_dir):
    from rivulet.operators.packets import event_packets

    out = {}
    for r in event_packets(spark, sf_dir).orderBy("pid", "cts", "event_id").collect():
        out.setdefault(r["pid"], []).append(r)
    return out


def test_jitter(spark, sf_dir):
    want = {}
    for pid, rows in streams(spark, sf_dir).items():
        j, last = 0, None
        for r in rows:
            d = r["event_id"] % 40
            if last is not None:
                j += abs(d - last) - ((j + 8) >> 4)
            last = d
        want[pid] = j >> 4
    assert {r["pid"]: r["jitter"] for r in catalog.QUERIES["a12_jitter"](spark, sf_dir).collect()} == want


def test_greedy_splits(spark, sf_dir):
    rows = streams(spark, sf_dir)
    for name, column, least, key in (("w5_split_size", "size", 100, "event_id"), ("s5_interleave", "dur", 86_400_000, "id")):
        want = {}
        for own in rows.values():
            part = held = 0
            for r in own:
                if held and held + r[column] > least:
                    part, held = part + 1, 0
                held += r[column]
                want[r["event_id"]] = part
        assert {r[key]: r["part" if name[0] == "w" else "chunk"] for r in catalog.QUERIES[name](spark, sf_dir).collect()} == want


def test_align(spark, sf_dir):
    want = {}
    for own in streams(spark, sf_dir).values():
        last = least = None
        for r in own:
            t = r["cts"]
            if last is not None and least is not None and abs(t - last - least) > 60_000:
                t = last + least
            if r["dur"] > 0:
                least = min(least or r["dur"], r["dur"])
            last = want[r["event_id"]] = t
    assert {r["event_id"]: r["out_ts"] for r in catalog.QUERIES["w3_align"](spark, sf_dir).collect()} == want


def test_sessions_are_gap_segments(spark, sf_dir):
    """The stream's sessions are those that a batch pass finds."""
    want, gap = set(), 6 * 3_600_000
    for pid, own in streams(spark, sf_dir).items():
        run = []
        for r in [*own, None]:
            if run and (r is None or r["cts"] - run[-1] >= gap):
                want.add((pid, run[0], run[-1] + gap, len(run)))
                run = []
            if r is not None:
                run.append(r["cts"])
    got = {tuple(r) for r in catalog.QUERIES["t6_stream_sessions"](spark, sf_dir).select("pid", "start_ms", "end_ms", "packets").collect()}
    assert got == want
