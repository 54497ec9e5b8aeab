"""Queries on whole tables against brute force, at a size where the former id filters cut rows."""

import os
from collections import defaultdict

import pandas as pd
import pytest

from quillon.plans import all_queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def run(spark, name):
    return all_queries.QUERIES[name](spark, SF).toPandas()


def test_ranges_of_every_order(spark):
    keys = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey"]).o_orderkey.tolist()
    pages = {k: ",".join(map(str, sorted({*range(k % 7 + 1, k % 7 + 2 + k % 4), k % 3 + 1}))) for k in keys}
    got = run(spark, "f23_page_ranges")
    assert len(got) == len(keys) and dict(zip(got.o_orderkey, got.pages)) == pages
    ids = {k: ",".join(str(i) for i in range(min(k % 9, k % 5), max(k % 9, k % 5) + 1) if i % 2 == 0) for k in keys}
    got = run(spark, "f24_order_ranges")
    assert len(got) == len(keys) and dict(zip(got.o_orderkey, got.ids)) == ids


def test_lines_of_every_user(spark):
    events = pd.read_parquet(f"{SF}/events.parquet", columns=["user_id", "event_id"]).sort_values("event_id")
    want = {u: (len(g), ",".join(map(str, g.event_id))) for u, g in events.groupby("user_id")}
    got = run(spark, "s09_json_lines")
    assert len(got) == len(want) and {r.user_id: (r.lines, r.results) for r in got.itertuples()} == want


def test_union_of_all_events_and_orders(spark):
    events, orders = pd.read_parquet(f"{SF}/events.parquet"), pd.read_parquet(f"{SF}/orders.parquet")
    jobs = defaultdict(list)
    for u, ts, seq, kind in zip(events.user_id, pd.to_datetime(events.ts), events.event_id, events.event_type):
        jobs[u].append((ts, seq, kind))
    for u, ts, seq, kind in zip(orders.o_custkey, pd.to_datetime(orders.o_orderdate), orders.o_orderkey, orders.o_orderstatus):
        jobs[u].append((ts, seq, kind))
    want = sorted((u, seq, kind, i) for u, rows in jobs.items() for i, (_, seq, kind) in enumerate(sorted(rows), 1))
    got = run(spark, "w15_event_union")
    assert sorted(got[["job_id", "source_seq", "event", "seq"]].itertuples(index=False, name=None)) == want
