"""Bars and order sums of the driver tables: right rows, and one reading of a large table in a run."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.plans import catalog, catalog_sessions
from pulsegrid.plans import inputs as I

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double"
ORDERS = "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def low(row):
    """Nulls first, as Spark orders them."""
    return [(v is not None, v) for v in row]


def lines():
    day = lambda i: None if i % 13 == 0 else datetime(1995, 1, 2) + timedelta(days=i % 7)
    rows = []
    for i in range(400):
        order = None if i % 3 == 0 else 10 + i % 5
        rows.append((order, i % 4, None if i % 6 == 0 else i % 9, i % 3, float(i % 8), None if i % 17 == 0 else 100.0 + i,
                     None if i % 19 == 0 else "ANR"[i % 3], None if i % 23 == 0 else "OF"[i % 2], day(i)))
    rows.append((None, 1, 1, 1, 2.0, 7.0, "Z", "O", datetime(1995, 2, 1)))  # a bar without any order key
    return rows + rows[:40]


def events():
    at = datetime(2024, 1, 1, 5)
    rows = [(None if i % 4 == 0 else i % 6, None if i % 11 == 0 else at + timedelta(minutes=20 * (i // 9)), None if i % 13 == 0 else ("click", "cart")[i % 2],
             None if i % 7 == 0 else float(i)) for i in range(200)]
    return list({(r[0], r[1], r[2]): r for r in rows}.values())


def orders():
    return [(i, None if i % 10 == 0 else 1000.0 + 37.0 * i, None if i % 21 == 0 else datetime(1995, 1, 1) + timedelta(days=i % 40), ("1-URGENT", "2-HIGH", "5-LOW", None)[i % 4])
            for i in range(200)]


def tables(spark, folder, *parts):
    for name, rows, schema in parts:
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return I.Tables(spark, str(folder))


def test_session_bars(spark, tmp_path):
    t = tables(spark, tmp_path, ("lineitem", lines(), LINES))
    groups = defaultdict(list)
    for r in lines():
        groups[r[7], r[6], r[8]].append(r)
    want = []
    for (status, flag, day), rs in groups.items():
        last = max(rs, key=lambda r: low((r[0], r[3], r[1], r[2], r[5])))
        want.append(("_".join(v for v in (status, flag) if v is not None), "fx" if status == "O" else "gg", day, last[5], sum(r[4] for r in rs)))
    got = [tuple(r) for r in I.session_bars(t).select("file_name_clean", "root_code", "Time", "Latest", "Volume").collect()]
    assert sorted(got, key=low) == sorted(want, key=low)


def test_hourly_bars(spark, tmp_path):
    t = tables(spark, tmp_path, ("events", events(), EVENTS))
    groups = defaultdict(list)
    for r in events():
        groups[r[2], r[1] and r[1].replace(minute=0)].append(r)
    want = []
    for (kind, hour), rs in groups.items():
        known = [r[3] for r in rs if r[3] is not None]
        ordered = sorted(rs, key=lambda r: low((r[1], r[0])))
        want.append((kind, hour, ordered[0][3], max(known, default=None), min(known, default=None), ordered[-1][3], float(len(rs))))
    got = [tuple(r) for r in I.hourly_bars(t).select("file_name_clean", "Time", "Open", "High", "Low", "Latest", "Volume").collect()]
    assert sorted(got, key=low) == sorted(want, key=low)


def test_session_surprises(spark, tmp_path):
    t = tables(spark, tmp_path, ("orders", orders(), ORDERS))
    mean = lambda v: sum(v) / len(v) if v else None
    session = lambda d: d and (d - datetime(1995, 1, 1)).days // 10
    of = lambda s, p: [r[1] for r in orders() if r[1] is not None and s in ("all", session(r[2])) and (p is None or (r[3] or "")[:1] == p)]
    got = {r["session"]: r for r in I.session_surprises(t).collect()}
    assert set(got) == {session(r[2]) for r in orders()}
    for s, row in got.items():
        for m, p in (("1m", None), ("6m", "1"), ("1y", "2"), ("2y", "3")):
            own, whole = mean(of(s, p)), mean(of("all", p))
            found = row[f"ois_{m}_raw"]
            assert (found is None) if own is None or whole is None else abs(found - (own - whole) / 1000) < 1e-9


def test_large_tables_are_read_once(spark, tmp_path):
    """Every later step reads the bars, not the tables they are made of."""
    t = tables(spark, tmp_path, ("lineitem", lines(), LINES), ("events", events(), EVENTS), ("orders", orders(), ORDERS))
    plans = (I.session_bars(t), I.session_clocks(t), I.hourly_bars(t), I.hourly_calendar(t), I.session_surprises(t), I.dirty_lines(t),
             catalog.session_candidates(t), catalog.hourly_days(t), catalog_sessions.session_slots(t))
    for plan in plans:
        assert not [f for f in plan.inputFiles() if any(f"/{n}.parquet/" in f for n in ("lineitem", "events", "orders"))]
    assert I.session_clocks(t).where(F.col("session").isNull()).count() == 1
