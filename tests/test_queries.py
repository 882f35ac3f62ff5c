"""Every query with a SQL twin gives the same rows in DuckDB; every other runs."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from roadgeo import registry
from roadgeo import views as V

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.ORACLES:
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in got.fetchall()]
    assert Counter(rows) == Counter(want)


def test_elevations_of_nodes_are_the_same_in_sql(spark, tmp_path):
    """Small balances have digits that adding 30 and taking it off again would lose; nodes 5 or 10 feet apart show it."""
    rows = [(k * 120, k % 25, round((k * 37 % 12_000 - 6_000) / 100, 2)) for k in range(4000)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, V.nodes(spark, str(tmp_path)).select("node_id", "elev").collect())) == con.execute(f"SELECT node_id, elev FROM ({V.SQL['nodes']}) ORDER BY 1").fetchall()


def test_sight_lines_that_touch_and_shares_of_halves_are_those_of_sql(spark, tmp_path):
    """Where the line of sight to an object just touches the ground before it, and where a share ends in half a millionth, the order of the sums decides."""
    rows = []
    for user in range(400):
        eye = round(0.07 + user * 1.37, 2)
        rows += [(user, [eye, 0, 0, round(eye + 3.5, 2), 0, 0, 0, 0, 0, round(eye + 1.5, 2), 0])]
    rows.append((1000, [1000.0 if i in (100, 200, 206, 300, 306) else 0.0 for i in range(640)]))
    events = [(user * 1000 + i, user, float(z)) for user, values in rows for i, z in enumerate(values)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_seconds(event_id) as ts", "user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for t in ("orders", "supplier"):
        (tmp_path / f"{t}.parquet").symlink_to(DATA / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("sight_distance", "blind_share"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]}) ORDER BY ALL").fetchall()
        assert sorted(map(tuple, df.collect())) == got
    assert [r for r in got if r[0] == 1000][0][2] == 0.064062  # 41 of 640
