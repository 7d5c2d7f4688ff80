"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from cairnflow.plans import catalogue
from cairnflow.sources.views import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.11g}")
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([tidy(r[i]) for i in order] for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.SQL[name])
    names, found = [d[0] for d in want.description], want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_and_repeats(spark, sf, name):
    a, b = (rows(df.columns, [tuple(r) for r in df.collect()]) for df in (catalogue.QUERIES[name](spark, sf) for _ in range(2)))
    assert a and a == b


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_equals_batch_on_all_events(spark, sf):
    batch, stream = (catalogue.QUERIES[n](spark, sf) for n in ("shadow_state_batch", "stream_shadow_state"))
    order = ["replay_id"]
    assert batch.orderBy(order).collect() == stream.orderBy(order).collect()


def test_command_line(spark, sf, tmp_path, capsys):
    from cairnflow.__main__ import main
    from cairnflow.sources.views import view

    assert main(["queries"]) == 0 and "readiness_score" in capsys.readouterr().out
    view(spark, sf, "obs").write.parquet(f"{tmp_path}/obs")
    view(spark, sf, "cfg").drop("n_nationkey").write.parquet(f"{tmp_path}/cfg")
    assert main(["status", f"{tmp_path}/obs", "--now", catalogue.NOW, "--html", f"{tmp_path}/x.html"]) == 0
    assert main(["advance", f"{tmp_path}/obs", f"{tmp_path}/cfg", "--now", catalogue.NOW, "--out", f"{tmp_path}/new"]) == 0
    assert spark.read.parquet(f"{tmp_path}/new").count() == 25
