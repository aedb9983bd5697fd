"""Every registered query against its SQL counterpart in DuckDB, over the whole smallest tables."""

import math
import os

import pytest

from threadloom.catalog import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i]:.8g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: kinds[k] for c, k in df.dtypes} == {d[0]: str(d[1]) for d in want.description}
    got = [tuple(r) for r in df.collect()]
    assert rows(got, df.columns) == rows(want.fetchall(), names)
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


def test_the_rest_runs(spark, duck):
    ties = QUERIES["projection"](spark, DIR)
    ends = lambda df: sorted((r.id, r["count"]) for r in df.selectExpr("explode(array(a, b)) AS id").groupBy("id").count().collect())
    null = QUERIES["null_model"](spark, DIR)
    assert ends(null) == ends(ties) and null.count() == ties.count()
    reference, other = (duck.execute(f"SELECT s_suppkey, {x} FROM supplier").fetchall() for x in ("s_nationkey", "s_suppkey % 5"))
    aligned = dict(tuple(r) for r in QUERIES["alignment"](spark, DIR).collect())
    assert len({(aligned[i], x) for i, x in other}) == len({x for _, x in other})
    assert sum(aligned[i] == x for i, x in reference) >= max(sum(x == n and y == k for (_, x), (_, y) in zip(reference, other)) for n in range(25) for k in range(5))
    label = dict(tuple(r) for r in QUERIES["louvain"](spark, DIR).collect())
    assert set(label) == {i for i, _ in ends(ties)} and set(label.values()) == set(range(len(set(label.values()))))
    weights, held, inside = [tuple(r) for r in ties.collect()], {}, 0
    for a, b, w in weights:
        inside += w * (label[a] == label[b])
        for x in (a, b):
            held[label[x]] = held.get(label[x], 0) + w
    m = sum(w for *_, w in weights)
    quality = inside / m - sum((k / (2 * m)) ** 2 for k in held.values())
    runs = {r.run: r for r in QUERIES["stability"](spark, DIR).collect()}
    assert set(runs) == set(range(10)) and math.isclose(runs[0].modularity, quality, abs_tol=1e-8) and runs[0].rand == 1
    assert quality > -1e-9 and all(-1e-9 < r.modularity < 1 and 0 <= r.rand <= 1 and 1 <= r.largest <= len(label) for r in runs.values())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
