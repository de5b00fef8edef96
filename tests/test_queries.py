"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from siftline.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def rows(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, SF).collect()}


def texts(spark, table, key, text):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key, text).collect()]


def test_slices_by_brute_force(spark):
    from siftline.operators.items import slice_spans

    want = {(d, f"s{i + 1}", a, b, b - a < len(t)) for d, t in texts(spark, "documents", "doc_id", "text") for i, (a, b) in enumerate(slice_spans(t, 6000))}
    assert rows(spark, "slice_partition") == want


def test_readable_text_by_brute_force(spark):
    from siftline.functions.html import read_html

    pages = texts(spark, "pages", "page_id", "html")
    assert rows(spark, "readable_text") == {(p, read_html(h)) for p, h in pages} and any(read_html(h) for _, h in pages)
    kept = {p: len(read_html(h).split()) for p, h in pages}
    dense = rows(spark, "density_gate")
    assert all(k == kept[p] and d == (w < 200 or 5 * k >= w) for p, w, k, d in dense) and len(dense) == len(pages)


def test_near_quotes_by_brute_force(spark):
    """Every quote against each document of which something was found, and against a twentieth of the others."""
    from siftline.operators import grounding

    fuzzy, got = rows(spark, "ground_fuzzy"), rows(spark, "ground_ladder")
    seen = {r[0] for r in fuzzy | got}
    docs = [(d, t) for d, t in texts(spark, "documents", "doc_id", "text") if d in seen or d % 20 == 0]
    items = texts(spark, "benchmark", "item_id", "text")
    altered = [(i, q[: len(q) // 2] + "#" + q[len(q) // 2 + 1 :]) for i, q in items]
    want = {(d, i, *found) for d, t in docs for i, q in altered if t and (found := grounding.fuzzy_find(q, t))}
    assert fuzzy == want and want
    loose = {i: q.replace(", ", ",\u00a0").replace(". ", ".  ") + " " for i, q in items}
    every = [(i, {0: q, 1: loose[i], 2: dict(altered)[i]}[i % 3]) for i, q in items]
    want = {(d, i, *found) for d, t in docs for i, q in every if t and (found := grounding.resolve(q, t))[0] != "missing"}
    assert {r for r in got if r[2] != "missing"} == want and {r[2] for r in want} >= {"exact", "normalized"}


def test_calibration_fits(spark):
    found = QUERIES["calibration_fit"](spark, SF).collect()
    totals = {}
    for r in found:
        totals[r[0]] = totals.get(r[0], 0) + r.points
    assert set(totals.values()) == {100} and all(r.mse >= 0 for r in found)
    assert set(QUERIES) - set(ORACLES) == {"slice_partition", "readable_text", "density_gate", "ground_fuzzy", "ground_ladder", "calibration_fit", "calibration_tables", "truth_sample_seeded"}


def test_entry_points_hold_all_queries(spark):
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert entry_points.entry(spark).count() > 0
