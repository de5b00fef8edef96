"""Fitted tables against plain scores, and against SQL over the same tables."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from siftline.operators import calibrate
from siftline.operators.calibrate import Calibration
from siftline.queries import scores as Q
from siftline.queries.base import Tables

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 1)
KNOWN = Calibration({"q1_delivery_proof": 40.0, "q3_delivery_hiring": 25.0, "q4_growth_signal": 35.0}, {"firm.com": 0.5, "firm.com/blog": 0.9, "board": 0.2}, 0.3, {"q1_delivery_proof": 200.0})


def worth(c, item, uri, captured):
    match = max((p for p in c.weights if p in uri.lower()), key=len, default=None)
    age = max(0.0, (NOW - captured).total_seconds() / 86400) if captured else 0.0
    return (c.default if match is None else c.weights[match]) * (0.5 ** (age / c.half_lives[item]) if item in c.half_lives else 1)


def score(c, quotes):
    best = {}
    for item, category, uri, captured in quotes:
        if item in c.points and category in {"q1_delivery_proof": ("",), "q3_delivery_hiring": ("ATS_REQUISITIONS",)}.get(item, ("", "ATS_REQUISITIONS")):
            best[item] = max(best.get(item, 0), worth(c, item, uri, captured))
    return min(100, math.floor(round(sum(c.points[i] * round(s, 6) for i, s in best.items()), 6) + 0.5))


def tables(spark, c, n=160, seed=1):
    rng = random.Random(seed)
    uris = ["https://FIRM.com/blog/x", "https://firm.com/", "https://board.io", "https://else.net"]
    quotes = {r: [(rng.choice([*c.points, "unknown"]), rng.choice(["", "ATS_REQUISITIONS"]), rng.choice(uris), rng.choice([None, NOW - timedelta(days=rng.randrange(900)), NOW + timedelta(days=3)])) for _ in range(rng.randrange(0, 6))] for r in range(n)}
    expected = {r: float(score(c, q)) for r, q in quotes.items()}
    one = spark.createDataFrame([(r, *q, NOW) for r, qs in quotes.items() for q in qs], "record int, item string, category string, uri string, captured_at timestamp, scored_at timestamp")
    two = spark.createDataFrame([(r, e, r % 5 == 0, 1) for r, e in expected.items()], "record int, expected double, held boolean, i int")
    return quotes, expected, one, two


@pytest.fixture(scope="module")
def made(spark):
    return tables(spark, KNOWN)


def test_errors_of_trials_match_plain_scores(spark, made):
    quotes, expected, one, two = made
    trials = [KNOWN, Calibration({"q1_delivery_proof": 70.0, "q3_delivery_hiring": 10.0, "q4_growth_signal": 20.0}, {"firm.com": 1.0, "firm.com/blog": 0.0, "board": 0.7}, 0.9, {"q1_delivery_proof": 30.0}), KNOWN.moved({("weights", ""): 0.0, ("points", "q4_growth_signal"): 80.0})]
    rows = calibrate.evidence(one, two, KNOWN)
    for held in (False, True):
        for t, (mse, mae) in zip(trials, calibrate.priced(rows, trials, held=held), strict=True):
            e = [score(t, q) - expected[r] for r, q in quotes.items() if (r % 5 == 0) == held]
            assert mse == pytest.approx(sum(x * x for x in e) / len(e)) and mae == pytest.approx(sum(map(abs, e)) / len(e))
    assert sum(trials[2].points.values()) == pytest.approx(100) and calibrate.priced(rows, [KNOWN]) == [(0.0, 0.0)]


def test_descent_finds_its_way_back(spark, made):
    _, _, one, two = made
    away = Calibration(KNOWN.points, {"firm.com": 0.8, "firm.com/blog": 0.9, "board": 0.2}, 0.6, {"q1_delivery_proof": 500.0})
    found, errors = calibrate.fit_tables(one, two, away, kinds=("weights", "halves"), sweeps=12)
    assert errors["before"][0] > 20 and errors["train"][0] < errors["before"][0] / 8 and errors["held"][0] < errors["before"][0] / 4
    assert found.points == KNOWN.points and abs(found.weights["firm.com"] - 0.5) < 0.1 and abs(found.default - 0.3) < 0.1
    same, errors = calibrate.fit_tables(one, two.where("false"), away, sweeps=2)
    assert errors["train"] == errors["held"] == (0.0, 0.0) and sum(same.points.values()) == 100


def test_errors_of_the_query_match_sql(spark):
    found = Q.calibration_tables(Tables(spark, SF)).collect()
    value = {(r.kind, r.name): r.value for r in found}
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    sql = Q._C
    for item, start in Q.ITEMS.items():
        sql = sql.replace(f"'{item}' THEN {start}", f"'{item}' THEN {value['points', item]}")
    sql = sql.replace("ELSE 10 END", f"ELSE {value['points', 'q4_growth_signal']} END")
    for pattern, start in Q.WEIGHTS:
        sql = sql.replace(f"contains(uri, '{pattern}') THEN {start}::DOUBLE", f"contains(uri, '{pattern}') THEN {value['weights', pattern]}::DOUBLE")
    sql = sql.replace("ELSE 0.3::DOUBLE END", f"ELSE {value['weights', '']}::DOUBLE END")
    for item, start in Q.HALF_LIVES.items():
        sql = sql.replace(f"/ {start}::DOUBLE", f"/ {value['halves', item]}::DOUBLE")
    got = con.sql(f"WITH {sql}, n AS (SELECT score, o_totalprice / 600 AS e, (row_number() OVER (ORDER BY record) - 1) % 5 = 0 AS held FROM c JOIN orders ON record = o_orderkey) SELECT held, avg(pow(score - e, 2)) FROM n GROUP BY 1").fetchall()
    assert {h: pytest.approx(e, rel=1e-3) for h, e in got} == {False: found[0].mse, True: found[0].held_mse} and len(found) == 4 + 5 + 2
