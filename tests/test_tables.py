"""Robots files as tables, seeded samples and merged logs against plain versions."""

import random

import pytest

from siftline.operators import capture, items, ledger


def test_robots_files_decide_by_their_longest_prefix(spark):
    files = [
        ("https://a.com", "User-agent: *\nDisallow: /x\nAllow: /x/open\nAllow: /x\u00e9\nDisallow: /x\u00e9"), ("http://a.com", "User-agent: siftline\nDisallow: /"), ("https://b.com", "no rules"), ("https://c.com", None),
        ("https://d.com", "User-agent: other\nDisallow: /"), ("https://e.com", "User-agent: *\n" + "\n".join(f"Disallow: /{'y' * n}" for n in range(1, 200, 7)) + "\nAllow: /yyy"),
    ]
    want = [
        ("https://A.com/x/1", False), ("https://a.com/x/open?q=/x", True), ("https://a.com/xé", True), ("https://a.com/other", True), ("https://a.com", True), ("http://a.com", False), ("http://a.com/?x", False), ("https://a.com:8080/x", True),
        ("https://b.com/x", True), ("https://c.com/x", True), ("https://d.com/", True), ("https://e.com/yyy", True), ("https://e.com/yyyyyyyyy", False), ("https://e.com/yy", False), (None, True), ("no address", True), ("", True), ("https://a.com/x/1", False),
    ]
    rules = capture.robots_table(spark.createDataFrame(files, "origin string, text string"))
    pages = spark.createDataFrame([(u, "kept", n) for n, (u, _) in enumerate(want)], "url string, path string, n int")
    got = capture.permitted(pages, rules)
    assert got.columns == ["url", "path", "n", "allowed"] and [(r.url, r.allowed) for r in got.orderBy("n").collect()] == [(u, a) for u, a in want]
    assert all(r.allowed for r in capture.permitted(pages, rules.where("false")).collect()) and capture.permitted(pages.where("false"), rules).collect() == []


@pytest.mark.parametrize(("seed", "size", "span"), [(0, 5, 10), (7, 30, 3), (11, 500, 50), (3, 1, 10_000), (5, 0, 10)])
def test_seeded_sample_is_pythons(spark, seed, size, span):
    rng = random.Random(1)
    numbers = rng.sample(range(-(2**61), 2**61), 150) + list(range(100))
    table = spark.createDataFrame([(n, f"row {n}") for n in numbers] + [(None, "no number")], "id long, turn_of string")
    ordered = sorted(numbers)
    want = random.Random(seed).sample(ordered, min(size, len(ordered)))
    got = items.seeded_sample(table, order="id", size=size, seed=seed, span=span)
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.turn)] == want
    assert items.seeded_sample(table.where("false"), order="id", size=3, seed=1).collect() == []


@pytest.mark.parametrize("span", [5, 60, 100_000])
def test_merged_logs_carry_values_over_stretches(spark, span):
    rng = random.Random(span)
    pick = lambda n: [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(200), k, rng.choice([None, k])) for k in range(n)]
    one, two = pick(150), pick(90)
    logs = {"one": spark.createDataFrame(one, "entity string, at long, seq int, x int"), "two": spark.createDataFrame([(*r[:3], f"v{r[3]}" if r[3] is not None else None) for r in two], "entity string, at long, seq int, y string")}
    rows = sorted([(e, at, "one", s, x, None) for e, at, s, x in one] + [(e, at, "two", s, None, f"v{x}" if x is not None else None) for e, at, s, x in two], key=lambda r: r[1:4])
    last, want = {}, []
    for e, at, log, seq, x, y in rows:
        before = last.get(e, (None, None))
        last[e] = (before[0] if x is None else x, before[1] if y is None else y)
        want.append((e, at, log, seq, *last[e]))
    got = ledger.merged(logs, values=("x", "y"), span=span)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert ledger.merged({k: v.where("false") for k, v in logs.items()}, values=("x", "y")).collect() == []
