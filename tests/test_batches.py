"""Numbering and budgeted batches against plain loops."""

import random

import pytest

from siftline.operators import batches, items


def brute(rows, most_items, most_chars):
    out, state = [], {}
    for by, order, size in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        batch, n, chars, place = state.get(by, (-1, most_items, 0, -1))
        if n == most_items or (most_chars and chars + (size or 0) > most_chars):
            batch, n, chars = batch + 1, 0, 0
        state[by] = batch, n + 1, chars + (size or 0), place + 1
        out.append((by, order, size or 0, place + 1, batch))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most_items", "most_chars", "stretch", "fan"), [(6, 100, 8, 3), (1, 0, 4, 2), (3, 40, 3, 2), (6, 0, 2048, 2048), (5, 1, 7, 4)])
def test_batches_match_a_loop(spark, most_items, most_chars, stretch, fan):
    """A frequent key, a null one, sparse and negative numbers, null, zero and oversized sizes."""
    rng = random.Random(most_items)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), n, rng.choice([None, 0, 1, 10, 30, 60, 500])) for n in rng.sample(range(-(10**15), 10**15), 300)]
    table = spark.createDataFrame([(b, o, s, 1) for b, o, s in rows], "by string, at long, size int, part long").drop("part")
    got = batches.packed(table, by="by", order="at", size="size", most_items=most_items, most_chars=most_chars, stretch=stretch, fan=fan)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, most_items, most_chars)
    assert batches.packed(table.where("false"), by="by", order="at", size="size").collect() == []


@pytest.mark.parametrize("span", [1, 7, 40, 10_000])
def test_numbers_by_quantiles(spark, span):
    """Sparse 64-bit numbers make stretches of like sizes; nulls and a null key are numbered too."""
    rng = random.Random(span)
    rows = [(rng.choice(["a", "a", None]), n) for n in [*rng.sample(range(2**62), 200), *range(100)]]
    table = spark.createDataFrame([*rows, ("c", None)], "by string, at long")
    got = items.numbered(table, by="by", order="at", span=span).collect()
    want = {}
    for by in ("a", None):
        want |= {(by, at): n for n, at in enumerate(sorted(a for b, a in rows if b == by))}
    assert {(r.by, r.at): r.place for r in got} == want | {("c", None): 0}
    parts = table.groupBy(items.stretches(table, "at", span).alias("s")).count().collect()
    assert max(r["count"] for r in parts) <= max(3 * span, 12) and (span > 300 or len(parts) > 5)
