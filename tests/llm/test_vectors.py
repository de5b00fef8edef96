"""Vector codes and exact search against plain versions in Python integers, and on odd tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from siftline.llm import codes, vafile

VECTORS = "vec_id long, embedding array<float>, label int, row long, query long, id string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, n, 1, 2, "x", 0.5) for i, v, n in rows], VECTORS)


def table(size=16, n=150, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(size)], rng.choice([0, 1, 2, None])) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, 1) for i in range(60)]  # one vector in very many rows
    rows += [(1000, None, 1), (1001, [0.0] * size, None), (1002, [0.1] * (size - 1) + [None], 2), (1003, [math.nan] * size, 2), (1004, [math.inf] + [0.0] * (size - 1), 2)]
    return rows + [(7, same, 1), (50, [0.25] * size, 3), (1050, [1e30] * size, 3), (1100, [-0.25] * size, 3)]


def integers(v, most):
    return [max(-most, min(most, math.floor(256 * float(np.float32(x))))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, n) for i, v, n in rows if usable(v)]
    size = -(-max([len(v) for _, v, _ in kept] + [1]) // parts) * parts
    width = size // parts
    most = 2**28 // (1 << (width - 1).bit_length())
    vectors = [(i, integers(v, most) + [0] * (size - len(v)), n) for i, v, n in kept]
    first = sorted(vectors, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in vectors:
                groups[best(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    told = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found = [(i, n, [best(cut(v, p), books[p]) for p in range(parts)]) for i, v, n in vectors]
    sums = Counter()
    for _, n, f in found:
        sums[n] += sum(d for d, _ in f)
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), sums[n], told) for i, n, f in found), key=str)


@pytest.mark.parametrize(("size", "n"), [(16, 90), (48, 80), (64, 100), (20, 40)])
def test_codes_match_brute_force(spark, size, n):
    """Parts of one, three, four and (ending in zeros) two components; nulls, repeated rows, ties, extreme values, labels that are null."""
    rows = table(size, n)
    assert sorted(map(tuple, codes.digest(frame(spark, rows)).collect()), key=str) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert codes.digest(frame(spark, [])).collect() == [] == codes.digest(frame(spark, [(1, None, 1)])).collect()
    rows = [(None, [0.5, -0.5], 1), (3, [0.25], None), (2, [], None), (2, [0.1, 0.2, 0.3], 1)]
    want = brute_codes(rows)
    assert sorted(map(tuple, codes.digest(frame(spark, rows), max_labels=0).collect()), key=str) == want and len(want) == 4


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 16])
def test_transform_orders_by_sign_changes_and_keeps_distances(n):
    rows = codes.transform(np.eye(n, dtype=np.int64)).T
    full = codes.transform(np.eye(rows.shape[0], dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in full] == list(range(len(full))) and set(full.ravel().tolist()) <= {1, -1}
    rng = np.random.default_rng(n)
    for spread in (2, 300, 10**6):
        x, c = rng.integers(-spread, spread, (500, n)), rng.integers(-spread, spread, (37, n))
        c[20] = c[3]
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        entry, found = codes.nearest_entries(x, c)
        assert (entry == far.argmin(axis=1)).all() and (found == far.min(axis=1)).all()


def test_codes_turn_back(spark):
    coded, books = codes.encode(frame(spark, table(32, 50)))
    for r in coded.collect():
        assert len(codes.decode(np.array([r.codes]), books)[0]) == 32


def brute_search(rows, every=50, k=5):
    kept = sorted({(i, tuple(integers(v, 2**24))) for i, v, _ in rows if i is not None and usable(v)})
    out = []
    for i, q in kept:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in kept if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"cells": 4, "query_rows": 2}, {"max_sample": 3, "query_rows": 3, "max_stripes": 2}, {"k": 200}, {"every": 1, "k": 3, "cells": 2}])
def test_search_matches_brute_force(spark, options):
    """Equal vectors in very many rows, ties, extreme values, nulls, repeated rows and ids, other lengths, clashing columns."""
    rows = table(24, 120) + [(None, [0.1] * 24, 1), (2000, [0.5, 0.5], 1), (2001, [0.5, -0.5], 1), (2050, [], 1), (2051, [], 1), (100, [0.3] * 24, 0)]
    asked = {k: v for k, v in options.items() if k in ("every", "k")}
    got = sorted(map(tuple, vafile.search(frame(spark, rows), **options).collect()))
    assert got == brute_search(rows, **asked)


def test_search_reads_few_exact_vectors():
    """Over cells of a few units, what a scan keeps is a small part of all rows and holds the true best."""
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (6000, 32))
    edges = np.array([np.concatenate(([-300], np.sort(rng.choice(np.arange(-299, 300), 254, replace=False)), [300, 300])) for _ in range(32)])
    grid = vafile.Grid(edges)
    cells = grid.codes(x)
    assert all((edges[k][cells[:, k]] <= x[:, k]).all() and (x[:, k] < edges[k][cells[:, k].astype(int) + 1]).all() for k in range(32))
    best = vafile.Best(list(range(20)), x[:20], 5)
    for begin in range(0, 6000, 1000):
        best.scan(np.arange(begin, begin + 1000), np.arange(begin, begin + 1000), *grid.bounds(cells[begin : begin + 1000]))
    found = best.found(np.arange(20)).to_pydict()
    pairs = set(zip(found["query"], found["row"], strict=True))
    score = x[:20] @ x.T
    assert len(pairs) < 20 * 60
    for q in range(20):
        order = [r for r in np.argsort(-score[q], kind="stable").tolist() if r != q][:5]
        assert all((q, r) in pairs for r in order)


def test_search_of_empty_table(spark):
    assert vafile.search(frame(spark, [])).collect() == [] == vafile.search(frame(spark, [(50, [0.5], 1)])).collect()


@pytest.mark.parametrize(("run", "sql"), [(codes.digest, codes.ORACLE_SQL), (vafile.search, vafile.ORACLE_SQL)])
def test_sql_on_the_smallest_table(spark, run, sql):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(sql)
    got = run(spark.read.parquet(path))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
