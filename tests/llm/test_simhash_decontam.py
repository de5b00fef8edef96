import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftline.llm import decontam, simhash

DOCS = "doc_id long, text string, source string, fp string, hit int"


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "two three four five six")]
    base = words(rng, 300)
    for i in range(6, 40):
        kind = i % 4
        if kind == 0:
            rows.append((i, " ".join(base)))
        elif kind == 1:
            edited = list(base)
            for _ in range(rng.randrange(1, 6)):
                edited[rng.randrange(len(edited))] = "edit"
            rows.append((i, " ".join(edited)))
        else:
            rows.append((i, " ".join(words(rng, rng.randrange(1, 200)))))
    rows += [(40, "Größe ÀB " * 30), (7, rows[7][1]), (41, "\n".join(["same line"] * 4000))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], DOCS)


def plain_fingerprint(text):
    tokens = [t for t in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    fps = {r: plain_fingerprint(r[1]) for r in rows}
    root = {f: f for f in fps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    first = {}
    for r in rows:
        k = find(fps[r])
        first[k] = min(first.get(k, r[0]), r[0])
    return sorted((r[0], f"{fps[r]:016x}", first[find(fps[r])]) for r in rows)


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    got = sorted(map(tuple, simhash.digest(frame(spark, rows)).collect()))
    assert got == brute_classes(rows)


@pytest.mark.parametrize("options", [{}, {"owners_in_task": 2}, {"segments": 2}, {"segments": 4, "owners_in_task": 3}])
def test_simhash_links_random_balls(spark, options):
    rng = random.Random(2)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(12):
            at = centre
            for _ in range(rng.randrange(6)):
                at ^= 1 << rng.randrange(64)
            fps.add(at)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), **options)).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 4:
                s, t = (x - (1 << 64) if x >> 63 else x for x in (a, b))
                assert roots[s] == roots[t]


def test_entry_of_many_visitors_passes_in_blocks():
    rng = np.random.default_rng(3)
    fps = (np.uint64(5) << np.uint64(50)) ^ rng.integers(0, 1 << 8, 400).astype(np.uint64)
    rows = [np.zeros(400, np.int64), fps.astype(np.int64), np.r_[np.ones(3, np.int64), np.zeros(397, np.int64)]]
    batches = [pa.record_batch([pa.array(r[i : i + 7]) for r in rows], names=["key", "fp", "own"]) for i in range(0, 400, 7)]
    found = {(a, b) for out in simhash._entries(4, held_rows=20)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert (a ^ b).bit_count() <= 4
        root[find(a)] = find(b)
    for i, a in enumerate(fps.tolist()):
        for j, b in enumerate(fps.tolist()):
            if (i < 3 or j < 3) and (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)
    assert len(found) < 3 * 400 and simhash.segments_for(10**6, 4) == 3 and simhash.segments_for(10**12, 4) == 2


def test_simhash_empty_and_null_ids(spark):
    assert simhash.digest(frame(spark, [])).collect() == []
    got = simhash.digest(frame(spark, [(None, "a b c d e"), (3, "a b c d e")])).collect()
    assert {r.component_id for r in got} == {None}


def test_keep_first_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "fp", "hit"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_classes(rows)})
    # Rows that repeat an id with an unrelated text are documents of their own.
    again = [*rows, (7, "quite another text with many words of its own"), (7, "quite another text with many words of its own")]
    assert sorted(r.doc_id for r in simhash.keep_first(frame(spark, again)).collect()) == sorted([*{c for _, _, c in brute_classes(rows)}, 7])
    assert simhash.keep_first(frame(spark, [])).collect() == []


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 13) -> list[tuple]:
    """The contract said plainly, for tests."""
    out = []
    for doc, text in docs:
        words = decontam.normalise(text)
        hit, own = set(), set()
        for item, t in items:
            w = decontam.normalise(t)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                seq = w[i : i + n]
                for j in range(len(words) - len(seq) + 1):
                    if words[j : j + len(seq)] == seq:
                        hit.update(range(j, j + len(seq)))
                        own.add(str(item))
        out.append((doc, len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


ITEMS = [(1, " ".join(f"q{i}" for i in range(30))), (2, "Short item, here!"), (3, None), (4, "..."), (5, " ".join(f"q{i}" for i in range(8, 25))), (6, "größe ß x")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def contaminated_docs():
    q = [f"Q{i}" for i in range(30)]
    filler = [f"f{i}" for i in range(500)]
    return [
        (1, None), (2, ""), (3, " ".join(q[:12])), (4, "-".join(q[3:16])), (5, " ".join(filler + q[5:20])), (6, " ".join(filler * 3 + q[5:20])),
        (7, "say short ITEM here"), (8, "shorts item here"), (9, "Größe, ß-x"), (10, " ".join(q)), (10, " ".join(q)), (11, "a short item here"), (12, "short item here " * 3000),
    ]


def test_decontamination_matches_brute_force(spark):
    rows = contaminated_docs()
    want = sorted(brute_force(rows, ITEMS))
    assert sorted(map(tuple, decontam.digest(frame(spark, rows), bench(spark)).collect())) == want
    assert sorted(map(tuple, decontam.digest(frame(spark, rows), bench(spark), max_bytes=400).collect())) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_decontamination_offsets_and_empty_tables(spark):
    text = "Ünder (Short) Item—HERE: no. Short item, here"
    span = decontam.scan(text, decontam.automaton([("2", "Short item, here!")], 13))[3]
    assert [text[a:b] for a, b in span] == ["Short item, here"]
    rows = contaminated_docs()
    none = decontam.digest(frame(spark, rows), bench(spark, [])).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    assert decontam.digest(frame(spark, []), bench(spark)).collect() == []
    kept = decontam.keep_clean(frame(spark, rows), bench(spark))
    assert kept.columns == ["doc_id", "text", "source", "fp", "hit"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute_force(rows, ITEMS) if not r[-1])


def test_items_without_an_id_hit_too(spark):
    import duckdb

    items = [(None, " ".join(f"q{i}" for i in range(30))), (None, "short item here"), (3, "another short item here")]
    rows = contaminated_docs() + [(20, "another short item here"), (21, " ".join(f"q{i}" for i in range(13)))]
    rows = [*dict(rows).items()]  # the SQL takes doc_id for a key
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(con.sql(decontam.ORACLE_SQL).fetchall())
    for most in (64 << 20, 400):
        assert sorted(map(tuple, decontam.digest(frame(spark, rows), bench(spark, items), max_bytes=most).collect())) == want
    hit = {r.doc_id: r.hit for r in decontam.mark(frame(spark, rows), bench(spark, items)).collect()}
    assert hit[21].n_hit == 13 and hit[21].item_ids == [] and hit[20].item_ids == ["3"]
    assert not {21, 10} & {r.doc_id for r in decontam.keep_clean(frame(spark, rows), bench(spark, items)).collect()}


def test_decontamination_in_takes_and_other_windows(spark, monkeypatch):
    """Long items come in takes that share words; windows of other sizes have blocks of other sizes; blocks that very many items share are kept apart by what stands beside them."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["a", "b", "cc", "Dd", "é"]) for _ in range(n))
    items = [(i, words(rng.randrange(1, 40))) for i in range(40)] + [(99, words(300))]
    rows = [(i, words(rng.randrange(0, 30)) + " " + (items[i][1] if i % 3 == 0 else items[-1][1][i * 3 : i * 3 + 90]) + "; " + words(20)) for i in range(40)]
    monkeypatch.setattr(decontam, "TAKE", 5)
    for n in (1, 2, 5, 6, 13):
        want = sorted(brute_force(rows, items, n))
        for most in (8 << 20, 1500):
            assert sorted(map(tuple, decontam.digest(frame(spark, rows), bench(spark, items), window_words=n, max_bytes=most).collect())) == want


def test_automaton_stays_in_bounds():
    """A part at its bound: no more nodes than bytes, and what a process grows by (in one of its own)."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from siftline.llm import decontam
rng = random.Random(1)
rows = [(str(i), " ".join("w%d" % rng.randrange(200_000) for _ in range(400))) for i in range(2500)]  # 7 MB
class Rows:
    def select(self, *_): return self
    def toLocalIterator(self): return (type("R", (), {"i": i, "t": t}) for i, t in rows)
decontam.F = type("F", (), {"col": staticmethod(lambda n: type("C", (), {"cast": lambda s, k: s, "alias": lambda s, k: s})())})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
lists = list(decontam.parts(Rows(), item_id="i", text="t", window_words=13, max_bytes=8 << 20))
for part in lists:
    built = decontam.automaton(part, 13)
    assert built.blocks.get_stats()["nodes_count"] < 8 << 20
print(len(lists), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    parts, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert parts == 2 and grown < 1000
