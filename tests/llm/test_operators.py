"""Each operator against a brute-force version and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import ann, mixing, sharding, substring, suffix, toxicity, urlfilter

DOCS = "doc_id long, text string, source string, seg string, shard int, score double, id long"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, 0.5, 9) for r in rows], DOCS)


def corpus(words=True):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, shared = text(150), text(130)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "short"), (5, base), (6, base), (7, base.replace("w1 ", "edit ", 1) + " tail"), (8, text(40) + " " + shared + " " + text(40)), (9, shared + "\n" + text(90))]
    rows += [(10, "same " * 400), (11, "é ß " + base[50:700] + " ü"), (12, text(100) + " " + shared[100:] + " " + shared), (5, base), (None, shared), (13, "z" * 3000), (14, "ab " * 700)]
    rows += [(20 + i, text(60) + " " + base[i * 3 : i * 3 + 480] + " " + text(20)) for i in range(6)]
    return rows


def brute_words(rows, n=20):
    seen = {}
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in seen:
                gone[j : j + n] = [True] * n
            seen.setdefault(tuple(w[j : j + n]), (i, j))
        out[i, t] = (i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return sorted((out[r] for r in rows), key=str)


@pytest.mark.parametrize("hot", [1 << 20, 1])
def test_substring_matches_brute_force(spark, hot):
    rows = corpus()
    assert sorted(map(tuple, substring.digest(frame(spark, rows), hot=hot, shard_symbols=500).collect()), key=str) == brute_words(rows)


def brute_bytes(rows, n=400, passage=256):
    docs = {(i, t): (t or "").encode() for i, t in rows}

    def flags(n):
        count = Counter(b[j : j + n] for b in docs.values() for j in range(len(b) - n + 1))
        out = {}
        for key, b in docs.items():
            gone = out[key] = bytearray(len(b))
            for j in range(len(b) - n + 1):
                if count[b[j : j + n]] > 1:
                    gone[j : j + n] = b"\1" * n
        return out

    out, short = {}, flags(passage)
    for key, gone in flags(n).items():
        b = docs[key]
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[key] = (key[0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), sum(short[key]))
    return sorted((out[r] for r in rows), key=str)


@pytest.mark.parametrize("hot", [1 << 18, 1])
def test_suffix_array_matches_brute_force(spark, hot):
    rows = corpus()
    assert sorted(map(tuple, suffix.digest(frame(spark, rows), hot=hot, shard_symbols=2000).collect()), key=str) == brute_bytes(rows)


def test_lyndon_grouping_and_fm_index():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(60))] + [0]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix.suffix_array(text) == want
    text = np.array([rng.randrange(2, 6) for _ in range(400)] + [0])
    index = substring.FMIndex(text)
    ends = np.arange(5, 400)
    depth, _ = index.statistics(text, ends, np.full(len(ends), 5))
    grams = {k: Counter(tuple(text[i : i + k]) for i in range(401 - k)) for k in range(1, 6)}
    assert depth.tolist() == [max([k for k in range(1, 6) if grams[k][tuple(text[e - k : e])] >= 2], default=0) for e in ends]


def test_dedup_of_empty_table(spark):
    assert substring.digest(frame(spark, [])).collect() == [] and suffix.digest(frame(spark, [])).collect() == []
    kept = {r.doc_id: r.kept for r in substring.remove(frame(spark, [(1, "a b  c"), (2, None)])).collect()}
    assert kept == {1: "a b c", 2: ""}


@pytest.mark.parametrize("options", [{}, {"groups_in_task": 30, "heavy": 64}])
def test_sharding_is_even_gapless_and_keeps_groups(spark, options):
    rows = corpus() + [(1000 + i, f"text {i} " * (i % 40)) for i in range(400)] + [(5000 + i % 3, "tie") for i in range(30)] + [(6000, "long " * 1500)]
    got = sharding.digest(frame(spark, rows), rows_in_task=20, **options).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    text = defaultdict(set)
    for i, t in rows:
        text[i].add(t or "")
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        t = next(t for t in text[r.doc_id] if len(t.encode()) + 1 == r.size)
        assert r.text_crc32 == zlib.crc32(t.encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < (800 if options else 60)
    whole = sharding.shard(frame(spark, rows), rows_in_task=20, **options)
    assert whole.columns == ["doc_id", "text", "source", "seg", "score", "id", "shard", "slot"]
    assert Counter((r.doc_id, r.text, r.shard) for r in whole.collect()) == Counter((i, t, min(where[t or ""])) for i, t in rows)
    assert sharding.digest(frame(spark, [])).collect() == [] == sharding.shard(frame(spark, [])).collect()


def brute_place(groups, parts, capacity=None, rooms=None):
    """The partitions of groups one after another, each by plain best fit in descending order: loads of the bins."""
    out = []
    for p in range(parts):
        bins = [[r, 0] for r in rooms[p]] if rooms else []
        for h, s in sorted(((h, s) for h, s in groups if h % parts == p), key=lambda g: (-g[1], g[0])):
            fits = [(room, i) for i, (room, _) in enumerate(bins) if room >= s]
            if fits:
                i = min(fits)[1]
            elif rooms:
                i = max((room, i) for i, (room, _) in enumerate(bins))[1]
            else:
                i = len(bins)
                bins.append([max(capacity, s), 0])
            bins[i][0] -= s
            bins[i][1] += s
        out.append([load for _, load in bins])
    return out


def test_place_matches_brute_force_on_many_small_groups(spark):
    rng = random.Random(12)
    groups = [(h, rng.choice([1, 2, 3, 5, 8, 40, 300])) for h in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(groups, "h long, size long")
    size = dict(groups)
    # By capacity: the bins of each partition, the half full ones packed once more.
    placed = {r.h: r.shard for r in sharding.place(df, capacity=1000, groups_in_task=500).collect()}
    loads = Counter()
    for h, b in placed.items():
        loads[b] += size[h]
    want = [b for part in brute_place(groups, 7, capacity=1000) for b in part]
    half = [b for part in brute_place(groups, 7, capacity=1000) for b in [min(part)] if 2 * b <= 1000]
    bins, count = sharding.best_fit_decreasing(half, 1000)
    merged = Counter()
    for b, s in zip(bins, half, strict=True):
        merged[b] += s
    assert len(placed) == 3000 and max(loads.values()) <= 1000 and set(loads) == set(range(len(loads)))
    assert sorted(loads.values()) == sorted([*(Counter(want) - Counter(half)).elements(), *merged.values()])
    assert len(loads) <= -(-sum(size.values()) // 1000) + 7
    # Into eight shards, nothing of it heavy.
    placed = {r.h: r.shard for r in sharding.place(df, groups_in_task=500, heavy=1).collect()}
    totals = [sum(s for h, s in groups if h % 7 == p) for p in range(7)]
    want = brute_place(groups, 7, rooms=[[-(-t // 8)] * 8 for t in totals])
    assert [sum(size[h] for h, b in placed.items() if b == i) for i in range(8)] == [sum(part[i] for part in want) for i in range(8)]


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(60))]
        placed, count = sharding.best_fit_decreasing(sizes, 60)
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(60 - b, k) for k, b in enumerate(bins) if 60 - b >= sizes[i]]
            if fits:
                want[i] = min(fits)[1]
            else:
                want[i] = len(bins)
                bins.append(0)
            bins[want[i]] += sizes[i]
        assert placed == want and count == len(bins)
    assert sharding.best_fit_decreasing([100, 5], 60)[1] == 2


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choices(["a", "b", "c", None], [60, 25, 10, 5])[0]) for i in range(600)] + [(700, None, "a"), (701, "", "b"), (0, "w", "a")]
    docs = frame(spark, rows)
    got = mixing.digest(docs, block_tokens=2000, rows_in_task=50).collect()
    first = [r for r in got if r.epoch == 0]
    assert Counter((r.doc_id, r.source) for r in first) == Counter((r[0], r[2]) for r in rows)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.tokens
    own = Counter()
    for r in first:
        own[r.source] += r.tokens
    assert max(tokens[s] / own[s] for s in own) <= 2.1
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-6 and all(abs(tokens[s] / sum(tokens.values()) - w) < 0.03 for s, w in weight.items())
    assert len({(r.block, r.slot) for r in got}) == len(got)
    blocks = Counter(r.block for r in got)
    assert all(max(r.slot for r in got if r.block == b) == n - 1 for b, n in blocks.items())
    mixed = mixing.mix(docs, block_tokens=2000, rows_in_task=50)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in got)
    w = {r.source: r.weight for r in mixing.digest(docs, max_repeats=None, target_entropy=1.2).collect()}
    assert abs(-sum(x * np.log2(x) for x in w.values()) - 1.2) < 0.01
    assert mixing.digest(frame(spark, [])).collect() == [] and mixing.mix(frame(spark, [])).collect() == []


def test_toxicity_learns_from_document_labels(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(200)]
    rows, labels = [(900, None), (901, ""), (None, "fine words")], []
    for i in range(500):
        parts = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(6)]
        if i % 5 == 0:
            parts[rng.randrange(6)] += rng.choice([" stinker", " blockhead"])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, known = frame(spark, rows), spark.createDataFrame([*labels, (900, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, known).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert held and np.mean([p == y for p, y in held]) > 0.97
    assert got[900].score == got[901].score == 0 and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    for i, text in rows:  # the sentences that are located are those with the words
        if i is not None and got[i].held_out:
            spans = [tuple(map(int, x.split(":"))) for x in got[i].sentences.split(",") if x]
            assert [bool(re.search("stinker|blockhead", text[a:b])) for a, b in spans] == [True] * len(re.findall("stinker|blockhead", text or ""))
    model = toxicity.fit(docs, known)
    score, found = model.scorer().document("All good here. You stinker of a man. Fine.", True)
    assert score > 0.5 and [(a, b) for a, b, _ in found] == [(14, 35)]
    # Noisy-or by hand: one minus the product over sentences of one minus the logistic of their features' weights.
    weigh = lambda s: model.bias + sum(model.weights.get(f, 0.0) for t in set(s.lower().split()) for f in toxicity.features(t))
    for i, text in rows[:60] + rows[-3:]:
        plain = 1 - np.prod([1 - 1 / (1 + np.exp(-weigh(s))) for s in re.split(r"[.!?\n]+", text or "") if s])
        if i is not None:
            assert abs(got[i].score - plain) < 1e-9
    long = toxicity.digest(frame(spark, [(1, "fine words. " * 50_000), (2, "fine words. " * 50_000 + "you stinker")]), known, model=model).collect()
    assert {r.doc_id: r.score > 0.5 for r in long}[2] and len(long) == 2
    kept = toxicity.keep_civil(docs, known)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    assert {r.score for r in toxicity.digest(docs, known.where("toxic = 0")).collect()} == {0.0} and toxicity.digest(frame(spark, []), known).collect() == []


def test_url_filter(spark):
    rows = [
        (1, "https://a.EXAMPLE.net/en/x"), (2, "http://b.net"), (3, "http://b.net/"), (4, "https://www.example.com/de/y"), (5, "https://x.org/fr/1"), (6, "https://x.org/en/1?utm_source=a"), (7, "http://x.org/en/1/#t"),
        (8, None), (9, ""), (10, "no scheme"), (11, "https://only.org/z"), (12, "ftp://H.Org?x://y/z"), (13, "https://notexample.net/en/x"), (6, "https://x.org/en/1?utm_source=a"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, host string, rule string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.repeated_urls(pages)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == (None, "block") and got[3][2:] == ("net/", "block") and got[4][2:] == ("example.com/de/", "block")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "block") == got[7][2:] and got[11][2:] == (None, "allow") and got[13][2:] == ("net/", "block")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[12][:2] == ("h.org", "")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "key string")
    listed = keys.where("key LIKE '%7'")
    for most in (64 << 20, 0):
        assert urlfilter.listed(keys, listed, blocks=4, broadcast_bytes=most).count() == 3001
        assert sorted(r.key for r in urlfilter.listed(keys, listed, blocks=4, broadcast_bytes=most).where("hit").collect()) == sorted(r.key for r in listed.collect())
    assert urlfilter.judge(pages.limit(0), urlfilter.repeated_urls(pages)).collect() == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(900, 16))
    data[500:560] = data[100]
    rows = [(i, [float(x) for x in v], 1, 0.0) for i, v in enumerate(data)]
    rows += [(2000, None, 1, 0.0), (2001, [0.0] * 16, 1, 0.0), (2002, [float("nan")] + [1.0] * 15, 1, 0.0), (2003, [None] + [1.0] * 15, 1, 0.0), (None, rows[0][1], 1, 0.0), (2100, [1.0, 2.0], 1, 0.0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double")
    got = ann.nearest(df, shard_rows=200).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((data - data[q]) ** 2).sum(1))
        want = [int(j) for j in np.lexsort((np.arange(900), d)) if j != q][:10]
        hits += len({j for j, _ in by[q]} & set(want))
        total += 10
        assert [r for r, _ in by[q]] == [r for r, _ in sorted(by[q], key=lambda x: (x[1], x[0]))] and all(abs(s - d[j]) < 1e-12 for j, s in by[q])
    assert hits / total >= 0.95 and [j for j, _ in by[100]] == list(range(500, 510)) and 2100 not in by
    assert ann.nearest(df.limit(0)).collect() == []


def odd_documents(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, 2) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    at = {r[0]: r for r in rows}
    first = rows[0]
    rows += [(None, None, None, None, None, 1, 2), (90001, "", "en", None, 0, 1, 2), (90002, None, "en", "s", 0, 1, 2), first, first, (first[0], "another text of the same id altogether", "en", "s", 1, 1, 2), (90003, "x y " * 60_000, "en", "s", 1, 1, 2)]
    return rows, at, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, __row int")


def test_queries_visit_near_cells(spark):
    """Clustered vectors in many cells: most neighbours found though few shards are asked; cells of very many vectors are split."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(30, 12)) * 10
    data = np.concatenate([m + rng.normal(size=(60, 12)) for m in middles])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, every=20, shard_rows=50).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & set(np.argsort(((data - data[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, 1800, 20))
    assert hits / 900 >= 0.95
    x = data[rng.permutation(len(data))]
    at = ann.centres(x, 30)
    assert at.shape == (30, 12) and ann.probes(x, at, 10, 0.99) < 15
    assert {r.rank for r in ann.nearest(df, every=20, shard_rows=50, max_cells=2).collect()} == set(range(1, 11))


def test_tables_are_deleted(spark):
    from urllib.parse import urlparse
    from pathlib import Path
    from siftline.llm.common import discard, materialise, workspace

    with workspace(spark):
        inner = materialise(spark.range(3).toDF("x"), "inner")
        outer = materialise(inner, "outer", outlives=True)
        assert inner.count() == 3
    there = lambda df: Path(urlparse(df._written_to).path).exists()
    assert not there(inner) and there(outer) and outer.count() == 3
    discard(outer)
    assert not there(outer)


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on odd rows (null, empty, repeated, very long, clashing columns) against a plain version of what it decides."""
    import corpus_pipeline
    from tests.llm.test_simhash_decontam import brute_classes, brute_force, plain_fingerprint

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    rows, _, docs = odd_documents(spark)
    # The stages' own helper columns have these names where a table leaves them free.
    clashes = ("__id", "__hit", "__Score", "__n", "__key", "__tkey", "__times", "a.b")
    docs = docs.withColumns({c: F.lit(f"kept {c}") for c in clashes})
    own = [tuple(r) for r in docs.collect()]
    order = lambda found: sorted(map(tuple, found), key=str)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = lambda s: model.bias + sum(sum(model.weights.get(f, 0.0) for f in toxicity.features(t)) for t in set(s.lower().split()))
    score = lambda t: 1 - np.prod([1 / (1 + np.exp(weight(s))) for s in re.findall(r"[^.!?\n]+", t or "")])
    got = stages["toxicity"](spark, docs, sf)
    want = [r for r in own if score(r[1]) < 0.5]
    assert got.columns == docs.columns and order(got.collect()) == order(want) and 0 < len(want) < len(own)

    docs = spark.createDataFrame(want, docs.schema)
    got = stages["near_dedup"](spark, docs, sf)
    fps = {r[:2]: plain_fingerprint(r[1]) for r in want}
    keyed = sorted({(-(2**63) if r[0] is None else r[0], r[1]) for r in want}, key=str)
    root = {}
    for n, (i, t) in enumerate(keyed):  # components over all pairs
        root[n] = n
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    prints = [plain_fingerprint(t) for _, t in keyed]
    for a in range(len(keyed)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(keyed):
        least[find(n)] = min(least.get(find(n), i), i)
    kept = got.collect()
    assert got.columns == docs.columns and sorted(-(2**63) if r.doc_id is None else r.doc_id for r in kept) == sorted(least.values())
    assert all(tuple(r) in set(want) for r in kept)

    docs = spark.createDataFrame([tuple(r) for r in kept], docs.schema)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {(d, t) for (d, t), r in zip([(r[0], r[1]) for r in kept], brute_force([(r[0], r[1]) for r in kept], items), strict=True) if r[-1]}
    want = [tuple(r) for r in kept if (r[0], r[1]) not in bad]
    got = stages["decontaminate"](spark, docs, sf)
    assert got.columns == docs.columns and order(got.collect()) == order(want) and bad

    docs = spark.createDataFrame([*want, want[0], want[0]], docs.schema)  # repeated rows
    got = stages["mix"](spark, docs, sf)
    taken = Counter(r.doc_id for r in mixing.digest(docs).collect())
    mixed = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and Counter(r[0] for r in mixed) == taken and set(mixed) == set(want)

    docs = spark.createDataFrame(mixed, docs.schema)
    got = stages["shard"](spark, docs, sf)
    out = got.collect()
    assert [c for c in got.columns if c != "slot"] == [c for c in docs.columns if c != "shard"] + ["shard"]
    assert Counter(r[:5] for r in map(tuple, out)) == Counter(r[:5] for r in mixed)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in out:
        homes[r.text or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())

    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_mix_draws_repeated_rows_one_by_one(spark):
    rows = [(1, "a b c", "small"), (1, "a b c", "small"), *[(10 + i, "w " * 50, "large") for i in range(20)]]
    docs = frame(spark, rows)
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == Counter(r.doc_id for r in mixing.digest(docs).collect())


@pytest.mark.parametrize("hot", [1 << 18, 1])
def test_suffix_array_at_the_border_and_repeated_rows(spark, hot):
    rng = random.Random(6)
    text = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = [(1, None), (2, text(900)), (3, text(500))]
    rows += [rows[1], rows[1]]  # one document, three times: nothing of it stands elsewhere
    for i in range(120):
        shared = text(399 + i % 12)
        rows += [(10 + 2 * i, text(rng.randrange(60)) + shared + text(rng.randrange(60))), (11 + 2 * i, text(rng.randrange(60)) + shared + text(rng.randrange(60)))]
    assert sorted(map(tuple, suffix.digest(frame(spark, rows), hot=hot).collect()), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("length", [100, 200, 256, 300, 410])
def test_suffix_array_at_other_lengths(spark, length):
    """Repeats about as long as they have to be, on both sides of the shorter passage."""
    rng = random.Random(length)
    text = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    rows = corpus()
    for i in range(40):
        shared = text(length - 6 + i % 12)
        rows += [(10 + 2 * i, text(rng.randrange(60)) + shared + text(rng.randrange(60))), (11 + 2 * i, text(rng.randrange(60)) + shared + text(rng.randrange(60)))]
    rows += [(500, text(30) + (both := text(240)) + text(20)), (501, text(25) + both)]
    assert sorted(map(tuple, suffix.digest(frame(spark, rows), length=length, shard_symbols=2000).collect()), key=str) == brute_bytes(rows, length, min(256, length))
