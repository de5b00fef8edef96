import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import html, parse, urls
from siftline.functions import text as T
from siftline.operators import calibrate, evidence, export, gates, grounding, items, ledger
from siftline.operators.export import Clause, Filter
from siftline.plans import funnel
from siftline.sources import packets, readers


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_slices_partition_any_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b. ", "\n", "\n\n", "# h\n", "=== SECTION: X (URI: y) ===\n", "word " * 9]) for _ in range(rng.randrange(60)))
        budget = rng.choice([1, 7, 40, 1000])
        spans = items.slice_spans(text, budget)
        assert "".join(text[a:b] for a, b in spans) == text and all(0 < b - a <= budget for a, b in spans)
    assert items.slice_spans("abc", 0) == [(0, 3)] and items.slice_spans("", 5) == []


def test_slices_cut_where_texts_break():
    cut = lambda t, n: [t[a:b] for a, b in items.slice_spans(t, n)]
    assert cut("One is here.\nTwo is there.\nThree", 14) == ["One is here.\n", "Two is there.\n", "Three"]
    assert cut('He said "so." Then v3.5 came (late.) And went.', 24) == ['He said "so." ', "Then v3.5 came (late.) ", "And went."]
    assert cut("first line\nsecond line\n\nnew paragraph", 24) == ["first line\nsecond line\n\n", "new paragraph"]
    assert cut("intro\n# Head\nbody text\n# Next\nmore", 22) == ["intro\n# Head\nbody text\n"[:6], "# Head\nbody text\n", "# Next\nmore"]
    assert cut("=== SECTION: A (URI: u) ===\nx\n=== SECTION: B (URI: v) ===\ny", 31) == ["=== SECTION: A (URI: u) ===\nx\n", "=== SECTION: B (URI: v) ===\ny"]
    assert cut("abcdefghij", 4) == ["abcd", "efgh", "ij"]


def test_sentences_and_their_places(spark):
    text = "  We moved to v3.5 of it. Costs fell by 4.2%!\nNo end here\nIs it so? Yes"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = items.located(docs, vocab.SENTENCE, keys=["id"], text="text").orderBy("start").collect()
    assert all(text[r.start : r.end] == r.found for r in got)
    assert [r.found for r in got] == ["We moved to", "5 of it.", "Costs fell by", "2%!", "No end here", "Is it so?", "Yes"]
    assert docs.select(items.statements(F.col("text")).alias("x")).first().x == ["We moved to v3.5 of it.", "Costs fell by 4.2%!", "No end here\nIs it so?", "Yes"]
    best = items.spans(docs, ("costs", "we", "IT ", "it"), item_id="id", text="text", most=1).collect()
    assert best == []  # none of 15 characters
    docs = spark.createDataFrame([(1, "Nothing of note stands here. We moved it all to the cloud. We like it. Then we rested for it.")], "id int, text string")
    got = items.spans(docs, ("we", "IT ", "it", "cloud"), item_id="id", text="text", most=2).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.start, r.hits, r.sentence) for r in got] == [(0, 29, 3, "We moved it all to the cloud."), (1, 71, 2, "Then we rested for it.")]


def test_normal_forms_and_their_places():
    text = "  \u201cWe\u00a0 moved\n it\u201d \u2014 so\u2026 \ufb01ne \u2022 x "
    plain, at = grounding.normal(text)
    assert plain == '"We moved it" -- so... fine - x' and len(at) == len(plain)
    a, b, again = grounding.normal_find('"We moved it" --', text)
    assert text[a:b] == "\u201cWe\u00a0 moved\n it\u201d \u2014" and not again
    assert grounding.normal("") [0] == "" and grounding.normal(" \n ")[0] == "" and grounding.normal_find("  ", text) is None


def test_quotes_climb_the_ladder(spark):
    base = "Before it all. We migrated forty services to the cloud in a year. "
    quote = "We migrated forty services to the cloud in a year."
    assert grounding.resolve(quote, base) == ("exact", 15, 65)
    assert grounding.resolve(quote, base + base) == ("ambiguous", None, None)
    assert grounding.resolve(quote.replace("to the", "to\u00a0the"), base)[0] == "normalized"
    assert grounding.resolve(quote.replace("to the", "to\u00a0the"), base * 2)[0] == "ambiguous"
    rung, a, b = grounding.resolve(quote.replace("forty", "forly"), base)
    assert rung == "fuzzy" and abs(a - 15) <= 6 and abs(b - 65) <= 6
    assert grounding.resolve(quote.replace("forty", "forly"), base + "and much more in between, of another kind; " + base)[0] == "ambiguous"
    assert grounding.resolve("Something else that nobody ever said", base) == ("missing", None, None)
    rows = spark.createDataFrame([(1, 1, quote, base), (1, 2, "short", base), (2, 1, quote, None)], "doc_id long, quote_id long, quote string, text string")
    assert {(r.doc_id, r.quote_id): r.rung for r in grounding.ladder(rows).collect()} == {(1, 1): "exact", (1, 2): "short", (2, 1): "missing"}
    assert grounding.in_span(quote, quote) == (0, 50) and grounding.in_span("We\u00a0migrated forty", quote) == (0, 17)
    assert grounding.in_span("not in it at all", quote) is None and grounding.in_span("e", quote) is None


def test_variants_and_concepts():
    assert vocab.variants(" Banking ") == ("banking", "fintech", *[v for v in vocab.SYNONYMS["fintech"] if v not in ("banking", "fintech")])
    assert vocab.variants("consultancy")[0] == "consultancy" and vocab.variants("zebra") == ("zebra",) and vocab.variants(" ") == ()
    assert vocab.concept("q1_delivery_proof") == "delivery_proof" and vocab.concept("abc12_my_certification") == "certification" and vocab.concept("delivery_proof") == "delivery_proof"
    assert vocab.concept("long_prefix_growth_signal") == "growth_signal" and vocab.concept("nothing") == "" and vocab.concept("1_client_outcome") == "client_outcome"
    assert len(vocab.TRACKING_PARAMS) == 25


def test_fuzzy_find():
    text = "Some words before. We migrated forty services to the cloud in a year. And after."
    quote = "We migrated forty servicez to the cloud in a year."
    found = grounding.fuzzy_find(quote, text)
    assert found and found[2] >= 0.85 and abs(found[0] - 19) <= len(quote) // 8
    assert grounding.fuzzy_find("nothing like this at all, really nothing", text) is None


def test_filters(spark):
    rows = [(1, {"n": "5", "b": "true", "s": '"Abc"'}), (2, {"n": '"7"', "b": "false"}), (3, {"n": "null"}), (4, {})]
    df = spark.createDataFrame(rows, "id int, claims map<string,string>")
    ids = lambda f: [r.id for r in df.where(export.holds(f, F.col("claims"))).orderBy("id").collect()]
    assert ids(Filter(all=(Clause("n", ">=", 5),))) == [1, 2]
    assert ids(Filter(all=(Clause("b", ">=", 1),))) == [1] and ids(Filter(all=(Clause("b", "==", 1),))) == []
    assert ids(Filter(all=(Clause("s", "==", "aBC"),))) == [1] and ids(Filter(all=(Clause("n", "==", None),))) == [3]
    assert ids(Filter(all=(Clause("n", "!=", 5),))) == [2, 3, 4] and ids(Filter(all=(Clause("n", "not_in", (5, 7)),))) == [2, 3, 4]
    assert ids(Filter(any=(Filter(all=(Clause("n", "==", 5),)), Filter(all=(Clause("b", "==", False),))))) == [1, 2]
    for bad in (("n", "like", 1), ("n", "in", 1), ("n", "in", ()), ("n", "==", (1,))):
        with pytest.raises(ValueError):
            Clause(*bad)
    order = export.top(df.withColumn("c", F.col("claims")["n"]), [*export.sort_keys(F.col("c")), F.col("id")], 4)
    assert [r.id for r in order.orderBy("rank").collect()] == [3, 4, 1, 2]


def test_gates_say_three_things(spark):
    p = gates.Profile(size_min=10, locations=("united kingdom",))
    rows = [
        ("a consultancy, 50 employees in London", "fetched", "qualified"), ("a consultancy, 50 employees in London", "snippet", "lead"), ("our platform, free trial", "snippet", "eliminated"),
        ("", "fetched", "lead"), ("a consultancy with 5 employees", "fetched", "eliminated"), ("a therapy practice", "fetched", "eliminated"), ("a consultancy. find a way", "fetched", "lead"),
    ]
    df = gates.rung_rows(spark.createDataFrame(rows, "text string, evidence string, want string"), p)
    assert all(r.verdict == r.want for r in df.collect())
    assert gates.earned(("kind",), False) == "surface" and gates.earned(("vertical",), True) == "stories" and gates.earned((), True) == ""
    assert gates.Profile(size_min=5, size_max=50).narrowed(gates.Profile(size_min=9, size_max=30)).size_max == 30
    none = gates.funnel(spark.createDataFrame(rows, "text string, evidence string, want string"), gates.Profile(allows="any"))
    assert {r.v for r in none.select(gates.verdict(F.col("results")).alias("v")).collect()} == {"lead"}


def test_ledger_fold_equals_sequential_rules(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(400):
        e, o, s = f"e{rng.randrange(30)}", rng.choice(["", "read", "lead", "qualified", "eliminated"]), rng.choice([0.0, float(rng.randrange(100))])
        rows.append((i, e, i, "lane", "r", o, f"b{i}", 1, s, "t" if s else "", "run"))
        state = want.setdefault(e, ["", "", 0.0])
        if o not in ("", "read") and (state[0] != "eliminated" or o == "eliminated"):
            state[0], state[1] = o, f"b{i}"
        state[2] = s or state[2]
    df = spark.createDataFrame(rows, "event_id long, entity string, seen_at long, lane string, rung string, outcome string, because string, pages long, score double, tier string, run_id string")
    assert {r.entity: [r.outcome, r.because, r.score] for r in ledger.fold(df.repartition(4)).collect()} == want


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.canonical(u), u="HTTPS://Www.A.com/x/?utm_source=1&q=2#top") == "https://www.a.com/x?q=2"
    for url, entity in {
        "https://boards.greenhouse.io/acme-co/jobs/1": "acme_co.com", "https://www.snowflake.com/partners/trace3": "trace3.com", "https://github.com/x/y": "github.com",
        "https://careers.acme.com/x": "acme.com", "https://clutch.co/profile/big-firm": "big_firm.com", "Plain Name!": "plain_name", "": "unknown_entity",
    }.items():
        assert one(spark, urls.entity(u), u=url) == entity
    for url, category in {
        "https://snowflake.com/customers/x": "vendor_registry", "https://g2.com/x": "b2b_directory_audit", "https://a.com/careers/senior-data-engineer": "ats_requisitions",
        "https://a.com/case-studies/x": "first_party_case_study", "https://a.com/services": "first_party_practice", "https://a.com/search?q=jobs": "general_web",
    }.items():
        assert one(spark, urls.category(u), u=url) == category


def test_text_and_html(spark):
    t = F.col("t")
    assert one(spark, T.garbage(t), t="\x00" * 60 + "a" * 60) and not one(spark, T.garbage(t), t="\x00" * 20)
    assert html.read_html("<nav>menu</nav><article><p>Hello <b>you</b></p></article><p>aside</p><script>x()</script>") == "Hello\nyou\naside"
    assert one(spark, F.array_join(evidence.technologies(t), ","), t="We moved clients Acme to Kafka. Then Terraform came") == "Kafka,Terraform"


def test_calibration_recovers_points(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    true = np.array([50.0, 30.0, 20.0])
    df = spark.createDataFrame([("t", *map(float, r), float(r @ true)) for r in x], "task string, a double, b double, c double, y double")
    got = {r.item: r.points for r in calibrate.fit(df, by="task", items=["a", "b", "c"], expected="y").collect()}
    assert sum(got.values()) == 100 and all(abs(got[k] - v) <= 2 for k, v in zip("abc", true, strict=True))
    assert calibrate.whole_points(np.array([0.2, 0.3, 99.5])).tolist() == [1, 1, 98]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Domain,research,title,extra\na b.com,"two\nlines",T,x\n')
    got = readers.items(spark, str(tmp_path / "a.csv")).first()
    assert (got.item_id, got.text, got.title, got.metadata) == ("a_b.com", "two\nlines", "T", {"extra": "x"})
    (tmp_path / "b.jsonl").write_text('{"id": "1", "body": "x"}\n{"id": "2", "body": "y"}\n')
    assert readers.items(spark, str(tmp_path / "b.jsonl")).count() == 2
    (tmp_path / "c.json").write_text('{"items": [{"id": "1", "text": "x"}]}')
    assert readers.items(spark, str(tmp_path / "c.json")).first().item_id == "1"
    (tmp_path / "d.html").write_text("<title>t</title><script>x</script><p>Hi</p>")
    assert "Hi" in readers.items(spark, str(tmp_path / "d.html")).first().text
    with pytest.raises(ValueError):
        readers.items(spark, "x.pdf")
    readers.write_csv(readers.items(spark, str(tmp_path / "b.jsonl")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    readers.items(spark, str(tmp_path / "b.jsonl")).write.parquet(str(tmp_path / "p.parquet"))
    assert readers.discover(spark, "table", path=str(tmp_path / "p.parquet")).count() == 2
    rungs = spark.createDataFrame([("d", "n", 1, "a"), ("d", "n", 2, "b")], "dag_id string, node_id string, run_seq int, item string")
    for _ in range(2):
        readers.write_rungs(rungs, str(tmp_path / "rungs"))
    assert spark.read.parquet(str(tmp_path / "rungs")).count() == 2


def test_lane_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a consultancy with 50 employees for banking", False), (2, "our platform, free trial", False)], "item_id int, text string, eliminated boolean")
    steps = funnel.lane(gates.Profile(size_min=10, verticals=("fintech",)))
    out = funnel.run(spark, rows, steps, str(tmp_path / "lane"))
    assert [(r.item_id, r.verdict, r.rung) for r in out.collect()] == [(1, "qualified", "stories")]
    broken = [(n, lambda df: 1 / 0) for n, _ in steps]
    assert funnel.run(spark, rows, broken, str(tmp_path / "lane")).count() == 1


def test_near_quotes_are_candidates(spark):
    """Pairs by all quotes against all texts, with planted near quotes: typos, curly quotes, changed blanks, nothing in common."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    quotes = [prose(n) for n in (4, 8, 15, 30, 50)] + ['"Yes," they said: it\'s done... at last, and for good']
    texts = [prose(200), "", "x"]
    for q in quotes:
        typo = list(q)
        for _ in range(max(1, len(q) // 20)):
            typo[rng.randrange(len(q))] = "z"
        mixed = "".join(c + "#" if i % 14 == 7 else "" if i % 14 == 0 else c for i, c in enumerate(q))
        for form in ("".join(typo), mixed, q.replace(" ", "  "), q.replace('"', "“").replace("'", "’").replace("...", "…")):
            texts.append(prose(rng.randrange(40)) + " " + form + " " + prose(30))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    want = {(d, q, *found) for d, t in enumerate(texts) for q, quote in enumerate(quotes) if t and (found := grounding.fuzzy_find(quote, t))}
    got = {tuple(r) for r in grounding.fuzzy(grounding.near(asked, docs)).collect()}
    assert got == want and len({q for _, q, *_ in want}) == len(quotes) and sum(quotes[q] not in texts[d] for d, q, *_ in want) >= 12


def test_slices_take_texts_by_the_hundred(spark):
    """Batches of Arrow hold 10,000 texts, however long."""
    docs = spark.createDataFrame([(1, "one. two"), (2, None), (3, "")], "doc_id long, text string")
    own = items.slices(docs, item_id="doc_id", text="text", budget=5)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert {tuple(r) for r in own.collect()} == {(1, "s1", 0, 5, True), (1, "s2", 5, 8, True)}


def test_mentions_take_texts_by_the_hundred(spark):
    docs = spark.createDataFrame([(1, "a quote that stands, a quote that stands"), (2, None), (3, ""), (None, "here a quote that stands")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a quote that stands"), (8, "a quote that stands"), (9, "not there at all, no")], "quote_id long, quote string")
    found = grounding.mentions(asked, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan
    assert {tuple(r) for r in found.collect()} == {(d, q, a, a + 19, n) for q in (7, 8) for d, a, n in ((1, 0, 2), (None, 5, 1))}


def test_evidence_is_read_in_one_pass(spark, tmp_path):
    """Each section once for the dossier, and once on each side of the claims that others may repeat; the figures are those of the operators."""
    texts = ("The team migrated Kafka and cut cost by 40% for Acme Corp", "We hire for Terraform work, apply now", "Nothing of note", None, "certified, with blended rate plans")
    kinds = ("FIRST_PARTY_PRACTICE", "ATS_REQUISITIONS", "VENDOR_REGISTRY", None)
    rows = [(f"e{i % 37}" if i % 50 else None, i, kinds[i % 4] if i % 9 else kinds[0], f"https://x/{i}", texts[i * i % 5]) for i in range(400)]
    spark.createDataFrame(rows, "entity string, ord long, category string, uri string, text string").write.parquet(f"{tmp_path}/p")
    parts = spark.read.parquet(f"{tmp_path}/p")
    read = evidence.read_out(parts, "tier_1")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    sums = lambda df, column: {r[0]: r[1] for r in df.where("entity IS NOT NULL").groupBy("entity").agg(column).collect()}
    found, weak, many = sums(evidence.contradictions(parts), F.count("*")), sums(evidence.confidences(parts), F.min("weight")), sums(parts, F.count("*"))
    got = {r.entity: (r.contradictions, r.weakest, r.sections) for r in read.collect()}
    assert got == {e: (found.get(e, 0), weak.get(e, 0.0), n) for e, n in many.items()} and found and len(set(found.values())) > 1


def test_ladder_is_climbed_by_many_tasks(spark):
    quote = "we moved forty services of theirs to the new cluster in May"
    texts = [quote + " and more", "so " + quote.replace(" ", "  "), "so " + quote.replace("forty", "forly") + ".", "something else that was said at length, again and again"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string").coalesce(1)
    found = grounding.ladder(grounding.near(spark.createDataFrame([(1, quote)], "quote_id long, quote string"), docs))
    assert found.rdd.getNumPartitions() >= 4 and {r.doc_id: r.rung for r in found.collect()} == {0: "exact", 1: "normalized", 2: "fuzzy"}


def test_blocks_cost_their_least_edit_distance():
    """Bit vectors against the plain table; texts of one file are dealt to many tasks, and difflib sees only windows that may reach the ratio."""
    rng = random.Random(5)

    def least(block, quote):
        row = [0] * (len(quote) + 1)
        for i, x in enumerate(block):
            new = [i + 1]
            for j, y in enumerate(quote):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return min(row)

    for size in (1, 2, 17, 60, 130):
        quote, blocks = [rng.randrange(4) for _ in range(size)], [[rng.randrange(5) for _ in range(16)] for _ in range(70)]
        assert grounding.block_costs(np.array(blocks), np.array(quote)).tolist() == [least(b, quote) for b in blocks]


def test_chunks_cost_their_least_insertions_and_deletions():
    """Bits against the plain table, for more quotes than a word has bits, with chunks known, new and forgotten; at most that where a chunk stands once."""
    rng = random.Random(3)

    def least(chunk, quote):
        row = [0] * (len(quote) + 1)
        for i, x in enumerate(chunk):
            new = [i + 1]
            for j, y in enumerate(quote):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] if x == y else 99))
            row = new
        return min(row)

    quotes = [np.array([rng.randrange(5) for _ in range(size)]) for size in [1, 2, 5, *range(8, 78)]]
    chunks = grounding.Chunks(quotes, 5, 60)
    for turn in range(6):
        text = np.array([rng.randrange(6) for _ in range(6 * 40)])
        plain = sorted(set(map(tuple, text.reshape(-1, 6).tolist())))
        want = np.array([[min(3, least(chunk, quote)) for chunk in plain] for quote in quotes])
        keys = np.unique(chunks.keys(text))
        assert np.array_equal(chunks.costs(keys, np.full(len(keys), 2)), want) and len(chunks.known) <= 60
    text = np.concatenate([np.tile(np.arange(6), 30), [rng.randrange(6) for _ in range(24)]])
    keys, times = np.unique(chunks.keys(text), return_counts=True)
    plain = sorted(set(map(tuple, text.reshape(-1, 6).tolist())))
    got, want = chunks.costs(keys, times), np.array([[min(3, least(chunk, quote)) for chunk in plain] for quote in quotes])
    assert (got <= want).all() and (got < want).any() and np.array_equal(got[:, times > 1], want[:, times > 1])


def test_unlike_windows_are_ruled_out_by_chunks(monkeypatch):
    """Pairs by the common subsequence of all windows; hardly a block is aligned, and no chunk is worked out twice."""
    rng, seen, own = random.Random(11), [], grounding.block_costs
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quotes = [prose(n) for n in (3, 4, 9, 15, 20, 25, 30, 35)]
    texts = [prose(rng.randrange(100, 400)) for _ in range(12)] + ["", "x", "of it"]
    for q in quotes:
        texts += ["".join("#" if rng.random() < share else c for c in q) for share in (0, 0.05, 0.14, 0.2)] + [prose(30) + " " + q[:-3] + "#" + prose(20), q[: len(q) * 3 // 4].strip()]

    def common(a, b):
        row, every = (1 << len(b)) - 1, (1 << len(b)) - 1
        for c in a:
            has = sum(1 << k for k, d in enumerate(b) if c == d)
            row = ((row + (row & has)) | (row & ~has)) & every
        return len(b) - row.bit_count()

    def near(q, t):
        windows = (t[a : a + len(q)] for a in range(0, max(1, len(t) - len(q) + 1), max(1, len(q) // 8)))
        return any(common(w, q) >= 0.85 * (len(q) + len(w)) / 2 - 1e-6 for w in windows if t)

    monkeypatch.setattr(grounding, "block_costs", lambda blocks, quote: (seen.append(len(blocks)), own(blocks, quote))[1])
    index, want = grounding.Near(quotes), [(t, q) for q in range(len(quotes)) for t in range(len(texts)) if near(quotes[q], texts[t])]
    assert index.pairs(texts) == want and len(want) > 20
    assert sum(seen) * 100 < sum(map(len, texts)) // 16 * len(quotes)
    monkeypatch.setattr(grounding.Chunks, "_work_out", None)
    assert index.pairs(texts) == want
    monkeypatch.setattr(grounding.Near, "MANY", 0)
    assert index.pairs(texts) == want and seen


def test_near_quotes_are_searched_by_many_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of one file") for i in range(64)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "text 7 of one fine")], "quote_id long, quote string")
    assert grounding.near(asked, docs).rdd.getNumPartitions() >= 4 and {r.doc_id for r in grounding.near(asked, docs).collect()} >= {7}
    rng, seen, own = random.Random(9), [], difflib.SequenceMatcher.set_seq1
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quote = prose(40)
    text = prose(4000) + " " + quote[:90] + "#" + quote[91:]
    monkeypatch.setattr(difflib.SequenceMatcher, "set_seq1", lambda self, a: (seen.append(a), own(self, a))[1])
    found = grounding.fuzzy_find(quote, text)
    assert abs(found[0] - len(text) + len(quote)) <= 8 and len(seen) < 60


def test_difflib_is_asked_where_it_may_matter(monkeypatch):
    """Places, ratios and ambiguity are those of asking it about every window and every repair, for slips, repeats, short texts and odd signs."""
    rng, seen, own = random.Random(2), [], difflib.SequenceMatcher.set_seq1
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def plain_find(quote, text, least=0.85):
        wanted, (plain, at) = grounding.normal(quote)[0], grounding.normal(text)
        ratio = lambda a: difflib.SequenceMatcher(None, a, wanted, autojunk=False).ratio()
        size = len(wanted)
        found = [(s, ratio(plain[s : s + size])) for s in range(0, max(1, len(plain) - size + 1), max(1, size // 8))]
        if not (hits := [x for x in found if x[1] >= least]):
            return None
        best = max(hits, key=lambda x: x[1])[0]
        start, end = int(at[best]), int(at[min(best + size, len(at)) - 1]) + 1
        windows = [(start, end)] + [(s, e) for d in (1, 2, 3, 5, 8) for s in (max(0, start - d), start) for e in (min(len(text), end + d), end)]
        start, end = max(windows, key=lambda x: ratio(grounding.normal(text[x[0] : x[1]])[0]))
        return start, end, ratio(grounding.normal(text[start:end])[0]), hits[-1][0] - hits[0][0] >= size

    cases = []
    for n in (3, 6, 12, 20):
        for share in (0, 0.03, 0.08, 0.13):
            quote = prose(n)
            slip = "".join("z" if rng.random() < share else c + "…" * (rng.random() < share / 4) for c in quote)
            cases += [(quote, x) for x in (prose(9) + " " + slip + " " + prose(30), slip, slip[3:], slip + prose(25) + "  " + quote, "“" + slip + "” " + slip, prose(30))]
    got = [grounding.fuzzy_find(*case) for case in cases]
    assert got == [plain_find(*case) for case in cases]
    assert {None if x is None else x[3] for x in got} == {None, True, False}
    monkeypatch.setattr(difflib.SequenceMatcher, "set_seq1", lambda self, a: (seen.append(a), own(self, a))[1])
    quote = prose(40)
    assert not grounding.fuzzy_find(quote, prose(50) + " " + quote[:90] + "#" + quote[91:] + " " + prose(50))[3] and len(seen) <= 8


def test_fuzzy_offsets_are_of_the_text_as_it_was():
    text = "Well… so… it was… and then we migrated forty services to the cloud"
    a, b, ratio, again = grounding.fuzzy_find("and then we migrated forty services to the cloud", text)
    assert ratio >= 0.85 and not again and abs(a - text.index("and then")) <= 6 and b <= len(text)


def test_short_quotes_are_searched(spark):
    from siftline.queries.items import ground_exact, ground_missing_anti

    quotes = [(1, "fifteen letters"), (2, "twelve chars"), (3, "stands nowhere at all"), (4, "no, neither"), (5, "twenty-three characters")]
    held = {"documents": spark.createDataFrame([(7, "here: fifteen letters and twelve chars, and twenty-three characters")], "doc_id long, text string"), "benchmark": spark.createDataFrame(quotes, "item_id long, text string")}
    tables = type("Held", (), held)()
    assert vocab.MIN_QUOTE == 15
    assert {(r.quote_id, r.start) for r in ground_exact(tables).collect()} == {(1, 6), (5, 44)}
    assert {r.quote_id for r in ground_missing_anti(tables).collect()} == {3, 4}


def test_readable_text_closes_chrome_as_browsers_do():
    read = html.read_html
    assert read("<body><div><nav>menu<p>more</div><p>text</p></body>") == "text"
    assert read('<div role="navigation">x</div><div class="cookie-note">y</div><section>z</section>') == "z"
    assert read('<article><header>Title</header><div class="promo">copy</div></article><footer>end</footer>') == "Title\ncopy"
    assert read("<form>a<br>b<input></form>c") == "c" and read(None) == "" and read("<p>one<p>two") == "one\ntwo"


def test_json_in_prose():
    assert parse.find_json('x {"a": 1, "b": [1, 2,],} y') == {"a": 1, "b": [1, 2]} and parse.find_json("```json\n[1,]\n```") == [1] and parse.find_json(" 5 ") == 5
    assert parse.find_json("none") is None and parse.find_json(None) is None and parse.find_json("a {b} [1] {}") == [1]
    assert parse.find_payload('q {"x": {"input_items": []}} {"output_schema": 1, "input_items": [2]}') == {"output_schema": 1, "input_items": [2]} and parse.find_payload("{") is None


def test_json_in_odd_prose():
    deep = "[" * 100_000
    assert parse.find_json(deep) is None and parse.find_json(deep + "]" * 100_000) is not None and parse.find_json('{"a":' * 100_000) is None and parse.find_payload(deep) is None
    assert parse.find_json('{bad "x} then {"a": 1}') == {"a": 1} and parse.find_json('he said "so {"a": "}", "b": "\\""}') == {"a": "}", "b": '"'}
    assert parse.find_json('[1, "a, ]",]') == [1, "a, ]"] and parse.find_json('text ``` {"a": 1,} ``` more') == {"a": 1} and parse.find_json("``` no") is None
    assert parse.find_json("((([{)]}") is None and parse.find_json('"it\'s [not') is None and parse.find_json("null") is None


def test_bodies(spark):
    bodies = [
        ("é".encode("latin-1"), "text/html", "é"), ("é".encode(), "text/html; charset=nonsense", "é"), ("é".encode("utf-16-le"), "x; charset=utf-16-le", "é"), (None, None, ""), (b"\x81", None, "\ufffd"), (b"\x93q\x94", "", "“q”"),
        (b"\xe9\x93", "a; charset=ISO-8859-1", "é\x93"), ("中".encode("gbk"), "x; charset=gbk", "中"), (b"\xff\xfe", "x;charset=utf-8", "ÿþ"), ("é".encode(), "x; charset=hex", "é"), (b"", "x; charset=utf-16", ""), ("中".encode(), "x; charset=ascii", "中"),
    ]
    table = spark.createDataFrame(bodies, "raw binary, kind string, want string")
    assert [r.got for r in table.select(parse.body(table.raw, table.kind).alias("got")).collect()] == [w for _, _, w in bodies]


def test_ld(spark):
    block = lambda text: f'<script type="application/ld+json">{text}</script>'
    posting = lambda firm: f'{{"@type":"JobPosting","hiringOrganization":{firm}}}'
    pages = [
        (block('[%s,{"@type":"Person","text":"%s"},{"text":"untyped text"}]' % (posting('[{"name":" A  b "}]'), "long " * 20)), ("A b", "", "untyped text")),
        (block(f'[{posting(chr(123) + chr(34) + "url" + chr(34) + ":" + chr(34) + "https://linkedin.com/x" + chr(34) + chr(125))},{posting(chr(123) + chr(34) + "name" + chr(34) + ":" + chr(34) + "Real Firm" + chr(34) + chr(125))}]'), ("Real Firm", "", "")),
        (block('{"@graph":{"@type":["X","jobPosting"],"hiringOrganization":"  S  t ","description":"d1"}}') + block("{bad") + block(posting('"Later"')), ("S t", "", "d1")),
        (block(posting("[]")) + block(posting("7")) + block(posting('{"name":"","sameAs":"https://www.firm.com/x"}')), ("", "firm.com", "")),
        (block("[" * 100_000) + block('{"description":"after"}'), ("", "", "after")), ("", ("", "", "")), (None, ("", "", "")), (block('[[[{"text":"inner"}]]]'), ("", "", "inner")), (block('{"@type":null,"text":"no type"}'), ("", "", "no type")),
        (block('{"@type":"Product","description":["a list"],"text":"same"}') + block('{"text":"also"}'), ("", "", "same")),
    ]
    table = spark.createDataFrame([(p,) for p, _ in pages], "html string")
    assert [tuple(r.got) for r in table.select(parse.ld(table.html).alias("got")).collect()] == [w for _, w in pages]


def test_sitemaps_captures_and_images(spark):
    one = lambda function, text: spark.createDataFrame([(text,)], "x string").select(function(F.col("x")).alias("got")).first().got
    found = one(parse.sitemap, "<urlset><url><loc> https://a.com/?x=1&amp;y=&lt;&amp;lt; </loc><lastmod>2024</lastmod></url><url><loc><![CDATA[https://b.com/?a&b]]></loc></url></urlset>")
    assert [tuple(p) for p in found.pages] == [("https://a.com/?x=1&y=<&lt;", "2024"), ("https://b.com/?a&b", None)] and found.sitemaps == []
    assert tuple(one(parse.capture_parts, "https://web.archive.org/web/2024if_/https://a.com")) == ("https://a.com", "2024") and one(parse.capture_parts, "https://web.archive.org/web/2024long_/https://a.com") is None
    images = '<img src=x alt="Team &amp; co" w=1>b<IMG ALT=\'Logo\'>c<img alt="it\'s us">e<img src=q>f<img alt="&amp;&eacute;">g<img alt="Hero-Image"><img alt="back ground">'
    assert one(parse.exposed_alts, images) == " Team &amp; co b c it's us e<img src=q>f g Hero-Image  " and one(parse.exposed_alts, None) is None and one(parse.exposed_alts, "") == ""


def test_packets_and_frozen_inputs(spark, tmp_path):
    records = spark.createDataFrame([("a", 1.5, ["x"]), ("b", None, [])], "item_id string, score double, notes array<string>")
    receipts = spark.createDataFrame([(0.5, 10), (None, 7)], "cost double, tokens int")
    packets.write_packet(records, str(tmp_path / "p"), run_id="r", task={"name": "t"}, receipts=receipts)
    header, back = packets.read_packet(spark, str(tmp_path / "p"))
    assert header["total_records"] == 2 and header["total_cost"] == 0.5 and header["total_tokens"] == 17 and {r.item_id for r in back.collect()} == {"a", "b"}
    records.limit(1).write.mode("append").json(str(tmp_path / "p" / "records"))
    with pytest.raises(ValueError):
        packets.read_packet(spark, str(tmp_path / "p"))
    assert packets.digest(records).first() == packets.digest(records.orderBy("score")).first() != packets.digest(records.limit(1)).first()
    frozen = packets.freeze({"records": records}, str(tmp_path / "f"), run_id="r", sampled=["a"])
    assert frozen["inputs"]["records"]["rows"] == 2 and spark.read.parquet(str(tmp_path / "f" / "records")).count() == 2


def test_tables_that_leave(spark, tmp_path):
    rows = spark.createDataFrame([("i", "text, with\nlines", ["u", "v"], ["A", "B"])], "item_id string, text string, source_uris array<string>, source_categories array<string>")
    packets.write_dossiers(rows, str(tmp_path / "d"))
    back = spark.read.csv(str(tmp_path / "d"), header=True, multiLine=True, escape='"').first()
    assert back.asDict() == {"item_id": "i", "text": "text, with\nlines", "source_uri": None, "source_count": "1", "source_categories": "A,B", "source_backends": None, "source_uris": "u v"}
    packets.write_rung_csv(spark.createDataFrame([(1, "c", "i", ["kind"])], "extra int, candidate string, item_id string, gates array<string>"), str(tmp_path / "r"))
    back = spark.read.csv(str(tmp_path / "r"), header=True, escape='"')
    assert back.columns == ["item_id", "candidate", "extra", "gates"] and back.first().gates == '["kind"]'


def test_id_lists(spark, tmp_path):
    got = lambda g: sorted(r.item_id for r in packets.ids(spark, g).collect())
    (tmp_path / "a.csv").write_text("name,id\nx,1\ny, 2 \nz,\n")
    (tmp_path / "b.json").write_text('{"records": [{"item_id": "q"}, {"item_id": "r"}]}')
    (tmp_path / "c.txt").write_text("one\n\n two \n")
    (tmp_path / "d.jsonl").write_text('{"id": 7}\n{"id": 8}\n')
    assert got(["a", " b ", ""]) == ["a", "b"] and got("a, b;c\nd") == ["a", "b", "c", "d"] and got(str(tmp_path / "a.csv")) == ["1", "2"]
    assert got(str(tmp_path / "b.json")) == ["q", "r"] and got(str(tmp_path / "c.txt")) == ["one", "two"] and got(str(tmp_path / "d.jsonl")) == ["7", "8"]


def test_profiles_and_ladders():
    assert gates.Profile.of({"size_min": "20", "size_max": "many", "locations": "germany", "verticals": ["retail", " "]}) == gates.Profile(size_min=20, locations=("germany",), verticals=("retail",))
    assert gates.Profile.of(None) == gates.Profile()
    assert gates.reachable("snippet", ("kind",), "snippet") and not gates.reachable("snippet", ("vertical",), "snippet") and not gates.reachable("fetched", ("kind",), "snippet") and gates.reachable("fetched", ("vertical",), "fetched")
    gates.check_ladder(vocab.LADDER)
    for bad in ((" ", "snippet", ("kind",)), ("a", "guess", ("kind",)), ("a", "snippet", ()), ("a", "snippet", ("colour",))):
        with pytest.raises(ValueError):
            gates.check_ladder((bad,))
