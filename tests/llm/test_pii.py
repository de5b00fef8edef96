import hashlib
import random
import re

from siftline.llm import pii

DOCS = "doc_id long, text string, kind string, start int, tkey int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    found = []
    for rank, (kind, pattern, _) in enumerate(pii.KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def digest_of(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()


def card(rng, n):
    body = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def corpus():
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a@b.c@d.e a@b.com%x@y.z aa@ bb@c-d.e.f. .@x.y"), (4, "1.2.3.4.5.6.7.8 0.0.0.256 010.1.2.0003 1.2.3"), (5, "+1 (017) 555-7713 +12 +1234567890123456 ++4 123 456 78"), (6, "😀é joe@x.org Ünï 10.0.0.1 " + card(rng, 16))]
    alphabet = ["a", "b.c", "@", ".", "1", "22", "255", "+", " ", "-", "(", ")", "%", "é", "\n", "0", card(rng, 13), card(rng, 16)]
    rows += [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))) for i in range(7, 150)]
    rows += [(150, "1 " * 30_000), (151, "a" * 2_000 + "@"), (152, "x@y.z " * 2000), (153, "9" * 2_000), (6, rows[5][1]), (None, "q@r.st")]
    return rows


def test_base_spans_match_python(spark):
    rows = corpus()
    got = pii.digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {(i, digest_of(brute(t)), *[sum(k == kind for _, _, k, _ in brute(t)) for kind in ("email", "ip", "card", "phone")]) for i, t in rows}
    assert {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got} == want


def test_disclosing_terms_are_found(spark):
    rng = random.Random(9)
    vocab = [f"word{c}{d}" for c in "abcdefghij" for d in "abcdefghij"]
    text = lambda: [rng.choice(vocab) for _ in range(30)]
    rows = [(i, " ".join(text())) for i in range(200)]
    rows += [(200 + i, " ".join([*text(), "Zorro,", "pat@home.org", *text()])) for i in range(5)]
    rows += [(300, "here comes zorro alone"), (301, None), (205, None)]
    spans = {r.doc_id: r.spans for r in pii.digest(frame(spark, rows)).collect()}
    assert spans[300] == "term:11:16"
    assert all(s == "" for i, s in spans.items() if i is not None and i < 200)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[300] == "here comes [TERM] alone" and "[EMAIL]" in clean[201] and "[TERM]" in clean[201] and "pat@" not in clean[201]
    assert {r.text for r in pii.sanitise(frame(spark, [(1, "a joe@x.org b"), (2, None)]), generalise=False).collect()} == {"a  b", ""}


def test_long_runs_are_quick(spark):
    rows = [(1, "a" * 300_000 + "@"), (2, "9" * 300_000), (3, "1 " * 200_000)]
    assert {r.spans for r in pii.digest(frame(spark, rows)).collect()} == {""}


def test_empty_table(spark):
    assert pii.digest(frame(spark, [])).collect() == []


def test_terms_with_digits_and_short_terms_disclose(spark):
    rng = random.Random(9)
    vocab = [f"word{c}{d}" for c in "abcdefghij" for d in "abcdefghij"]
    text = lambda: [rng.choice(vocab) for _ in range(30)]
    rows = [(i, " ".join(text())) for i in range(200)]
    rows += [(200 + i, " ".join([*text(), "jdoe77,", "A1234", "李四", "Xu", "call:+1", "(017)", "555-7713", "pat@home.org", *text()])) for i in range(5)]
    rows += [(300, "jdoe77 a1234 李四 xu"), (301, "(017) 555-7713 home pat")]
    spans = {r.doc_id: r.spans for r in pii.digest(frame(spark, rows)).collect()}
    assert spans[300] == "term:0:6,term:7:12,term:13:15,term:16:18"
    assert spans[301] == "" and all(spans[i] == "" for i in range(200))
