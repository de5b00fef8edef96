"""Alignment of two vocabularies against a plain version that compares sets of end offsets, encoded by the libraries that the files are made for."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftline.llm import alignment

FOLDER = "/opt/tokenizers"
DOCS = "doc_id long, text string, row long, pair long, a string"


def brute(rows):
    one = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    alphabet = alignment.byte_alphabet()
    docs, links = [], Counter()
    for i, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in one.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(t) else p.replace("▁", " ").encode() for t in b for p in [two.id_to_piece(t)]]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        place = [{e: k + 1 for k, e in enumerate(side)} for side in ends]
        at = [[0] + [side[e] for e in both] for side in place]
        groups = [(a[p:q], b[r:s]) for p, q, r, s in zip(at[0], at[0][1:], at[1], at[1][1:], strict=False)]
        own = [(g[-1], h[-1]) for g, h in groups]
        links.update(own)
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        docs.append((i, a, b, own, hashlib.sha256(told.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    return sorted(((i, len(a), len(b), len(own), len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), h) for i, a, b, own, h in docs), key=str)


def rows():
    rng = random.Random(4)
    letters = "abcdefghij eé ß\n\tñ中文字 🙂,.'0123456789  "
    out = [(1, None), (2, ""), (3, " "), (4, "   \n\n "), (5, "<|endoftext|> <s> </s> <unk> <0x41> it's"), (6, "a▁b"), (7, "é  ​﻿\x00\x0b x"), (None, "no id"), (8, "tie tie tie"), (8, "tie tie tie"), (8, "another text")]
    out += [(9, "z" * 7000), (10, " ".join(rng.choice(["alpha", "bétä", "g4mma,", "(δ)"]) for _ in range(25000))), (11, "中文 " * 500)]
    return out + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 400)))) for i in range(200)]


def frame(spark, table):
    return spark.createDataFrame([(i, t, 7, 8, "x") for i, t in table], DOCS)


def test_groups_are_the_common_ends():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 70)
        sides = [sorted({n, *(k for k in range(1, n) if rng.random() < p)}) for p in (rng.choice([0.1, 0.5, 0.9, 1]), rng.choice([0.1, 0.5, 0.9, 1]))]
        both = sorted(set(sides[0]) & set(sides[1]))
        got = alignment.groups(*(np.array(s, np.int32) for s in sides))
        assert [x.tolist() for x in got] == [[s.index(e) + 1 for e in both] for s in sides]
    assert [x.tolist() for x in alignment.groups(np.zeros(0, np.int32), np.zeros(0, np.int32))] == [[], []]


def test_cut_texts_keep_their_tokens():
    text = " ".join(f"wörd{i}, {i * 7919}  (x)\n" for i in range(400)) + "it's  the end"
    known = alignment.vocabularies(FOLDER, "byte_bpe_50k.json", "piece_bpe_32k.model")
    parts = list(alignment.stretches("word and " * 500 + text, 50))
    assert len(parts) > 50 and " ".join(parts) == "word and " * 500 + text
    assert known.cuttable and known.b.encode(" ".join(parts)) == [t for p in parts for t in known.b.encode(p)]
    assert known.a.encode_ordinary(" " + " ".join(parts)) == [t for p in parts for t in known.a.encode_ordinary(" " + p)]


@pytest.mark.parametrize("max_pairs", [1 << 20, 20, 0])
def test_alignment_matches_brute_force(spark, max_pairs):
    """With the frequent pairs broadcast and the others joined; odd texts, repeated and null ids, clashing columns."""
    table = rows()
    got = alignment.digest(frame(spark, table), max_pairs=max_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(table)


def test_alignment_of_whole_small_table(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.digest(frame(spark, table)).collect()), key=str) == brute(table)


def test_alignment_operator_and_empty_table(spark):
    got = {r.doc_id: r for r in alignment.align(frame(spark, [(1, "hello, wörld"), (2, None)])).collect()}
    assert got[2].a == got[2].b == got[2].ends_a == got[2].ends_b == []
    assert got[1].ends_a[-1] == len(got[1].a) and got[1].ends_b[-1] == len(got[1].b) and len(got[1].ends_a) == len(got[1].ends_b)
    assert alignment.digest(frame(spark, [])).collect() == []
