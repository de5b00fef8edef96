"""Toxicity by multiple-instance learning: sentence scores are combined by noisy-or and trained from document labels alone."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import fresh

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SCHEMA = "score double, sentences array<struct<start: int, end: int, score: double>>"


def features(token: str) -> tuple[str, ...]:
    """A token's word without outer punctuation, and its beginnings of four to six letters."""
    word = _EDGE.sub("", token)
    return (word, *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n)) if word else ()


@dataclass
class Model:
    """Log-odds of a sentence: the bias and the weights of its distinct tokens' features."""

    bias: float
    weights: dict[str, float]

    def scorer(self):
        return _Scorer(self)


class _Scorer(dict):
    """Token -> weight, remembered; forgets all beyond a million tokens."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[token] = sum(self.model.weights.get(f, 0.0) for f in features(token))
        return value

    def logit(self, sentence: str) -> float:
        return self.model.bias + sum(map(self.__getitem__, set(sentence.split())))

    def document(self, text: str | None, locate: bool) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and the sentences that score 0.5 or more as [start, end) of the text."""
        text = text or ""
        silent, found = 0.0, []
        for m in _SENTENCE.finditer(text):
            z = self.logit(m[0].lower())
            silent -= math.log1p(math.exp(z)) if z < 30 else z
            if locate and z >= 0:
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return min(1.0, -math.expm1(silent)), found


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, max_docs: int, max_bytes: int) -> DataFrame:
    """(text, label) of at most ``max_docs`` labelled documents and ``max_bytes`` of text, in the order of a hash of the id.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Several labels of one id count as toxic if one is.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)  # so small that it may be broadcast
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).orderBy(F.xxhash64("id"), "id").select("text", "y")


def train(rows: list[tuple[str, int]], *, least_docs: int = 5, least_z: float = 7.0, rounds: int = 300, rate: float = 0.02, ridge: float = 1e-6) -> Model:
    """Full-batch RMSProp on the noisy-or likelihood of the document labels. Without a toxic label every score is 0.

    Features are those that toxic documents hold more often than chance: in ``least_docs`` of them, and by ``least_z``
    standard deviations. Others could only learn single documents by heart.
    """
    if not any(y for _, y in rows):
        return Model(-1e3, {})
    memo: dict[str, tuple[str, ...]] = {}
    bags, owner = [], []
    seen: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for d, (text, label) in enumerate(rows):
        mine: set[str] = set()
        for m in _SENTENCE.finditer(text):
            bag = [f for t in set(m[0].lower().split()) for f in (memo.get(t) or memo.setdefault(t, features(t)))]
            bags.append(bag)
            owner.append(d)
            mine.update(bag)
        seen.update(mine)
        if label:
            toxic.update(mine)
    q = sum(y for _, y in rows) / len(rows)
    names = {f: i for i, f in enumerate(sorted(f for f, k in toxic.items() if k >= least_docs and k - seen[f] * q >= least_z * math.sqrt(seen[f] * q * (1 - q))))}
    columns = [[names[f] for f in bag if f in names] for bag in bags]
    sizes = np.array([len(c) for c in columns], np.int64)
    column = np.array([i for c in columns for i in c], np.int64)
    row = np.repeat(np.arange(len(columns)), sizes)
    owner_of, y = np.array(owner, np.int64), np.array([v for _, v in rows], float)
    b = -math.log(30 * max(1.0, len(bags) / len(rows)))
    # Features start where one of them alone gives a sentence the share of toxic documents among those that hold it.
    share = np.array([(toxic[f] + q) / (seen[f] + 1) for f in names])
    w = np.maximum(0, np.log(share / (1 - share)) - b)
    gw, gb = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        z = np.clip(b + np.bincount(row, w[column], len(columns)), -30, 30)
        silent = np.bincount(owner_of, -np.log1p(np.exp(z)), len(rows))
        p = np.clip(-np.expm1(silent), 1e-9, 1)
        pull = np.where(y > 0, -(1 - p) / p, 1.0)  # what a document's label asks of its sentences
        g = pull[owner_of] / (1 + np.exp(-z))
        dw, db = np.bincount(column, g[row], len(names)) / len(rows) + ridge * w, g.sum() / len(rows)
        gw, gb = 0.98 * gw + 0.02 * dw**2, 0.98 * gb + 0.02 * db**2
        w -= rate * dw / (np.sqrt(gw) + 1e-6)
        b -= rate * db / (math.sqrt(gb) + 1e-6)
    return Model(float(b), {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 6000, max_bytes: int = 48 << 20) -> Model:
    """Train on a bounded sample of labelled rows: ``max_docs`` documents, ``max_bytes`` of text."""
    rows = sample(docs, labels, doc_id=doc_id, text=text, label=label, max_docs=max_docs, max_bytes=max_bytes).toPandas()
    return train([(t, int(y)) for t, y in zip(rows["text"], rows["y"], strict=True)])


def scored(text: Column, model: Model, locate: bool = True) -> Column:
    """SCHEMA of a text: its score, and the offending sentences if asked for."""

    @F.pandas_udf(SCHEMA)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.scorer()
        for texts in batches:
            yield pd.DataFrame([own.document(t, locate) for t in texts], columns=["score", "sentences"])

    return score(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and sentences: those that score 0.5 or more by themselves, as ``start:end`` in code points, comma-joined.

    Null and empty texts have no sentence, so score 0. A null id is not held out and has no label. Repeated rows score alike.
    """
    model = model or fit(docs, labels, doc_id=doc_id, text=text, **options)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), scored(F.col(text), model).alias("s"))
    told = F.transform("s.sentences", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.array_join(told, ",").alias("sentences"))


def keep_civil(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.5, model: Model | None = None, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    model = model or fit(docs, labels, text=text, **options)
    name = fresh(docs, "score")
    return docs.withColumn(name, scored(F.col(text), model, locate=False)["score"]).where(F.col(name) < threshold).drop(name)
