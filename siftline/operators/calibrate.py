"""Calibration: checklist points fitted to expected scores by coordinate descent on sums that Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.evidence import qualifies


def simplex(values: np.ndarray, total: float = 100.0) -> np.ndarray:
    """The nearest point whose parts are not negative and sum to ``total``."""
    ordered = np.sort(values)[::-1]
    excess = (np.cumsum(ordered) - total) / np.arange(1, len(values) + 1)
    return np.maximum(values - excess[np.flatnonzero(ordered > excess)[-1]], 0)


def whole_points(points: np.ndarray, total: int = 100) -> np.ndarray:
    """Whole numbers of at least 1 that sum to ``total``, by largest remainder, the first of equals."""
    out = np.maximum(np.floor(points), 1).astype(int)
    order = np.argsort(-(points - np.floor(points)), kind="stable")
    k = 0
    while out.sum() != total:
        i = order[k % len(order)]
        if out.sum() < total:
            out[i] += 1
        elif out[i] > 1:
            out[i] -= 1
        k += 1
    return out


def fit(observations: DataFrame, *, by: str, items: list[str], expected: str, steps: tuple[float, ...] = (4.0, 2.0, 1.0, 0.5, 0.25), sweeps: int = 50) -> DataFrame:
    """(by, item, points, mse) per group. Squared error needs only the sums of products of strengths and expected scores, so
    each group is one row of k*k + k + 2 sums, whatever its size; the descent runs over those."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(items) for j, b in enumerate(items) if i <= j]
    crossed = [F.sum(F.col(a) * F.col(expected)).alias(f"y{i}") for i, a in enumerate(items)]
    sums = observations.groupBy(by).agg(*products, *crossed, F.sum(F.col(expected) * F.col(expected)).alias("yy"), F.count("*").alias("n"))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.to_dict("records"):
                k = len(items)
                x = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                y = np.array([r[f"y{i}"] for i in range(k)])
                error = lambda p: (p @ x @ p - 2 * p @ y + r["yy"]) / r["n"]  # noqa: B023, E731
                points = np.full(k, 100.0 / k)
                best = error(points)
                for step in steps:
                    for _ in range(sweeps):
                        before = best
                        for i in range(k):
                            for move in (step, -step):
                                tried = points.copy()
                                tried[i] = min(100.0, max(0.0, tried[i] + move))
                                tried = simplex(tried)
                                if (e := error(tried)) < best - 1e-9:
                                    points, best = tried, e
                        if best >= before - 1e-9:
                            break
                rows += [(r[by], item, int(p), float(round(best, 6))) for item, p in zip(items, whole_points(points), strict=True)]
            yield pd.DataFrame(rows, columns=[by, "item", "points", "mse"])

    return sums.mapInPandas(descend, f"{by} string, item string, points int, mse double")


# --- points, source weights and half-lives together ---------------------------------------------------
#: First and last step, least and greatest value of each kind; half-lives are multiplied, the others added to.
STEPS = {"points": (4.0, 0.25, 0.0, 100.0), "weights": (0.2, 0.01, 0.0, 1.0), "halves": (1.6, 1.02, 0.5, 7300.0)}


@dataclass(frozen=True)
class Calibration:
    """What turns quotes into a score: points of items, weights of address patterns (the longest match counts) with a default, half-lives in days of some items."""

    points: dict[str, float]
    weights: dict[str, float]
    default: float
    half_lives: dict[str, float]

    def value(self, kind: str, name: str) -> float:
        return {"points": self.points, "weights": {**self.weights, "": self.default}, "halves": self.half_lives}[kind][name]

    def moved(self, changes: dict[tuple[str, str], float]) -> Calibration:
        """With new values; points are brought back to a sum of 100."""
        points, weights, halves, default = dict(self.points), dict(self.weights), dict(self.half_lives), self.default
        for (kind, name), value in changes.items():
            if kind == "weights" and not name:
                default = value
            else:
                {"points": points, "weights": weights, "halves": halves}[kind][name] = value
        if any(kind == "points" for kind, _ in changes):
            points = dict(zip(points, simplex(np.array(list(points.values()))).tolist(), strict=True))
        return Calibration(points, weights, default, halves)


def evidence(quotes: DataFrame, observations: DataFrame, known: Calibration) -> DataFrame:
    """(record, expected, held, i, w, age): of each observed record and item the youngest quote of each weight; what trials need, and they change nothing of it.

    quotes: (record, item, category, uri, captured_at, scored_at); observations: (record, expected, held). Quotes that don't qualify,
    and of unknown items, go; a record without any keeps one row with nulls. A quote without a time, or of one ahead, has no age. Of a
    record all rows lie in one partition, so a trial shuffles sums alone.
    """
    patterns, items = sorted(known.weights, key=lambda p: -len(p)), list(known.points)
    at = F.coalesce(*(F.when(F.contains(F.lower("uri"), F.lit(p.lower())), F.lit(n)) for n, p in enumerate(patterns)), F.lit(len(patterns)))
    allowed, place = F.lit(False), F.lit(None).cast("int")
    for n, item in enumerate(items):
        mine = F.col("item") == item
        allowed, place = F.when(mine, qualifies(item, F.col("category"))).otherwise(allowed), F.when(mine, F.lit(n)).otherwise(place)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = F.greatest(F.coalesce((micros("scored_at") - micros("captured_at")) / F.lit(86_400_000_000.0), F.lit(0.0)), F.lit(0.0))
    youngest = quotes.where(F.col("item").isin(*items) & allowed).groupBy("record", place.alias("i"), at.alias("w")).agg(F.min(age).alias("age"))
    return observations.select("record", "expected", "held").join(youngest, "record", "left").repartition("record")


def priced(rows: DataFrame, trials: list[Calibration], held: bool = False) -> list[tuple[float, float]]:
    """(mean squared, mean absolute) error of each trial over the records held out, or over the others: one aggregate for all trials."""
    patterns, items = sorted(trials[0].weights, key=lambda p: -len(p)), list(trials[0].points)
    numbers = lambda values: F.array(*(F.lit(v).cast("double") for v in values))
    worth, points = [], []
    for t in trials:
        half = F.get(numbers(t.half_lives.get(i) for i in items), F.col("i"))
        worth.append(F.get(numbers([*(t.weights[p] for p in patterns), t.default]), F.col("w")) * F.coalesce(F.pow(F.lit(0.5), F.col("age") / half), F.lit(1.0)))
        points.append(F.get(numbers(t.points[i] for i in items), F.col("i")))
    own = rows.where(F.col("held") == held)
    best = own.groupBy("record", "i").agg(F.first("expected").alias("expected"), *(F.round(F.max(w), 6).alias(f"s{n}") for n, w in enumerate(worth)))
    score = lambda n: F.least(F.lit(100.0), F.floor(F.round(F.coalesce(F.sum(points[n] * F.col(f"s{n}")), F.lit(0.0)), 6) + 0.5))
    scored = best.groupBy("record").agg(*((score(n) - F.first("expected")).alias(f"e{n}") for n in range(len(trials))))
    found = scored.agg(*(F.avg(F.col(f"e{n}") * F.col(f"e{n}")).alias(f"q{n}") for n in range(len(trials))), *(F.avg(F.abs(f"e{n}")).alias(f"a{n}") for n in range(len(trials)))).first()
    return [(found[f"q{n}"] or 0.0, found[f"a{n}"] or 0.0) for n in range(len(trials))]


def fit_tables(quotes: DataFrame, observations: DataFrame, start: Calibration, *, kinds: tuple[str, ...] = ("points", "weights", "halves"), sweeps: int = 50) -> tuple[Calibration, dict[str, tuple[float, float]]]:
    """The calibration that descent from ``start`` finds, points whole, and its errors: {"train": (mse, mae), "held": ..., "before": ...}.

    A sweep prices a step up and a step down of every parameter in one aggregate over the evidence, and then, in another, the best
    step alone and together with the next best ones; the best of all is taken. A sweep without gain shortens the steps; the shortest ends
    it. Held-out records have no part in it. No observations: the start with errors of 0.
    """
    names = [(k, n) for k in kinds for n in {"points": start.points, "weights": {**start.weights, "": 0}, "halves": start.half_lives}[k]]
    rows = evidence(quotes, observations, start).persist()
    try:
        now, steps = start, {k: STEPS[k][0] for k in kinds}
        best = before = priced(rows, [now])[0]
        for _ in range(sweeps):
            moves = []
            for kind, name in names:
                _, _, low, high = STEPS[kind]
                value = now.value(kind, name)
                for up in (True, False):
                    other = (value * steps[kind] if up else value / steps[kind]) if kind == "halves" else value + (steps[kind] if up else -steps[kind])
                    if (other := max(low, min(high, other))) != value:
                        moves.append(((kind, name), other))
            errors = priced(rows, [now.moved(dict([m])) for m in moves]) if moves else []
            gains: dict[tuple[str, str], tuple[float, float]] = {}
            for ((name, value), (mse, _)) in zip(moves, errors, strict=True):
                if mse < min(best[0] - 1e-9, gains.get(name, (np.inf,))[0]):
                    gains[name] = mse, value
            ordered = [(name, value) for name, (_, value) in sorted(gains.items(), key=lambda g: g[1][0])]
            if ordered:
                together = [now.moved(dict(ordered[: n + 1])) for n in range(len(ordered))]
                errors = priced(rows, together)
                n = min(range(len(together)), key=lambda n: errors[n][0])
                now, best = together[n], errors[n]
                continue
            if all(steps[k] <= STEPS[k][1] for k in kinds):
                break
            steps = {k: max(STEPS[k][1], s**0.5 if k == "halves" else s / 2) for k, s in steps.items()}
        if "points" in kinds:
            now = Calibration(dict(zip(now.points, whole_points(np.array(list(now.points.values()))).astype(float).tolist(), strict=True)), now.weights, now.default, now.half_lives)
        return now, {"train": priced(rows, [now])[0], "held": priced(rows, [now], held=True)[0], "before": before}
    finally:
        rows.unpersist()
