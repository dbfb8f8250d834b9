"""Proportional hazards (Breslow ties) by Newton steps over rows that are shuffled once.

Rows are dealt once to ranges of time, latest first, and sorted inside them. From then on every pass reads
the ranges where they lie and carries running sums through a range batch by batch, so memory does not grow
with the rows and a time that holds a third of them may span many ranges:

1. totals of each range (and of its latest time) turn into what every range starts with;
2. a scan from there gives likelihood, gradient and the hazard that each range adds;
3. a scan with the hazards of earlier times gives the second moments.

Events of a time that runs on into the next range wait for the range where it ends.

The driver holds three vectors per range (at most ``MAX_RANGES`` of them) and one d x d matrix; no pass shuffles rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardline.session import cut_lineage

MAX_RANGES = 4096  # ranges grow with the rows beyond this many
ROWS_PER_RANGE = 100_000
_SMALLEST_STEP = 2.0**-20


@dataclass(frozen=True)
class CoxModel:
    beta: np.ndarray
    centre: np.ndarray
    gradient: float  # largest absolute gradient entry at the end, per row
    log_likelihood: float
    steps: int

    def score_column(self, features: Column | str) -> Column:
        """Log relative hazard: higher means earlier events."""
        values = F.col(features) if isinstance(features, str) else features
        weights = F.array(*[F.lit(float(b)) for b in self.beta])
        dot = F.aggregate(F.zip_with(values, weights, lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
        return dot - F.lit(float(self.centre @ self.beta))


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.vstack(batch["x"].to_numpy())


@dataclass(frozen=True)
class _Point:
    """What the scans found for one coefficient vector. Per range: sums of all rows before it, hazard of all earlier
    times outside it, hazard of its own events, and of the events that waited for its latest time."""

    beta: np.ndarray
    shift: float
    start: np.ndarray
    before: np.ndarray
    own: np.ndarray
    waited: np.ndarray
    likelihood: float
    gradient: np.ndarray
    outer: np.ndarray


class _Scan:
    """Sums at risk along one range, latest time first; a time that batches cut apart is held until it is whole."""

    def __init__(self, start: np.ndarray, beta: np.ndarray, shift: float):
        self.carry, self.held, self.beta, self.shift = start.copy(), None, beta, shift

    def times(self, batch: pd.DataFrame, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Time, deaths and sums at risk of every time that is whole by now."""
        t, w = batch["t"].to_numpy(), np.exp(m @ self.beta - self.shift)
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sums = np.add.reduceat(np.column_stack([w, w[:, None] * m]), first, axis=0)
        dead, at = np.add.reduceat(batch["ev"].to_numpy(float), first), t[first]
        if self.held is not None and self.held[0] == at[0]:
            dead[0] += self.held[1]
            sums[0] += self.held[2]
        elif self.held is not None:
            at, dead, sums = np.r_[self.held[0], at], np.r_[self.held[1], dead], np.vstack([self.held[2], sums])
        self.held = at[-1], dead[-1], sums[-1]
        return self._risk(at[:-1], dead[:-1], sums[:-1])

    def last(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, dead, sums = self.held
        return self._risk(np.array([at]), np.array([dead]), sums[None, :])

    def _risk(self, at, dead, sums):
        risk = self.carry + np.cumsum(sums, axis=0)
        if len(risk):
            self.carry = risk[-1]
        return at, dead, risk


def _terms(dead: np.ndarray, risk: np.ndarray, shift: float) -> np.ndarray:
    """Likelihood, hazard, gradient and outer products that the events of some times add, in one vector."""
    hit = dead > 0
    dead, risk = dead[hit], risk[hit]
    mean = risk[:, 1:] / risk[:, :1]
    logs = dead @ (np.log(risk[:, 0]) + shift)
    return np.r_[-logs, (dead / risk[:, 0]).sum(), -(dead @ mean), ((mean * dead[:, None]).T @ mean).ravel()]


def _deal(df: DataFrame, n: int, rows_per_range: int) -> DataFrame:
    """Rows as (part, t, ev, x) in ranges of falling time, at most ``MAX_RANGES``.

    The number that orders equal times is taken from written rows, so a repeated task deals alike.
    """
    some = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1000))
    parts = min(MAX_RANGES, max(math.ceil(n / rows_per_range), some))
    order = [F.desc("t"), F.asc("salt")]
    numbered = cut_lineage(df).withColumn("salt", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.select(F.spark_partition_id().alias("part"), "t", "ev", "x"))


def _totals(rows: DataFrame, beta: np.ndarray) -> tuple[float, dict[int, dict]]:
    """The largest linear score, and per range its latest and earliest time, its sums and those of its latest time.

    Weights are relative to the largest score, so none overflows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peak, total, lead, latest, earliest, part = -np.inf, 0.0, 0.0, None, None, None
        for b in batches:
            if not len(b):
                continue
            m, t = _matrix(b), b["t"].to_numpy()
            eta = m @ beta
            top = max(peak, float(eta.max()))
            fade, peak = np.exp(peak - top), top
            w = np.exp(eta - peak)
            stacked = np.column_stack([w, w[:, None] * m])
            latest, earliest, part = t[0] if latest is None else latest, t[-1], int(b["part"].iloc[0])
            total, lead = total * fade + stacked.sum(0), lead * fade + stacked[t == latest].sum(0)
        if part is not None:
            yield pd.DataFrame({"part": [part], "peak": [peak], "latest": [latest], "earliest": [earliest], "total": [total], "lead": [lead]})

    schema = "part int, peak double, latest double, earliest double, total array<double>, lead array<double>"
    found = {r["part"]: r.asDict() for r in rows.mapInPandas(run, schema).collect()}
    shift = max(r["peak"] for r in found.values())
    for r in found.values():
        for c in ("total", "lead"):
            r[c] = np.array(r[c]) * np.exp(r["peak"] - shift)
    return shift, found


def _evaluate(rows: DataFrame, beta: np.ndarray, ridge: float) -> _Point:
    """Likelihood and gradient at ``beta``, with what the second moments need; ``ridge`` is already times the rows."""
    d = len(beta)
    shift, found = _totals(rows, beta)
    order = sorted(found)
    start, own, waited = np.zeros((order[-1] + 1, d + 1)), np.zeros(order[-1] + 1), np.zeros(order[-1] + 1)
    for p, q in zip(order, order[1:]):
        start[q] = start[p] + found[p]["total"]
    runs_on = {p for p, q in zip(order, order[1:]) if found[p]["earliest"] == found[q]["latest"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, part, sums, open_dead = None, None, np.zeros(2 + d + d * d), 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for b in batches:
                if not len(b):
                    continue
                part = int(b["part"].iloc[0])
                scan = scan or _Scan(start[part], beta, shift)
                m, ev = _matrix(b), b["ev"].to_numpy(float)
                _, dead, risk = scan.times(b, m)
                sums += _terms(dead, risk, shift)
                sums[0] += ev @ (m @ beta)
                sums[2 : 2 + d] += ev @ m
            if part in runs_on:
                open_dead = scan.held[1]
            elif part is not None:
                sums += _terms(*scan.last()[1:], shift)
        if part is not None:
            place = np.r_[np.arange(len(sums)), 0, 1]
            yield pd.DataFrame({"part": np.where(np.arange(len(place)) < len(sums), -1, part), "i": place, "v": np.r_[sums, open_dead, sums[1]]})

    # vectors are summed on the way; of each range come its events still open and its hazard
    total, waiting = np.zeros(2 + d + d * d), 0.0
    of_range = {p: np.zeros(2) for p in order}
    for r in rows.mapInPandas(run, "part int, i int, v double").groupBy("part", "i").agg(F.sum("v").alias("v")).collect():
        (total if r["part"] < 0 else of_range[r["part"]])[r["i"]] = r["v"]
    with np.errstate(divide="ignore", invalid="ignore"):
        for p in order:
            own[p] = of_range[p][1]
            whole_here = p not in runs_on or found[p]["earliest"] != found[p]["latest"]
            if waiting and whole_here:
                late = _terms(np.array([waiting]), (start[p] + found[p]["lead"])[None, :], shift)
                total, waited[p], waiting = total + late, late[1], 0.0
            waiting += of_range[p][0]
    hazard = own + waited
    before = np.cumsum(hazard[::-1])[::-1] - hazard
    likelihood = float(total[0] - 0.5 * ridge * beta @ beta) if np.isfinite(total).all() else -np.inf
    return _Point(beta, shift, start, before, own, waited, likelihood, total[2 : 2 + d] - ridge * beta, total[2 + d :].reshape(d, d))


def _information(rows: DataFrame, point: _Point, ridge: float) -> np.ndarray:
    """Second moments of the rows, each weighted by the hazard up to its time, less the outer products."""
    d = len(point.beta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, passed, latest, total = None, 0.0, None, np.zeros((d, d))
        for b in batches:
            if not len(b):
                continue
            part, t, m = int(b["part"].iloc[0]), b["t"].to_numpy(), _matrix(b)
            scan = scan or _Scan(point.start[part], point.beta, point.shift)
            latest = t[0] if latest is None else latest
            at, dead, risk = scan.times(b, m)
            later = np.r_[passed, passed + np.cumsum(dead / risk[:, 0])]
            passed = later[-1]
            hazard = point.before[part] + point.own[part] - later[np.searchsorted(-at, -t, "left")] + np.where(t == latest, point.waited[part], 0.0)
            total += (m * (np.exp(m @ point.beta - point.shift) * hazard)[:, None]).T @ m
        yield pd.DataFrame({"i": np.arange(d * d, dtype=np.int32), "v": total.ravel()})

    second = np.zeros(d * d)
    for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        second[r["i"]] = r["v"]
    return second.reshape(d, d) - point.outer + ridge * np.eye(d)


def fit_cox(
    df: DataFrame,
    features: str,
    time: str,
    event: str,
    n_features: int,
    ridge: float = 1e-6,
    max_steps: int = 25,
    tolerance: float = 1e-6,
    rows_per_range: int = ROWS_PER_RANGE,
) -> CoxModel:
    """Coefficients whose gradient is below ``tolerance`` per row in every (scaled) feature.

    A step that lowers the likelihood is halved. A fit that does not get there within ``max_steps`` is an error, and so
    are missing times, events and feature values, a row of another width, and data without events.
    """
    d, x = n_features, F.col(features).cast("array<double>")
    slim = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("ev"), x.alias("x"))
    broken = (
        F.col("t").isNull() | F.isnan("t") | F.col("ev").isNull() | F.col("x").isNull() | (F.size("x") != d)
        | F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    )
    facts = slim.agg(F.count("*").alias("n"), F.count_if(broken).alias("broken"), F.count_if(F.col("ev") != 0).alias("events")).first()
    if facts["broken"]:
        raise ValueError(f"{facts['broken']} rows lack a time, an event or one of {d} feature values")
    if not facts["events"]:
        raise ValueError("no events to learn from")
    n = facts["n"]
    per_feature = slim.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    moments = {r["i"]: r for r in per_feature.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    mean = np.array([moments[i]["m"] for i in range(d)])
    std = np.array([moments[i]["s"] for i in range(d)])
    std = np.where(std > 0, std, 1.0)

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"t": b["t"], "ev": (b["ev"] != 0).astype(np.int32), "x": list((_matrix(b) - mean) / std)})

    rows = _deal(slim.mapInPandas(scale, "t double, ev int, x array<double>"), n, rows_per_range)
    point, step = _evaluate(rows, np.zeros(d), ridge * n), 0
    while np.abs(point.gradient).max() >= tolerance * n:
        step += 1
        if step > max_steps:
            raise ValueError(f"not converged after {max_steps} steps; largest gradient {np.abs(point.gradient).max() / n:.3g} a row")
        try:
            move = np.linalg.solve(_information(rows, point, ridge * n), point.gradient)
        except np.linalg.LinAlgError:
            raise ValueError("features depend on each other: set a ridge") from None
        share = 1.0
        while True:
            tried = _evaluate(rows, point.beta + share * move, ridge * n)
            if tried.likelihood >= point.likelihood - 1e-9 * abs(point.likelihood):
                break
            share /= 2
            if share < _SMALLEST_STEP:
                raise ValueError(f"no step raises the likelihood after {step} steps; largest gradient {np.abs(point.gradient).max() / n:.3g} a row")
        point = tried
    plain = point.likelihood + 0.5 * ridge * n * point.beta @ point.beta
    return CoxModel(point.beta / std, mean, float(np.abs(point.gradient).max() / n), float(plain), step)
