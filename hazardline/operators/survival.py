"""Product-limit curves, censoring weights and concordance for right-censored labels.

Concordance compares pairs, but never lists them. Rows are cut into ranges of time and into ranges of risk. Pairs inside
a range of time are counted there by a wavelet matrix, in O(m log m) for its bounded number of rows; so are pairs of
different times inside a range of risk. All other pairs differ in both ranges and follow from the table of counts by
(time range, risk range), block by block. That is two shuffles of narrow rows at any size, for all evaluated groups at
once, and no group of rows is ever whole in one task. A time or a risk frequent enough to overfill a range gets one of its
own, which needs no count inside: its pairs are those of events with censorings, or ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardline.operators.ordering import (
    ROWS_PER_BUCKET,
    OrderedTable,
    bucketize,
    edges_from_quantiles,
    even_shares,
)
from hazardline.session import cut_lineage, stage_table

ROWS_PER_STRIP = 1_000_000
RANGES = 16  # ranges of time and of risk at least
_BLOCK_BITS = 6  # time ranges that one task adds up: 64
_LATER = 1 << 30  # stands for all time ranges of later blocks
TAU = 7.0  # fixed value: evaluation horizon in years


def event_table(labels: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct times with the number of events and of censorings at each."""
    is_event = F.col(event).cast("int")
    return labels.groupBy(*by, time).agg(
        F.sum(is_event.cast("long")).alias("n_event"), F.sum((1 - is_event).cast("long")).alias("n_censored")
    )


def _at_risk(table: DataFrame, time: str, by: Sequence[str], rows_per_bucket: int) -> OrderedTable:
    ordered = OrderedTable(table, time, by, rows_per_bucket)
    return ordered.running({"at_risk": F.col("n_event") + F.col("n_censored")}, backward=True)


def _survival_factor(reverse: bool) -> Column:
    """1 - d/n; the censoring curve lets events leave before censorings of the same time."""
    if reverse:
        left, gone = F.col("at_risk") - F.col("n_event"), F.col("n_censored")
    else:
        left, gone = F.col("at_risk"), F.col("n_event")
    return F.lit(1.0) - F.coalesce(F.try_divide(gone.cast("double"), left.cast("double")), F.lit(0.0))


def kaplan_meier(
    labels: DataFrame, time: str, event: str, by: Sequence[str] = (), reverse: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Survival curve (or, reversed, the censoring curve) at every distinct time."""
    ordered = _at_risk(event_table(labels, time, event, by), time, by, rows_per_bucket)
    return ordered.running({"survival": _survival_factor(reverse)}, "product").result()


def nelson_aalen(
    labels: DataFrame, time: str, event: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Cumulative hazard at every distinct time."""
    ordered = _at_risk(event_table(labels, time, event, by), time, by, rows_per_bucket)
    return ordered.running({"hazard": F.col("n_event").cast("double") / F.col("at_risk").cast("double")}).result()


def censoring_curve(
    train: DataFrame, evaluated: DataFrame, time: str, event: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The train labels' censoring curve, read at every time of either table.

    Evaluation times enter with zero counts: they carry the curve forward and leave it unchanged.
    """
    fitted = event_table(train, time, event, by)
    asked = evaluated.select(*by, time).distinct().select(
        *by, time, F.lit(0).cast("long").alias("n_event"), F.lit(0).cast("long").alias("n_censored")
    )
    table = (
        fitted.unionByName(asked)
        .groupBy(*by, time)
        .agg(F.sum("n_event").alias("n_event"), F.sum("n_censored").alias("n_censored"))
    )
    ordered = _at_risk(table, time, by, rows_per_bucket)
    return ordered.running({"g": _survival_factor(True)}, "product").result().select(*by, time, "at_risk", "g")


def ipcw_weights(
    train: DataFrame,
    evaluated: DataFrame,
    time: str,
    event: str,
    by: Sequence[str] = (),
    tau: float | None = None,
    out: str = "weight",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1/G(t) for events before ``tau``, 0 for every other row.

    An event where G is 0, or past the last train time while G is still positive, has no weight:
    the query fails with a message rather than returning one. So does a row without a time or an event; rows
    whose group is null are a group of their own.
    """
    missing = F.raise_error(F.lit("missing time or event")).cast("double")
    known = F.col(time).isNotNull() & F.col(event).isNotNull()
    evaluated = evaluated.withColumn(time, F.when(known, F.col(time)).otherwise(missing))
    curve = censoring_curve(train, evaluated, time, event, by, rows_per_bucket)
    counts = F.col(event).cast("boolean")
    if tau is not None:
        counts = counts & (F.col(time) < F.lit(float(tau)))
    beyond = (F.col("at_risk") == 0) & (F.col("g") > 0)
    weight = (
        F.when(~counts, F.lit(0.0))
        .when(beyond, F.raise_error(F.lit("event time beyond the train labels")).cast("double"))
        .when(F.col("g") <= 0, F.raise_error(F.lit("censoring survival is zero at an event time")).cast("double"))
        .otherwise(F.lit(1.0) / F.col("g"))
    )
    curve = curve.select(F.col(time).alias("__time"), *(F.col(c).alias(f"__by_{c}") for c in by), "at_risk", "g")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by), F.col(time) == F.col("__time"))
    joined = evaluated.join(curve, same).withColumn(out, weight)
    return joined.drop("at_risk", "g", "__time", *(f"__by_{c}" for c in by))


# ---- concordance -------------------------------------------------------------------------------


def _count_strip(order: np.ndarray, risk: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted pair totals (concordant + half ties, comparable) over rows i with weight and rows j later in order."""
    along = np.argsort(order, kind="stable")
    order, weight = order[along], weight[along]
    who = np.flatnonzero(weight > 0)
    if who.size == 0:
        return 0.0, 0.0
    rank = np.unique(risk, return_inverse=True)[1][along].astype(np.int32)
    # the later rows of i are the places low..high; a wavelet matrix keeps both ends while it sorts by one bit at a time
    low = np.searchsorted(order, order[who], "right").astype(np.int32)
    high, own, weight = np.full(len(who), len(order), np.int32), rank[who], weight[who]
    comparable, good = (high - low).astype(np.float64), np.zeros(len(who), np.int64)
    for bit in reversed(range(int(rank.max()).bit_length())):
        ones = (rank >> bit) & 1 == 1
        zeros = np.zeros(len(rank) + 1, np.int32)
        np.cumsum(~ones, out=zeros[1:])
        low_zeros, high_zeros, above = zeros[low], zeros[high], (own >> bit) & 1 == 1
        good += np.where(above, high_zeros - low_zeros, 0)
        low = np.where(above, zeros[-1] + low - low_zeros, low_zeros)
        high = np.where(above, zeros[-1] + high - high_zeros, high_zeros)
        rank = np.concatenate([rank[~ones], rank[ones]])
    return float(weight @ (good + 0.5 * (high - low))), float(weight @ comparable)


def _groups(df: DataFrame, keys: list[str]) -> tuple[list[str], str]:
    """Names and schema text of the key columns, in the order of the table."""
    fields = [f for f in df.schema.fields if f.name in keys]
    return [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _spread(df: DataFrame, names: list[str]) -> DataFrame:
    # a stated number of partitions: strips cost time, not bytes, so small ones are not to be packed into one task
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def _time_strips(placed: DataFrame, by: list[str]) -> DataFrame:
    """Pairs inside each time range (num, den), and its rows and weight by risk range (n, w)."""
    names, schema = _groups(placed, [*by, "tb"])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # an event comes before the censorings of its own time, and is no partner of other events there
        order = 2 * np.unique(pdf["t"].to_numpy(), return_inverse=True)[1] + pdf["c"].to_numpy()
        weight = pdf["w"].to_numpy()
        bins, at = np.unique(pdf["rb"].to_numpy(), return_inverse=True)
        out = pd.DataFrame({"rb": bins, "n": np.bincount(at), "w": np.bincount(at, weight), "num": 0.0, "den": 0.0})
        out.loc[0, ["num", "den"]] = _count_strip(order, pdf["risk"].to_numpy(), weight)
        for name, value in zip(names, key, strict=True):
            out[name] = [value] * len(out)
        return out

    return _spread(placed, names).groupBy(*names).applyInPandas(count, schema + ", rb int, n long, w double, num double, den double")


def _risk_strips(placed: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of different time ranges inside each risk range."""
    names, schema = _groups(placed, [*by, "rb"])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        good, _ = _count_strip(pdf["tb"].to_numpy(), pdf["risk"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame([[*key, good, 0.0]], columns=[*names, "num", "den"])

    return _spread(placed, names).groupBy(*names).applyInPandas(count, schema + ", num double, den double")


def _between_ranges(cells: DataFrame, by: list[str], one_risk: Column) -> DataFrame:
    """Pairs of different time ranges: comparable ones, concordant ones of different risk ranges, half of those of one risk."""
    cells = cells.groupBy(*by, "tb", "rb").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    cells = cells.withColumn("block", F.shiftright("tb", _BLOCK_BITS))
    later = cells.groupBy(*by, "block", "rb").agg(F.sum("n").alias("n")).where("block > 0")
    later = later.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
    later = later.groupBy(*by, "block", "rb").agg(F.sum("n").alias("n"))
    later = later.select(*by, F.lit(_LATER).alias("tb"), "rb", "n", F.lit(0.0).alias("w"), "block")
    names, schema = _groups(cells, [*by, "block"])

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tb", ascending=False)
        bins, at = np.unique(pdf["rb"].to_numpy(), return_inverse=True)
        n, w, half = pdf["n"].to_numpy(), pdf["w"].to_numpy(), np.where(pdf["one_risk"], 0.5, 0.0)
        seen, num, den = np.zeros(len(bins), np.int64), 0.0, 0.0
        ends = np.append(np.flatnonzero(np.diff(pdf["tb"].to_numpy())) + 1, len(pdf))
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            upto, own = np.cumsum(seen), at[start:end]
            num += w[start:end] @ (upto[own] - seen[own] + half[start:end] * seen[own])
            den += w[start:end].sum() * upto[-1]
            seen[own] += n[start:end]  # a time range has one row for each risk range
        return pd.DataFrame([[*key, num, den]], columns=[*names, "num", "den"])

    both = cells.unionByName(later).withColumn("one_risk", one_risk)
    return _spread(both, names).groupBy(*names).applyInPandas(count, schema + ", num double, den double")


def concordance(
    df: DataFrame, time: str, event: str, risk: str, weight: str | None = None, by: Sequence[str] = (), rows_per_strip: int = ROWS_PER_STRIP
) -> DataFrame:
    """Weighted concordance per group: ``numerator``, ``denominator`` and their ratio ``cindex``.

    Row i counts if it is an event with positive weight; its partners are the rows later in time, and
    those of equal time that are censored. Equal risk scores count one half. ``cindex`` is NULL if no
    pair is comparable. A row without a time, an event or a risk score is an error.
    """
    by = list(by)
    score = F.col(risk).cast("double")
    missing = lambda what: F.raise_error(F.lit(f"missing {what}"))
    is_event = F.coalesce(F.col(event).cast("int"), missing("event").cast("int"))
    base = df.select(
        *by,
        F.coalesce(F.col(time).cast("double"), missing("time").cast("double")).alias("t"),
        (1 - is_event).alias("c"),
        F.when(score.isNull() | F.isnan(score), missing("risk score").cast("double")).otherwise(score).alias("risk"),
        (is_event * (F.col(weight) if weight else F.lit(1.0))).cast("double").alias("w"),
    )
    # 0.0 is added as -0.0 equals 0.0, but not for a search among edges
    base = stage_table(base.withColumns({"t": F.col("t") + 0.0, "risk": F.col("risk") + 0.0}), "pairs")
    # ranges over all groups together, so that a strip is bounded however the groups' times and risks differ
    wanted = max(RANGES, math.ceil(base.count() / rows_per_strip))
    quantiles = base.select(*(F.percentile_approx(c, even_shares(wanted), F.lit(20 * wanted)) for c in ("t", "risk"))).first()
    (edges, hot), (risk_edges, hot_risks) = (edges_from_quantiles([q for q in found or [] if math.isfinite(q)]) for found in quantiles)
    placed = bucketize(bucketize(base, "t", edges, "slot"), "risk", risk_edges, "rb")
    one_time = F.col("slot").isin(hot) if hot else F.lit(False)
    one_risk = F.col("rb").isin(hot_risks) if hot_risks else F.lit(False)
    placed = placed.withColumn("tb", 2 * F.col("slot") + F.when(one_time, F.col("c")).otherwise(0))
    inside = _time_strips(placed.where(~one_time).select(*by, "tb", "rb", "t", "c", "risk", "w"), by)
    alone = placed.where(one_time).groupBy(*by, "tb", "rb").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    alone = alone.withColumns({"num": F.lit(0.0), "den": F.lit(0.0)})
    cells = stage_table(inside.unionByName(alone), "cells")
    parts = [
        cells.select(*by, "num", "den"),
        _between_ranges(cells, by, one_risk).select(*by, "num", "den"),
        _risk_strips(placed.where(~one_risk).select(*by, "rb", "tb", "risk", "w"), by).select(*by, "num", "den"),
    ]
    totals = reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("num").alias("numerator"), F.sum("den").alias("denominator"))
    return totals.withColumn("cindex", F.try_divide("numerator", "denominator"))


def ipcw_cindex(
    train: DataFrame,
    evaluated: DataFrame,
    time: str,
    event: str,
    risk: str,
    tau: float | None = TAU,
    by: Sequence[str] = (),
    train_by: Sequence[str] | None = None,
    rows_per_strip: int = ROWS_PER_STRIP,
) -> DataFrame:
    """Concordance with squared inverse censoring weights; rows at or past ``tau`` remain partners only.

    ``by`` groups the evaluated rows. The censoring curve is the train table's: one per group when the
    train table carries the ``train_by`` columns (default: those of ``by`` it has), else one for all.
    """
    curve_by = [c for c in by if c in train.columns] if train_by is None else list(train_by)
    weighted = ipcw_weights(train, evaluated, time, event, curve_by, tau)
    squared = weighted.withColumn("__w2", F.col("weight") * F.col("weight"))
    return concordance(squared, time, event, risk, "__w2", by, rows_per_strip)


def harrell_cindex(
    evaluated: DataFrame, time: str, event: str, risk: str, by: Sequence[str] = (), rows_per_strip: int = ROWS_PER_STRIP
) -> DataFrame:
    return concordance(evaluated, time, event, risk, None, by, rows_per_strip)


def require_pairs(result: DataFrame) -> DataFrame:
    """Fail the query where no pair was comparable, instead of returning an empty ratio."""
    none = F.raise_error(F.lit("no comparable pairs")).cast("double")
    return result.withColumn("cindex", F.coalesce("cindex", none))


def comparable_pairs(labels: DataFrame, time: str, event: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Number of comparable partners per distinct event time: later rows plus censorings of that time."""
    ordered = _at_risk(event_table(labels, time, event), time, (), rows_per_bucket)
    return ordered.result().where(F.col("n_event") > 0).select(
        time, "n_event", (F.col("at_risk") - F.col("n_event")).alias("n_partners")
    )


def evaluate_by_split(
    scored: DataFrame, part: str, time: str, event: str, risk: str, tau: float | None = TAU, train_value: str = "train"
) -> DataFrame:
    """One metric row per part, all weighted by the train part's censoring curve."""
    # read several times below: the scores are computed once
    scored = cut_lineage(scored.select(part, time, event, risk))
    train = scored.where(F.col(part) == train_value)
    return ipcw_cindex(train, scored, time, event, risk, tau, by=[part], train_by=[])


def evaluate_by_cluster(
    scored: DataFrame, cluster: str, time: str, event: str, risks: Sequence[str], tau: float | None = TAU, min_rows: int = 10
) -> DataFrame:
    """Metric per (cluster, model) in one job; a cluster's own labels give its censoring curve.

    Clusters under ``min_rows`` rows are left out, as no metric is meaningful there.
    """
    scored = cut_lineage(scored.select(cluster, time, event, *risks))
    sizes = scored.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_rows)
    kept = scored.join(sizes, cluster, "left_semi")
    stacked = kept.select(
        cluster, time, event,
        F.explode(F.array(*[F.struct(F.lit(r).alias("model"), F.col(r).cast("double").alias("risk")) for r in risks])).alias("m"),
    ).select(cluster, time, event, "m.*")
    return ipcw_cindex(kept, stacked, time, event, "risk", tau, by=[cluster, "model"], train_by=[cluster])
