"""The wide feature row: one builder, fitted on the train table and applied to any other.

The plan per table is one scan of the observations with one ``groupBy`` on the subject key, one left
join to the subjects, and projections. Top items, categories and means are fitted once and are small.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardline.functions import scalars as X
from hazardline.functions import text as T
from hazardline.operators import aggregates as A
from hazardline.operators.prepare import MeanImputer, OneHot, assemble_features
from hazardline.sources.fixed import CHR7_LENGTH, CO_OCCURRENCE_PAIRS, DOUBLE_COLUMNS, GENE_SETS


@dataclass(frozen=True)
class FeatureSpec:
    """Which feature blocks to build, and from which columns."""

    key: str = "ID"
    numeric: tuple[str, ...] = tuple(DOUBLE_COLUMNS)
    category: str | None = "CENTER"
    text: str | None = None
    markers: tuple[str, ...] = tuple(T.MARKERS)
    translocations: bool = False
    anomalies: bool = False
    age: str | None = None
    haemoglobin: str | None = None
    item: str = "GENE"
    value: str = "VAF"
    label: str = "CHR"
    top_n: int = 10
    stats: tuple[str, ...] = ("count", "mean")
    item_flags: bool = True
    item_means: bool = False
    sets: Mapping[str, list[str]] = field(default_factory=dict)
    set_stats: tuple[str, ...] = ("flag",)
    pairs: tuple[tuple[str, str], ...] = ()
    density: tuple[str, int] | None = None
    entropy: bool = False
    fill: str = "mean"  # missing observation features: column mean, or zero
    impute: str = "mean"  # missing numeric columns: column mean, or zero


_SETS = {"sets": GENE_SETS}
_TEXT = {"text": "CYTOGENETICS"}
_RICH = ("count", "mean", "fraction_distinct", "interaction")
PRESETS: dict[str, FeatureSpec] = {
    "base10": FeatureSpec(),
    "text10": FeatureSpec(**_TEXT),
    "text10_sets": FeatureSpec(**_TEXT, **_SETS),
    "text15_sets": FeatureSpec(top_n=15, **_TEXT, **_SETS),
    "pairs25": FeatureSpec(top_n=25, **_TEXT, **_SETS, set_stats=_RICH, pairs=tuple(CO_OCCURRENCE_PAIRS)),
    "values25": FeatureSpec(top_n=25, **_TEXT, **_SETS, set_stats=A.SET_STATS, stats=("count", "mean", "max"), item_means=True),
    "density15": FeatureSpec(top_n=15, **_TEXT, **_SETS, translocations=True, density=("7", CHR7_LENGTH)),
    "entropy15": FeatureSpec(
        top_n=15, **_TEXT, **_SETS, translocations=True, anomalies=True, density=("7", CHR7_LENGTH),
        stats=("count", "mean", "std"), entropy=True,
    ),
    "rich30": FeatureSpec(
        top_n=30, **_TEXT, **_SETS, markers=tuple(T.MARKERS + T.EXTRA_MARKERS), set_stats=_RICH, item_means=True,
        pairs=(CO_OCCURRENCE_PAIRS[0],),
    ),
    "wide30": FeatureSpec(top_n=30, **_TEXT, **_SETS),
    "zero15": FeatureSpec(top_n=15, **_TEXT, **_SETS, category=None, fill="zero", impute="zero"),
    "subject_only": FeatureSpec(top_n=0, stats=(), item_flags=False),
}
PRESETS["rich30_age"] = replace(PRESETS["rich30"], age="AGE", haemoglobin="HB")


@dataclass(frozen=True)
class FeatureModel:
    """Fitted builder. ``blocks`` names the features in the order of every table it transforms."""

    spec: FeatureSpec
    top: list[str]
    one_hot: OneHot | None
    imputer: MeanImputer
    blocks: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [n for part in self.blocks.values() for n in part]

    def transform(self, subjects: DataFrame, obs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Key, ``keep`` columns, then every feature as a complete ``double``."""
        wide = self.imputer.transform(_joined(self.spec, self.top, self.one_hot, self.blocks, subjects, obs))
        return wide.select(self.spec.key, *keep, *[F.col(n).cast("double").alias(n) for n in self.names])

    def assembled(self, subjects: DataFrame, obs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Key, ``keep`` columns and one ``features`` array."""
        wide = assemble_features(self.transform(subjects, obs, keep), self.names)
        return wide.select(self.spec.key, *keep, "features")


def fit_features(spec: FeatureSpec, subjects: DataFrame, obs: DataFrame, fit_on: DataFrame | None = None) -> FeatureModel:
    """Fit top items, categories and means on ``subjects`` (or on ``fit_on``, for self-fitted means)."""
    top = A.top_n_list(obs, spec.item, spec.top_n) if spec.top_n else []
    one_hot = OneHot.fit(subjects, spec.category) if spec.category else None
    blocks = _blocks(spec, top, one_hot, subjects, obs)
    names = [n for part in blocks.values() for n in part]
    if len(set(names)) < len(names):
        raise ValueError(f"feature names collide: {sorted({n for n in names if names.count(n) > 1})}")
    source = fit_on if fit_on is not None else subjects
    numeric = blocks["numeric"] if spec.impute == "mean" else []
    observed = blocks["observed"] if spec.fill == "mean" else []
    # without observed columns to fill, the subject table alone has all the means
    wide = _joined(spec, top, one_hot, blocks, source, obs) if observed else source
    return FeatureModel(spec, top, one_hot, MeanImputer.fit(wide, numeric + observed), blocks)


def build_feature_table(spec: FeatureSpec, subjects: DataFrame, obs: DataFrame) -> DataFrame:
    """Fit on the table itself and return its wide rows."""
    return fit_features(spec, subjects, obs).transform(subjects, obs)


def _text_columns(spec: FeatureSpec) -> list[Column]:
    if not spec.text:
        return []
    cleaned = T.clean_text(spec.text)
    made = T.text_contains_flags(cleaned, spec.markers) + [T.complex_flag(cleaned).alias("cyto_complex_karyotype")]
    made += [T.count_translocations(spec.text).alias("n_translocations")] if spec.translocations else []
    made += [T.count_anomalies(spec.text).alias("n_anomalies")] if spec.anomalies else []
    return made


def _observed_columns(spec: FeatureSpec, top: list[str]) -> list[Column]:
    """Blocks that are missing for a subject without observations (or without any top item)."""
    made = A.basic_stats(spec.value, spec.stats)
    if spec.item_flags and top:
        any_top = F.count_if(F.col(spec.item).isin(top)) > 0
        flags = A.flag_columns(spec.item, top)
        if spec.fill == "mean":
            flags = [F.when(any_top, f).alias("has_" + A.safe_name(v)) for f, v in zip(flags, top)]
        made += flags
    made += A.mean_columns(spec.item, spec.value, top) if spec.item_means else []
    return made


def _zero_columns(spec: FeatureSpec, top: list[str]) -> list[Column]:
    """Blocks whose absence means zero."""
    made = A.set_columns(spec.item, spec.value, spec.sets, spec.set_stats, top) if spec.sets else []
    made += A.pair_columns(spec.item, spec.pairs)
    made += [A.density_column(spec.label, *spec.density)] if spec.density else []
    return made


def _blocks(spec: FeatureSpec, top: list[str], one_hot: OneHot | None, subjects: DataFrame, obs: DataFrame) -> dict[str, list[str]]:
    """Ordered column names per block, as the analyser reports them (no job runs)."""
    extra = (["age_bin"] if spec.age else []) + (["hb_low"] if spec.haemoglobin else [])
    observed = obs.agg(F.lit(0), *_observed_columns(spec, top)).columns[1:]
    return {
        "numeric": list(spec.numeric),
        "category": one_hot.names() if one_hot else [],
        "text": subjects.select(*_text_columns(spec)).columns,
        "extra": extra,
        "observed": observed + (["val_entropy"] if spec.entropy else []),
        "zero": obs.agg(F.lit(0), *_zero_columns(spec, top)).columns[1:],
    }


def _joined(
    spec: FeatureSpec, top: list[str], one_hot: OneHot | None, blocks: dict[str, list[str]], subjects: DataFrame, obs: DataFrame
) -> DataFrame:
    made = _text_columns(spec) + (one_hot.columns() if one_hot else [])
    if spec.age:
        # a table without ages gets the second bin throughout; an age outside every bin stays missing until here
        bins = X.bin_numeric(X.column_or_default(subjects, spec.age, 60.0))
        made.append(F.coalesce(bins, F.lit(1)).alias("age_bin"))
    if spec.haemoglobin:
        low = X.column_or_default(subjects, spec.haemoglobin, 0.0) < X.LOW_HB
        made.append(X.threshold_flag(low).alias("hb_low"))
    wide = subjects.select("*", *made)
    zero = _zero_columns(spec, top)
    observed = _observed_columns(spec, top)
    if observed or zero:
        wide = wide.join(A.summarize(obs, spec.key, observed + zero), spec.key, "left")
    if spec.entropy:
        wide = wide.join(A.agg_entropy(obs, spec.key, spec.value, "val_entropy"), spec.key, "left")
    to_zero = blocks["zero"] + (blocks["observed"] if spec.fill == "zero" else [])
    to_zero += list(spec.numeric) if spec.impute == "zero" else []
    return wide.fillna(0, subset=to_zero) if to_zero else wide
