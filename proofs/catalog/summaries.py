"""Per-subject aggregates and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardline.functions import text as X
from hazardline.operators import aggregates as A
from hazardline.sources.fixed import CHR7_LENGTH
from proofs.catalog.tables import r6
from proofs.registry import proof
from proofs.views import PAIRS, SETS

#: The items that SQL names; Spark takes the most frequent ones it finds, and there are no more than these.
GENES = [f"Brand#{i}" for i in range(1, 26)]
TOP_N, TOP_OF_SETS = 30, 10


def fitted_items(t, n=TOP_N):
    return A.top_n_list(t.obs, "gene", n)


def quoted(items):
    return ", ".join(f"'{i}'" for i in items)


def rounded(df, *skip):
    return df.select(*[F.col(c) if c in skip else r6(c).alias(c) for c in df.columns])


@proof("agg_count", "SELECT id, count(*) AS n FROM obs GROUP BY id")
def agg_count(t):
    return A.summarize(t.obs, "id", [F.count(F.lit(1)).alias("n")])


@proof("agg_mean", "SELECT id, round(avg(vaf), 6) AS val_mean FROM obs GROUP BY id")
def agg_mean(t):
    return rounded(A.summarize(t.obs, "id", A.basic_stats("vaf", ["mean"])), "id")


@proof("agg_max", "SELECT id, max(vaf) AS val_max FROM obs GROUP BY id")
def agg_max(t):
    return A.summarize(t.obs, "id", A.basic_stats("vaf", ["max"]))


@proof("agg_std", "SELECT id, round(stddev_samp(vaf), 6) AS val_std FROM obs GROUP BY id")
def agg_std(t):
    return rounded(A.summarize(t.obs, "id", A.basic_stats("vaf", ["std"])), "id")


@proof(
    "agg_entropy",
    """, totals AS (SELECT id, sum(vaf) AS s FROM obs GROUP BY id)
       SELECT o.id, round(-coalesce(sum(CASE WHEN s <> 0 THEN vaf / s * ln(vaf / s + 1e-8) END), 0), 6) + 0.0::DOUBLE AS entropy
       FROM obs o JOIN totals t ON o.id = t.id GROUP BY o.id""",
)
def agg_entropy(t):
    return rounded(A.agg_entropy(t.obs, "id", "vaf"), "id")


@proof("agg_distinct", "SELECT id, count(DISTINCT gene) AS n_distinct FROM obs GROUP BY id")
def agg_distinct(t):
    return A.summarize(t.obs, "id", [A.agg_distinct("gene")])


@proof(
    "agg_density",
    """SELECT s.id, round(coalesce(d, 0) * 1e8, 6) AS density_e8 FROM subjects s LEFT JOIN (SELECT id,
       count(*) FILTER (chr = '7') / 159345973.0::DOUBLE AS d FROM obs GROUP BY id) o ON s.id = o.id""",
)
def agg_density(t):
    density = A.summarize(t.obs, "id", [A.density_column("chr", "7", CHR7_LENGTH)])
    filled = A.align_with_fill(t.subjects.select("id"), density, "id")
    return filled.select("id", F.round(F.col("density") * 1e8, 6).alias("density_e8"))


@proof("value_frequencies", "SELECT gene, count(*) AS n FROM obs GROUP BY gene")
def value_frequencies(t):
    return A.value_frequencies(t.obs, "gene")


@proof(
    "pivot_flag",
    "SELECT id, " + ", ".join(f"CAST(max(CASE WHEN gene = '{g}' THEN 1 ELSE 0 END) AS INT) AS {A.safe_name('has_' + g)}" for g in GENES)
    + f" FROM obs WHERE gene IN ({quoted(GENES)}) GROUP BY id",
)
def pivot_flag(t):
    items = fitted_items(t)
    return A.summarize(t.obs.where(F.col("gene").isin(items)), "id", A.flag_columns("gene", items))


@proof(
    "pivot_mean",
    "SELECT id, " + ", ".join(f"round(avg(vaf) FILTER (gene = '{g}'), 6) AS {A.safe_name('mean_' + g)}" for g in GENES)
    + " FROM obs GROUP BY id",
)
def pivot_mean(t):
    return rounded(A.summarize(t.obs, "id", A.mean_columns("gene", "vaf", fitted_items(t))), "id")


def set_sql(stat):
    forms = {
        "flag": "CAST(count(*) FILTER (gene IN ({m})) > 0 AS INT)",
        "count": "count(*) FILTER (gene IN ({m}))",
        "mean": "round(coalesce(avg(vaf) FILTER (gene IN ({m})), 0), 6)",
        "fraction_distinct": "round(count(DISTINCT gene) FILTER (gene IN ({m})) / {k}.0::DOUBLE, 6)",
        "fraction_count": "round(coalesce(count(*) FILTER (gene IN ({m})) / nullif((SELECT count(*) FROM top WHERE gene IN ({m})), 0)::DOUBLE, 0), 6)",
        "interaction": "round(count(*) FILTER (gene IN ({m})) * coalesce(avg(vaf) FILTER (gene IN ({m})), 0), 6)",
    }
    made = [
        forms[stat].format(m=quoted(members), k=len(members)) + f" AS set_{name}_{stat}"
        for name, members in SETS.items()
    ]
    top = f", top AS (SELECT gene FROM obs WHERE gene IS NOT NULL GROUP BY gene ORDER BY count(*) DESC, gene LIMIT {TOP_OF_SETS}) "
    return (top if stat == "fraction_count" else "") + "SELECT id, " + ", ".join(made) + " FROM obs GROUP BY id"


def set_query(stat):
    def run(t):
        top = fitted_items(t, TOP_OF_SETS) if stat == "fraction_count" else None
        df = A.summarize(t.obs, "id", A.set_columns("gene", "vaf", SETS, [stat], top=top))
        return df if stat in ("flag", "count") else rounded(df, "id")

    return run


for _key, _stat in {
    "set_flag": "flag",
    "set_count": "count",
    "set_mean": "mean",
    "set_fraction_distinct": "fraction_distinct",
    "set_fraction_count": "fraction_count",
    "set_interaction": "interaction",
}.items():
    proof(_key, set_sql(_stat))(set_query(_stat))


@proof(
    "co_occurrence",
    "SELECT id, " + ", ".join(
        f"CAST(max(CASE WHEN gene = '{a}' THEN 1 ELSE 0 END) * max(CASE WHEN gene = '{b}' THEN 1 ELSE 0 END) AS INT)"
        f" AS {A.safe_name(f'both_{a}_{b}')}" for a, b in PAIRS
    ) + " FROM obs GROUP BY id",
)
def co_occurrence(t):
    return A.summarize(t.obs, "id", A.pair_columns("gene", PAIRS))


@proof(
    "co_occurrence_all_pairs",
    """, seen AS (SELECT DISTINCT id, gene FROM obs WHERE gene IS NOT NULL)
       SELECT x.gene AS a, y.gene AS b, count(*) AS n FROM seen x JOIN seen y ON x.id = y.id AND x.gene < y.gene GROUP BY ALL""",
)
def co_occurrence_all_pairs(t):
    return A.pair_counts(t.obs, "id", "gene")


@proof(
    "column_moments",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(var_pop({c}) / 1e6, 4) AS var_pop FROM subjects" for c in ("x1", "x2", "x3")),
)
def column_moments(t):
    df = A.column_moments(t.subjects, ["x1", "x2", "x3"])
    return df.select("feature", F.round("mean", 6).alias("mean"), F.round(F.col("var_pop") / 1e6, 4).alias("var_pop"))


@proof(
    "ensemble_mean",
    """SELECT id, round((x1 + x2 + x3) / 3, 6) AS risk_score FROM (SELECT id, coalesce(x1, 0) AS x1, x2, x3 FROM subjects)""",
)
def ensemble_mean(t):
    scores = t.subjects.select(
        "id", F.explode(F.array(F.coalesce("x1", F.lit(0.0)), "x2", "x3")).alias("s")
    )
    return rounded(A.ensemble_mean(scores, "id", "s"), "id")


# ---- text ----------------------------------------------------------------------------------------

SQL_CLEAN = (
    "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_+();-]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
SQL_COUNT = "CAST(len(regexp_extract_all({0}, 'del|inv|t\\(|\\+|-')) AS INT)"


@proof("clean_text", f"SELECT doc_id, {SQL_CLEAN} AS cleaned FROM documents")
def clean_text(t):
    return t.read("documents").select("doc_id", X.clean_text("text").alias("cleaned"))


@proof(
    "text_contains_flags",
    "SELECT doc_id, " + ", ".join(f"CAST(contains(cleaned, '{m}') AS INT) AS {X.marker_name(m)}" for m in X.MARKERS + X.EXTRA_MARKERS)
    + f" FROM (SELECT doc_id, {SQL_CLEAN} AS cleaned FROM documents UNION ALL SELECT -1 - CAST(id AS BIGINT), coalesce(lower(replace(karyo, ',', ' ')), '') FROM subjects)",
)
def text_contains_flags(t):
    texts = t.read("documents").select("doc_id", "text").union(
        t.subjects.select(-1 - F.col("id").cast("long"), "karyo")
    )
    cleaned = texts.select("doc_id", X.clean_text("text").alias("c"))
    return cleaned.select("doc_id", *X.text_contains_flags(F.col("c"), X.MARKERS + X.EXTRA_MARKERS))


@proof("regex_count", f"SELECT doc_id, {SQL_COUNT.format(SQL_CLEAN)} AS n FROM documents")
def regex_count(t):
    return t.read("documents").select("doc_id", X.regex_count(X.clean_text("text"), X.ANOMALY).alias("n"))


@proof("complex_flag", f"SELECT doc_id, CAST({SQL_COUNT.format(SQL_CLEAN)} >= 3 AS INT) AS is_complex FROM documents")
def complex_flag(t):
    return t.read("documents").select("doc_id", X.complex_flag(X.clean_text("text")).alias("is_complex"))


@proof(
    "count_translocations",
    "SELECT id, CAST(len(regexp_extract_all(lower(coalesce(karyo, '')), 't\\([0-9;]+\\)')) AS INT) AS n FROM subjects",
)
def count_translocations(t):
    return t.subjects.select("id", X.count_translocations("karyo").alias("n"))


@proof("count_anomalies", f"SELECT doc_id, {SQL_COUNT.format('lower(text)')} AS n FROM documents")
def count_anomalies(t):
    return t.read("documents").select("doc_id", X.count_anomalies("text").alias("n"))
