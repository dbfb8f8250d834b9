"""Fitted preparation, the wide feature table, splits, vectors and corruption."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from hazardline.functions import vectors as V
from hazardline.operators import ordering as O
from hazardline.operators import prepare as P
from hazardline.plans import features as W
from proofs.catalog.summaries import rounded
from proofs.catalog.tables import r6
from proofs.registry import proof
from proofs.views import DIM, PAIRS, SETS

MARKERS = ("+8", "del(5q)", "t(8;21)", "-7")
FLAGSHIP = W.FeatureSpec(
    key="id", numeric=("x1", "x2", "x3"), category="center", text="karyo", markers=MARKERS, item="gene", value="vaf",
    label="chr", top_n=10, stats=("count", "mean", "max"), sets=SETS, set_stats=("flag", "count"), pairs=tuple(PAIRS),
    density=("7", 1000), fill="zero",
)


@proof("impute_mean", "SELECT id, round(coalesce(x1, (SELECT avg(x1) FROM subjects)), 6) AS x1, x2 FROM subjects")
def impute_mean(t):
    df = t.subjects.select("id", "x1", "x2")
    return P.MeanImputer.fit(df, ["x1", "x2"]).transform(df).select("id", r6("x1").alias("x1"), "x2")


@proof(
    "one_hot",
    "SELECT id, " + ", ".join(f"CAST(center = 'NATION_{i}' AS INT) AS \"center_NATION_{i}\"" for i in range(25)) + " FROM subjects",
)
def one_hot(t):
    df = t.subjects.select("id", "center")
    return P.OneHot.fit(df, "center").transform(df).drop("center")


@proof(
    "one_hot_wide",
    """, keys AS (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY ALL)
       SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS slot, n::DOUBLE AS n FROM keys""",
)
def one_hot_wide(t):
    """Every customer a category: the sparse vectors of all orders, summed."""
    df = t.read("orders").select(F.col("o_custkey").cast("string").alias("customer"))
    hot = P.WideOneHot.fit(df, "customer")
    total = hot.transform(df, "v").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))
    return hot.table.join(total.select(F.posexplode("s").alias("slot", "n")), "slot").select("value", "slot", "n")


@proof(
    "standardize",
    """SELECT id, round((x2 - (SELECT avg(x2) FROM subjects)) / (SELECT stddev_pop(x2) FROM subjects), 6) + 0.0::DOUBLE AS x2,
              round((x3 - (SELECT avg(x3) FROM subjects)) / (SELECT stddev_pop(x3) FROM subjects), 6) + 0.0::DOUBLE AS x3,
              0.0::DOUBLE AS flat FROM subjects""",
)
def standardize(t):
    df = t.subjects.select("id", "x2", "x3", F.lit(5.0).alias("flat"))
    return rounded(P.Standardizer.fit(df, ["x2", "x3", "flat"]).transform(df), "id")


@proof(
    "assemble_features",
    """SELECT id, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN coalesce(x1, 0) WHEN 1 THEN x2 ELSE x3 END AS value
       FROM subjects, range(3) r(p)""",
)
def assemble_features(t):
    df = P.assemble_features(t.subjects.fillna(0.0, ["x1"]), ["x1", "x2", "x3"])
    return df.select("id", F.posexplode("features").alias("pos", "value"))


def _flagship_sql(labelled: bool) -> str:
    top = "(SELECT row_number() OVER (ORDER BY n DESC, gene) AS k, gene FROM (SELECT gene, count(*) AS n FROM obs GROUP BY gene))"
    sets = ", ".join(
        f"max(CASE WHEN gene IN ({', '.join(repr(g) for g in m)}) THEN 1 ELSE 0 END) AS s_{n}, "
        f"count(*) FILTER (gene IN ({', '.join(repr(g) for g in m)})) AS c_{n}" for n, m in SETS.items()
    )
    pairs = ", ".join(
        f"max(CASE WHEN gene = '{a}' THEN 1 ELSE 0 END) * max(CASE WHEN gene = '{b}' THEN 1 ELSE 0 END) AS p{i}" for i, (a, b) in enumerate(PAIRS)
    )
    ranks = ", ".join(f"max(CASE WHEN k = {i} THEN 1 ELSE 0 END) AS k{i}" for i in range(1, 11))
    outs = ["round(coalesce(s.x1, (SELECT avg(x1) FROM base)), 6) AS x1", "s.x2", "s.x3"]
    outs += [f"CAST(center = 'NATION_{i}' AS INT)::DOUBLE AS \"center_NATION_{i}\"" for i in range(25)]
    for m, name in (("+8", "plus8"), ("del(5q)", "del5q"), ("t(8;21)", "t8_21"), ("-7", "minus7")):
        outs.append(f"CAST(contains(coalesce(karyo, ''), '{m}') AS INT)::DOUBLE AS cyto_{name}")
    outs.append("CAST(len(regexp_extract_all(coalesce(karyo, ''), 'del|inv|t\\(|\\+|-')) >= 3 AS INT)::DOUBLE AS cyto_complex_karyotype")
    outs += ["coalesce(n, 0)::DOUBLE AS obs_count", "round(coalesce(m, 0), 6) AS val_mean", "coalesce(x, 0)::DOUBLE AS val_max"]
    outs += [f"coalesce(k{i}, 0)::DOUBLE AS top_{i}" for i in range(1, 11)]
    for name in SETS:
        outs += [f"coalesce(s_{name}, 0)::DOUBLE AS set_{name}_flag", f"coalesce(c_{name}, 0)::DOUBLE AS set_{name}_count"]
    outs += [f"coalesce(p{i}, 0)::DOUBLE AS pair_{i}" for i in range(len(PAIRS))]
    outs.append("coalesce(d, 0)::DOUBLE AS density")
    join = "JOIN labelled l ON s.id = l.id" if labelled else ""
    base = "SELECT s.* FROM subjects s " + join
    extra = ", l.time, l.event" if labelled else ""
    return f""", base AS ({base}), ranked AS (SELECT o.*, k FROM obs o JOIN {top} t ON o.gene = t.gene),
      per AS (SELECT id, count(*) AS n, avg(vaf) AS m, max(vaf) AS x, count(*) FILTER (chr = '7') / 1000.0::DOUBLE AS d,
                {sets}, {pairs}, {ranks} FROM ranked GROUP BY id)
      SELECT s.id{extra}, {', '.join(outs)} FROM base s LEFT JOIN per ON s.id = per.id {join}"""


def flagship(t, labelled: bool):
    """Wide rows with the top-item flags named by rank, so that the names do not depend on the data."""
    subjects, keep = t.subjects, ()
    if labelled:
        subjects, keep = subjects.join(t.labelled.select("id", "time", "event"), "id"), ("time", "event")
    model = W.fit_features(FLAGSHIP, subjects, t.obs)
    wide = model.transform(subjects, t.obs, keep)
    ranked = {"has_" + W.A.safe_name(v): f"top_{i + 1}" for i, v in enumerate(model.top)}
    pairs = {f"both_{W.A.safe_name(a)}_{W.A.safe_name(b)}": f"pair_{i}" for i, (a, b) in enumerate(PAIRS)}
    named = wide.withColumnsRenamed(ranked | pairs)
    return named.withColumns({"x1": r6("x1"), "val_mean": r6("val_mean")})


@proof("build_feature_table", _flagship_sql(labelled=True))
def build_feature_table(t):
    return flagship(t, labelled=True)


# ---- splits --------------------------------------------------------------------------------------


@proof(
    "stratified_split",
    """SELECT id, event, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY md5('42|' || id)) <= ceil(round(0.2 * count(*) OVER (PARTITION BY event), 9))
              THEN 'valid' ELSE 'train' END AS part FROM labelled""",
)
def stratified_split(t):
    return O.stratified_split(t.labelled.select("id", "event"), "id", "event")


@proof("kfold_assign", "SELECT id, CAST(ntile(3) OVER (ORDER BY md5('42|' || id)) AS INT) AS fold FROM subjects")
def kfold_assign(t):
    return O.kfold_assign(t.subjects.select("id"), "id", 3)


# ---- vectors -------------------------------------------------------------------------------------


@proof(
    "l2_normalize",
    """SELECT vec_id, CAST(p AS INT) AS pos, round(v[p + 1] / sqrt(list_dot_product(v, v)), 6) + 0.0::DOUBLE AS value
       FROM vectors, range(64) r(p)""",
)
def l2_normalize(t):
    unit = t.vectors.select("vec_id", F.posexplode(V.l2_normalize(F.col("v"))).alias("pos", "value"))
    return rounded(unit, "vec_id", "pos")


@proof(
    "cosine_similarity",
    """, mean AS (SELECT list(m ORDER BY p) AS c FROM (SELECT p, avg(v[p + 1]) AS m FROM vectors, range(64) r(p) GROUP BY p))
       SELECT vec_id, round(list_cosine_similarity(v, c) / 0.5, 6) + 0.0::DOUBLE AS sim FROM vectors, mean""",
)
def cosine_similarity(t):
    """Cosine of every row with the table's mean row, over temperature 0.5."""
    centre = t.vectors.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(DIM)]).alias("c")).first()["c"]
    against = F.array(*[F.lit(x) for x in centre])
    return rounded(t.vectors.select("vec_id", V.cosine_similarity(F.col("v"), against, 0.5).alias("sim")), "vec_id")


SQL_HIT = "substr(md5('42|{salt}|' || vec_id || '|' || (p // 8)), CAST(p % 8 AS INT) * 4 + 1, 4) < '{limit}'"
SQL_U = "(('0x' || substr(md5('42|{salt}|' || vec_id || '|' || p), {start}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def sql_gauss(salt):
    return f"sqrt(-2.0 * ln({SQL_U.format(salt=salt, start=1)})) * cos(2.0 * pi() * {SQL_U.format(salt=salt, start=9)})"


def exploded(df, *columns):
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return df.select("vec_id", F.posexplode(zipped).alias("pos", "z")).select("vec_id", "pos", *[r6(F.col("z")[c]).alias(c) for c in columns])


@proof(
    "mask_features_zero",
    f"""SELECT vec_id, CAST(p AS INT) AS pos, round(CASE WHEN {SQL_HIT.format(salt='m', limit=format(int(0.1 * 65536), '04x'))} THEN 0 ELSE v[p + 1] END, 6) + 0.0::DOUBLE AS masked
        FROM vectors, range(64) r(p)""",
)
def mask_features_zero(t):
    return exploded(t.vectors.select("vec_id", V.mask_features_zero(F.col("v"), F.col("vec_id"), DIM, 0.1).alias("masked")), "masked")


@proof(
    "mask_features_noise",
    f""", mean AS (SELECT p, avg(v[p + 1]) AS m FROM vectors, range(64) r(p) GROUP BY p)
        SELECT vec_id, CAST(p AS INT) AS pos, round(CASE WHEN {SQL_HIT.format(salt='n', limit=format(int(0.33 * 65536), '04x'))}
          THEN m + 0.1 * {sql_gauss('n')} ELSE v[p + 1] END, 6) + 0.0::DOUBLE AS masked FROM vectors JOIN mean ON true""",
)
def mask_features_noise(t):
    means = t.vectors.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(DIM)]).alias("c")).first()["c"]
    row = F.array(*[F.lit(x) for x in means])
    noisy = V.mask_features_noise(F.col("v"), row, F.col("vec_id"), DIM, 0.33)
    return exploded(t.vectors.select("vec_id", noisy.alias("masked")), "masked")


@proof(
    "perturb_selected",
    f"""SELECT vec_id, CAST(p AS INT) AS pos, round(CASE WHEN p IN (1, 5, 63) THEN v[p + 1] + 0.1 * {sql_gauss('p')} ELSE v[p + 1] END, 6) + 0.0::DOUBLE AS perturbed,
               CASE WHEN p IN (1, 5, 63) THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM vectors, range(64) r(p)""",
)
def perturb_selected(t):
    return exploded(t.vectors.select("vec_id", *V.perturb_selected(F.col("v"), [1, 5, 63], F.col("vec_id"))), "perturbed", "mask")


@proof(
    "two_views",
    "SELECT vec_id, CAST(p AS INT) AS pos, " + ", ".join(
        f"round(CASE WHEN {SQL_HIT.format(salt=s, limit=format(int(0.2 * 65536), '04x'))} THEN 0 ELSE v[p + 1] END, 6) + 0.0::DOUBLE AS view_{s}"
        for s in ("a", "b")
    ) + " FROM vectors, range(64) r(p)",
)
def two_views(t):
    return exploded(t.vectors.select("vec_id", *V.two_views(F.col("v"), F.col("vec_id"), DIM, 0.2)), "view_a", "view_b")
