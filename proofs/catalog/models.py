"""Fitted models and the neighbour graph over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from hazardline.operators import cox, graph, models
from hazardline.operators import forest as R
from hazardline.operators.ensemble import fit_per_cluster as fit_clusters
from hazardline.operators.ensemble import mean_of_all
from hazardline.operators.importance import permutation_importance as importance
from hazardline.operators import search
from hazardline.operators.ordering import stratified_split
from hazardline.operators.prepare import Standardizer, assemble_features
from hazardline.operators.tree_table import fit_trees
from hazardline.plans import features as W
from hazardline.session import cut_lineage, shared_dir
from hazardline.sources import tables as T
from proofs.catalog.preparation import FLAGSHIP
from proofs.catalog.summaries import rounded
from proofs.registry import proof
from proofs.views import TAU

SMALL = R.ForestParams(20, 10, 15, max_depth=6)


def cohort_rows(t, scaled: bool = False, spec=FLAGSHIP):
    """Labelled subjects as (id, time, event, features), written once for the fits, and the fitted builder."""
    subjects = t.subjects.join(t.labelled.select("id", "time", "event"), "id")
    model = W.fit_features(spec, subjects, t.obs)
    wide = model.transform(subjects, t.obs, ("time", "event"))
    if scaled:
        wide = cut_lineage(wide)
        wide = Standardizer.fit(wide, model.names).transform(wide)
    rows = assemble_features(wide, model.names).select("id", "time", "event", "features")
    return cut_lineage(rows), model


def train_rows(t, scaled: bool = False, spec=FLAGSHIP):
    rows, model = cohort_rows(t, scaled, spec)
    return rows, model.names


def unlabelled_rows(t, model):
    """Rows of the subjects without a label, built by the model fitted on the labelled ones."""
    rest = t.subjects.join(t.labels.where("event IS NULL").select("id"), "id", "left_semi")
    return model.assembled(rest, t.obs)


def fitted(t, params):
    rows, model = cohort_rows(t)
    return model, fit_trees(rows, [R.ModelSpec(params)], "features", "time", "event", "id", names=model.names)


@proof("survival_forest_fit")
def survival_forest_fit(t):
    return fitted(t, R.FOREST_BASE)[1].nodes


@proof("extra_survival_trees_fit")
def extra_survival_trees_fit(t):
    return fitted(t, R.EXTRA_TREES)[1].nodes


@proof("survival_forest_score")
def survival_forest_score(t):
    model, trees = fitted(t, R.FOREST_TUNED)
    return trees.score(unlabelled_rows(t, model), "features").select("id", "risk_score")


SQL_ROOT = """, seen AS (SELECT time, event, x2, coalesce(n, 0)::DOUBLE AS items FROM labelled JOIN subjects USING (id)
       LEFT JOIN (SELECT id, count(*) AS n FROM obs GROUP BY id) o USING (id)),
   cells AS (SELECT f, v, time, count(*) AS n, sum(event) AS d
       FROM (SELECT 0 AS f, x2 AS v, time, event FROM seen UNION ALL SELECT 1, items, time, event FROM seen) GROUP BY f, v, time),
   times AS (SELECT time, count(*) AS n, sum(event) AS d, sum(count(*)) OVER (ORDER BY time DESC) AS y FROM seen GROUP BY time),
   cuts AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS above FROM (SELECT DISTINCT f, v FROM cells)),
   below AS (SELECT c.f, c.v, c.above, e.time, sum(e.n) AS n, sum(e.d) AS d FROM cuts c JOIN cells e ON e.f = c.f AND e.v <= c.v
       WHERE above IS NOT NULL GROUP BY c.f, c.v, c.above, e.time),
   filled AS (SELECT c.f, c.v, c.above, t.time, t.d, t.y, coalesce(b.d, 0) AS dl,
         sum(coalesce(b.n, 0)) OVER (PARTITION BY c.f, c.v ORDER BY t.time DESC) AS yl, coalesce(b.n, 0) AS nl
       FROM (SELECT * FROM cuts WHERE above IS NOT NULL) c CROSS JOIN times t LEFT JOIN below b ON b.f = c.f AND b.v = c.v AND b.time = t.time),
   stats AS (SELECT f, v, above, sum(nl) AS n, sum(dl - d * yl / y) AS gap,
         sum(CASE WHEN y > 1 THEN yl / y * (1 - yl / y) * d * (y - d) / (y - 1) ELSE 0 END) AS var FROM filled GROUP BY f, v, above)
   SELECT CAST(f AS INT) AS feature, round((v + above) / 2, 9) AS cut, n::DOUBLE AS n_left, CAST((SELECT count(*) FROM seen) AS DOUBLE) AS n
   FROM stats WHERE n >= 15 AND (SELECT count(*) FROM seen) - n >= 15 AND var > 1e-12 ORDER BY gap * gap / var DESC LIMIT 1"""


@proof("survival_forest_root", SQL_ROOT)
def survival_forest_root(t):
    """The first split of a tree over all rows and both features, exact in cuts and event times."""
    items = t.obs.groupBy("id").agg(F.count("*").cast("double").alias("items"))
    rows = t.labelled.join(t.subjects.select("id", "x2"), "id").join(items, "id", "left").fillna(0.0, ["items"])
    rows = rows.select("id", "time", "event", F.array("x2", "items").alias("features"))
    one = R.ForestParams(1, 10, 15, max_features=None, max_depth=1, bootstrap=False)
    nodes = fit_trees(rows, [R.ModelSpec(one)], "features", "time", "event", "id").nodes
    root, left = nodes.where("depth = 0 and feature >= 0").alias("r"), nodes.alias("l")
    return root.join(left, F.col("r.left") == F.col("l.node")).select("r.feature", F.round("r.cut", 9).alias("cut"), F.col("l.size").alias("n_left"), F.col("r.size").alias("n"))


@proof("cox_ph")
def cox_ph(t):
    rows, names = train_rows(t)
    model = cox.fit_cox(rows, "features", "time", "event", len(names))
    return rows.select("id", model.score_column("features").alias("risk_score"))


def sql_newton(steps: int) -> str:
    """Newton steps on two features, written out: risk sets by a window over distinct times, the 2 x 2 system by hand."""
    text = """, seen AS (SELECT time, event, x2 / 100 AS a, coalesce(n, 0)::DOUBLE AS b FROM labelled JOIN subjects USING (id)
       LEFT JOIN (SELECT id, count(*) AS n FROM obs GROUP BY id) o USING (id)),
   b0 AS (SELECT 0.0::DOUBLE AS p, 0.0::DOUBLE AS q)"""
    for k in range(steps):
        text += f""",
   w{k} AS MATERIALIZED (SELECT time, sum(event) AS d, sum(event * a) AS da, sum(event * b) AS db, sum(w) AS w, sum(w * a) AS wa, sum(w * b) AS wb,
         sum(w * a * a) AS waa, sum(w * a * b) AS wab, sum(w * b * b) AS wbb
       FROM (SELECT *, exp(a * p + b * q) AS w FROM seen CROSS JOIN b{k}) GROUP BY time),
   r{k} AS (SELECT d, da, db, sum(w) OVER o AS s, sum(wa) OVER o AS sa, sum(wb) OVER o AS sb, sum(waa) OVER o AS saa, sum(wab) OVER o AS sab,
         sum(wbb) OVER o AS sbb FROM w{k} WINDOW o AS (ORDER BY time DESC ROWS UNBOUNDED PRECEDING)),
   g{k} AS (SELECT sum(da - d * sa / s) AS ga, sum(db - d * sb / s) AS gb, sum(d * (saa / s - sa * sa / s / s)) AS haa,
         sum(d * (sab / s - sa * sb / s / s)) AS hab, sum(d * (sbb / s - sb * sb / s / s)) AS hbb FROM r{k}),
   b{k + 1} AS MATERIALIZED (SELECT p + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS p, q + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS q
       FROM b{k} CROSS JOIN g{k})"""
    return text + f" SELECT 'x2' AS feature, round(p, 7) + 0.0::DOUBLE AS beta FROM b{steps} UNION ALL SELECT 'items', round(q, 7) + 0.0::DOUBLE FROM b{steps}"


@proof("cox_coefficients", sql_newton(6))
def cox_coefficients(t):
    """Coefficients of two features without a ridge, against Newton steps written out in SQL."""
    items = t.obs.groupBy("id").agg(F.count("*").cast("double").alias("items"))
    rows = t.labelled.join(t.subjects.select("id", F.col("x2") / 100), "id").toDF(*t.labelled.columns, "x2")
    rows = rows.join(items, "id", "left").fillna(0.0, ["items"]).select("time", "event", F.array("x2", "items").alias("features"))
    model = cox.fit_cox(rows, "features", "time", "event", 2, ridge=0.0, tolerance=1e-10)
    found = t.spark.createDataFrame([("x2", float(model.beta[0])), ("items", float(model.beta[1]))], "feature string, beta double")
    return found.select("feature", (F.round("beta", 7) + 0.0).alias("beta"))


@proof("boosted_clinical_benchmark")
def boosted_clinical_benchmark(t):
    spec = replace(FLAGSHIP, text=None, top_n=0, stats=(), item_flags=False, sets={}, pairs=(), density=None)
    rows, _ = train_rows(t, spec=spec)
    return models.boosted_benchmark(rows, "features", "time", "event", TAU, rounds=10).transform(rows).select("id", "risk_score")


@proof("time_regression")
def time_regression(t):
    rows, _ = train_rows(t)
    return models.time_regression(rows, "features", "time").transform(rows).select("id", "risk_score")


@proof("kmeans_clusters")
def kmeans_clusters(t):
    clusters = models.fit_kmeans(t.vectors, "v", 4)
    return models.assign_clusters(clusters, t.vectors, "v").select("vec_id", "cluster")


@proof("fit_per_cluster")
def fit_per_cluster(t):
    rows, names = train_rows(t, scaled=True)
    placed = cut_lineage(models.assign_clusters(models.fit_kmeans(rows, "features", 3), rows, "features"))
    forests = fit_clusters(placed, "cluster", 3, replace(SMALL, n_estimators=8), "features", "time", "event", "id", names)
    return mean_of_all(forests, placed, "features").select("id", "cluster", "risk_score")


@proof("embed_rows")
def embed_rows(t):
    pca = models.fit_embedding(t.vectors, "v", 8)
    return models.embed_rows(pca, t.vectors, "v").select("vec_id", F.posexplode("embedding").alias("pos", "value"))


SQL_KNN = """, unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vectors),
   sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.u, b.u), 10) AS sim FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
   knn AS (SELECT src, dst, sim, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS INT) AS rank FROM sims
           QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 10)"""


@proof("join_all_pairs_similarity", f"{SQL_KNN} SELECT src AS vec_id, round(avg(sim), 6) + 0.0::DOUBLE AS mean_sim FROM sims GROUP BY src")
def join_all_pairs_similarity(t):
    return rounded(graph.similarity_to_all(t.vectors, "vec_id", "v"), "vec_id")


@proof("knn_graph", f"{SQL_KNN} SELECT src, dst, round(sim, 6) + 0.0::DOUBLE AS sim, rank FROM knn")
def knn_graph(t):
    return rounded(graph.knn_graph(t.vectors, "vec_id", "v", 10), "src", "dst", "rank")


@proof("top_k_per_group", """SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY round(v[1], 9) DESC, vec_id) AS INT) AS rank
    FROM vectors JOIN (SELECT vec_id AS k, label FROM embeddings) e ON vec_id = e.k
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(v[1], 9) DESC, vec_id) <= 10""")
def top_k_per_group(t):
    df = t.read("embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 9).alias("s"))
    return graph.top_k_per_group(df, "label", 10, [F.desc("s"), "vec_id"]).select("label", "vec_id", "rank")


SQL_HOP = """, {out} AS (SELECT m.dst AS id, p, sum(x.value / sqrt(ds.deg) / sqrt(dd.deg)) AS value
     FROM (SELECT src, dst FROM knn UNION ALL SELECT vec_id, vec_id FROM vectors) m
     JOIN {src} x ON x.id = m.src JOIN deg ds ON ds.id = m.src JOIN deg dd ON dd.id = m.dst GROUP BY m.dst, p)"""


@proof(
    "propagate_neighbors",
    SQL_KNN + """, deg AS (SELECT v.vec_id AS id, 1.0::DOUBLE + count(dst) AS deg FROM vectors v LEFT JOIN knn ON knn.dst = v.vec_id GROUP BY v.vec_id),
     start AS (SELECT vec_id AS id, p, v[p + 1] AS value FROM vectors, range(64) r(p))"""
    + SQL_HOP.format(out="one", src="start") + SQL_HOP.format(out="two", src="one")
    + " SELECT id AS vec_id, CAST(p AS INT) AS pos, round(value, 6) + 0.0::DOUBLE AS value FROM two",
)
def propagate_neighbors(t):
    edges = graph.knn_graph(t.vectors, "vec_id", "v", 10)
    spread = graph.propagate_neighbors(t.vectors, "vec_id", "v", cut_lineage(edges))
    return rounded(spread.select("vec_id", F.posexplode("propagated").alias("pos", "value")), "vec_id", "pos")


@proof("permutation_importance")
def permutation_importance(t):
    rows, names = train_rows(t)
    parts = stratified_split(rows, "id", "event")
    train, valid = parts.where("part = 'train'"), parts.where("part = 'valid'")
    trees = fit_trees(train, [R.ModelSpec(R.FOREST_TUNED)], "features", "time", "event", "id", names=names)
    return importance(trees, valid, train, "features", "time", "event", "id", names, tau=TAU)


GRID = {"n_estimators": [5, 10], "min_samples_split": [10], "min_samples_leaf": [10, 20], "max_features": ["sqrt", "log2"]}
SPACE = {"n_estimators": (4, 8), "min_samples_split": (2, 20), "min_samples_leaf": (2, 20), "max_features": ["sqrt", "log2"]}


@proof("grid_search")
def grid_search(t):
    rows, names = train_rows(t)
    return search.grid_search(rows, GRID, "features", "time", "event", "id", replace(SMALL, max_depth=5), tau=TAU, names=names)


@proof("random_search")
def random_search(t):
    rows, names = train_rows(t)
    return search.random_search(rows, 8, SPACE, "features", "time", "event", "id", replace(SMALL, max_depth=5), TAU, names=names)


@proof("refit_and_score")
def refit_and_score(t):
    rows, model = cohort_rows(t)
    names, base = model.names, replace(SMALL, max_depth=5)
    grid = {"n_estimators": [10], "min_samples_leaf": [10, 20]}
    table = search.grid_search(rows, grid, "features", "time", "event", "id", base, metric="harrell", names=names)
    scores = search.refit_and_score(table, rows, unlabelled_rows(t, model), "features", "time", "event", "id", base, names)
    path = f"{shared_dir(t.spark)}/refit-{uuid.uuid4().hex}"
    T.write_scores(scores, path, "id")
    return T.read_scores(t.spark, path)
