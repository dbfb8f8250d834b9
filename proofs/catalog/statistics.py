"""Curves, weights, concordance and routing on given scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardline.operators import survival as S
from hazardline.operators.ensemble import choose_models, route_by_cluster
from hazardline.operators.ordering import stratified_split
from proofs.catalog.summaries import rounded
from proofs.registry import proof
from proofs.views import TAU


def sql_curve(source: str, by: str = "") -> str:
    """Counts, risk sets and both product-limit curves at every distinct time of ``source``."""
    part, keys = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT *, product(1 - d / n) OVER ({part} ORDER BY time) AS s,
        product(CASE WHEN n > d THEN 1 - c / (n - d) ELSE 1 END) OVER ({part} ORDER BY time) AS g
      FROM (SELECT *, CAST(sum(d + c) OVER ({part} ORDER BY time DESC) AS DOUBLE) AS n
            FROM (SELECT {keys}time, CAST(sum(event) AS DOUBLE) AS d, CAST(sum(1 - event) AS DOUBLE) AS c FROM {source} GROUP BY {keys}time))"""


def sql_pairs(rows: str, by: str = "", score: str = "risk") -> str:
    """All-pairs concordance of ``rows(time, event, <score>, w)`` where w is the squared weight."""
    match = " AND ".join(f"i.{b} = j.{b}" for b in by.split(", ")) if by else "true"
    keys = ", ".join(f"i.{b}" for b in by.split(", ")) + "," if by else ""
    group = f"GROUP BY {keys[:-1]}" if by else ""
    return f"""SELECT {keys} sum(i.w * CASE WHEN j.{score} < i.{score} THEN 1.0 WHEN j.{score} = i.{score} THEN 0.5 ELSE 0 END) AS num, sum(i.w) AS den
      FROM {rows} i JOIN {rows} j ON {match} AND (j.time > i.time OR (j.time = i.time AND j.event = 0))
      WHERE i.event = 1 AND i.w > 0 {group}"""


def sql_weight(curve: str, row: str = "l") -> str:
    return f"CASE WHEN {row}.event = 1 AND {row}.time < {TAU} THEN 1 / {curve}.g ELSE 0 END"


def metric(df, *by):
    return df.select(*by, F.round("cindex", 6).alias("cindex"))


@proof("kaplan_meier", f"SELECT time, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS n_event, CAST(c AS BIGINT) AS n_censored, round(s, 6) AS survival FROM ({sql_curve('labelled')})")
def kaplan_meier(t):
    return rounded(S.kaplan_meier(t.labelled, "time", "event"), "time", "at_risk", "n_event", "n_censored")


@proof("running_survival", f"SELECT time, round(g, 6) AS survival FROM ({sql_curve('labelled')})")
def running_survival(t):
    return rounded(S.kaplan_meier(t.labelled, "time", "event", reverse=True), "time").select("time", "survival")


@proof("nelson_aalen", f"SELECT time, round(sum(d / n) OVER (ORDER BY time), 6) AS hazard FROM ({sql_curve('labelled')})")
def nelson_aalen(t):
    return rounded(S.nelson_aalen(t.labelled, "time", "event").select("time", "hazard"), "time")


@proof("ipcw_weights", f", curve AS ({sql_curve('labelled')}) SELECT l.id, round({sql_weight('curve')}, 6) AS weight FROM labelled l JOIN curve ON l.time = curve.time")
def ipcw_weights(t):
    weighted = S.ipcw_weights(t.labelled, t.labelled, "time", "event", tau=TAU)
    return rounded(weighted.select("id", "weight"), "id")


@proof(
    "ipcw_cindex",
    f""", curve AS ({sql_curve('labelled')}),
      w AS (SELECT l.*, ({sql_weight('curve')}) ** 2 AS w FROM labelled l JOIN curve ON l.time = curve.time)
      SELECT round(num / den, 6) AS cindex FROM ({sql_pairs('w')})""",
)
def ipcw_cindex(t):
    return metric(S.ipcw_cindex(t.labelled, t.labelled, "time", "event", "risk", TAU))


@proof("harrell_cindex", f", w AS (SELECT *, 1.0::DOUBLE AS w FROM labelled) SELECT round(num / den, 6) AS cindex FROM ({sql_pairs('w')})")
def harrell_cindex(t):
    return metric(S.harrell_cindex(t.labelled, "time", "event", "risk"))


SQL_PARTS = """, parts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY md5('42|' || id))
      <= ceil(round(0.2 * count(*) OVER (PARTITION BY event), 9)) THEN 'valid' ELSE 'train' END AS part FROM labelled),
   trained AS (SELECT * FROM parts WHERE part = 'train')"""


@proof(
    "evaluate_by_split",
    f"""{SQL_PARTS}, curve AS ({sql_curve('trained')}),
      w AS (SELECT p.*, CASE WHEN p.event = 1 AND p.time < {TAU} THEN (1 / curve.g) ** 2 ELSE 0 END AS w
            FROM parts p ASOF LEFT JOIN curve ON p.time >= curve.time)
      SELECT part, round(num / den, 6) AS cindex FROM ({sql_pairs('w', 'part')})""",
)
def evaluate_by_split(t):
    parts = stratified_split(t.labelled, "id", "event")
    return metric(S.evaluate_by_split(parts, "part", "time", "event", "risk", TAU), "part")


SQL_CLUSTERS = f""", two AS (SELECT l.id, l.grp, l.time, l.event, l.risk AS a, s.x2 AS b FROM labelled l JOIN subjects s ON l.id = s.id),
   curve AS ({sql_curve('two', 'grp')}),
   w AS (SELECT l.*, ({sql_weight('curve')}) ** 2 AS w FROM two l JOIN curve ON l.time = curve.time AND l.grp = curve.grp),
   metrics AS (SELECT grp, 'a' AS model, round(num / den, 9) AS cindex FROM ({sql_pairs('w', 'grp', 'a')})
     UNION ALL SELECT grp, 'b', round(num / den, 9) FROM ({sql_pairs('w', 'grp', 'b')}))"""


def two_scores(t):
    return t.labelled.join(t.subjects.select("id", "x2"), "id").select("id", "grp", "time", "event", F.col("risk").alias("a"), F.col("x2").alias("b"))


@proof("evaluate_by_cluster", f"{SQL_CLUSTERS} SELECT grp, model, round(cindex, 6) AS cindex FROM metrics")
def evaluate_by_cluster(t):
    return metric(S.evaluate_by_cluster(two_scores(t), "grp", "time", "event", ["a", "b"], TAU), "grp", "model")


@proof(
    "route_by_cluster",
    f"""{SQL_CLUSTERS}, choice AS (SELECT grp, arg_max(model, cindex) AS choice FROM metrics GROUP BY grp)
      SELECT id, choice, CASE choice WHEN 'a' THEN a ELSE b END AS risk_score FROM two JOIN choice ON two.grp = choice.grp""",
)
def route_by_cluster_(t):
    scored = two_scores(t)
    metrics = S.evaluate_by_cluster(scored, "grp", "time", "event", ["a", "b"], TAU)
    routed = route_by_cluster(scored, "grp", choose_models(metrics, "grp", "a"), ["a", "b"], "a")
    return routed.select("id", "choice", "risk_score")
