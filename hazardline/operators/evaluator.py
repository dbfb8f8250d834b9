"""Concordance as a Spark ML evaluator, for ML's own cross-validation and as the metric of a pipeline."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame

from hazardline.operators.survival import harrell_cindex, ipcw_cindex


class ConcordanceEvaluator(Evaluator):
    """Plain concordance, or the weighted one when ``train`` labels are given (``tau`` limits it)."""

    def __init__(
        self, time: str = "time", event: str = "event", risk: str = "risk_score", train: DataFrame | None = None, tau: float | None = None
    ):
        super().__init__()
        self.columns, self.train, self.tau = (time, event, risk), train, tau

    def _evaluate(self, dataset: DataFrame) -> float:
        time, event, risk = self.columns
        if self.train is None:
            result = harrell_cindex(dataset, time, event, risk)
        else:
            result = ipcw_cindex(self.train, dataset, time, event, risk, self.tau)
        value = result.first()["cindex"]
        if value is None:
            raise ValueError("no comparable pairs")
        return float(value)

    def isLargerBetter(self) -> bool:
        return True
