"""The survival forest as a Spark ML estimator: ML params, saved and loaded like any ML stage, tuned by ML's own searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from hazardline.operators.forest import ForestParams, ModelSpec
from hazardline.operators.tree_table import TreeTable, fit_trees


def _param(name: str, doc: str, convert: Callable) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class _ForestColumns(HasFeaturesCol):
    timeCol = _param("timeCol", "observed time", TypeConverters.toString)
    eventCol = _param("eventCol", "1 for an event, 0 for censored", TypeConverters.toString)
    keyCol = _param("keyCol", "row key that bootstrap weights are drawn from", TypeConverters.toString)
    riskCol = _param("riskCol", "risk score to write, higher for earlier events", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", timeCol="time", eventCol="event", keyCol="id", riskCol="risk_score")


class SurvivalForest(_ForestColumns, HasSeed, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Exact survival forest over an array column.

    ``maxFeatures`` is "sqrt", "log2", "all" or a share as text; ``maxDepth`` 0 sets no limit.

    >>> grid = ParamGridBuilder().addGrid(forest.minSamplesLeaf, [5, 10]).build()
    >>> CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=ConcordanceEvaluator(), numFolds=3).fit(df)
    """

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    minSamplesSplit = _param("minSamplesSplit", "fewest rows of a node that is split", TypeConverters.toInt)
    minSamplesLeaf = _param("minSamplesLeaf", "fewest rows of a leaf", TypeConverters.toInt)
    maxFeatures = _param("maxFeatures", "features drawn per node", TypeConverters.toString)
    splitter = _param("splitter", "best or random", TypeConverters.toString)
    maxDepth = _param("maxDepth", "levels below the root, 0 for any", TypeConverters.toInt)
    bootstrap = _param("bootstrap", "draw rows with replacement", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", timeCol="time", eventCol="event", keyCol="id", riskCol="risk_score", numTrees=100,
        minSamplesSplit=6, minSamplesLeaf=3, maxFeatures="sqrt", splitter="best", maxDepth=0, bootstrap=True, seed=42,
    ):
        super().__init__()
        self._setDefault(numTrees=100, minSamplesSplit=6, minSamplesLeaf=3, maxFeatures="sqrt", splitter="best", maxDepth=0, bootstrap=True, seed=42)
        self._set(**self._input_kwargs)

    def settings(self) -> ForestParams:
        """The params as the library's own settings, checked."""
        get = self.getOrDefault
        wide = get(self.maxFeatures)
        features = None if wide == "all" else wide if wide in ("sqrt", "log2") else float(wide)
        return ForestParams(
            get(self.numTrees), get(self.minSamplesSplit), get(self.minSamplesLeaf), features, get(self.splitter),
            get(self.maxDepth) or None, get(self.bootstrap), get(self.seed),
        ).checked()

    def _fit(self, dataset: DataFrame) -> "SurvivalForestModel":
        names = (self.getOrDefault(p) for p in (self.featuresCol, self.timeCol, self.eventCol, self.keyCol))
        trees = fit_trees(dataset, [ModelSpec(self.settings())], *names)
        return self._copyValues(SurvivalForestModel(trees)._resetUid(self.uid))


class SurvivalForestModel(_ForestColumns, Model, MLReadable, MLWritable):
    """Adds the risk column; ``trees`` is the table of nodes."""

    def __init__(self, trees: TreeTable) -> None:
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.trees.score(dataset, self.getOrDefault(self.featuresCol), self.getOrDefault(self.riskCol))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: SurvivalForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.trees.save(f"{path}/trees")


class _ModelReader(MLReader):
    def __init__(self, cls: type[SurvivalForestModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SurvivalForestModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(TreeTable.load(self.sparkSession, f"{path}/trees"))._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model


class MetricEvaluator(Evaluator):
    """Any function from a scored table to a number as an evaluator."""

    def __init__(self, metric: Callable[[DataFrame], float], larger_is_better: bool = True) -> None:
        super().__init__()
        self.metric, self.larger = metric, larger_is_better

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.metric(dataset))

    def isLargerBetter(self) -> bool:
        return self.larger
