"""Named preparation blocks as stages of a ``pyspark.ml`` Pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.ml.feature import (
    PCA, Imputer, MinMaxScaler, RobustScaler, StandardScaler, StringIndexer, OneHotEncoder, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler, VectorSlicer,
)

SCALERS = {"standard": lambda i, o: StandardScaler(inputCol=i, outputCol=o, withMean=True), "minmax": lambda i, o: MinMaxScaler(inputCol=i, outputCol=o), "robust": lambda i, o: RobustScaler(inputCol=i, outputCol=o)}


class CorrelationSelector(Estimator):
    """Keeps a column of a vector unless an earlier kept one has a correlation with it beyond ``most``."""

    def __init__(self, inputCol: str, outputCol: str, most: float = 0.95):
        super().__init__()
        self.inputCol, self.outputCol, self.most = inputCol, outputCol, most

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        matrix = Correlation.corr(dataset, self.inputCol).first()[0].toArray()
        kept: list[int] = []
        for i in range(len(matrix)):
            if not any(abs(matrix[i, j]) > self.most for j in kept):
                kept.append(i)
        return VectorSlicer(inputCol=self.inputCol, outputCol=self.outputCol, indices=kept)


class ComponentShare(Estimator):
    """Principal components, as many as a share of the columns that the vector has when it is fitted."""

    def __init__(self, inputCol: str, outputCol: str, share: float = 0.8):
        super().__init__()
        self.inputCol, self.outputCol, self.share = inputCol, outputCol, share

    def _fit(self, dataset: DataFrame):
        size = dataset.select(self.inputCol).first()[0].size
        return PCA(k=max(1, int(self.share * size)), inputCol=self.inputCol, outputCol=self.outputCol).fit(dataset)


def compile_blocks(blocks: Sequence[tuple[str, str]], numeric: Sequence[str], target: str, texts: Sequence[str] = ()) -> Pipeline:
    """Stages for (kind, option) pairs: fill, encode, scale, select, reduce. The result is ``features``.

    Rows go only where the fill option is ``drop``; without a fill block gaps get the median. Select knows ``variance``, ``correlation`` and ``k_best``.
    """
    stages, inputs, vector = [], list(numeric), None
    n = 0
    fill = next((option for kind, option in blocks if kind == "fill"), None)
    if fill is None and numeric:
        blocks = [("fill", "median"), *blocks]

    def assemble():
        nonlocal vector
        if vector is None:
            stages.append(VectorAssembler(inputCols=inputs, outputCol="_v0", handleInvalid="skip" if fill == "drop" else "error"))
            vector = "_v0"

    for kind, option in blocks:
        n += 1
        if kind == "fill" and option != "drop":
            filled = [f"{c}_filled" for c in numeric]
            stages.append(Imputer(inputCols=list(numeric), outputCols=filled, strategy=option))
            inputs = filled + inputs[len(numeric):]
        elif kind == "encode" and texts:
            codes = [f"{c}_code" for c in texts]
            stages.append(StringIndexer(inputCols=list(texts), outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
            if option == "onehot":
                stages.append(OneHotEncoder(inputCols=codes, outputCols=[f"{c}_hot" for c in texts]))
                codes = [f"{c}_hot" for c in texts]
            inputs = inputs + codes
        elif kind == "scale":
            assemble()
            stages.append(SCALERS[option](vector, f"_v{n}"))
            vector = f"_v{n}"
        elif kind == "select":
            assemble()
            if option == "variance":
                stages.append(VarianceThresholdSelector(featuresCol=vector, outputCol=f"_v{n}", varianceThreshold=0.0))
            elif option == "correlation":
                stages.append(CorrelationSelector(vector, f"_v{n}"))
            else:
                stages.append(UnivariateFeatureSelector(featuresCol=vector, labelCol=target, outputCol=f"_v{n}", selectionMode="numTopFeatures")
                              .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(max(1, len(inputs) // 2)))
            vector = f"_v{n}"
        elif kind == "reduce":
            assemble()
            stages.append(ComponentShare(vector, f"_v{n}"))
            vector = f"_v{n}"
    assemble()
    stages.append(VectorAssembler(inputCols=[vector], outputCol="features"))
    return Pipeline(stages=stages)
