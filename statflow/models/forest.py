"""Random forests, on Spark's distributed learner."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.functions.arrays import as_vector


@dataclass
class ForestModel:
    """A trained forest; ``levels`` are the classes of a classification, None for a regression."""

    model: object
    features: str | list[str]
    levels: list[str] | None

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the mean of the trees or their majority's class, ties to the lesser class."""
        rows = _features(df, self.features)
        out = self.model.setPredictionCol("__p").transform(rows)
        extra = [c for c in ("__features", "__p", "rawPrediction", "probability") if c in out.columns and c not in df.columns]
        value = F.col("__p") if self.levels is None else F.get(F.array(*[F.lit(x) for x in self.levels]), F.col("__p").cast("int"))
        return out.withColumn(output, value).drop(*extra)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, features: str | list[str], levels: list[str] | None) -> ForestModel:
        kind = RandomForestRegressionModel if levels is None else RandomForestClassificationModel
        return cls(kind.load(path), features, levels)


def _features(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    v = as_vector(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn("__features", array_to_vector(v))


def random_forest(
    df: DataFrame, features: str | Sequence[str], response: str, num_trees: int = 20, classify: bool | None = None, max_depth: int = 10, min_sample: int = 100, node_epsilon: float = 0.0,
    max_categories: int = 32, num_vars: int | str = 0, seed: int = 42, bootstrap: bool = True,
) -> ForestModel:
    """``num_vars`` 0: the square root of the features. A string response is classified unless told otherwise."""
    if num_trees < 1 or not 1 <= max_depth <= 30:
        raise ValueError("num_trees >= 1 and 1 <= max_depth <= 30 are needed")
    classify = dict(df.dtypes)[response] in ("string", "boolean") if classify is None else classify
    names = [features] if isinstance(features, str) else list(features)
    rows = df.dropna(subset=[response, *names])
    levels = None
    if classify:
        levels = [r[0] for r in rows.select(F.col(response).cast("string").alias("r")).distinct().orderBy("r").limit(1001).collect()]
        if len(levels) > 1000:
            raise ValueError("over 1000 classes")
        label = (F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(response).cast("string")) - 1).cast("double")
    else:
        label = F.col(response).cast("double")
    subset = "sqrt" if num_vars == 0 else str(num_vars)
    learner = (RandomForestClassifier if classify else RandomForestRegressor)(
        featuresCol="__features", labelCol="__label", numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_sample, minInfoGain=node_epsilon, maxBins=max(2, max_categories), featureSubsetStrategy=subset, seed=seed, bootstrap=bootstrap
    )
    data = _features(rows, features).select("__features", label.alias("__label"))
    return ForestModel(learner.fit(data), features if isinstance(features, str) else list(features), levels)


def classification_tree(df: DataFrame, features: str | Sequence[str], response: str, max_depth: int = 5, min_sample: int = 2, max_categories: int = 32, seed: int = 42) -> ForestModel:
    """A single tree of binary splits by gini gain: a forest of one that sees every row and feature."""
    return random_forest(df, features, response, 1, True, max_depth, min_sample, 0.0, max_categories, "all", seed, bootstrap=False)


def random_forest_batch(train: DataFrame, test: DataFrame, features: str | Sequence[str], response: str, extra: Sequence[str] = (), **args) -> DataFrame:
    """Trains on one gathered table and predicts another: extra columns, inputs, prediction."""
    names = [features] if isinstance(features, str) else list(features)
    return random_forest(train, features, response, **args).predict(test).select(*extra, *names, "prediction")
