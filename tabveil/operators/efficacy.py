"""Predictive use of an artificial table: the same classifier fitted to both, judged on real test rows."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from .metrics import average_precision, ranking_points


def as_categories(df: DataFrame, y: str) -> DataFrame:
    """df with booleans, other than y, as strings, so that they are categories."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if f.dataType.typeName() == "boolean" and f.name != y})


def preprocessing(df: DataFrame, y: str) -> tuple[list, dict]:
    """Stages to a vector column features, and the fills of missing strings by their mode.

    Numbers: median and min-max; strings: mode and one-hot, values unseen at fit all zero. df is from as_categories().
    """
    strings = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name != y]
    numbers = [c for c in df.columns if c not in strings and c != y]
    fills = df.agg(*[F.mode(c).alias(c) for c in strings]).first().asDict() if strings else {}
    stages, parts = [], []
    if numbers:
        stages += [Imputer(inputCols=numbers, outputCols=[f"{c}__n" for c in numbers], strategy="median"), VectorAssembler(inputCols=[f"{c}__n" for c in numbers], outputCol="__numbers"), MinMaxScaler(inputCol="__numbers", outputCol="__scaled")]
        parts.append("__scaled")
    if strings:
        stages += [StringIndexer(inputCols=strings, outputCols=[f"{c}__i" for c in strings], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in strings], outputCols=[f"{c}__o" for c in strings], dropLast=True)]
        parts += [f"{c}__o" for c in strings]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")], {k: v for k, v in fills.items() if v is not None}


def default_classifier(kind: str, n: int, seed: int = 1):
    if kind == "lr":
        return LogisticRegression(labelCol="__y", weightCol="__w", regParam=1 / max(n, 1), maxIter=50)
    if kind == "rf":
        return RandomForestClassifier(labelCol="__y", weightCol="__w", numTrees=100, maxDepth=5, minInstancesPerNode=max(1, math.ceil(0.05 * n)), seed=seed)
    raise ValueError("the default classifier is lr or rf")


#: What tuned() tries: inverse penalties and whether classes are balanced; trees, impurities and depths.
LR_GRID = {"c": [10 ** (-4 + 8 * k / 9) for k in range(10)], "balanced": [True, False]}
RF_GRID = {"trees": [100, 200, 500], "impurity": ["entropy", "gini"], "depth": [3, 5, 10]}


def tuned(kind: str, n: int, seed: int = 1, parallelism: int = 4, folds: int = 3, grid: dict | None = None) -> CrossValidator:
    """The default classifier with the settings of its grid that have the best area under the precision-recall curve across folds."""
    one, build = default_classifier(kind, n, seed), ParamGridBuilder()
    grid = (LR_GRID if kind == "lr" else RF_GRID) | (grid or {})
    if kind == "lr":
        build = build.addGrid(one.regParam, [1 / (c * max(n, 1)) for c in grid["c"]]).addGrid(one.weightCol, ["__w" if b else "__even" for b in grid["balanced"]])
    else:
        build = build.addGrid(one.numTrees, grid["trees"]).addGrid(one.impurity, grid["impurity"]).addGrid(one.maxDepth, grid["depth"])
    judge = BinaryClassificationEvaluator(labelCol="__y", metricName="areaUnderPR")
    return CrossValidator(estimator=one, estimatorParamMaps=build.build(), evaluator=judge, numFolds=folds, seed=seed, parallelism=parallelism)


class ClassifierComparison:
    """Average precision on the same real rows of a classifier fitted to the original and to the artificial table.

    y is the last column unless named. With tune, the default classifier is chosen from a grid by cross-validation,
    parallelism fits at a time; grid replaces parts of LR_GRID or RF_GRID.
    """

    def __init__(self, y: str | None = None, default: str | None = "lr", classifier=None, exclude: tuple[str, ...] = (), tune: bool = False, seed: int = 1, parallelism: int = 4, grid: dict | None = None) -> None:
        if classifier is None and default is None:
            raise ValueError("name a default classifier or give one")
        self.y, self.default, self.classifier, self.exclude = y, default, classifier, tuple(exclude)
        self.tune, self.seed, self.parallelism, self.grid = tune, seed, parallelism, grid

    def _estimator(self, n: int):
        if self.classifier:
            return self.classifier
        return tuned(self.default, n, self.seed, self.parallelism, grid=self.grid) if self.tune else default_classifier(self.default, n, self.seed)

    def _weighted(self, df: DataFrame) -> tuple[DataFrame, int]:
        rows = df.withColumn("__y", F.col(self.y).cast("double"))
        counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
        n = sum(counts.values())
        weight = F.lit(0.0)
        for label, c in counts.items():
            weight = F.when(F.col("__y") == label, n / (len(counts) * c)).otherwise(weight)
        return rows.withColumn("__w", weight).withColumn("__even", F.lit(1.0)), n

    def _fit(self, df: DataFrame):
        df = as_categories(df, self.y)
        rows, n = self._weighted(df)
        stages, fills = preprocessing(df, self.y)
        model = Pipeline(stages=[*stages, self._estimator(n)]).fit(rows.fillna(fills))
        return model, fills

    def fit(self, original: DataFrame, artificial: DataFrame) -> ClassifierComparison:
        cols = [c for c in original.columns if c not in self.exclude]
        self.y = self.y or cols[-1]
        self.models_ = {"original": self._fit(original.select(*cols)), "artificial": self._fit(artificial.select(*cols))}
        self.columns_ = cols
        return self

    def predictions(self, which: str, test: DataFrame) -> DataFrame:
        model, fills = self.models_[which]
        return model.transform(as_categories(test.select(*self.columns_), self.y).fillna(fills)).select(F.col(self.y).cast("int").alias("label"), F.round(vector_to_array("probability")[1], 6).alias("score"))

    def score(self, test: DataFrame) -> dict[str, float]:
        return {k: average_precision(self.predictions(k, test), "score", "label").first()[0] for k in self.models_}

    def plot_data(self, test: DataFrame) -> DataFrame:
        """Points of the ROC and precision-recall curves of both models."""
        parts = [ranking_points(self.predictions(k, test), "score", "label").withColumn("model", F.lit(k)) for k in self.models_]
        return parts[0].unionByName(parts[1])


class FeatureImportanceComparison(ClassifierComparison):
    """Coefficients or importances of both models, aligned by feature, 0 where one lacks it."""

    def importances(self, which: str) -> DataFrame:
        model, _ = self.models_[which]
        last = getattr(model.stages[-1], "bestModel", model.stages[-1])
        values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
        spark = SparkSession.active()
        meta = self._names(model, spark)
        return spark.createDataFrame([(name, float(values[i])) for i, name in meta], "feature string, importance double")

    def _names(self, model, spark) -> list[tuple[int, str]]:
        schema = spark.createDataFrame([], self.schema_)
        attrs = model.transform(schema).schema["features"].metadata["ml_attr"].get("attrs", {})
        return sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)

    def fit(self, original: DataFrame, artificial: DataFrame) -> FeatureImportanceComparison:
        self.y = self.y or [c for c in original.columns if c not in self.exclude][-1]
        self.schema_ = self._weighted(as_categories(original.limit(0), self.y))[0].schema
        super().fit(original, artificial)
        return self

    def aligned(self) -> DataFrame:
        a, b = self.importances("original"), self.importances("artificial").withColumnRenamed("importance", "artificial")
        return a.withColumnRenamed("importance", "original").join(b, "feature", "full_outer").na.fill(0.0)

    def distance(self) -> float:
        return self.aligned().agg(F.sqrt(F.sum(F.pow(F.col("original") - F.col("artificial"), 2)))).first()[0]

    def top(self, k: int = 30) -> DataFrame:
        """feature, table, importance of the k features that matter most to the original model."""
        best = self.aligned().orderBy(F.desc(F.abs("original")), "feature").limit(k)
        return best.unpivot(["feature"], ["original", "artificial"], "table", "importance")
