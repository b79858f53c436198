"""Ordinal rating model: one logistic regression over all rating thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.operators.lookups import accuracy_mae

THRESHOLD_SCALE = 10.0  # large inputs keep the threshold weights small, so the penalty spares them


@dataclass(frozen=True)
class RatingModel:
    """Weights of the features, and one threshold per step between classes."""

    alpha: float
    weights: list[float]
    thresholds: list[float]

    def predict(self, features: Column) -> Column:
        """The number of thresholds that the score of the features passes."""
        weights = F.array(*[F.lit(w) for w in self.weights])
        score = F.aggregate(
            F.zip_with(features, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x
        )
        passed = [(score > t).cast("int") for t in self.thresholds]
        return sum(passed[1:], passed[0])


def text_vectors(rows: DataFrame, text: str, into: str, size: int = 256, unit: bool = True) -> DataFrame:
    """Texts as hashed word counts, of length 1 unless `unit` is false, for use where no embedding
    is at hand."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size)
    counted = counts.transform(words.transform(rows))
    if unit:
        counted = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return counted.withColumn(into, vector_to_array("_unit" if unit else "_counts")).drop("_words", "_counts", "_unit")


def with_thresholds(rows: DataFrame, classes: int) -> DataFrame:
    """Every row once per threshold `k` below the highest class, with `label`: whether y > k."""
    k = F.explode(F.sequence(F.lit(0), F.lit(classes - 2)))
    return rows.select("*", k.alias("k")).withColumn("label", (F.col("y") > F.col("k")).cast("double"))


def chosen_trial(trials: DataFrame) -> DataFrame:
    """The trial with the lowest error, the first one on ties."""
    return trials.orderBy("mae", "trial").limit(1)


def fit(train: DataFrame, alpha: float, classes: int, rows: int, max_iter: int = 100) -> RatingModel:
    """Fit on `train` (features array<double>, y int from 0).

    Every row is repeated once per threshold k, with the question "is y > k" and a marker of the
    threshold next to the features. The feature weights are shared, which makes the sum of the
    logistic losses over all thresholds one ordinary regression. `alpha` weighs the squared
    weights against that sum. Only the weights come to the driver.
    """
    steps = classes - 1
    expanded = with_thresholds(train, classes)
    marker = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.when(i == F.col("k"), THRESHOLD_SCALE).otherwise(0.0),
    )
    data = expanded.select(
        array_to_vector(F.concat("features", marker)).alias("features"),
        "label",
    )
    learner = LogisticRegression(
        regParam=alpha / (rows * steps), standardization=False, fitIntercept=False, maxIter=max_iter
    )
    found = learner.fit(data).coefficients.toArray().tolist()
    size = len(found) - steps
    return RatingModel(alpha, found[:size], [-THRESHOLD_SCALE * c for c in found[size:]])


def gradient(model: RatingModel, train: DataFrame, classes: int, rows: int) -> DataFrame:
    """coordinate and gradient of the loss that `fit` minimises, at the weights of `model`: first
    the features, then one coordinate per threshold. All are near 0 where a fit has ended.

    One scan: the residuals are summed per coordinate map-side, so a task passes on one row per
    coordinate."""
    steps = classes - 1
    weights = F.array(*[F.lit(w) for w in model.weights])
    score = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    limit = F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), F.col("k") + 1)
    residual = 1 / (1 + F.exp(limit - score)) - F.col("label")
    asked = with_thresholds(train, classes).select("features", "k", residual.alias("r"))
    own = F.transform("features", lambda x: x * F.col("r"))
    marks = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.when(i == F.col("k"), F.col("r") * THRESHOLD_SCALE).otherwise(0.0))
    each = asked.select(F.posexplode(F.concat(own, marks)).alias("coordinate", "g"))
    found = [*model.weights, *[-t / THRESHOLD_SCALE for t in model.thresholds]]
    penalty = F.element_at(F.array(*[F.lit(w * model.alpha / (rows * steps)) for w in found]), F.col("coordinate") + 1)
    return each.groupBy("coordinate").agg((F.sum("g") / (rows * steps)).alias("g")).select(
        "coordinate", (F.col("g") + penalty).alias("gradient")
    )


def scores(model: RatingModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """Accuracy and mean absolute error of the model, in one row."""
    return accuracy_mae(rows.withColumn("_p", model.predict(F.col(features))), "y", "_p")


def tune(
    train: DataFrame, val: DataFrame, classes: int, alphas: Sequence[float] = K.RATING_ALPHAS
) -> tuple[RatingModel, DataFrame]:
    """The model with the lowest validation error (the first on ties) and the table of trials."""
    rows = train.count()
    models = [fit(train, a, classes, rows) for a in alphas]
    trials = reduce(
        DataFrame.unionByName,
        [scores(m, val).select(F.lit(n).alias("trial"), F.lit(m.alpha).alias("alpha"), "accuracy", "mae") for n, m in enumerate(models)],
    )
    best = chosen_trial(trials).first()["trial"]
    return models[best], trials.withColumn("chosen", F.col("trial") == best)


def report(train: DataFrame, val: DataFrame, test: DataFrame, blank: DataFrame, classes: int) -> DataFrame:
    """All trials on the validation rows, then the chosen model on the test rows and on
    validation rows with a blank profile."""
    best, trials = tune(train, val, classes)
    named = trials.select(F.lit("val").alias("rows"), "alpha", "accuracy", "mae", "chosen")
    for name, rows in (("test", test), ("val blank", blank)):
        named = named.unionByName(
            scores(best, rows).select(
                F.lit(name).alias("rows"), F.lit(best.alpha).alias("alpha"), "accuracy", "mae", F.lit(True).alias("chosen")
            )
        )
    return named
