"""The gradient of the rating model's loss, and that a fit ends where it is flat."""

import math
import random

from histloom.plans import rating as R

CLASSES = 4


def rows(n=120):
    rnd = random.Random(4)
    data = []
    for _ in range(n):
        x = [rnd.uniform(-1, 1) for _ in range(3)]
        data.append((x, min(3, max(0, round(1.5 + x[0] - x[1] / 2 + rnd.gauss(0, 0.7))))))
    return data


def loss(model, data):
    total = 0.0
    for x, y in data:
        score = sum(a * b for a, b in zip(x, model.weights))
        for k, t in enumerate(model.thresholds):
            total += math.log(1 + math.exp(-(score - t) if y > k else score - t))
    n = len(data) * (CLASSES - 1)
    own = [*model.weights, *[-t / R.THRESHOLD_SCALE for t in model.thresholds]]
    return total / n + model.alpha / n / 2 * sum(w * w for w in own)


def moved(model, at, step):
    weights, marks = list(model.weights), [-t / R.THRESHOLD_SCALE for t in model.thresholds]
    (weights if at < 3 else marks)[at if at < 3 else at - 3] += step
    return R.RatingModel(model.alpha, weights, [-R.THRESHOLD_SCALE * m for m in marks])


def test_gradient_and_fit(spark):
    data = rows()
    train = spark.createDataFrame(data, "features array<double>, y int")
    given = R.RatingModel(2.0, [0.3, -0.2, 0.1], [-1.0, 0.2, 1.1])
    found = {r.coordinate: r.gradient for r in R.gradient(given, train, CLASSES, len(data)).collect()}
    for at in range(6):
        slope = (loss(moved(given, at, 1e-5), data) - loss(moved(given, at, -1e-5), data)) / 2e-5
        assert abs(found[at] - slope) < 1e-7
    sizes = {}
    for steps in (2, 100):
        fitted = R.fit(train, 1.0, CLASSES, len(data), max_iter=steps)
        sizes[steps] = max(abs(r.gradient) for r in R.gradient(fitted, train, CLASSES, len(data)).collect())
    assert sizes[100] < 1e-3 < sizes[2]
