"""The ranking model against its definition, and reruns over repeated ids."""

import numpy as np

from moraine.llm import quality_rank

DOCS = "doc_id long, text string, source string"


def test_weights_are_the_minimum_of_the_pairwise_loss():
    rng = np.random.default_rng(4)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, 3)) + np.outer(y, [1.0, -0.5, 0.0])
    pairs, ridge = 5_000, 3.0
    model = quality_rank.Ranker(x, y, pairs=pairs, ridge=ridge, seed=2)
    z = model.expand(x)
    draw = np.random.default_rng(2)
    d = z[draw.choice(np.flatnonzero(y == 1), pairs)] - z[draw.choice(np.flatnonzero(y == 0), pairs)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + ridge / 2 * (w @ w)
    # plain gradient descent from zero comes to the same weights
    w = np.zeros(z.shape[1])
    for _ in range(4_000):
        w -= 2e-4 * (ridge * w - d.T @ (1 / (1 + np.exp(d @ w))))
    assert np.abs(w - model.weights).max() < 1e-2 and loss(model.weights) <= loss(w) + 1e-6
    # the threshold leaves as many above it as have label 1
    assert (model(x) >= 0.5).sum() == y.sum()
    scores = z @ model.weights
    assert np.array_equal(np.argsort(scores, kind="stable"), np.argsort(model(x), kind="stable"))


def test_one_label_or_none():
    x = np.random.default_rng(1).normal(size=(20, 3))
    assert (quality_rank.Ranker(x, np.ones(20, int))(x) > 0.5).all() and (quality_rank.Ranker(x, np.zeros(20, int))(x) < 0.5).all()
    assert (quality_rank.Ranker(np.zeros((0, 3)), np.zeros(0, int))(x) == 0.5).all()


def test_repeated_ids_and_odd_tables(spark):
    rows = [(k % 50, f"{'word ' * (k % 7 + 3)}{'### ' * (k % 2) * 4}{k}", "s") for k in range(300)] + [(1, None, "s"), (None, "", None), (2, "long " * 60_000, "s")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS quality", "1.5 AS score", "'y' AS x", "'z' AS h")
    labels = spark.createDataFrame([(k, k % 2, "t") for k in range(50)] + [(3, 0, "t"), (3, 1, "t"), (None, 1, "t"), (4, None, "t")], "doc_id long, quality int, text string")
    got = [sorted(map(str, quality_rank.scored(docs.repartition(n), labels).collect())) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert quality_rank.scored(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality_rank.scored(docs, labels.where("false")).collect()} == {0.5}
