import zlib

import numpy as np

from lectern.llm import quality
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(found[i].score, y, found[i].predicted) for i, y in truth.items() if found[i].held_out]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    score, y, predicted = np.array(rows).T
    assert (predicted == (score >= 0.7)).all()
    good, bad = score[y == 1], score[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert (predicted == y).mean() > 0.98


def test_labels_held_out_are_not_learnt_from(spark, documents):
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, quality int, toxic int"
    )
    assert {r.score for r in quality.classify(documents, labels).collect()} == {0.5}


def test_awkward_documents(spark, edge, nothing, documents):
    labels = spark.createDataFrame(
        [(1, 1, 0), (6, 0, 0), (None, 1, 0), (8, None, 0), (4, 5, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"
    )
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(documents, labels.limit(0)).filter("score = 0.5").count() == documents.count()


def brute(model, row):
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + (row[model.feature[t, node]] > model.limit[t, node])
        total += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_equals_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.grow(x, y, trees=20)
    assert np.allclose(model.score(x), [brute(model, row) for row in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_statistics_are_finite():
    for text in ("", " ", "a", "|||", "x" * 10, "a b\n\nc", "漢字"):
        found = quality.statistics(text)
        assert len(found) == len(quality.STATISTICS) and np.isfinite(found).all()


def slow_trees(x, y, trees, depth, bins, rate=0.12, ridge=1.0, least=4.0):
    """Scores of the training rows, with every split of every node tried by itself."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)  # noqa: E731, B023

        def grown(rows, level):
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for limit in edges[f]:
                    left, right = rows[x[rows, f] <= limit], rows[x[rows, f] > limit]  # noqa: B023
                    if h[left].sum() >= least and h[right].sum() >= least:  # noqa: B023
                        gain = worth(left) + worth(right) - worth(rows)  # noqa: B023
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1] is None:
                total[rows] -= rate * g[rows].sum() / (h[rows].sum() + ridge)  # noqa: B023
            else:
                for part in best[1]:
                    grown(part, level + 1)

        grown(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-total))


def test_trees_equal_split_by_split_search():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 5))
    x[:, 3] = np.round(x[:, 3])  # few values, so bins are missing
    y = ((x[:, 0] + x[:, 1] ** 2 + 0.3 * x[:, 3] + 0.3 * rng.normal(size=240)) > 0.8).astype(float)
    model = quality.grow(x, y, trees=12, depth=3, bins=8)
    assert np.allclose(model.score(x), slow_trees(x, y, 12, 3, 8), atol=1e-9)
