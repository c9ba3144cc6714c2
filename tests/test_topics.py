"""The number of mini-batches does not follow the number of documents."""

import pytest

from textloom.models import topics


@pytest.mark.parametrize("documents", [100, 3_000, 100_000, 400_000])
def test_a_pass_has_a_bounded_number_of_batches(spark, monkeypatch, documents):
    asked = {}

    class Recorded:
        def __init__(self, **settings):
            asked.update(settings)

        def fit(self, features):
            return features.count()

    monkeypatch.setattr(topics, "LDA", Recorded)
    assert topics.fit(spark.range(documents), topics=8, passes=5, batch=256) == documents
    assert asked["maxIter"] <= 5 * topics.BATCHES
    assert asked["maxIter"] * asked["subsamplingRate"] == pytest.approx(5, rel=0.05)  # whole passes
    assert asked["subsamplingRate"] * documents >= min(documents, 256)
