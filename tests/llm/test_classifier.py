"""The classifier learns from the whole of long texts."""
import numpy as np
from pyspark.sql import functions as F

from veracell.llm import classifier, textbatch


def long_texts(n_texts=160, n_chunks=60, few=12):
    """Letters only, but for digits in texts of label 1, in none of the ``few`` chunks that come
    first by the hash of their place."""
    rng = np.random.default_rng(5)
    place = np.arange(n_chunks) * classifier.STEP
    late = np.argsort(textbatch.mix64(place.astype(np.uint64)))[few:]
    out = []
    for i in range(n_texts):
        t = rng.integers(97, 123, n_chunks * classifier.STEP + 32).astype(np.uint8)
        if i % 2:
            for s in place[late]:
                t[s + 40:s + 200] = rng.integers(48, 58, 160)
        out.append((i, t.tobytes().decode(), i % 2))
    return out


def test_late_parts_of_long_texts_are_learned(spark):
    df = spark.createDataFrame(long_texts(), "doc_id long, text string, quality int")
    net = classifier.fit_classifier(df, df, F.lit(True))
    score = {r.quality: r.p for r in df.select(
        "quality", classifier.quality_score(net).alias("p")).groupBy("quality").agg(
        F.avg("p").alias("p")).collect()}
    assert score[1] > 0.9 and score[0] < 0.1


def test_gradient_does_not_depend_on_slabs(monkeypatch):
    rng = np.random.default_rng(1)
    x = classifier.Chunks([rng.integers(32, 127, n).astype(np.uint8) for n in (0, 90, 7000, 300)])
    net, y, w = classifier.Network(), np.array([0, 1, 1, 0]), np.array([1., 2., 1., 1.])
    whole = net.gradient(x[:], x.first, y, w)
    monkeypatch.setattr(classifier, "POOLED", 3)
    slabs = net.gradient(x, x.first, y, w)
    for k in whole:
        np.testing.assert_allclose(slabs[k], whole[k], rtol=1e-6, atol=1e-9)
