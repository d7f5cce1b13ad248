"""Importance resampling beside plain arithmetic."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veracell.functions.session import cut_lineage
from veracell.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    s, t = counts([x for _, x in docs]), counts(target)
    big, small = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for i, text in docs:
        n, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small)))
                for b in (zlib.crc32(x.encode()) % 10000 for x in f)]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append((i, n, len(f), weight, weight + math.floor(
            -1000 * math.log(-math.log((h + .5) / 4294967296)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0, r[2]) for r in rows if r[1] >= 20)
    k = percent * len(fit) // 100
    place = {key: n + 1 for n, key in reversed(list(enumerate(fit[:k])))}
    return sorted(((r[0], *r[2:5], place.get((-r[4], r[0] is None, r[0] or 0, r[2]))
                    if r[1] >= 20 else None) for r in rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = "the of Ähre x1 — don't 中文 stop. Apache".split() + ["q" * 40, "é" * 30]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return made + [(200, None), (201, ""), (202, "a" * 5000), (None, " ".join(["the of"] * 20)),
                   (203, "x " * 3000)]


def test_rows_are_those_of_plain_arithmetic(spark, rows):
    target = ["the of stop", None, "Apache x1 the of of"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns(
        {c: F.lit(2) for c in ("weight", "score", "pos", "rank", "k_score", "n_words", "bucket")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for pivots in (24, 1):
        got = [tuple(r) for r in resampling.resample(docs, bench, pivots=pivots).collect()]
        assert sorted(got, key=repr) == plain(rows, target)


@pytest.mark.parametrize("piece", [1 << 20, 64, 7])
def test_features_do_not_depend_on_the_pieces(rows, piece):
    import pyarrow as pa
    texts = pa.array([t or "" for _, t in rows])
    got = [(d, c) for doc, crc, _ in resampling.features(texts, piece)
           for d, c in zip(doc.tolist(), crc.tolist())]
    want = [(i, zlib.crc32(f.encode())) for i, (_, t) in enumerate(rows) for f in features(t)[1]]
    assert sorted(got) == sorted(want)


def test_repeated_rows_and_ties(spark):
    text = " ".join(["w"] * 30)
    docs = spark.createDataFrame([(5, text)] * 40 + [(6, text)] * 3, "doc_id long, text string")
    out = resampling.resample(docs, docs.limit(0)).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"] is not None)
    assert len(out) == 43 and ranks == list(range(1, 11))
    assert resampling.resample(docs.limit(0), docs).collect() == []


def test_quickselect_finds_every_rank(spark):
    rng = random.Random(2)
    data = [(-rng.randint(0, 9), i % 7 == 0, None if i % 7 == 0 else rng.randint(0, 5),
             rng.randint(0, 2), i) for i in range(200)]
    df = cut_lineage(spark.createDataFrame(
        data, "k_score long, k_null boolean, doc_id long, n_features long, pos long"))
    order = sorted(data, key=lambda r: (r[0], r[1], r[2] or 0, r[3], r[4]))
    for k in (1, 2, 77, 199, 200):
        assert tuple(resampling.kth_key(df, k, pivots=5)) == order[k - 1]
    assert resampling.kth_key(df, 0) is None and resampling.kth_key(df, 201) is None
