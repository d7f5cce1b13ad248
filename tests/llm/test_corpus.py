"""Corpus operators beside plain versions, on small texts with every odd case."""
import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from veracell.llm import (chat_format, classifier, contamination, context_mixing,  # noqa: E402
                          licenses, near_duplicates, packing, quality_rules, queries, repeats,
                          textbatch, token_counts)
from veracell.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in Ähre mit ça licence ñandú 中文 don't x1 — stop. (more) Apache GNU".split()
# Extra columns whose names clash with those the operators use inside.
EXTRA = {"key": 1, "rep": 2, "group": "g", "n": 3, "h1": 4, "starts": 5, "score": 0.5, "part": 6,
         "kept": "k", "labels": "l", "copied": True, "text2": "t", "component": 9}


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".\n", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [text(rng, rng.randint(1, 120)) for _ in range(25)]
    long = text(rng, 9000)
    passage = text(rng, 150)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100, None), (101, ""), (102, "   \n\t "), (103, "one two"), (104, "One  TWO"),
            (105, long), (106, long + " tail"), (107, base[3]), (108, base[3]), (108, base[3]),
            (109, base[4] + " " + passage + " " + base[5]), (110, base[6] + passage),
            (111, passage + passage), (112, "a" * 1500), (113, "ab" * 900 + "x"),
            (114, "<|endoftext|> a<|startoftext|>b 'twas we'll  'RE x\x1cy"),
            (115, "Licensed under the Apache License, Version 2.0. MIT License; cc by, "
                  "SPDX-License-Identifier: GPL-3.0-only gnu general public license"),
            (116, "\x00zero\x00 byte"), (117, "é É ﬁ İstanbul")]
    words = base[7].split()
    for k in range(12):  # a group of near copies, linked in a chain
        words[(7 * k) % len(words)] = f"w{k}"
        out.append((200 + k, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = ["doc_id", "text", "lang", "source"]
    langs = [None, "en", "de"]
    data = [(d, t, langs[i % 3], f"s{i % 4}" if i % 5 else None) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert df.columns == names
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def got(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_words_and_hashes_follow_the_text():
    t = pa.array(["a b", None, "", " c\td ", "é"], pa.large_string())
    data, offsets = textbatch.flat(textbatch.text_array(t))
    s, e, d = textbatch.words(data, offsets, textbatch.PLAIN_WORD)
    assert [(bytes(data[x:y]).decode(), k) for x, y, k in zip(s, e, d)] == [
        ("a", 0), ("b", 0), ("c", 3), ("d", 3), ("é", 4)]
    h = textbatch.span_hash(textbatch.prefix_hash(np.frombuffer(b"xyabzab", np.uint8)),
                            np.array([2, 5]), np.array([4, 7]))
    assert h[0] == h[1]


def _pieces(spark, df, rows, length=64):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), length)
    r = pieces.collect()
    want = Counter()
    ids = {}
    for d, t in rows:
        ids[d] = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[d] += len(ids[d])
    have = Counter()
    places = {}
    for p in r:
        have[p.doc_id] += p.length
        assert list(np.frombuffer(p.ids, "<u4")) == ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id])
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert have == want
    sizes = []
    for q in places.values():
        at = 0
        for o, n in sorted(q):
            assert o == at
            at += n
        sizes.append(at)
    assert sorted(sizes)[1:] == [length] * (len(sizes) - 1)
    return pieces


def test_packing(spark, docs, rows):
    pieces = _pieces(spark, docs.repartition(5), rows)
    whole = packing.sequences(pieces, 64).collect()
    for s in whole:
        n = s.n_tokens
        assert len(s.ids) == 4 * (n if n & (n - 1) == 0 else 64)


def test_word_encoder_past_its_memory(rows, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    for _ in range(2):
        for d, t in rows:
            ids, n = enc.encode(*textbatch.flat(pa.array([t or ""], pa.large_string())))
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids + [1]


def test_licenses(docs, rows):
    r = {x.doc_id: x for x in licenses.scan_licenses(docs).collect()}
    for d, t in rows:
        x = r[d]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == \
            brute.license_base(t, licenses.BASE)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert 0 <= x.score <= 1
    assert {"apache", "apache-2.0", "mit", "cc-by", "gpl", "gpl-3.0"} <= set(
        r[115].labels.split(","))
    assert len(licenses.rules()) > 300
    rules = licenses.rules()
    assert all(a[0] >= b[0] for a, b in zip(rules, rules[1:]))


def test_contained_detections_are_suppressed():
    d = [(50, 5, 20, "low", .5), (70, 0, 25, "high", .5), (50, 24, 40, "apart", .5),
         (70, 0, 25, "tie", .5)]
    assert [x[3] for x in licenses.resolve(d)] == ["high", "apart"]


@pytest.mark.parametrize("small_node", [512, 2])
def test_near_duplicates(docs, rows, small_node, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TIGHT", 0.7 if small_node > 2 else 1.0)
    same(got(near_duplicates.near_duplicates(docs.repartition(3), small_node=small_node)),
         brute.near(rows))


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 200)
    same(got(near_duplicates.near_duplicates(docs)), brute.near(rows))


def test_null_ids_are_kept(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    same(got(near_duplicates.near_duplicates(df)), [(None, 2, None, True), (1, 2, 1, True)])


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + rng.randint(1, 50)) for _ in range(90)]
    edges += [(7, 7), (300, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = [(v, find(v)) for v in list(parent)]
    same(got(connected_components(spark.createDataFrame(edges, "a long, b long"))), want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_context_mixing(docs, rows):
    held = queries.fold(10) == 0
    model = context_mixing.fit(docs.where(~held))
    r = sorted(context_mixing.score_texts(docs.repartition(3), model, held).collect(),
               key=lambda x: (x.doc_id, x.score))
    c = Counter()
    for d, t in rows:
        if brute.fold(d, 10):
            c.update([*brute.PLAIN.findall(brute.low(t)), ""])
    n, v = sum(c.values()), len(c)
    for x, (d, t) in zip(r, sorted(rows, key=lambda x: (x[0], repr(x[1])))):
        w = [*brute.PLAIN.findall(brute.low(t)), ""]
        assert (x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (
            d, brute.fold(d, 10) == 0, len(w), sum(c[y] > 0 for y in w), n)
        assert x.base_score == pytest.approx(
            sum(math.log10((c[y] + .1) / (n + .1 * (v + 1))) for y in w))
        assert x.score < 0
    # What was learned is likelier than noise of the same length.
    by = {x.doc_id: x.bits_per_byte for x in r}
    assert by[105] < by[117]


def test_base_lists_are_bounded(spark, monkeypatch):
    """A word that every text has is in no list: no task gets more of them than of other words."""
    monkeypatch.setattr(context_mixing, "COMMON", 16, raising=False)
    monkeypatch.setattr(context_mixing, "BUCKET", 256, raising=False)
    written = []

    def cut(df, real=context_mixing.cut_lineage):
        written.append(real(df))
        return written[-1]

    monkeypatch.setattr(context_mixing, "cut_lineage", cut)
    texts = [f"the a{i} the b{i % 97} c{i % 50} {'d' * (i % 3)}" for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 10 == 0
    model = context_mixing.Model({o: np.ones((1 << b, 2), np.uint16)
                                  for o, b in context_mixing.BITS.items()})
    r = {x.doc_id: x for x in context_mixing.score_texts(df, model, held).collect()}
    c = Counter(w for i, t in enumerate(texts) if i % 10 for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*t.split(), ""]
        assert (r[i].n_tokens, r[i].n_known, r[i].train_tokens) == (
            len(w), sum(c[y] > 0 for y in w), n)
        assert r[i].base_score == pytest.approx(
            sum(math.log10((c[y] + .1) / (n + .1 * (v + 1))) for y in w))
    lists = next(x for x in written if "bucket" in x.columns).where("bucket >= 0").groupBy(
        "bucket").agg(F.sum(F.octet_length("docs") / 4).alias("n")).collect()
    assert len(lists) > 8 and max(x.n for x in lists) < 1000


def test_bit_predictions_sum_to_one():
    model = context_mixing.Model({o: np.random.default_rng(1).integers(
        0, 3, (1 << b, 2)).astype(np.uint16) for o, b in context_mixing.BITS.items()})
    u = (np.uint64(0x6162636465) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert (10 ** model.log10(u)).sum() == pytest.approx(1, abs=1e-4)


def test_classifier(spark, docs, rows):
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in rows] + [(0, None, 0)],
                                   "doc_id long, quality int, toxic int")
    net = classifier.fit_classifier(docs, labels, queries.fold(4) != 2)
    r = docs.select("doc_id", classifier.quality_score(net).alias("p")).collect()
    assert len(r) == len(rows) and all(0 <= x.p <= 1 for x in r)
    only = classifier.fit_classifier(docs, labels.where("quality = 1"), F.lit(True))
    assert {r[0] for r in docs.select(classifier.quality_score(only)).collect()} == {1.0}
    none = classifier.fit_classifier(docs.where("1 = 0"), labels, F.lit(True))
    assert docs.where("1 = 0").select(classifier.quality_score(none)).collect() == []


def test_classifier_gradient():
    net = classifier.Network()
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (7, classifier.CHUNK)).astype(np.uint8)
    first, y, w = np.array([0, 2, 6]), np.array([0, 1, 1]), np.array([1., 2., 1.])

    def loss():
        t = np.einsum("be,kef->kbf", net.p["embed"], net.p["filters"])
        pooled = net.pool(x, t)
        z = net.combine(pooled, first) @ net.p["out"] + net.p["out_bias"][0]
        return float(((np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)) * w).sum()
                     / w.sum())

    g = net.gradient(x, first, y, w)
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-4
        up = loss()
        net.p[k][at] = was - 1e-4
        down = loss()
        net.p[k][at] = was
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=0.05, abs=1e-5)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    df = queries.QUERIES["op5_quality_classifier"](spark, sf)
    both = df.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hit = {r.quality: r.p for r in both.groupBy("quality").agg(
        F.avg("predicted").alias("p")).collect()}
    assert hit[1] > 0.98 and hit[0] < 0.1


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        s, e, d = classifier.chunks(np.zeros(n, np.uint8), np.array([0, n]))
        assert s[0] == 0 and e[-1] == n and (s[1:] < e[:-1]).all() and (e - s <= 256).all()


def test_repeats(docs, rows):
    same(got(repeats.remove_repeats(docs.repartition(4))), brute.repeats(rows))


@pytest.mark.parametrize("options", [
    {"hot": 1}, {"hot": 2}, {"hot": 1, "widths": (1,)}, {"hot": 3, "piece": 1000},
    {"piece": 700}])
def test_repeats_of_hot_anchors_and_in_pieces(docs, rows, options):
    want = {d: x for d, _, *x in brute.repeats(rows)}
    starts = repeats.repeated_starts(docs, **options)
    texts = docs.select("doc_id", "text", repeats.text_key(F.col("text")).alias("k")).select(
        "doc_id", "text", "k.h1", "k.h2").join(starts, ["h1", "h2"])
    for r in texts.collect():
        spans = repeats.removed_spans([(s.a, s.z) for s in r.starts], 400)
        if sum(t == r.text for _, t in rows) == 1:
            assert sum(b - a for a, b in spans) == want[r.doc_id][0]


def test_a_passage_of_very_many_texts_is_split(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(520))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60)))
             + passage[i % 3:] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 60))))
            for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: x for d, _, x, *_ in brute.repeats(rows)}
    for hot in (5, 40):
        starts = repeats.repeated_starts(df, hot=hot)
        found = {}
        for r in df.select("doc_id", repeats.text_key(F.col("text")).alias("k")).select(
                "doc_id", "k.h1", "k.h2").join(starts, ["h1", "h2"]).collect():
            found[r.doc_id] = sum(b - a for a, b in repeats.removed_spans(
                [(s.a, s.z) for s in r.starts], 400))
        assert found == {d: n for d, n in want.items() if n}


def test_repeats_of_other_lengths(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(got(repeats.remove_repeats(df, length=200)), brute.repeats(rows, 200))


def test_passages_of_over_50_words_are_told_whatever_their_bytes(spark):
    rng = random.Random(12)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(n))
    longer, just, less, common = words(51), words(51), words(50), words(60)
    texts = [f"{words(30)} {longer} {words(40)}", f"{words(9)}\n{longer.replace(' ', '  ')}",
             f"{just}", f"{words(80)} {just}", f"{words(5)} {less} x", f"{words(5)} {less} y",
             f"{common} {words(3)} {common}", f"{words(9)} {longer[:-1]}", just, words(500),
             None, "", "a " * 200, "a " * 60, "a " * 50]
    texts += [f"{words(i % 4)} {common} {words(3 - i % 4)}" for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeats.remove_repeats(docs, passage_words=51)
    want = [(*r, n) for r, n in zip(brute.repeats(rows), brute.passage_words(rows))]
    same(got(out), want)
    assert [n for *_, n in want[:6]] == [51, 51, 51, 51, 0, 0] and want[0][2] == 0


@pytest.mark.parametrize("options", [{}, {"piece": 97}, {"gram": 1}])
def test_passages_of_words(docs, spark, rows, options):
    rng = random.Random(6)
    blocks = [" ".join(rng.choice("abc") for _ in range(rng.randint(20, 90))) for _ in range(9)]
    mixed = list({" ".join(rng.choice(blocks) for _ in range(rng.randint(1, 4)))
                  for _ in range(60)})
    for some in (rows, list(enumerate(mixed))):
        df = spark.createDataFrame(some, "doc_id long, text string")
        found = {(r.h1, r.h2): r.n_shared for r in repeats.shared_words(df, **options).collect()}
        seen = Counter(t for _, t in some)
        for r, (_, t), n in zip(df.select(repeats.text_key(F.col("text")).alias("k")).collect(),
                                some, brute.passage_words(some)):
            if seen[t] == 1:
                assert found.get((r.k.h1, r.k.h2), 0) == n


def test_words_of_a_long_text_are_hashed_in_stretches():
    data = np.frombuffer((" ".join(map(str, range(5000))) + " " + "x" * 4000 + "\n y ").encode(),
                         np.uint8)
    ends = np.array([0, len(data)])
    whole, parts = (textbatch.word_hashes(data, ends, n)[0] for n in (1 << 20, 700))
    assert len(whole) == 5002 and (whole == parts).all()


def test_op6_tells_passages(spark):
    assert "n_passage_words" in queries.QUERIES["op6_repeats"](spark, SF).columns


def test_repeats_with_names_of_its_own(docs, rows):
    odd = docs.withColumns({c: F.lit(1) for c in ("row", "k", "__k", "__starts", "f", "found")})
    assert repeats.without_repeats(odd).count() == len(rows)


def test_repeats_at_random(spark):
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefgh "):
        blocks = ["".join(rng.choice(alphabet) for _ in range(rng.randint(80, 700)))
                  for _ in range(12)]
        rows = [(i, "".join(rng.choice(blocks) for _ in range(rng.randint(1, 4))))
                for i in range(25)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        same(got(repeats.remove_repeats(df)), brute.repeats(rows))


def test_repeats_are_cut_from_texts(docs, rows):
    want = {d: x.decode("utf-8", "ignore") for d, *_, x in brute.cut(rows)}
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    r = out.select("doc_id", "text").collect()
    assert len(r) == len(rows)
    assert all((x.text or "") == want[x.doc_id] for x in r)


def test_chat(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    r = chat_format.chat_digest(conv).collect()
    assert len(r) == conv.select("conv_id").distinct().count()
    assert sum(x.n_right for x in r) > 0.9 * sum(x.n_lines for x in r)
    assert all(x.system_lines + x.user_lines + x.assistant_lines == x.n_lines for x in r)


def test_chat_in_chunks_is_the_same_path(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet").withColumn(
        "conv_id", F.floor(F.col("conv_id") / 6)).withColumn("turn", F.col("turn") + 10 * (
            F.crc32(F.col("text").cast("binary")) % 30))
    paths = []
    for n in (1 << 40, 3):
        chunks = chat_format.chunked(conv, chat_format.styled_line(), chunk_turns=n)
        model = chat_format.learn(chat_format.chunked(conv, chat_format.styled_line()))
        paths.append(got(chat_format.parse(chunks, model).groupBy("conv_id").agg(F.flatten(
            F.sort_array(F.collect_list(F.struct("chunk", "path"))).path))))
    same(*paths)


def test_chat_odd_rows(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "hi?"), (1, 0, "user", "hi?"), (1, None, None, None), (None, 0, "robot", ""),
         (2, 5, "assistant", "x\n\ny"), (3, 0, "system", "a" * 100_000)],
        "conv_id long, turn int, role string, text string").withColumn("chunk", F.lit("c"))
    r = chat_format.chat_digest(conv).collect()
    assert {x.conv_id: x.n_lines for x in r} == {1: 3, None: 1, 2: 3, 3: 1}
    assert chat_format.chat_digest(conv.where("1 = 0")).count() == 0


def test_quality_rules(docs, rows):
    r = quality_rules.judge(docs).collect()
    same([(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words,
           x.base_failed) for x in r], [(d, *brute.quality_counts(t)) for d, t in rows])
    assert not any(x.kept and x.base_failed for x in r)


def test_sketches_merge_and_bound_the_error(spark):
    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, 0.1, 4000)
    df = spark.createDataFrame([(int(i % 3), *[float(x)] * len(quality_rules.MEASURES))
                                for i, x in enumerate(v)],
                               ["g", *quality_rules.MEASURES])
    merged = quality_rules.merge(quality_rules.sketch(df, ["g"]), [])
    same(got(merged), got(quality_rules.merge(quality_rules.sketch(df, []), [])))
    f = quality_rules.fences(merged.withColumn("all", F.lit(1)), ["all"]).first()
    q1, q3 = np.quantile(v, [.25, .75])
    assert f.symbol_share_fence == pytest.approx(q3 + 4 * (q3 - q1), rel=0.08)


def test_contamination(spark, docs, rows):
    items = [(1, rows[0][1]), (2, rows[9][1]), (3, " ".join(rows[105 - 105][1].split()[2:30])),
             (4, None), (5, ""), (6, "one two"), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    want = brute.contained(rows, items)
    same([x[:4] for x in got(contamination.contained_items(docs, df))], want)
    assert got(contamination.contained_items(docs, df.where("1 = 0"))) == []
    bad = {d for _, d, *_ in want}
    assert {r.doc_id for r in contamination.without_items(docs, df).collect()} == {
        d for d, _ in rows} - bad


def test_contamination_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_SHINGLES", 50)
    items = [(i, t) for i, t in rows[:12]]
    df = spark.createDataFrame(items, "item_id long, text string")
    same([x[:4] for x in got(contamination.contained_items(docs, df))],
         brute.contained(rows, items))


def test_token_counts(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same(got(token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))),
         [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)))
          for d, t in rows])


def test_token_counts_of_odd_strings():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    alphabet = "abstmdrvle'''  \t\n 　é!?19²日\x1c\x85́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(4000)]
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert c.count(texts).tolist() == want


def test_character_classes_are_those_of_the_library():
    from tokenizers.pre_tokenizers import ByteLevel
    split = ByteLevel(add_prefix_space=False, use_regex=True)
    table, names, bad = token_counts.class_table(split), token_counts.CLASSES, []
    for c in [*range(0xD800), *range(0xF900, 0x11000), *range(0x1D000, 0x1F000), 0x20000]:
        kind = names[table[c]]
        kind = {"quote": "other", "space": "blank"}.get(kind, kind)
        kind = "letter" if kind in "stmdrvle" else kind
        one = [k for k, x in (("letter", "a"), ("number", "1"), ("other", "!"))
               if len(split.pre_tokenize_str(x + chr(c) + x)) == 1]
        if (one or ["blank"]) != [kind]:
            bad.append(hex(c))
    assert bad == []


@pytest.mark.parametrize("run", [
    lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    licenses.scan_licenses, near_duplicates.near_duplicates, repeats.remove_repeats,
    repeats.without_repeats, quality_rules.judge,
    lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    lambda d: context_mixing.score_texts(d, context_mixing.fit(d), F.lit(False)),
    lambda d: d.select(classifier.quality_score(classifier.Network()))])
def test_empty_tables(empty, run):
    assert got(run(empty)) == []


def test_pipeline_of_an_empty_table(spark, monkeypatch):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: real.where("1 = 0")
                        if n == "documents" else s.read.parquet(f"{d}/{n}.parquet"))
    assert corpus_pipeline.run(spark, SF).collect() == []


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = random.Random(4)

    def words(n, size=5):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(size))
                        for _ in range(n))
    passage = words(51)
    rows = [(i, f"{words(60)} {passage} {words(60)}", "en", "s", 0) for i in range(4)] + [
        (9, words(120), "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.repeated_bytes(spark, df, SF).collect()}
    assert all(passage not in out[i].text and len(out[i].text) > 600 for i in range(4))
    assert out[9].text == rows[-1][1] and all(r.n_chars == len(r.text) for r in out.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near duplicates", "repeated bytes",
                            "decontamination", "packing"]
    one = stages["quality classifier"](spark, docs, SF).cache()
    assert one.columns == columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = stages["near duplicates"](spark, one, SF).cache()
    assert two.columns == columns
    kept = {d for d, _, _, k in brute.near(rows) if k}
    assert sorted(r.doc_id for r in two.collect()) == sorted(kept)
    three = stages["repeated bytes"](spark, two, SF).cache()
    assert three.columns == columns
    want = {d: x.decode("utf-8", "ignore") for d, *_, x in brute.cut(
        [r for r in rows if r[0] in kept], corpus_pipeline.PASSAGE_BYTES)}
    got_ = {r.doc_id: r.text for r in three.collect()}
    assert got_ == want
    four = stages["decontamination"](spark, three, SF).cache()
    assert four.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(
        "item_id", "text").collect()]
    bad = {d for _, d, *_ in brute.contained(list(got_.items()), items)}
    left = [(r.doc_id, r.text) for r in four.collect()]
    assert {d for d, _ in left} == set(got_) - bad
    _pieces(spark, four, left, 2048)
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == len(left)
