"""Token alignment beside whole-text tokenization and plain loops."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veracell.llm import alignment

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
ZERO = (0, 0, 0, 0, "", 0, 0)


def plain(texts):
    """The digest columns of every text, from one call of each library a text."""
    a_lib, b_lib = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(
        model_file=B_PATH)
    a_lib.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a_lib.get_vocab(
        with_added_tokens=False).items() if all(c in letters for c in t)}

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace(
            "▁", " ").encode()

    found, docs = [], Counter()
    for text in texts:
        links, row = Counter(), None
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            if b"".join(map(a_bytes.get, a)) == (" " + text).encode() == b"".join(map(b_bytes, b)):
                ends_a = np.cumsum([len(a_bytes[i]) for i in a])
                ends_b = np.cumsum([len(b_bytes(i)) for i in b])
                groups = []
                for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    start = groups[-1][0] if groups else 0
                    groups.append((cut, [i for i, e in zip(a, ends_a) if start < e <= cut],
                                   [i for i, e in zip(b, ends_b) if start < e <= cut]))
                for _, x, y in groups:
                    links.update((p, q) for p in x for q in y)
                line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y))
                                for _, x, y in groups)
                row = (len(a), len(b), len(groups), sum(links.values()),
                       hashlib.sha256(line.encode()).hexdigest())
                docs.update(links.keys())
        found.append((row, links))
    best = {}
    for (p, _), n in docs.items():
        best[p] = max(best.get(p, 0), n)
    return [ZERO if row is None else (*row, sum(t for (p, q), t in links.items() if docs[p, q] ==
            best[p]), sum(t * docs[k] for k, t in links.items())) for row, links in found]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ("the of Ähre x1 — don't 中文字 stop. <|endoftext|> </s> <0x41> 𐍈𐍉 \x00 é a‍b "
             "ﬁ İ 's").split(" ")
    gaps = [" ", " ", " ", "  ", "\n", "\t ", "　 ", "\x1c ", " \x1d", "\u0085 "]
    made = [rng.choice(["", "", " ", "\n", "\x1c"]) + "".join(
        rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))
        for _ in range(120)]
    return made + [None, "", " ", "   ", "\n", "a" * 3000, "▁", "x▁y", "the cat " * 50,
                   "the cat " * 50, "good text", "good text"]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("common", [alignment.COMMON, 40])
def test_digest_is_that_of_plain_loops(spark, texts, common):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("pairs", "times", "pair", "n", "best", "__pos", "groups")})
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digest(
        df.repartition(3), A_PATH, B_PATH, common=common).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_long_texts_are_taken_apart(spark, texts):
    rng = random.Random(5)
    long = " ".join(rng.choice([t for t in texts if t and "▁" not in t]) for _ in range(60))
    df = spark.createDataFrame([(None, long)], "doc_id long, text string")
    whole, parts = (alignment.token_groups(df, A_PATH, B_PATH, piece=p).first()
                    for p in (1 << 20, 500))
    assert whole == parts
    assert (whole.n_a, whole.n_b, whole.n_groups, whole.n_links) == plain([long])[0][:4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digest(df, A_PATH, B_PATH).collect() == []
