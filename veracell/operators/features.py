"""Feature matrix: imputed numbers, one-hot levels, text shape, TF-IDF components, standardised.

The layout (names, medians, levels, vocabulary) is metadata; the matrix itself is a DataFrame
``(row_id, x array<double>)`` built by projection, plus one join per text column for counts.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veracell.functions import values as V
from veracell.functions.arrow import arrays, matrix, text_slabs
from veracell.functions.hashing import fingerprint
from veracell.functions.joins import join_group_facts
from veracell.functions.session import cut_lineage, materialise
from veracell.functions.stop_words import STOP_WORDS
from veracell.operators.quantiles import quantiles

MAX_LEVELS = 50
MAX_DUMMIES = 20
MAX_TEXT_COLUMNS = 10
MISSING = "__MISSING__"


# ---- text expressions --------------------------------------------------------------------------

#: Character classes of the text counts.
_DIGIT, _NUMBER, _LETTER, _UPPER, _SPACE = 1, 2, 4, 8, 16
_SHAPE = ["len", "words", "digits", "letters", "uppers", "spaces", "specials", "entropy"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class bits of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        table[c] = ((_DIGIT if kind == "Nd" else 0) | (_NUMBER if kind[0] == "N" else 0)
                    | (_LETTER if kind[0] == "L" else 0) | (_UPPER if kind == "Lu" else 0)
                    | (_SPACE if kind[0] == "Z" else 0))
    table[[9, 10, 11, 12, 13]] |= _SPACE
    return table


def _entropy(points: np.ndarray) -> float:
    if not len(points):
        return 0.0
    n = np.unique(points, return_counts=True)[1].astype(float)
    return float(np.log2(len(points)) - (n * np.log2(n)).sum() / len(points))


def _shape_of(column: pa.Array) -> np.ndarray:
    """Counts over the code points of whole texts, all texts at once; a row for each of _SHAPE."""
    texts = [t or "" for t in column.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    begin = ends - size
    kinds = _classes()[points]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[begin]

    inside = (kinds & _SPACE) == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin[size > 0]] = inside[begin[size > 0]]
    out = {"len": size, "words": count(first), "digits": count(kinds & _DIGIT > 0),
           "letters": count(kinds & _LETTER > 0), "uppers": count(kinds & _UPPER > 0),
           "spaces": count(~inside), "specials": count(kinds & (_LETTER | _NUMBER | _SPACE) == 0),
           "entropy": [_entropy(points[a:z]) for a, z in zip(begin, ends)]}
    return np.stack([np.asarray(out[c], float) for c in _SHAPE])


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in _SHAPE]))
def _shape(column: pa.Array) -> pa.Array:
    """The counts of a batch, whose texts are taken in slabs of bounded size."""
    parts = [_shape_of(part) for part in text_slabs(column)]
    got = np.concatenate(parts, axis=1) if parts else np.zeros((len(_SHAPE), 0))
    return pa.StructArray.from_arrays(list(map(pa.array, got)), names=_SHAPE)


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    return _shape(text)["entropy"]


def text_shape(text: Column) -> dict[str, Column]:
    """Row-local text features by name."""
    t = F.coalesce(text, F.lit(""))
    got = _shape(t)  # the same call in all columns, so it runs once a row
    size = F.greatest(got["len"], F.lit(1.0))
    return {
        "len": got["len"], "words": got["words"],
        "digit_ratio": got["digits"] / size, "alpha_ratio": got["letters"] / size,
        "upper_ratio": got["uppers"] / size, "space_ratio": got["spaces"] / size,
        "special_ratio": got["specials"] / size, "entropy": got["entropy"],
        "is_empty": (F.length(t) == 0).cast("double"),
        "looks_numeric": V.strip(t).rlike(r"^[\d.\-+eE,]+$").cast("double"),
        "has_date_pattern": t.rlike(r"\d{2,4}[-/]\d{1,2}[-/]\d{1,2}").cast("double"),
    }


def value_print(df: DataFrame, column: str) -> Column:
    return fingerprint(F.coalesce(V.as_text(df, column), F.lit("")))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """Add ``value_freq`` and ``is_rare``.

    Values are counted by a 128-bit fingerprint, so the exchanged tables hold no text; a hot value
    is one line of the counts, and frequent lines are broadcast.
    """
    hashed = df.withColumn("__h", value_print(df, column))
    counts = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    out = join_group_facts(hashed, counts, "__h", df.count())
    return out.withColumn("value_freq", F.col("n").cast("double")) \
        .withColumn("is_rare", (F.col("n") == 1).cast("double")).drop("__h", "n")


# ---- TF-IDF ------------------------------------------------------------------------------------

_WORD = re.compile(r"\w+")


@dataclass
class Vocabulary:
    terms: list[str]
    idf: list[float]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with their occurrences and texts, added up within a batch."""
    for b in batches:
        tf, docs = Counter(), Counter()
        for part in text_slabs(b.column(0)):
            for text in part.to_pylist():
                found = _WORD.findall(text.lower())
                tf.update(found)
                docs.update(set(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tf), pa.string()), pa.array(list(tf.values()), pa.int64()),
             pa.array([docs[t] for t in tf], pa.int64())], names=["term", "tf", "docs"])


def vocabulary(df: DataFrame, column: str, most: int = 20, least_docs: int = 2) -> Vocabulary:
    """The commonest terms but stop words with their smooth idf: one counting shuffle, a top-k."""
    text = F.coalesce(V.as_text(df, column), F.lit(""))
    top = (df.select(text.alias("t")).mapInArrow(_terms, "term string, tf long, docs long")
           .groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs"))
           .where((F.col("docs") >= least_docs) & ~F.col("term").isin(["", *STOP_WORDS]))
           .orderBy(F.desc("tf"), "term").limit(most).collect())
    n = df.count()
    top = sorted(top, key=lambda r: r["term"])
    return Vocabulary([r["term"] for r in top],
                      [float(np.log((1 + n) / (1 + r["docs"])) + 1) for r in top])


def _weights(texts: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """L2-normalised TF-IDF of each text; without terms of the vocabulary all zero."""
    at = {t: i for i, t in enumerate(vocab.terms)}
    tf = np.zeros((len(texts), len(at)))
    for row, text in enumerate(texts.to_pylist()):
        for word in _WORD.findall((text or "").lower()):
            i = at.get(word)
            if i is not None:
                tf[row, i] += 1
    x = tf * np.array(vocab.idf)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def tfidf(text: Column, vocab: Vocabulary, basis: np.ndarray | None = None) -> Column:
    """The TF-IDF vector of a text over the vocabulary, or its coordinates in a basis; row-local."""
    if not vocab.terms:
        return F.array().cast("array<double>")

    @F.arrow_udf("array<double>")
    def vector(column: pa.Array) -> pa.Array:
        parts = [_weights(part, vocab) for part in text_slabs(column)]
        x = np.concatenate(parts) if parts else np.zeros((0, len(vocab.terms)))
        return arrays(x if basis is None else x @ basis)
    return vector(text)


def with_tfidf(df: DataFrame, column: str, vocab: Vocabulary, out: str) -> DataFrame:
    return df.withColumn(out, tfidf(V.as_text(df, column), vocab))


def gram_matrix(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, column sums, X'X) of an array column; partitions add up before the exchange."""
    def partial(batches):
        n, s, g = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            flat = np.concatenate([[float(n)], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([arrays(flat[None, :])], ["v"])

    parts = df.select(vec).mapInArrow(partial, "v array<double>")
    rows = (parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
            .collect())
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["i"]] = r["v"]
    d = int(round((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2))
    return int(flat[0]), flat[1:1 + d], flat[1 + d:].reshape(d, d)


def eigen(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs, largest first, each vector signed so that its largest loading is positive."""
    w, v = np.linalg.eigh((sym + sym.T) / 2)
    w, v = w[::-1], v[:, ::-1]
    lead = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return w, v * np.where(lead < 0, -1.0, 1.0)


def svd_basis(df: DataFrame, column: str, vocab: Vocabulary, most: int = 5) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix from its small Gram matrix."""
    _, _, g = gram_matrix(with_tfidf(df.select(V.col(column)), column, vocab, "v"), "v")
    _, basis = eigen(g)
    return basis[:, :min(most, len(vocab.terms) - 1)]


def with_components(df: DataFrame, column: str, vocab: Vocabulary, basis: np.ndarray,
                    out: str) -> DataFrame:
    return df.withColumn(out, tfidf(V.as_text(df, column), vocab, basis))


# ---- layout and matrix -------------------------------------------------------------------------

@dataclass
class Layout:
    """What each feature is; ``sources`` names the table column behind it."""
    names: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    numeric: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    texts: dict[str, tuple] = field(default_factory=dict)
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)


def text_columns(profile: list, most: int = MAX_TEXT_COLUMNS) -> list[str]:
    """Free text, identifiers, and categoricals with too many levels to one-hot."""
    return [p["column_name"] for p in profile
            if p["dtype"] in ("free_text", "identifier")
            or (p["dtype"] == "categorical" and p["unique_count"] > MAX_LEVELS)][:most]


def level_lists(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted levels per column, a null being its own level."""
    from veracell.operators.profile import value_counts
    if not columns:
        return {}
    rows = value_counts(df, {c: F.coalesce(V.as_text(df, c), F.lit(MISSING)) for c in columns}) \
        .select("column_name", "value").collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column_name"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def plan_features(df: DataFrame, profile: list, with_text: bool = True) -> Layout:
    """Decide the features from a collected column profile (one line per column)."""
    lay = Layout()
    numeric = [p["column_name"] for p in profile if p["dtype"] == "numeric"]
    cats = [p["column_name"] for p in profile
            if p["dtype"] == "categorical" and p["unique_count"] <= MAX_LEVELS]
    med = {p["column_name"]: p["median"] for p in profile if p["dtype"] == "numeric"}
    levels = level_lists(df, cats)
    for p in profile:
        c = p["column_name"]
        if c in numeric:
            lay.numeric[c] = med[c] if med[c] is not None else 0.0
            lay.names.append(c)
            lay.sources.append(c)
        elif c in levels and len(levels[c]) - 1 <= MAX_DUMMIES:
            lay.levels[c] = levels[c][1:]
            lay.names += [f"{c}_{v}" for v in levels[c][1:]]
            lay.sources += [c] * (len(levels[c]) - 1)
    for c in text_columns(profile) if with_text else []:
        shape = list(text_shape(F.lit("")))
        names = [f"{c}__{s}" for s in shape + ["value_freq", "is_rare"]]
        vocab, basis = vocabulary(df, c), None
        if len(vocab.terms) >= 2:
            basis = svd_basis(df, c, vocab)
            names += [f"{c}__tfidf_svd_{i}" for i in range(basis.shape[1])]
        lay.texts[c] = (vocab, basis)
        lay.names += names
        lay.sources += [c] * len(names)
    return lay


def raw_features(df: DataFrame, key: str, lay: Layout) -> DataFrame:
    """(row_id, x): every feature before standardising.

    Everything that one row decides is computed first. Where value frequencies must be joined, these
    numbers are written with a fingerprint per text column, so texts are read once and cross no
    exchange.
    """
    singles = {c: F.coalesce(V.number(df, c), F.lit(float(m))) for c, m in lay.numeric.items()}
    prints = {c: f"__h{i}" for i, c in enumerate(lay.texts)}
    local, parts, flat = [], [], []

    def flush():
        if flat:
            local.append(F.array(*flat).alias(f"__p{len(local)}"))
            parts.append(F.col(f"__p{len(local) - 1}"))
            flat.clear()

    for c in dict.fromkeys(lay.sources):
        if c in singles:
            flat.append(singles[c])
        elif c in lay.levels:
            v = F.coalesce(V.as_text(df, c), F.lit(MISSING))
            flat.extend((v == level).cast("double") for level in lay.levels[c])
        else:
            (vocab, basis), text = lay.texts[c], V.as_text(df, c)
            flat.extend(text_shape(text).values())
            flush()
            parts.append(F.col(f"__f{prints[c]}"))
            if basis is not None:
                local.append(tfidf(text, vocab, basis).alias(f"__p{len(local)}"))
                parts.append(F.col(f"__p{len(local) - 1}"))
    flush()
    data = df.select(F.col(key).alias("row_id"), *local,
                     *[value_print(df, c).alias(h) for c, h in prints.items()])
    if prints:
        data = cut_lineage(data)
        total = data.count()
    for h in prints.values():
        counts = data.groupBy(h).agg(F.count(F.lit(1)).alias("n"))
        data = join_group_facts(data, counts, h, total).withColumn(
            f"__f{h}", F.array(F.col("n").cast("double"), (F.col("n") == 1).cast("double"))).drop(
            h, "n")
    x = (F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else F.array(F.lit(0.0))
    bad = lambda v: F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))
    return data.select("row_id", F.transform(
        x, lambda v: F.when(bad(v), 0.0).otherwise(v)).alias("x"))


def standardise(raw: DataFrame, lay: Layout | None = None) -> DataFrame:
    """(x - mean) / population std per position; a flat feature is only centred.

    Means and deviations are kept in the layout if it has none yet, else the kept ones are used.
    """
    if lay is None or not lay.means:
        d = len(raw.select("x").first()["x"])
        row = raw.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d)
                        for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        means = [row[f"m{i}"] for i in range(d)]
        stds = [row[f"s{i}"] or 1.0 for i in range(d)]
        if lay is not None:
            lay.means, lay.stds = means, stds
    else:
        means, stds = lay.means, lay.stds
    stats = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"))
                      for m, s in zip(means, stds)])
    return raw.select("row_id", F.zip_with("x", stats, lambda v, t: (v - t.m) / t.s).alias("x"))


def feature_matrix(df: DataFrame, key: str, profile: list, with_text: bool = True) \
        -> tuple[DataFrame, Layout]:
    lay = plan_features(df, profile, with_text)
    return materialise(standardise(raw_features(df, key, lay), lay), "row_id"), lay


def numeric_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Median-imputed, standardised matrix of the given numeric columns."""
    med = quantiles(df, {c: V.number(df, c) for c in columns}, [0.5])
    lay = Layout(names=list(columns), sources=list(columns),
                 numeric={c: med[c][0] or 0.0 for c in columns})
    return materialise(standardise(raw_features(df, key, lay), lay), "row_id")
