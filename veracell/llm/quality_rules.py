"""Quality rules with adaptive thresholds.

One scan measures every text. The shares are then summed up in mergeable quantile sketches:
logarithmic buckets with a relative error of 2 %, one sketch per language, source and measure,
held as (group, measure, bucket, count) lines, so that merging is adding. From the quartiles of a
group comes its own fence; small groups take the sketch merged over their language, and then over
all rows. The fences are joined back to the measures and decide.

Defined cases: a null text has no words; a null language or source is a group of its own; an empty
table gives no rows; repeated rows are judged each; a text without words fails the base rule.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veracell.functions.joins import join_group_facts
from veracell.functions.session import cut_lineage
from veracell.llm import textbatch as tb

WINDOW = 8
GAMMA = 1.04
#: The smallest spread (q75 - q25) that a fence assumes, per measure, in shares. FENCE times that of
#: repeat_share stays under the 0.30 of the base rule, so that a group's own fence can decide.
MEASURES = {"symbol_share": 0.01, "upper_share": 0.04, "mark_share": 0.02,
            "dup_line_share": 0.05, "repeat_share": 0.05, "stutter_share": 0.04}
FENCE = 4.0
MIN_GROUP = 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER
_POINT = tb.PLAIN_WORD.copy()
_POINT[0x80:0xC0] = False  # continuation bytes do not begin a code point


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[offsets])


def _repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the key is found more than once in its text."""
    mine = tb.mix64(keys ^ (group.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    _, inverse, counts = np.unique(mine, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def measure_slab(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, doc = tb.words(data, offsets, tb.PLAIN_WORD)
    prefix = tb.prefix_hash(data)
    n_words = np.bincount(doc, minlength=n)

    breaks = np.flatnonzero(data == 10) + 1
    begin = np.unique(np.concatenate([offsets[:-1], breaks]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    stop = stop - (data[stop - 1] == 10) if len(stop) else stop
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[worded], stop[worded]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    lines = tb.mix64(tb.span_hash(prefix, begin, stop)
                     ^ (line_doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    _, first = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup = n_lines - np.bincount(line_doc[first], minlength=n)

    hashed = tb.span_hash(prefix, starts, ends)
    same = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    n_stutter = np.bincount(doc[1:][same], minlength=n)
    n_repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        inside = np.flatnonzero(doc[:len(doc) - WINDOW + 1] == doc[WINDOW - 1:])
        acc = np.zeros(len(inside), np.uint64)
        for j in range(WINDOW):
            acc += hashed[inside + j] * tb._STEP[j]
        twice = inside[_repeated(acc, doc[inside])]
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
        n_repeat = np.bincount(doc[covered], minlength=n)
    return {"n_words": n_words, "word_chars": _per_text(_POINT[data], offsets),
            "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat, "n_lines": n_lines, "n_stutter": n_stutter,
            "n_upper": _per_text(_UPPER[data], offsets),
            "n_letters": _per_text(_LETTER[data], offsets),
            "n_marks": _per_text(_MARK[data], offsets)}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_stutter", "n_upper", "n_letters", "n_marks"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of every text beside its id and the group columns; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = tb.text_array(b.column(b.num_columns - 1))
            for lo, hi in tb.slabs(texts):
                got = measure_slab(*tb.flat(texts.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                    + [pa.array(got[c].astype(np.int64)) for c in COUNTS],
                    names=["doc_id", *names, *COUNTS])

    names = [f"group_{i}" for i in range(len(group_cols))]
    return docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c).cast("string").alias(a) for c, a in zip(group_cols, names)],
        F.col(text_col).cast("string")).mapInArrow(
        run, ", ".join([f"doc_id {dict(docs.dtypes)[id_col]}", *[f"{a} string" for a in names],
                        *[f"{c} long" for c in COUNTS]]))


def _share(part: str, whole: str):
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _shares():
    return {"symbol_share": _share("n_symbols", "word_chars"),
            "upper_share": _share("n_upper", "n_letters"),
            "mark_share": _share("n_marks", "word_chars"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "stutter_share": _share("n_stutter", "n_words")}


ZERO = -100_000


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable quantile sketches: (keys, measure, bucket, n) lines."""
    bucket = F.when(F.col("value") <= 0, F.lit(ZERO)).otherwise(
        F.ceil(F.log("value") / float(np.log(GAMMA))).cast("int"))
    return rows.select(*keys, F.explode(F.create_map(*[
        x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "value")).groupBy(
        *keys, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One line per key: the number of rows and the upper fence of each measure."""
    every = Window.partitionBy(*keys, "measure")
    cum = sketches.withColumn("upto", F.sum("n").over(
        every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "rows", F.sum("n").over(every))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(
        F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (GAMMA + 1)))
    q = cum.groupBy(*keys, "measure").agg(
        F.first("rows").alias("rows"),
        F.min(F.when(F.col("upto") >= 0.25 * F.col("rows"), value)).alias("q25"),
        F.min(F.when(F.col("upto") >= 0.75 * F.col("rows"), value)).alias("q75"))
    floor = F.create_map(*[F.lit(x) for m in MEASURES.items() for x in m])
    q = q.withColumn("fence", F.col("q75") + FENCE * F.greatest(
        F.col("q75") - F.col("q25"), floor[F.col("measure")]))
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *[
        F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"{m}_fence")
        for m in MEASURES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source",
          min_group: int = MIN_GROUP) -> DataFrame:
    """Per row: the counts, base_failed, kept, and ``reasons``, the measures over their fence."""
    rows = measure(docs, id_col, text_col, (lang_col, source_col))
    tag = [F.coalesce(F.concat(F.lit("="), F.col(f"group_{i}")), F.lit("-")) for i in (0, 1)]
    rows = cut_lineage(rows.select(
        "*", tag[0].alias("lang_key"), F.struct(tag[0].alias("l"), tag[1].alias("s")).alias(
            "key")).withColumns(_shares()).drop("group_0", "group_1"))
    own = sketch(rows, ["lang_key", "key"])
    by_lang = merge(own, ["lang_key"])
    wide = fences(own, ["lang_key", "key"])
    lang = fences(by_lang, ["lang_key"])
    names = [f"{m}_fence" for m in MEASURES]
    every = fences(merge(by_lang, []).withColumn("all", F.lit(1)), ["all"]).select(
        *[F.col(c).alias(f"all_{c}") for c in names])
    lang = lang.select("lang_key", F.col("rows").alias("lang_rows"),
                       *[F.col(c).alias(f"lang_{c}") for c in names])
    # Per group, not per row: one line each.
    groups = wide.join(lang, "lang_key", "left").join(F.broadcast(every), how="left").select(
        "key", F.col("rows").alias("n"), *[
            F.when(F.col("rows") >= min_group, F.col(c)).when(
                F.col("lang_rows") >= min_group, F.col(f"lang_{c}")).otherwise(
                F.col(f"all_{c}")).alias(c) for c in names])
    groups = cut_lineage(groups)
    total = rows.count()
    out = join_group_facts(rows, groups, "key", total, small=0)
    reasons = F.concat_ws(",", *[F.when(F.col(m) > F.col(f"{m}_fence"), F.lit(m))
                                 for m in MEASURES])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), reasons.alias("reasons"),
                      (~failed & (reasons == "")).alias("kept"))
