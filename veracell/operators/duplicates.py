"""Exact and near duplicates without pair lists.

Exact copies are counted by fingerprint. Rows whose fields agree in all but ``t`` places share
at least one of ``t + 1`` field groups in full (pigeonhole), which leaves few candidates. Those are
keyed by every choice of ``g - t`` out of ``g`` field groups, with as many groups as ``KEYS``
allows. If every field is a group, two rows share a key exactly when they are similar enough, and
leaders and members follow from minima over the keys. In wider tables sharing a key is only
necessary: leaders are then taken round by round, each compared with the rows of its keys. Either
way a set of s similar rows costs s lines, never s * s pairs. Where blocking columns leave small
blocks, one exchange by block replaces all this: each block is decided in order in its task.
"""
from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions import values as V
from veracell.functions.hashing import fingerprint
from veracell.functions.joins import join_group_facts, join_lines
from veracell.functions.session import cut_lineage
from veracell.operators.typing import distinct_counts

# Name parts of columns fit for blocking.
BLOCK_WORDS = ["patient", "subject", "subj", "ptid", "record", "id", "identifier", "mrn", "ssn",
               "enrollment"]
#: Keys that a row may have.
KEYS = 128
#: Rows of a block that are compared in one task; larger blocks take the way by keys.
BLOCK_ROWS = 1000
#: Bytes of a field that is compared as it is; longer ones are by their SHA-256.
FIELD_BYTES = 64


def blocking_columns(df: DataFrame, columns: list[str], most: int = 2) -> list[str]:
    """The first columns with an identifier-like name and more than one value."""
    named = [c for c in columns if any(w in c.lower() for w in BLOCK_WORDS)]
    if not named:
        return []
    row = df.agg(*[(F.min(V.present(df, c)) < F.max(V.present(df, c))).alias(f"c{i}")
                   for i, c in enumerate(named)]).first()
    return [c for i, c in enumerate(named) if row[i]][:most]


def null_count(df: DataFrame, columns: list[str]) -> Column:
    return sum((V.present(df, c).isNull().cast("int") for c in columns), F.lit(0))


def exact_groups(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(fp, n, first_id, most_complete_id) of rows that occur more than once.

    Counting happens before the shuffle, so a row copied a billion times is one line.
    """
    rows = df.select(F.col(key).alias("row_id"), null_count(df, columns).alias("nulls"),
                     fingerprint(*[V.as_text(df, c) for c in columns]).alias("fp"))
    return (rows.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"),
        F.min_by("row_id", F.struct("nulls", "row_id")).alias("most_complete_id"))
        .where("n > 1"))


def exact_duplicates(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Members of exact clusters: (cluster_id, row_id, most_complete_id, is_extra)."""
    rows = df.select(F.col(key).alias("row_id"),
                     fingerprint(*[V.as_text(df, c) for c in columns]).alias("fp"))
    members = join_group_facts(rows, exact_groups(df, key, columns), "fp", df.count())
    return members.select(
        F.col("first_id").alias("cluster_id"), "row_id", "most_complete_id", "n",
        (F.col("row_id") != F.col("first_id")).alias("is_extra"))


def exact_duplicate_count(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return exact_groups(df, key, columns).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"),
        F.count(F.lit(1)).alias("exact_clusters"))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of fields with equal trimmed text; two nulls match, one null does not."""
    same = [V.strip(a[c]).eqNullSafe(V.strip(b[c])).cast("int") for c in a]
    return sum(same[1:], same[0]) / float(len(same))


def allowed_mismatches(fields: int, threshold: float) -> int:
    """The most fields that may differ so that (fields - t) / fields still reaches the threshold."""
    return max(t for t in range(fields + 1) if t == 0 or (fields - t) / fields >= threshold)


def _keys(block: list[Column], fields: dict[str, Column], subsets: list[tuple]) -> Column:
    """One fingerprint per subset of fields, its number included."""
    return F.array(*[
        fingerprint(F.lit(str(i)), *block, *[fields[c] for c in s])
        for i, s in enumerate(subsets)])


def _shared(rows: DataFrame) -> DataFrame:
    """Rows' keys that more than one row has; hot keys are one line each after counting."""
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_group_facts(rows, sizes, "k", rows.count()).drop("n")


def _pigeonhole_groups(df: DataFrame, columns: list[str], parts: int) -> list[tuple]:
    """Deal the columns into groups, the most distinct ones first, so each group is selective."""
    counts = {r["column_name"]: r["unique_count"] for r in distinct_counts(df, columns).collect()}
    ordered = sorted(columns, key=lambda c: -counts.get(c, 0))
    return [tuple(ordered[i::parts]) for i in range(parts)]


def near_duplicates(df: DataFrame, key: str, compare: list[str], block: list[str] | None = None,
                    threshold: float = 0.85) -> DataFrame:
    """Greedy leader clusters in key order: (leader_id, row_id, similarity), leaders left out.

    A row joins the smallest earlier leader it is similar to; a row without one leads. The
    sequence is resolved in rounds: rows whose similar predecessors are all decided are decided
    together, with minima over shared keys only.
    """
    block = block or []
    t = allowed_mismatches(len(compare), threshold)
    text = [_short(V.strip(V.as_text(df, c))) for c in compare]
    rows = df.select(F.col(key).alias("row_id"), *[e.alias(f"f{i}") for i, e in enumerate(text)],
                     *([fingerprint(*[V.as_text(df, c) for c in block]).alias("b")] if block
                       else []))
    if not block:
        return _by_keys(df, cut_lineage(rows), compare, t)
    large = cut_lineage(rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > BLOCK_ROWS).select("b"))
    if large.isEmpty():
        return _within_blocks(rows, len(compare), t)
    return _within_blocks(rows.join(large, "b", "left_anti"), len(compare), t).unionByName(
        _by_keys(df, cut_lineage(rows.join(large, "b", "left_semi")), compare, t))


def _short(c: Column) -> Column:
    return F.when(F.octet_length(c) > FIELD_BYTES, F.concat(F.lit("\u0000"), F.sha2(c, 256))) \
        .otherwise(c)


def _within_blocks(rows: DataFrame, fields: int, t: int) -> DataFrame:
    """The clusters of (b, row_id, f0, f1, ...) whose blocks b are small: one exchange by block."""
    id_type = rows.schema["row_id"].dataType.simpleString()
    return rows.repartition("b").sortWithinPartitions("b", "row_id").select(
        F.col("b.h1").alias("h1"), F.col("b.h2").alias("h2"), "row_id",
        *[f"f{i}" for i in range(fields)]).mapInArrow(
        _in_order(fields, t), f"leader_id {id_type}, row_id {id_type}, similarity double")


def _block_starts(t: pa.Table) -> np.ndarray:
    h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
    return np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))


def _in_order(fields: int, t: int):
    """Leaders and followers of whole blocks, sorted by block and row."""
    def decide(rows: pa.Table) -> pa.RecordBatch:
        n, starts = rows.num_rows, _block_starts(rows)
        first = np.repeat(starts, np.diff(np.append(starts, n)))
        place = np.arange(n) - first
        codes = [rows.column(f"f{i}").combine_chunks().dictionary_encode().indices.fill_null(-1)
                 .to_numpy(zero_copy_only=False) for i in range(fields)]
        leader, same = np.full(n, -1), np.zeros(n, np.int64)
        opened, p = np.arange(n), 0
        while len(opened):  # the p-th row of every block leads if no row before it took it
            opened = opened[place[opened] > p]
            lead = first[opened] + p
            leads = leader[lead] < 0
            row, lead = opened[leads], lead[leads]
            equal = sum((c[row] == c[lead]).astype(np.int64) for c in codes)
            hit = equal >= fields - t
            leader[row[hit]], same[row[hit]] = lead[hit], equal[hit]
            opened, p = opened[leader[opened] < 0], p + 1
        row = np.flatnonzero(leader >= 0)
        ids = rows.column("row_id").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(leader[row])), ids.take(pa.array(row)),
             pa.array(same[row] / float(fields))], ["leader_id", "row_id", "similarity"])

    def run(batches):
        held = None  # the last block may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            last = int(_block_starts(held)[-1])
            if last:
                yield decide(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield decide(held)
    return run


def _by_keys(df: DataFrame, rows: DataFrame, compare: list[str], t: int) -> DataFrame:
    """The clusters of (row_id, f0, f1, ...) and perhaps a block b, by keys over field groups."""
    b = [F.col(f"b.{h}").cast("string") for h in ("h1", "h2")] if "b" in rows.columns else []
    f = {c: F.col(f"f{i}") for i, c in enumerate(compare)}
    if t and len(compare) > t + 1:
        groups = _pigeonhole_groups(df, compare, t + 1)
        keyed = rows.select("row_id", F.explode(_keys(b, f, groups)).alias("k"))
        sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        alive = join_group_facts(keyed, sizes, "k", rows.count() * (t + 1)) \
            .select("row_id").distinct()
        rows = rows.join(alive, "row_id", "left_semi")
    parts = _key_groups(df, compare, t)
    subsets = [tuple(c for g in s for c in g)
               for s in itertools.combinations(parts, len(parts) - t)]
    keyed = rows.select("row_id", F.explode(_keys(b, f, subsets)).alias("k"))
    links = cut_lineage(_shared(keyed))
    fields = F.array(*f.values())
    mine = rows.select("row_id", fields.alias("mine"))
    theirs = rows.select(F.col("row_id").alias("leader_id"), fields.alias("theirs"))
    same = F.aggregate(F.zip_with("mine", "theirs", lambda x, y: x.eqNullSafe(y).cast("int")),
                       F.lit(0), lambda acc, v: acc + v)
    if len(parts) == len(compare):
        pairs = _assign(links, _leaders(links))
    else:
        def alike(pairs: DataFrame) -> DataFrame:
            return join_lines(pairs.distinct().join(mine, "row_id"), theirs, "leader_id",
                              rows.count()).where(same >= len(compare) - t).select(
                "row_id", "leader_id")
        pairs = _compared(links, alike)
    with_mine = pairs.join(mine, "row_id")
    return (join_lines(with_mine, theirs, "leader_id", rows.count())
            .select("leader_id", "row_id", (same / float(len(compare))).alias("similarity")))


def _key_groups(df: DataFrame, compare: list[str], t: int) -> list[tuple]:
    """The fields in as many groups as KEYS allows; each field its own where it can be."""
    if math.comb(len(compare), t) <= KEYS:
        return [(c,) for c in compare]
    g = max(n for n in range(t + 1, len(compare)) if math.comb(n, t) <= KEYS or n == t + 1)
    return _pigeonhole_groups(df, compare, g)


def _compared(links: DataFrame, alike) -> DataFrame:
    """(row_id, leader_id) by rounds. A row that is the smallest open one under all its keys has no
    open row before it that could be similar, so it leads; the open rows of its keys are compared
    with it, and those similar follow. Each round decides at least the smallest open row."""
    total = links.count()
    opened = links
    leaders = None
    while not opened.isEmpty():
        low = opened.groupBy("k").agg(F.count(F.lit(1)).alias("n"),
                                      F.min("row_id").alias("leader_id"))
        seen = cut_lineage(join_group_facts(opened, low, "k", total))
        new = seen.groupBy("row_id").agg(F.bool_and(
            F.col("leader_id") == F.col("row_id")).alias("leads")).where("leads").select("row_id")
        new = cut_lineage(new)
        leads = new.withColumnRenamed("row_id", "leader_id")
        follow = alike(seen.where("row_id <> leader_id").join(leads, "leader_id").select(
            "row_id", "leader_id")).select("row_id")
        leaders = new if leaders is None else leaders.unionByName(new)
        done = new.unionByName(follow).distinct()
        opened = cut_lineage(opened.join(done, "row_id", "left_anti"))
    if leaders is None:
        return links.select("row_id", F.col("row_id").alias("leader_id")).limit(0)
    # Every follower with all leaders before it that share a key; the smallest similar one counts.
    of_key = links.join(leaders, "row_id").select("k", F.col("row_id").alias("leader_id"))
    pairs = join_lines(links.join(leaders, "row_id", "left_anti"), of_key, "k", total).where(
        "leader_id < row_id").select("row_id", "leader_id")
    return alike(pairs).groupBy("row_id").agg(F.min("leader_id").alias("leader_id"))


def _leaders(links: DataFrame) -> DataFrame:
    """Decide leader (L) or follower (N) for every row, in rounds."""
    state = cut_lineage(links.select("row_id").distinct().withColumn("s", F.lit("U")))
    total = links.count()
    while True:
        seen = links.join(state, "row_id")
        low = seen.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("s") == "L", F.col("row_id"))).alias("min_leader"),
            F.min(F.when(F.col("s") == "U", F.col("row_id"))).alias("min_open"))
        view = join_group_facts(seen.where("s = 'U'"), low, "k", total).groupBy("row_id").agg(
            F.min("min_leader").alias("leader"), F.min("min_open").alias("open"))
        decided = view.select("row_id", F.when(F.col("leader") < F.col("row_id"), "N")
                              .when(F.col("open") >= F.col("row_id"), "L")
                              .otherwise("U").alias("new"))
        state = cut_lineage(state.join(decided, "row_id", "left").select(
            "row_id", F.coalesce("new", "s").alias("s")))
        if state.where("s = 'U'").isEmpty():
            return state


def _assign(links: DataFrame, state: DataFrame) -> DataFrame:
    seen = links.join(state, "row_id")
    leaders = seen.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("s") == "L", F.col("row_id"))).alias("leader_id"))
    return (join_group_facts(seen.where("s = 'N'"), leaders, "k", links.count())
            .groupBy("row_id").agg(F.min("leader_id").alias("leader_id")))


def without_extra_copies(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keep the first row of every exact cluster."""
    extra = exact_duplicates(df, key, columns).where("is_extra").select(
        F.col("row_id").alias(key))
    return df.join(extra, key, "left_anti")


def duplicate_report(df: DataFrame, key: str, columns: list[str], threshold: float = 0.85,
                     block: list[str] | None = None) -> DataFrame:
    """Exact and near counts with their rates; near search skips the extra exact copies."""
    block = blocking_columns(df, columns) if block is None else block
    compare = [c for c in columns if c not in block]
    total = df.count()
    exact = exact_duplicate_count(df, key, columns)
    near = near_duplicates(without_extra_copies(df, key, columns), key, compare, block, threshold) \
        .agg(F.count(F.lit(1)).alias("near_duplicates"))
    return exact.crossJoin(near).select(
        F.lit(total).cast("long").alias("total_rows"), "exact_duplicates", "near_duplicates",
        (F.col("exact_duplicates") / F.lit(max(total, 1))).alias("exact_rate"),
        ((F.col("exact_duplicates") + F.col("near_duplicates")) / F.lit(max(total, 1)))
        .alias("total_rate"))


def merge_keep_complete(df: DataFrame, key: str, match: list[str]) -> DataFrame:
    """One row per group of equal ``match`` columns: the row with the fewest nulls, its gaps
    filled from the other rows in key order."""
    others = [c for c in df.columns if c not in match and c != key]
    rank = F.struct(null_count(df, df.columns).alias("nulls"), V.col(key).alias("k"))
    aggs = [F.min_by(V.col(key), rank).alias(key)]
    for c in others:
        filled = F.when(V.present(df, c).isNotNull(), rank)
        aggs.append(F.min_by(V.present(df, c), filled).alias(c))
    return df.groupBy(*[V.col(c) for c in match]).agg(*aggs)
