"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered.

A transcript is a list of lines. Hidden states are the roles, each as first line of a turn or as a
later line; what a line shows is its speaker marker, whether it asks, whether it is blank, and its
length. Start, transition and emission counts are summed over labelled transcripts (a fixed number
of counts per task), and the Viterbi path gives each line its role.

Long conversations are cut into chunks of turns. A chunk of a conversation of several becomes a
max-plus matrix from entry to exit state; the matrices of a conversation are scanned forwards and
backwards, which fixes the states at the borders of all chunks, and each chunk is then decoded by
itself between them. The path is that of the whole conversation.

Defined cases: a null text is an empty line; a null turn comes last; rows that share conversation
and turn follow each other in the order of their text; null or unknown roles are not learned from
and count as wrong; null conversation ids form one conversation; empty tables give no rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veracell.functions.session import cut_lineage

ROLES = ["system", "user", "assistant"]
STATES = len(ROLES) * 2  # role * 2 + (0: first line of a turn, 1: later line)
CHUNK_TURNS = 64
MARKERS = ["", "system", "context", "user", "human", "q", "assistant", "ai", "bot", "a"]
_MARKER = re.compile(
    r"^\s*(?:#+\s*|<\|\s*|\[\s*|\*\*)?(system|context|user|human|q|assistant|ai|bot|a)"
    r"\s*(?:\|>|\]|:\*\*|\*\*:|:)[ \t]*", re.IGNORECASE)
_SIZES = [1, 80, 240, 800]
FEATURES = [len(MARKERS), 2, len(_SIZES) + 1]


def observe(line: str) -> tuple[int, int, int]:
    """Marker, question and length class of a line."""
    m = _MARKER.match(line)
    return (MARKERS.index(m.group(1).lower()) if m else 0, int(line.rstrip().endswith("?")),
            int(np.searchsorted(_SIZES, len(line.strip()), "right")))


class Model:
    """Log probabilities of starts, transitions and features, from counts with one added."""

    SIZES = [STATES, STATES * STATES, *[STATES * n for n in FEATURES]]

    def __init__(self, counts: np.ndarray):
        parts = np.split(np.asarray(counts, float) + 1, np.cumsum(self.SIZES)[:-1])
        start, move = parts[0], parts[1].reshape(STATES, STATES)
        start[1::2] = 1e-9  # no conversation begins with a later line
        for r in range(len(ROLES)):  # a later line follows a line of its own role
            for s in range(STATES):
                if s // 2 != r:
                    move[s, 2 * r + 1] = 1e-9
        self.start = np.log(start / start.sum())
        self.move = np.log(move / move.sum(1, keepdims=True))
        self.emit = [np.log(p.reshape(STATES, -1) / p.reshape(STATES, -1).sum(1, keepdims=True)).T
                     for p in parts[2:]]

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observe(x) for x in lines]).reshape(-1, len(FEATURES))
        return sum(e[seen[:, i]] for i, e in enumerate(self.emit))

    def matrix(self, lines: list[str]) -> np.ndarray:
        """Best log probability from each state before the lines to each state at their end."""
        out = None
        for e in self.emissions(lines):
            step = self.move + e
            out = step if out is None else (out[:, :, None] + step[None]).max(1)
        return out

    def decode(self, lines: list[str], entry: int, leave: int) -> np.ndarray:
        """The best path; entry -1 is the start of a conversation, leave -1 is any state."""
        emit = self.emissions(lines)
        best = (self.start if entry < 0 else self.move[entry]) + emit[0]
        back = np.zeros((len(lines), STATES), np.int64)
        for t in range(1, len(lines)):
            score = best[:, None] + self.move
            back[t] = score.argmax(0)
            best = score.max(0) + emit[t]
        path = np.zeros(len(lines), np.int64)
        path[-1] = best.argmax() if leave < 0 else leave
        for t in range(len(lines) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def chunked(conversations: DataFrame, line: Column, conv_col: str = "conv_id",
            turn_col: str = "turn", role_col: str = "role",
            chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, chunk, lines and truth (state of each line or -1) of chunks of turns; ``line`` is
    the text of a turn as it stands in the transcript."""
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit((1 << 62)))
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(role_col)) - 1,
                      F.lit(-1)).cast("int")
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), turn.alias("t"), role.alias("r"),
        F.coalesce(line, F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id", F.floor(F.col("t") / chunk_turns).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("t", "text", "r"))).alias("turns"))
    lines = F.flatten(F.transform("turns", lambda x: F.split(x.text, "\n")))
    truth = F.flatten(F.transform("turns", lambda x: F.transform(
        F.split(x.text, "\n"), lambda _, i: F.when(x.r < 0, -1).otherwise(
            x.r * 2 + F.when(i == 0, 0).otherwise(1)).cast("int"))))
    return whole.select("conv_id", "chunk", lines.alias("lines"), truth.alias("truth"))


def learn(chunks: DataFrame) -> Model:
    """Counts of all labelled lines; each task sends one line of fixed length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(n) for n in Model.SIZES]
        for b in batches:
            for chunk, lines, truth in zip(*(c.to_pylist() for c in b.columns)):
                before = None
                for i, (x, s) in enumerate(zip(lines, truth)):
                    if s >= 0:
                        if before is not None:
                            parts[1][before * STATES + s] += 1
                        elif i == 0 and chunk == 0:
                            parts[0][s] += 1
                        for k, v in enumerate(observe(x)):
                            parts[2 + k][s * FEATURES[k] + v] += 1
                    before = s if s >= 0 else None
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate(parts).tolist()])], names=["counts"])

    rows = chunks.select("chunk", "lines", "truth").mapInArrow(run, "counts array<double>")
    counts = np.zeros(sum(Model.SIZES))
    for pos, x in rows.select(F.posexplode("counts").alias("pos", "x")).groupBy("pos").agg(
            F.sum("x")).collect():
        counts[pos] = x
    return Model(counts)


def _borders(model: Model):
    """States before and after each chunk of one conversation, from the matrices of all."""
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("entry", pa.int32()),
                               ("leave", pa.int32())]))

    @F.arrow_udf("array<struct<chunk: bigint, entry: int, leave: int>>")
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for conv in column.to_pylist():
            m = [np.array(c["matrix"]).reshape(-1, STATES) for c in conv]
            ahead = [m[0][0]]  # the first chunk starts the conversation
            for x in m[1:]:
                ahead.append((ahead[-1][:, None] + x).max(0))
            behind = [np.zeros(STATES)]
            for x in m[:0:-1]:
                behind.append((x + behind[-1][None]).max(1))
            at = [int((a + b).argmax()) for a, b in zip(ahead, behind[::-1])]
            out.append([{"chunk": c["chunk"], "entry": e, "leave": s}
                        for c, e, s in zip(conv, [-1, *at], at)])
        return pa.array(out, kind)
    return scan


def _matrices(model: Model):
    @F.arrow_udf("array<double>")
    def matrix(lines: pa.Array, begins: pa.Array) -> pa.Array:
        out = []
        for x, first in zip(lines.to_pylist(), begins.to_pylist()):
            m = model.matrix(x)
            if first:  # the start takes the place of the transition into the first line
                e = model.emissions(x[:1])[0]
                v = model.start + e
                m = v[None] if len(x) == 1 else (
                    v[:, None] + model.matrix(x[1:])).max(0)[None]
            out.append(m.ravel().tolist())
        return pa.array(out, pa.list_(pa.float64()))
    return matrix


def _decoded(model: Model):
    @F.arrow_udf("array<int>")
    def path(lines: pa.Array, entry: pa.Array, leave: pa.Array) -> pa.Array:
        return pa.array([model.decode(x, -1 if e is None else e, -1 if s is None else s).tolist()
                         for x, e, s in zip(lines.to_pylist(), entry.to_pylist(),
                                            leave.to_pylist())], pa.list_(pa.int32()))
    return path


def parse(chunks: DataFrame, model: Model) -> DataFrame:
    """The chunks with ``path``, the state of every line on the best path of its conversation."""
    chunks = cut_lineage(chunks)
    counts = chunks.groupBy("conv_id").agg(F.min("chunk").alias("least"),
                                           F.max("chunk").alias("most"))
    several = counts.where("least <> most").select("conv_id", "least")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    mine = several.withColumnRenamed("conv_id", "c")
    parts = chunks.join(mine, same).withColumn("matrix", _matrices(model)(
        F.col("lines"), F.col("chunk") == F.col("least")))
    borders = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(
        "chunk", "matrix"))).alias("m")).select("c", F.explode(_borders(model)("m")).alias("b"))
    borders = borders.select("c", F.col("b.chunk").alias("bc"), "b.entry", "b.leave")
    known = chunks.join(borders, same & (F.col("chunk") == F.col("bc")), "left")
    return known.withColumn("path", _decoded(model)("lines", "entry", "leave")).select(
        *chunks.columns, "path")


def render(parsed: DataFrame) -> DataFrame:
    """conv_id, chunk, n_turns, rendered: canonical text of every chunk, ``<|role|>`` and the
    lines of the turn without their marker."""
    kind = pa.struct([("n_turns", pa.int64()), ("rendered", pa.string())])

    @F.arrow_udf("struct<n_turns: bigint, rendered: string>")
    def canonical(lines: pa.Array, path: pa.Array) -> pa.Array:
        out = []
        for x, p in zip(lines.to_pylist(), path.to_pylist()):
            turns, text = 0, []
            for line, s in zip(x, p):
                if s % 2 == 0:
                    turns += 1
                    text.append(f"<|{ROLES[s // 2]}|>")
                    line = _MARKER.sub("", line, count=1)
                text.append(line)
            out.append({"n_turns": turns, "rendered": "\n".join(text)})
        return pa.array(out, kind)

    return parsed.withColumn("__r", canonical("lines", "path")).select(
        *parsed.columns, "__r.n_turns", "__r.rendered")


#: Marker styles of the transcripts that the query writes, per role; None leaves the marker out.
STYLES = [["System: ", "User: ", "Assistant: "], ["### System: ", "### Human: ", "### Assistant: "],
          ["[system] ", "[user] ", "[assistant] "], ["Context: ", "Q: ", "A: "],
          [None, "User: ", None], [None, None, "AI: "]]


def styled_line(conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text"):
    """The text of a turn behind its marker in the style of its conversation."""
    style = F.pmod(F.crc32(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).cast("binary")),
                   F.lit(len(STYLES)))
    marker = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(ROLES, names):
            marker = F.when((style == k) & (F.col(role_col) == role), F.lit(name or "")).otherwise(
                marker)
    return F.concat(marker, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation: lines, turns, recovered lines by role, lines with the true role and turn
    border, and a checksum of the rendered text. The model learns from conversations whose
    crc32(conv_id) mod 10 is not 0 (``held_out`` marks the rest)."""
    chunks = cut_lineage(chunked(conversations, styled_line()))
    held = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")),
                             F.lit(10)) == 0, F.lit(False))
    out = render(parse(chunks, learn(chunks.where(~held))))
    hit = F.size(F.filter(F.zip_with("path", "truth", lambda a, b: a == b), lambda x: x))
    count = [F.sum(F.expr(f"size(filter(path, s -> s div 2 = {r}))")).cast("long").alias(
        f"{name}_lines") for r, name in enumerate(ROLES)]
    return out.groupBy("conv_id").agg(
        F.first(held).alias("held_out"), F.sum(F.size("lines")).cast("long").alias("n_lines"),
        F.sum("n_turns").alias("n_turns"), *count, F.sum(hit).cast("long").alias("n_right"),
        F.sum(F.crc32(F.concat_ws(":", F.col("chunk").cast("string"), "rendered").cast(
            "binary"))).alias("rendered_crc32"))
