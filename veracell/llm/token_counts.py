"""Token counts by a compiled finite-state tokenizer.

The splitting pattern of byte-level vocabularies is compiled into a deterministic transducer over
character classes. Its transitions announce where a piece begins (at this character or up to two
before it, as look-ahead needs). A text block is cut into chunks; each chunk is a map from entry
state to exit state; the maps are composed by a parallel prefix scan, which gives every chunk its
entry state. In a second sweep all chunks run side by side from these states and emit the
boundaries. Below the pieces stands a second machine whose arcs are whole pieces, compiled lazily
with the library: an arc carries the number of tokens that its piece emits.

Defined cases: a null or empty text has 0 bytes and 0 tokens; every row gets one line, repeated
rows too; the strings of special tokens inside a text count one token each, as in the library.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from veracell.llm import textbatch as tb

# Character classes: letters of contractions apart, then other letters, digits and so on.
CLASSES = ["s", "t", "m", "d", "r", "v", "l", "e", "letter", "number", "other", "quote", "space",
           "blank", "end"]
_LETTERS = {"s", "t", "m", "d", "r", "v", "l", "e", "letter"}
STATES = ["start", "letters", "numbers", "others", "quote", "quote_r", "quote_v", "quote_l",
          "closed", "one_space", "one_blank", "many_space", "many_blank"]
HERE, BACK = 1, 2  # a piece begins at this character, or at the one before it
CHUNK = 128
#: Pieces a worker remembers; others are counted again when they come back.
CACHE_PIECES = 700_000

#: The white space of the pattern's ``\s``.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]


def _kind(c: str) -> str:
    """The state that a piece beginning with class c is in."""
    return ("letters" if c in _LETTERS else "numbers" if c == "number" else "quote"
            if c == "quote" else "others" if c == "other" else "one_space" if c == "space"
            else "one_blank" if c == "blank" else "start")


def _arc(state: str, c: str) -> tuple[str, int]:
    """The next state, and which characters begin a piece."""
    white = c in ("space", "blank")
    if c == "end":
        return "start", HERE | (BACK if state.startswith("quote_") else 0)
    if state in ("start", "closed"):
        return _kind(c), HERE
    if state == "letters":
        return ("letters", 0) if c in _LETTERS else (_kind(c), HERE)
    if state == "numbers":
        return ("numbers", 0) if c == "number" else (_kind(c), HERE)
    if state == "others":
        return ("others", 0) if c in ("other", "quote") else (_kind(c), HERE)
    if state == "quote":
        if c in ("s", "t", "m", "d"):
            return "closed", 0
        if c in ("r", "v", "l"):
            return f"quote_{c}", 0
        return ("others", 0) if c in ("other", "quote") else (_kind(c), HERE)
    if state.startswith("quote_"):
        if c == ("l" if state == "quote_l" else "e"):
            return "closed", 0
        to, out = _arc("letters", c)
        return to, out | BACK
    if white:
        return f"many_{c}", 0
    if state == "one_space":
        return ("others" if c == "quote" else _kind(c)), 0
    if state == "many_space":
        return ("others" if c == "quote" else _kind(c)), BACK
    return _kind(c), HERE | (BACK if state == "many_blank" else 0)


def compile_lexer() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables, states x classes."""
    to = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    out = np.zeros_like(to)
    for i, s in enumerate(STATES):
        for j, c in enumerate(CLASSES):
            name, out[i, j] = _arc(s, c)
            to[i, j] = STATES.index(name)
    return to, out


def class_table(split) -> np.ndarray:
    """The class of every code point. Where two editions of Unicode differ, ``split`` (the
    library's splitting) shows which one it goes by."""
    import regex
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    newer = table.copy()
    kinds = {"L": CLASSES.index("letter"), "N": CLASSES.index("number")}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in kinds:
            table[c] = kinds[kind]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, k in kinds.items():
        found = "".join(regex.findall(rf"\p{{{kind}}}+", every))
        newer[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    for c in np.flatnonzero(table != newer).tolist():
        if not 0xD800 <= c < 0xE000:
            one = [k for k, x in (("letter", "a"), ("number", "1"))
                   if len(split.pre_tokenize_str(x + chr(c) + x)) == 1]
            table[c] = CLASSES.index(one[0] if one else "other")
    table[WHITE] = CLASSES.index("blank")
    table[32], table[39] = CLASSES.index("space"), CLASSES.index("quote")
    for c in "stmdrvle":
        table[ord(c)] = CLASSES.index(c)
    return table


def boundaries(classes: np.ndarray, to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Positions where pieces begin; ``classes`` ends with an end mark."""
    n, width = len(classes), to.shape[1]
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, CLASSES.index("end"), np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    step = to.ravel()
    maps = np.tile(np.arange(len(STATES), dtype=np.uint8)[:, None], (1, lanes))
    same = False
    for t in range(CHUNK):
        maps = step[maps * np.int16(width) + steps[t]]
        if not same and t % 4 == 3 and (maps == maps[:1]).all():
            maps, same = maps[:1], True  # every entry state has led to the same one
    if same:
        maps = np.repeat(maps, len(STATES), axis=0)
    reach = 1
    while reach < lanes:  # composition of the maps by doubling
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].copy(), axis=0)
        reach *= 2
    state = np.concatenate([[0], maps[0, :-1]]).astype(np.uint8)
    emit = out.ravel()
    sent = np.empty_like(steps)
    for t in range(CHUNK):
        arc = state * np.int16(width) + steps[t]
        sent[t] = emit[arc]
        state = step[arc]
    sent = sent.T.ravel()[:n]
    begin = (sent & HERE).astype(bool)
    begin[:-1] |= (sent[1:] & BACK).astype(bool)
    return np.flatnonzero(begin)


class Counter:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"] if t["special"]]
        self.to, self.out = compile_lexer()
        self.table = class_table(self.tokenizer.pre_tokenizer)
        self.arcs: dict[str, int] = {}

    def _count(self, pieces: list[str]) -> np.ndarray:
        arcs = self.arcs
        new = [p for p in set(pieces) if p not in arcs]
        if new:
            got = {p: len(e) for p, e in zip(
                new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            if len(arcs) + len(got) <= CACHE_PIECES:
                arcs.update(got)
            else:
                arcs = arcs | got
        return np.fromiter(map(arcs.__getitem__, pieces), np.int64, len(pieces))

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for r, t in enumerate(texts):
            segments = [t]
            for s in self.special:
                if s in t:
                    segments = [x for seg in segments for x in self._split(seg, s, extra, r)]
            parts += segments
            owner += [r] * len(segments)
        if not parts:
            return extra
        whole = "\n".join(parts) + "\n"
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        classes = self.table[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        classes[ends] = CLASSES.index("end")
        begin = boundaries(classes, self.to, self.out)
        stop = np.append(begin[1:], len(classes))
        real = classes[begin] != CLASSES.index("end")
        begin, stop = begin[real], stop[real]
        n = self._count([whole[a:b] for a, b in zip(begin.tolist(), stop.tolist())])
        segment = np.searchsorted(ends, begin)
        extra += np.bincount(np.asarray(owner)[segment], weights=n,
                             minlength=len(texts)).astype(np.int64)
        return extra

    @staticmethod
    def _split(text: str, special: str, extra: np.ndarray, row: int) -> list[str]:
        found = text.split(special)
        extra[row] += len(found) - 1
        return found


_workers: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _workers:
        _workers[path] = Counter(path)
    return _workers[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, as the byte-level ``tokenizers`` file gives them
    without added special tokens. One scan, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for b in batches:
            texts = tb.text_array(b.column(1))
            for lo, hi in tb.slabs(texts):
                part = texts.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()),
                    pa.array(c.count(part.to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
