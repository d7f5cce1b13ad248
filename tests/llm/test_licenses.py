"""Every alternative of the license rules finds its own wording."""
import itertools
import random
from re import _constants as C, _parser as P

import pyarrow as pa
import pytest

from veracell.llm import licenses

SOURCES = [(f[0], f[2]) for f in licenses.FAMILIES] + [(n[0], n[2]) for n in licenses.NOTICES]
ADDRESSES = [(f[0], f[4]) for f in licenses.FAMILIES if f[4]]


def wordings(pattern: str, most: int = 400) -> list[str]:
    """Texts that a rule stands for: every alternative, optional parts with and without, and both
    members of [- ]. Read from the rule as written, before it is compiled."""
    def each(nodes):
        return ["".join(x) for x in itertools.islice(
            itertools.product(*[one(*n) for n in nodes]), 20_000)]

    def one(op, arg):
        if op is C.LITERAL:
            return [chr(arg)]
        if op is C.ANY:
            return ["x"]
        if op is C.AT:
            return [""]
        if op is C.IN:
            return [x for k, v in arg for x in ([chr(v)] if k is C.LITERAL else
                    [chr(v[0])] if k is C.RANGE else ["7" if v is C.CATEGORY_DIGIT else "a"])]
        if op is C.BRANCH:
            return [x for b in arg[1] for x in each(b)]
        if op is C.SUBPATTERN:
            return each(arg[3])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner = each(body)
            return ([""] if low == 0 else []) + [x * max(low, 1) for x in inner]
        raise ValueError(op)

    found = sorted(set(each(P.parse(pattern))))
    return found if len(found) <= most else random.Random(1).sample(found, most)


@pytest.mark.parametrize("label,pattern", SOURCES)
def test_every_wording_is_matched_by_its_rule(label, pattern):
    compiled = licenses._pattern(rf"(?:{pattern})")
    missed = [w for w in wordings(pattern) if not compiled.search(f"z {w} z".encode())]
    assert not missed, missed[:5]


@pytest.mark.parametrize("text,label", [
    ("cc by-sa 4.0", "cc-by-sa"), ("CC-BY-SA-4.0", "cc-by-sa"), ("cc-by 4.0", "cc-by-named"),
    ("cc by nd", "cc-by-nd"), ("cc-by-nc-3.0", "cc-by-nc"), ("cc by-nc-sa 3.0", "cc-by-nc-sa"),
    ("cc-by-nc-nd", "cc-by-nc-nd"), ("bsd-3-clause license", "bsd-3-clause"),
    ("licensed under the BSD 2-Clause License", "bsd-2-clause"),
    ("the two-clause BSD license", "bsd-2-clause"), ("four-clause\n# bsd license", "bsd-4-clause"),
    ("zero-clause bsd license", "bsd-0-clause"), ("a BSD-style license", "bsd-unversioned"),
    ("Creative Commons Attribution-ShareAlike", "cc-attribution-sharealike"),
    ("creative commons attribution noncommercial", "cc-attribution-noncommercial"),
    ("dual-licensed under", "dual-licensed"), ("dual\n * licensed under", "dual-licensed")])
def test_hyphen_or_blank(text, label):
    data = text.lower().encode()
    assert label in {r[1] for r in licenses.rules() if r[3].search(data)}


def gated_and_not(texts):
    s = licenses.Scanner()
    _, _, found = s.scan(pa.array(texts, pa.large_string()))
    free = {}
    for i, t in enumerate(texts):
        data = t.lower().encode()
        hits = [(r[0], m.start(), m.end(), r[1], r[4]) for r in s.rules
                for m in r[3].finditer(data)]
        if hits:
            free[i] = licenses.resolve(hits)
    return found, free


@pytest.mark.parametrize("label,pattern", SOURCES + ADDRESSES)
def test_keywords_lose_no_match(label, pattern):
    every = wordings(pattern)
    for between in (" ", "\n * ", " # // "):
        few = random.Random(2).sample(every, min(len(every), 10))
        found, free = gated_and_not([w.replace(" ", between) for w in few])
        assert found == free
    keywords = {k for r in licenses.rules() if r[1] == label for k in r[2]}
    assert all(any(k in licenses.squeeze(w.encode()) for k in keywords) for w in every)


@pytest.mark.parametrize("text,label", [
    ("x/mit license", "x11"), ("expat license", "mit"), ("free public license", "bsd-0-clause"),
    ("do what the fuck you want to public license", "wtfpl"), ("psf license", "python-2.0"),
    ("unauthorised copying", "proprietary"), ("for academic use only", "research-only"),
    ("see the licence file for details", "see-license-file"), ("2-clause licence", "bsd-2-clause"),
    ("GNU General\n * Public License, version 2", "gpl-2.0"),
    ("all rights\n# reserved", "all-rights-reserved")])
def test_found_by_its_own_keyword(text, label):
    found, free = gated_and_not(["", text, "other"])
    assert found == free
    assert label in {h[3] for h in found[1]}
