"""License scans with ordered signature rules.

Every rule is a regular expression with keywords and a priority. Every match of a rule holds one of
its keywords, where white space and comment marks count as one blank. A text is first searched for
the keywords, all texts of a slab at once; only rules of which one is there run, on the whole text.
Overlapping detections are resolved in the order of priority, then length, then place: a detection
whose interval lies in that of one already taken is suppressed. Beside the rules stand the base
phrases, sequences of words that are counted wherever they stand.

Defined cases: a null or empty text has no words and no labels; every row gets a line; further
columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veracell.llm import textbatch as tb

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
        "mit license": "mit"}

#: label, keywords (divided by |), name pattern, tag pattern (as after an identifier line), address pattern or None.
#: Patterns are over text with A-Z lower-cased; a blank stands for any white space or comment mark,
#: [- ] for these or a hyphen.
FAMILIES = [
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.0", r"apache-1\.0", None),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.1", r"apache-1\.1", None),
    ("apache-2.0", "apache", r"apache (?:software )?(?:licen[cs]e,?)? ?\(?(?:version |v\.? ?)?2(?:\.0)?\b\)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-unversioned", "apache", r"apache (?:software )?licen[cs]e", r"apache", r"apache\.org/licenses"),
    ("mit", "mit|expat", r"(?:the )?\(?mit\)?(?:/expat)? licen[cs]e|\bmit-licensed|expat licen[cs]e", r"mit", r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit-0 licen[cs]e", r"mit-0", None),
    ("x11", "x11|x/mit", r"x11 licen[cs]e|mit/x11|x/mit licen[cs]e", r"x11", None),
    ("isc", "isc", r"\bisc licen[cs]e", r"isc", r"opensource\.org/licenses?/isc"),
    ("bsd-2-clause", "bsd|simplified|clause", r"(?:simplified|freebsd|two[- ]clause|2[- ]clause) \(?(?:bsd )?licen[cs]e|bsd[- ]2[- ]clause(?: licen[cs]e)?", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|three[- ]clause|3[- ]clause) bsd licen[cs]e|bsd[- ]3[- ]clause(?: licen[cs]e)?", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|four[- ]clause|4[- ]clause) bsd licen[cs]e|bsd[- ]4[- ]clause(?: licen[cs]e)?", r"bsd-4-clause", None),
    ("bsd-0-clause", "clause|free public|0bsd", r"(?:zero[- ]clause|0[- ]clause|free public) (?:bsd )?licen[cs]e|\b0bsd\b", r"0bsd", None),
    ("bsd-unversioned", "bsd", r"bsd(?:[- ]style)? licen[cs]e", r"bsd", None),
    ("gpl-1.0", "general public", r"gnu general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?version 1(?:\.0)?\b", r"gpl-1\.0(?:-only|-or-later|\+)?", None),
    ("gpl-2.0", "general public", r"gnu general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?\(?(?:version |v\.? ?)2(?:\.0)?\b", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public", r"gnu general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?\(?(?:version |v\.? ?)3(?:\.0)?\b", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-unversioned", "gpl", r"\bgnu gpl\b|\bgpl ?v?[23]?(?:\.0)?\+? licen[cs]e", r"gpl", r"gnu\.org/licenses/gpl"),
    ("gpl-named", "general public", r"gnu general public licen[cs]e", r"gpl-named", r"gnu\.org/copyleft/gpl"),
    ("lgpl-2.0", "general public", r"gnu library general public licen[cs]e", r"lgpl-2\.0(?:-only|-or-later|\+)?", None),
    ("lgpl-2.1", "general public", r"gnu lesser general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?\(?(?:version |v\.? ?)2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "general public", r"gnu lesser general public licen[cs]e,? (?:as published by the free software foundation[;,] )?(?:either )?\(?(?:version |v\.? ?)3", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl-unversioned", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl", r"gnu\.org/licenses/lgpl"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e,? (?:version |v\.? ?)1", r"agpl-1\.0", None),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.0", r"mpl-1\.0", None),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? \(?(?:version |v\.? ?)?2\.0", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-unversioned", "mozilla", r"mozilla public licen[cs]e", r"mpl", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,? (?:- |version |v\.? ?)*1\.0", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,? (?:- |version |v\.? ?)*2\.0", r"epl-2\.0", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e", r"edl-1\.0", r"eclipse\.org/(?:org/documents/)?edl"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e,? (?:version |v\.? ?)?1\.0", r"cddl-1\.0", None),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e,? (?:version |v\.? ?)?1\.1", r"cddl-1\.1", None),
    ("cpl-1.0", "common public", r"common public licen[cs]e", r"cpl-1\.0", None),
    ("ibmpl-1.0", "ibm public", r"ibm public licen[cs]e", r"ipl-1\.0", None),
    ("cc0-1.0", "cc0", r"\bcc0(?: 1\.0)?\b", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-1.0", "creative commons", r"creative commons attribution 1\.0", r"cc-by-1\.0", r"creativecommons\.org/licenses/by/1\.0"),
    ("cc-by-2.0", "creative commons", r"creative commons attribution 2\.0", r"cc-by-2\.0", r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-2.5", "creative commons", r"creative commons attribution 2\.5", r"cc-by-2\.5", r"creativecommons\.org/licenses/by/2\.5"),
    ("cc-by-3.0", "creative commons", r"creative commons attribution 3\.0", r"cc-by-3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4\.0", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-named", "cc", r"\bcc[- ]by(?:[- ]\d\.\d)?\b", r"cc-by", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "cc", r"\bcc[- ]by[- ]sa(?:[- ]\d\.\d)?\b", r"cc-by-sa-\d\.\d", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "cc", r"\bcc[- ]by[- ]nd(?:[- ]\d\.\d)?\b", r"cc-by-nd-\d\.\d", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", "cc", r"\bcc[- ]by[- ]nc(?:[- ]\d\.\d)?\b", r"cc-by-nc-\d\.\d", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "cc", r"\bcc[- ]by[- ]nc[- ]sa(?:[- ]\d\.\d)?\b", r"cc-by-nc-sa-\d\.\d", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "cc", r"\bcc[- ]by[- ]nc[- ]nd(?:[- ]\d\.\d)?\b", r"cc-by-nc-nd-\d\.\d", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-attribution-sharealike", "creative commons", r"creative commons attribution[- ]share ?alike", r"cc-sa", None),
    ("cc-attribution-noncommercial", "creative commons", r"creative commons attribution[- ]non-?commercial", r"cc-nc", None),
    ("cc-unversioned", "creative commons", r"creative commons(?: licen[cs]e)?", r"cc", r"creativecommons\.org/licenses"),
    ("unlicense", "unlicense", r"\bthe unlicense\b", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl|you want to public", r"do what the f\w+ you want to public licen[cs]e|\bwtfpl\b", r"wtfpl", r"wtfpl\.net"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]e", r"zlib", None),
    ("libpng", "libpng", r"\blibpng licen[cs]e", r"libpng(?:-2\.0)?", None),
    ("bsl-1.0", "boost", r"boost software licen[cs]e", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source", r"business source licen[cs]e", r"busl-1\.1", None),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e", r"sspl-1\.0", None),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e,? (?:version |v\.? ?)?2\.0", r"elastic-2\.0", None),
    ("elastic-unversioned", "elastic", r"elastic licen[cs]e", r"elastic", None),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e,? (?:version |v\.? ?)?1\.0", r"artistic-1\.0", None),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v\.? ?)?2\.0", r"artistic-2\.0", None),
    ("artistic-unversioned", "artistic", r"artistic licen[cs]e", r"artistic", None),
    ("perl", "perl", r"same terms as perl itself", r"perl", None),
    ("python-2.0", "python|psf", r"python (?:software foundation )?licen[cs]e|\bpsf licen[cs]e", r"(?:python|psf)-2\.0", None),
    ("php-3.01", "php", r"\bphp licen[cs]e,? (?:version |v\.? ?)?3\.01", r"php-3\.01", r"php\.net/license"),
    ("php-unversioned", "php", r"\bphp licen[cs]e", r"php", None),
    ("ruby", "ruby", r"\bruby(?:'s)? licen[cs]e|same terms as ruby", r"ruby", None),
    ("openssl", "openssl", r"\bopenssl licen[cs]e", r"openssl", None),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e", r"ssleay", None),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("vim", "vim", r"\bvim licen[cs]e", r"vim", None),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e", r"w3c", r"w3\.org/consortium/legal"),
    ("unicode", "unicode", r"unicode(?:,? inc\.?)? licen[cs]e", r"unicode-(?:dfs-2016|3\.0)", r"unicode\.org/(?:copyright|license)"),
    ("icu", "icu", r"\bicu licen[cs]e", r"icu", None),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa (?:open source )?licen[cs]e", r"ncsa", None),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.1", r"eupl-1\.1", None),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e", r"eupl-1\.2", None),
    ("cecill", "cecill", r"\bcecill(?:-[bc])?(?: licen[cs]e)?\b", r"cecill-(?:[bc]|[12]\.[01])", r"cecill\.info"),
    ("odbl-1.0", "open database", r"open database licen[cs]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e", r"afl-3\.0", None),
    ("osl-3.0", "open software", r"open software licen[cs]e", r"osl-3\.0", None),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms-pl", None),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms-rl", None),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e", r"apsl-2\.0", None),
    ("beerware", "beer-ware", r"beer-ware licen[cs]e", r"beerware", None),
    ("json", "good, not evil", r"software shall be used for good, not evil", r"json", None),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e", r"upl-1\.0", None),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)", r"mulanpsl-2\.0", None),
    ("llama-community", "llama", r"llama ?[23]?(?:\.\d)? community licen[cs]e", r"llama[23]?", None),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open(?:&| )?rail(?:-[ms])?(?: licen[cs]e)?", r"openrail(?:\+\+)?", None),
]
#: Further phrases: label, keywords, pattern, priority.
NOTICES = [
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", 60),
    ("public-domain", "public domain", r"this (?:work|file|code|software) is (?:in the )?public domain", 60),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 20),
    ("copyright-notice", "copyright", r"copyright (?:\(c\)|©|&copy;)? ?(?:\d{4})(?: ?[-,] ?\d{4})*", 10),
    ("copyright-notice", "(c)", r"\(c\) (?:copyright )?\d{4}", 10),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 85),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 85),
    ("bsd-unversioned", "redistribution and use", r"redistribution and use in source and binary forms", 85),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 85),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 85),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e", 85),
    ("warranty-disclaimer", "warrant", r"without (?:any )?warrant(?:y|ies) of any kind|without warranties or conditions", 15),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 40),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|distribution)", 40),
    ("proprietary", "licensor", r"may not be (?:copied|reproduced|distributed) without .{0,40}licensor", 40),
    ("non-commercial", "commercial", r"(?:for )?non-?commercial (?:use|purposes) only", 40),
    ("research-only", "research|academic", r"for (?:academic|research)(?: and research)? (?:use|purposes) only", 40),
    ("dual-licensed", "dual", r"dual[- ]licen[cs]ed under", 30),
    ("see-license-file", "licen", r"see (?:the )?(?:accompanying )?(?:file )?licen[cs]e(?:\.(?:txt|md))?(?: file)? for (?:details|more|the full)", 25),
    ("license-reference", "licensed under", r"licensed under (?:the )?terms of", 12),
]
#: How sure a kind of rule is of its label.
SURE = {"tag": 1.0, "address": 0.95, "text": 0.95, "grant": 0.9, "name": 0.8, "notice": 0.6}


def _pattern(p: str) -> re.Pattern:
    parts = [x.replace(" ?", r"\s?").replace(" ", r"[\s*#/]+") for x in p.split("[- ]")]
    return re.compile(r"[-\s*#/]+".join(parts).encode("utf-8"))


_SEPARATOR = bytes.maketrans(b"*#/", b"   ")


def squeeze(text: bytes) -> bytes:
    """The text with each run of white space and comment marks as one blank."""
    return b" ".join(text.translate(_SEPARATOR).split())


def _keywords(key: str) -> tuple[bytes, ...]:
    return tuple(squeeze(k.encode()) for k in key.split("|"))


def rules() -> list[tuple[int, str, tuple[bytes, ...], re.Pattern, float]]:
    """(priority, label, keywords, pattern, sureness) of all signatures, highest priority first."""
    out = []
    for label, key, name, tag, address in FAMILIES:
        keywords = _keywords(key)
        out.append((100, label, (b"spdx-license-identifier",), _pattern(
            rf"spdx-license-identifier: ?\(?(?:[\w.+-]+ (?:or|and|with) )*{tag}(?![\w.+-])"),
            SURE["tag"]))
        out.append((70, label, keywords, _pattern(
            "(?:licen[cs]ed|released|distributed|available|provided|published|covered) "
            rf"(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})"),
            SURE["grant"]))
        out.append((50, label, keywords, _pattern(rf"(?:{name})"), SURE["name"]))
        if address:
            out.append((90, label, _keywords(address.split("/")[0].replace("\\", "")),
                        _pattern(address), SURE["address"]))
    for label, key, text, priority in NOTICES:
        out.append((priority, label, _keywords(key), _pattern(text),
                    SURE["text"] if priority > 80 else SURE["notice"]))
    order = sorted(range(len(out)), key=lambda i: (-out[i][0], i))
    return [out[i] for i in order]


def resolve(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Drop detections (priority, start, end, label, sureness) that lie in one taken before."""
    taken: list[tuple[int, int, int, str, float]] = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(t[1] <= d[1] and d[2] <= t[2] for t in taken):
            taken.append(d)
    return sorted(taken, key=lambda d: (d[1], d[2], d[3]))


class Scanner:
    def __init__(self, signatures=None, phrases=None):
        self.rules = rules() if signatures is None else signatures
        self.keywords: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            for keyword in r[2]:
                self.keywords.setdefault(keyword, []).append(i)
        not_word = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
        self.phrases = []
        for phrase, label in (BASE if phrases is None else phrases).items():
            words = [re.escape(w.encode()) for w in phrase.split()]
            self.phrases.append((label, len(words), words[0], re.compile(
                rb"(?<!" + b"[^" + not_word[1:] + b")" + (not_word + rb"+").join(words)
                + rb"(?![^" + not_word[1:] + b")")))

    def scan(self, texts: pa.Array):
        """Per text: words, base places (n, first, last, labels) and resolved detections."""
        n = len(texts)
        whole = b"\0".join(t.as_buffer().to_pybytes() for t in texts).lower()
        data = np.frombuffer(whole, np.uint8)
        sizes = np.fromiter((t.as_buffer().size for t in texts), np.int64, n)
        begin = np.cumsum(sizes + 1) - sizes - 1
        starts, _, _ = tb.words(data, np.array([0, len(data)]), tb.ALNUM_WORD)
        first_word = np.searchsorted(starts, np.append(begin, len(data) + 1))
        base: dict[int, list] = {}
        for label, _, _, pattern in self.phrases:
            for m in pattern.finditer(whole):
                row = int(np.searchsorted(begin, m.start(), "right")) - 1
                if m.end() <= begin[row] + sizes[row]:
                    at = int(np.searchsorted(starts, m.start())) - int(first_word[row])
                    base.setdefault(row, []).append((at, label))
        squeezed = [squeeze(whole[b:b + s]) for b, s in zip(begin.tolist(), sizes.tolist())]
        stop = np.cumsum([len(t) + 1 for t in squeezed])
        gate = b"\0".join(squeezed)
        wanted: dict[int, set[int]] = {}
        for keyword, which in self.keywords.items():
            at = gate.find(keyword)
            while at >= 0:
                row = int(np.searchsorted(stop, at, "right"))
                wanted.setdefault(row, set()).update(which)
                at = gate.find(keyword, int(stop[row]))
        found = {}
        for row, which in wanted.items():
            text = whole[begin[row]:begin[row] + sizes[row]]
            hits = [(self.rules[i][0], m.start(), m.end(), self.rules[i][1], self.rules[i][4])
                    for i in sorted(which) for m in self.rules[i][3].finditer(text)]
            if hits:
                found[row] = resolve(hits)
        return np.diff(first_word), base, found


_workers: list[Scanner] = []

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, detections array<struct<label:string,start:long,end:long,"
          "priority:int>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One line per row: word counts, base phrase places, labels, score and the detections with
    their byte spans and priorities. One scan, no shuffle."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()),
                               ("end", pa.int64()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _workers:
            _workers.append(Scanner())
        for b in batches:
            texts = tb.text_array(b.column(1))
            for lo, hi in tb.slabs(texts):
                n_words, base, found = _workers[0].scan(texts.slice(lo, hi - lo))
                rows = []
                for r in range(hi - lo):
                    places, hits = base.get(r, []), found.get(r, [])
                    own = {label for _, label in places}
                    rows.append((
                        len(places), min(places)[0] if places else None,
                        max(places)[0] if places else None, ",".join(sorted(own)),
                        ",".join(sorted(own | {h[3] for h in hits})),
                        max([h[4] for h in hits] + [0.7] * bool(places) + [0.0]),
                        [{"label": h[3], "start": h[1], "end": h[2], "priority": h[0]}
                         for h in hits]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(n_words.astype(np.int64)),
                    *[pa.array(cols[i], pa.int64()) for i in range(3)],
                    pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()),
                    pa.array(cols[5], pa.float64()), pa.array(cols[6], kind)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                           "labels", "score", "detections"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)[id_col]}, {SCHEMA}")
