"""Operator 6, license scans: ordered signature rules behind a keyword prefilter.

Each rule is a regular expression over the folded words of a text, joined by single spaces, with a
priority. A rule runs only on texts that hold its keyword (one automaton pass over the text finds all
keywords). A detection that lies within another one of higher priority, or of the same priority and
greater length, is suppressed, in one sweep over them in that order. The contract's base phrases are rules too, and are never suppressed.

Defined results: null and empty texts have no words, detections or labels, and score 0; repeated rows
are scanned each; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import Any, NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, NOT_ALNUM, in_arrow, steps

_TO_WORDS = bytes(32 if NOT_ALNUM[LOWER_BYTES[b]] else LOWER_BYTES[b] for b in range(256))

#: The contract's phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Rule(NamedTuple):
    label: str
    priority: int  # a smaller number wins
    keyword: str
    pattern: str


class Detection(NamedTuple):
    start: int  # bytes in the folded text
    end: int
    priority: int
    label: str


#: (label, keyword, name): each name makes the rules of GRANTS below. Names are written by hand.
NAMES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v ?)3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v ?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v ?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: ?v ?[23](?: [01])?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v ?)3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: ?v ?3(?: 0)?)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause) bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl", "mpl", r"mpl(?: ?v)? ?[12] [01]"),
    ("epl", "eclipse", r"eclipse public licen[sc]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl", "common development", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "common public", r"common public licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e"),
    ("busl-1.1", "business source", r"business source licen[sc]e"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("python-2.0", "python", r"python (?:software foundation )?licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("unicode", "unicode", r"unicode(?: inc)? licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("odc-by", "attribution licen", r"open data commons attribution licen[sc]e"),
    ("eupl", "european union", r"european union public licen[sc]e"),
    ("eupl", "eupl", r"eupl"),
    ("osl-3.0", "open software", r"open software licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "creative commons", r"creative commons zero"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] [05])?(?! [ns][ad]\b)"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?(?! (?:nc|nd|sa)\b)"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: m| ?\+\+ m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama (?:[23] )?community licen[sc]e"),
)

#: Ways to grant a named license; the named forms are more certain than the bare name.
GRANTS = (
    (1, r"(?:is |are )?(?:released|distributed|available|published|provided|made available|dual licensed) under (?:the )?(?:terms of (?:the )?)?{}"),
    (1, r"(?:is |are )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{}"),
    (1, r"spdx licen[sc]e identifier {}"),
    (3, r"{}"),
)

#: Texts and notices that name no license.
NOTICES = (
    Rule("mit", 0, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("isc", 0, "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Rule("bsd", 0, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("bsd-3-clause", 0, "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    Rule("bsd-4-clause", 0, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    Rule("apache-2.0", 0, "apache org", r"(?:www )?apache org licenses license 2 0"),
    Rule("gpl", 0, "free software", r"this program is free software you can redistribute it and or modify it"),
    Rule("lgpl", 0, "free software", r"this library is free software you can redistribute it and or modify it"),
    Rule("mpl-2.0", 0, "mozilla public", r"subject to the terms of the mozilla public licen[sc]e v 2 0"),
    Rule("zlib", 0, "altered source", r"altered source versions must be plainly marked as such"),
    Rule("bsl-1.0", 0, "boost org", r"(?:www )?boost org license 1 0"),
    Rule("unlicense", 0, "public domain", r"this is free and unencumbered software released into the public domain"),
    Rule("wtfpl", 0, "what the", r"do what the [a-z]+ you want to public licen[sc]e"),
    Rule("public-domain", 2, "public domain", r"(?:in|into|to) the public domain"),
    Rule("cc", 0, "creativecommons org", r"creativecommons org (?:licenses|publicdomain) [a-z0-9]+"),
    Rule("proprietary", 2, "all rights reserved", r"all rights reserved"),
    Rule("proprietary", 2, "proprietary", r"proprietary and confidential"),
    Rule("proprietary", 2, "unauthorized copying", r"unauthorized copying of this (?:file|work|document)"),
    Rule("mit", 0, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Rule("mit", 1, "furnished to do so", r"to permit persons to whom the software is furnished to do so"),
    Rule("mit-0", 0, "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software(?! and to permit persons to whom the software is furnished to do so subject)"),
    Rule("x11", 0, "advertising or otherwise", r"(?:shall|may) not be used in advertising or otherwise to promote the sale use or other dealings"),
    Rule("hpnd", 0, "and its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    Rule("0bsd", 0, "0bsd", r"0bsd"),
    Rule("isc", 1, "copyright notice and this permission", r"provided that the above copyright notice and this permission notice appear in all copies"),
    Rule("bsd", 1, "retain the above", r"redistributions of source code must retain the above copyright notice"),
    Rule("bsd", 1, "in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    Rule("bsd-2-clause", 1, "freebsd", r"the freebsd (?:copyright|licen[sc]e|project)"),
    Rule("bsd-3-clause", 1, "regents", r"(?:the )?regents of the university of california"),
    Rule("bsd-3-clause-clear", 0, "express or implied licenses", r"no express or implied licenses to any party s patent rights are granted"),
    Rule("apache-2.0", 0, "licensed under the apache", r"licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance"),
    Rule("apache-2.0", 0, "in compliance with", r"you may not use this file except in compliance with the licen[sc]e"),
    Rule("apache-2.0", 1, "as is basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    Rule("apache-1.1", 0, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    Rule("apache-1.0", 0, "apache group", r"this product includes software developed by the apache group"),
    Rule("gpl-2.0-or-later", 0, "any later version", r"either version 2(?: of the licen[sc]e)? or at your option any later version"),
    Rule("gpl-3.0-or-later", 0, "any later version", r"either version 3(?: of the licen[sc]e)? or at your option any later version"),
    Rule("lgpl-2.1-or-later", 0, "any later version", r"either version 2 1(?: of the licen[sc]e)? or at your option any later version"),
    Rule("gpl", 1, "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    Rule("lgpl", 1, "gnu lesser", r"see the gnu lesser general public licen[sc]e for more details"),
    Rule("gpl", 1, "51 franklin", r"51 franklin (?:street|st) fifth floor boston ma"),
    Rule("gpl", 1, "temple place", r"59 temple place suite 330 boston ma"),
    Rule("gpl", 1, "gnu org licenses", r"(?:www )?gnu org licenses(?: gpl(?: [23] 0)?)?"),
    Rule("lgpl", 0, "gnu org licenses", r"(?:www )?gnu org licenses lgpl(?: [23] [01])?"),
    Rule("agpl-3.0", 0, "gnu org licenses", r"(?:www )?gnu org licenses agpl(?: 3 0)?"),
    Rule("gpl-2.0-classpath", 0, "classpath", r"(?:with (?:the )?)?classpath exception"),
    Rule("gpl-linking-exception", 0, "special exception", r"as a special exception the copyright holders? (?:of this library )?give you permission to link"),
    Rule("gcc-exception", 0, "runtime library exception", r"gcc runtime library exception"),
    Rule("autoconf-exception", 0, "configuration script", r"a configuration script generated by autoconf"),
    Rule("gfdl", 0, "invariant sections", r"with no invariant sections(?: with)? no front cover texts and (?:with )?no back cover texts"),
    Rule("mpl-2.0", 0, "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    Rule("mpl-1.1", 0, "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    Rule("npl-1.1", 0, "netscape public", r"netscape public licen[sc]e(?: version 1 [01])?"),
    Rule("epl", 0, "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    Rule("cddl", 0, "cddl", r"cddl(?: ?v?1 [01])?"),
    Rule("cddl", 0, "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    Rule("ms-pl", 0, "ms pl", r"ms pl"),
    Rule("ms-rl", 0, "ms rl", r"ms rl"),
    Rule("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented"),
    Rule("zlib", 1, "held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    Rule("libtiff", 0, "sam leffler", r"the names? of sam leffler(?: and silicon graphics)?"),
    Rule("ijg", 0, "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    Rule("openssl", 0, "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit"),
    Rule("ssleay", 0, "eric young", r"this product includes cryptographic software written by eric young"),
    Rule("curl", 0, "daniel stenberg", r"copyright c (?:[0-9]+ )*daniel stenberg"),
    Rule("bsl-1.0", 1, "machine executable", r"machine executable object code generated by a source language processor"),
    Rule("artistic", 1, "standard version", r"the standard version of the package"),
    Rule("perl", 0, "as perl itself", r"under the same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself"),
    Rule("python-2.0", 0, "psf", r"psf licen[sc]e(?: agreement)?"),
    Rule("cnri-python", 0, "cnri", r"cnri(?: open source)? licen[sc]e agreement"),
    Rule("tcl", 0, "regents of the university", r"copyrighted by the regents of the university of california sun microsystems inc"),
    Rule("postgresql", 0, "postgresql global development", r"postgresql global development group"),
    Rule("vim", 0, "vim licen", r"(?:the )?vim licen[sc]e"),
    Rule("beerware", 0, "beer", r"(?:the )?beer ?ware licen[sc]e"),
    Rule("json", 0, "good not evil", r"the software shall be used for good not evil"),
    Rule("sleepycat", 0, "sleepycat", r"sleepycat (?:software )?(?:public )?licen[sc]e"),
    Rule("qpl-1.0", 0, "q public", r"(?:the )?q public licen[sc]e"),
    Rule("ipl-1.0", 0, "ibm public", r"ibm public licen[sc]e"),
    Rule("apsl", 0, "apple public", r"apple public source licen[sc]e"),
    Rule("spl-1.0", 0, "sun public", r"sun public licen[sc]e"),
    Rule("w3c", 0, "w3c", r"w3c (?:software|document)(?: notice)?(?: and)? licen[sc]e"),
    Rule("ofl-1.1", 0, "reserved font name", r"with reserved font names?"),
    Rule("cc0-1.0", 0, "waived all copyright", r"(?:has )?waived all copyright and related or neighboring rights"),
    Rule("cc0-1.0", 0, "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    Rule("cc-by", 0, "licenses by", r"creativecommons org licenses by [1234] [05]"),
    Rule("cc-by-sa", 0, "licenses by sa", r"creativecommons org licenses by sa [1234] [05]"),
    Rule("cc-by-nc", 0, "licenses by nc", r"creativecommons org licenses by nc [1234] [05]"),
    Rule("cc-by-nd", 0, "licenses by nd", r"creativecommons org licenses by nd [1234] [05]"),
    Rule("cc-by-nc-sa", 0, "licenses by nc sa", r"creativecommons org licenses by nc sa [1234] [05]"),
    Rule("cc-by-nc-nd", 0, "licenses by nc nd", r"creativecommons org licenses by nc nd [1234] [05]"),
    Rule("odbl", 0, "opendatacommons", r"opendatacommons org licenses odbl"),
    Rule("odc-by", 0, "opendatacommons", r"opendatacommons org licenses by"),
    Rule("pddl", 0, "opendatacommons", r"opendatacommons org licenses pddl"),
    Rule("public-domain", 1, "reserved", r"no (?:copy)?rights? (?:is |are )?reserved"),
    Rule("public-domain", 1, "copyright to this source", r"(?:the )?authors? (?:hereby )?disclaims? copyright to this source code"),
    Rule("us-government", 1, "work of the united states", r"work of the united states government"),
    Rule("non-commercial", 2, "commercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
    Rule("non-commercial", 2, "commercial use", r"commercial use (?:is )?(?:strictly )?(?:prohibited|not permitted)"),
    Rule("research-only", 2, "research purposes", r"for (?:academic |scientific )?research purposes only"),
    Rule("evaluation", 2, "evaluation", r"for evaluation purposes only"),
    Rule("proprietary", 2, "trade secrets", r"contains? (?:confidential information and )?trade secrets"),
    Rule("proprietary", 2, "internal use", r"for internal use only"),
    Rule("proprietary", 2, "end user", r"end user licen[sc]e agreement"),
    Rule("proprietary", 2, "terms of", r"subject to (?:our|the) terms of (?:service|use)"),
    Rule("proprietary", 2, "do not distribute", r"do not (?:re)?distribute"),
    Rule("proprietary", 2, "without permission", r"may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission"),
)


def all_rules() -> tuple[Rule, ...]:
    granted = tuple(Rule(label, priority, word, grant.format(f"(?:{name})")) for label, word, name in NAMES for priority, grant in GRANTS)
    return (*NOTICES, *granted)


class Scanner:
    """Rules compiled, and the automaton of their keywords."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.by_word: dict[str, list[tuple[int, str, re.Pattern[bytes]]]] = {}
        for r in sorted(rules, key=lambda r: r.priority):
            self.by_word.setdefault(r.keyword, []).append((r.priority, r.label, re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])".encode())))
        self.words = ahocorasick.Automaton()
        for w in {*self.by_word, *BASE}:
            self.words.add_word(w, w)
        self.words.make_automaton()

    def keywords(self, folded: str) -> dict[str, list[int]]:
        """The end of each place of each keyword, from one pass."""
        out: dict[str, list[int]] = {}
        for end, word in self.words.iter(folded):
            out.setdefault(word, []).append(end + 1)
        return out

    def detect(self, folded: bytes, words: set[str]) -> list[Detection]:
        found = [Detection(m.start(), m.end(), p, label) for w in words if w in self.by_word for p, label, rule in self.by_word[w] for m in rule.finditer(folded)]
        return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Leave out each detection within a kept one of higher priority, or of the same and greater length."""
    kept: list[Detection] = []
    # kept spans that lie within no other kept one: both their starts and their ends ascend, so the last
    # one that starts no later than a span reaches furthest of all that could hold it
    starts: list[int] = []
    outer: list[Detection] = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        holder = outer[at - 1] if at else None
        if holder is None or holder.end < d.end:
            kept.append(d)
            low = at - 1 if at and starts[at - 1] == d.start else at
            high = low
            while high < len(outer) and outer[high].end <= d.end:
                high += 1
            starts[low:high], outer[low:high] = [d.start], [d]
        elif (holder.start, holder.end, holder.priority) == (d.start, d.end, d.priority):
            kept.append(d)  # another label of the same place
    return sorted(kept)


@cache
def scanner() -> Scanner:
    return Scanner(all_rules())


#: Certainty of a detection by its priority.
CERTAINTY = {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.8}


def scan_text(text: str | None) -> dict[str, Any]:
    words = (text or "").encode().translate(_TO_WORDS).split()
    folded = b" ".join(words)
    own = scanner()
    places = own.keywords(folded.decode("latin-1"))  # a character a byte, so that places are bytes
    starts: list[int] = []
    base: set[str] = set()
    detections: list[Detection] = []
    if places:
        for phrase, label in BASE.items():
            for end in places.get(phrase, ()):
                start = end - len(phrase)
                if (start == 0 or folded[start - 1] == 32) and (end == len(folded) or folded[end] == 32):
                    starts.append(start)
                    base.add(label)
        detections = own.detect(folded, set(places))
    spaces = [i for i, b in enumerate(folded) if b == 32] if starts or detections else []
    numbers = [bisect_right(spaces, s) for s in starts]
    labels = base | {d.label for d in detections}
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(numbers, default=None),
        "last_word": max(numbers, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": max([*(CERTAINTY[d.priority] for d in detections), 1.0 if base else 0.0]),
        "detections": [{"label": d.label, "first_word": bisect_right(spaces, d.start), "last_word": bisect_right(spaces, d.end - 1), "priority": d.priority} for d in detections],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first_word:long,last_word:long,priority:int>>"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32())])))])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch):
            found = pa.RecordBatch.from_pylist([scan_text(t) for t in piece.column(1).to_pylist()], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([piece.column(0), *found.columns], ["doc_id", *_ARROW.names])


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    return in_arrow(docs.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), _scan_batches, f"doc_id {docs.schema[key].dataType.simpleString()}, {SCHEMA}")
