"""License detection by ordered signature rules.

A rule is a hand-written pattern with a label, a priority and a gate derived from that
pattern: lists of keywords, of each of which all its matches hold one. A rule runs on a
text only if its gate is open on the lower-cased text with blanks for all white space, so
gates save time and lose nothing. Detections are intervals; one that lies inside an
interval of higher priority, or of the same priority and greater length, is suppressed, so
"GNU General Public License, version 3" inside a longer, more specific notice does not
count on its own. The labels of the remaining detections and of the base phrases are the
document's; its score is the largest priority among them as a share of 100.

Every document is read once, whole, without a shuffle.
"""

from __future__ import annotations

import re
from re import _constants, _parser

from pyspark.sql import DataFrame

from .common import id_type, per_document
from .features import words

# Fixed values of the contract: phrases of words and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_PRIORITY = 80

# label | names (alternatives) | SPDX identifier pattern | web address pattern | a sentence of the text
LICENSES = [
    ("mit", r"mit|expat|x11", r"mit(?:-0)?", r"opensource\.org/licenses?/mit",
     r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("apache-2", r"apache(?: software)?(?: licen[cs]e)?,? ?(?:version |v)?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0",
     r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-1", r"apache(?: software)? licen[cs]e,? ?(?:version |v)?1(?:\.[01])?", r"apache-1\.[01]", r"apache\.org/licenses/license-1\.1",
     r"the names? .?apache.? must not be used to endorse"),
    ("gpl-2", r"gnu general public licen[cs]e,? ?(?:version |v\.?)?2|gplv?-?2", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2",
     r"either version 2 of the licen[cs]e,? or \(at your option\) any later version"),
    ("gpl-3", r"gnu general public licen[cs]e,? ?(?:version |v\.?)?3|gplv?-?3", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3",
     r"either version 3 of the licen[cs]e,? or \(at your option\) any later version"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public licen[cs]e,? ?(?:version |v\.?)?2(?:\.[01])?|lgplv?-?2(?:\.1)?", r"lgpl-2\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2",
     r"gnu lesser general public licen[cs]e as published by the free software foundation; either version 2\.1"),
    ("lgpl-3", r"(?:gnu )?lesser general public licen[cs]e,? ?(?:version |v\.?)?3|lgplv?-?3", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3",
     r"gnu lesser general public licen[cs]e as published by the free software foundation,? either version 3"),
    ("agpl-3", r"(?:gnu )?affero general public licen[cs]e(?:,? ?(?:version |v\.?)?3)?|agplv?-?3", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl",
     r"remote network interaction; use with the gnu general public licen[cs]e"),
    ("gfdl", r"gnu free documentation licen[cs]e", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl",
     r"with no invariant sections,? no front-cover texts"),
    ("bsd-2", r"(?:simplified bsd|bsd 2[- ]clause|2[- ]clause bsd|freebsd)", r"bsd-2-clause(?:-patent)?", r"opensource\.org/licenses?/bsd-2-clause",
     r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3", r"(?:new bsd|modified bsd|revised bsd|bsd 3[- ]clause|3[- ]clause bsd)", r"bsd-3-clause(?:-clear)?", r"opensource\.org/licenses?/bsd-3-clause",
     r"neither the name of .{1,60} nor the names of its contributors may be used to endorse"),
    ("bsd-4", r"(?:original bsd|bsd 4[- ]clause|4[- ]clause bsd)", r"bsd-4-clause", r"directory\.fsf\.org/wiki/license:bsd_4clause",
     r"all advertising materials mentioning features or use of this software must display"),
    ("mpl-1.1", r"mozilla public licen[cs]e,? ?(?:version |v\.?)?1\.[01]", r"mpl-1\.[01]", r"mozilla\.org/mpl/(?:mpl-)?1\.1",
     r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("mpl-2", r"mozilla public licen[cs]e,? ?(?:version |v\.?)?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/mpl/2\.0",
     r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("epl-1", r"eclipse public licen[cs]e,? ?(?:version |v\.? ?|- ?v? ?)?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10",
     r"made available under the terms of the eclipse public licen[cs]e v1"),
    ("epl-2", r"eclipse public licen[cs]e,? ?(?:version |v\.? ?|- ?v? ?)?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0",
     r"made available under the terms of the eclipse public licen[cs]e 2"),
    ("cddl", r"common development and distribution licen[cs]e", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl",
     r"subject to the terms of the common development and distribution"),
    ("eupl", r"european union public licen[cs]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/.{0,60}eupl",
     r"licen[cs]ed under the eupl"),
    ("isc", r"isc", r"isc", r"opensource\.org/licenses?/isc",
     r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?", r"zlib\.net/zlib_license",
     r"altered source versions must be plainly marked as such"),
    ("boost", r"boost software licen[cs]e(?:,? ?(?:version |v)?1(?:\.0)?)?", r"bsl-1\.0", r"boost\.org/license_1_0",
     r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("artistic-2", r"artistic licen[cs]e(?:,? ?(?:version |v)?2(?:\.0)?)?", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic",
     r"same terms as perl itself"),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", r"psf-2\.0|python-2\.0", r"docs\.python\.org/.{0,20}license",
     r"python software foundation hereby grants licen[cs]ee"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql\.org/about/licence",
     r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee"),
    ("openssl", r"openssl(?:[ /-]ssleay)?", r"openssl", r"openssl\.org/source/license",
     r"this product includes software developed by the openssl project"),
    ("ms-pl", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl", r"ms-pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl", r"ms-rl"),
    ("ofl", r"(?:sil )?open font licen[cs]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl", r"reserved font name"),
    ("unlicense", r"unlicen[cs]e", r"unlicense", r"unlicense\.org",
     r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the f\w+ you want to public licen[cs]e|wtfpl", r"wtfpl", r"wtfpl\.net", r"you just do what the f"),
    ("cc0", r"cc0(?:[- ]1\.0)?|creative commons zero", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero",
     r"waived all copyright and related or neighboring rights"),
    ("cc-by", r"cc[- ]by(?![- ](?:sa|nc|nd))|creative commons attribution(?![- ](?:share|non|no))", r"cc-by-[1234]\.0", r"creativecommons\.org/licenses/by/",
     r"attribution \d\.\d (?:international|unported|generic)"),
    ("cc-by-sa", r"cc[- ]by[- ]sa|creative commons attribution[- ]share ?-?alike", r"cc-by-sa-[1234]\.0", r"creativecommons\.org/licenses/by-sa/",
     r"attribution-sharealike \d\.\d"),
    ("cc-by-nd", r"cc[- ]by[- ]nd|creative commons attribution[- ]no ?-?deriv\w*", r"cc-by-nd-[1234]\.0", r"creativecommons\.org/licenses/by-nd/",
     r"attribution-noderiv\w+ \d\.\d"),
    ("cc-by-nc", r"cc[- ]by[- ]nc(?![- ](?:sa|nd))|creative commons attribution[- ]non ?-?commercial(?![- ](?:share|no))", r"cc-by-nc-[1234]\.0", r"creativecommons\.org/licenses/by-nc/",
     r"attribution-noncommercial \d\.\d"),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]non ?-?commercial[- ]share ?-?alike", r"cc-by-nc-sa-[1234]\.0", r"creativecommons\.org/licenses/by-nc-sa/",
     r"attribution-noncommercial-sharealike \d\.\d"),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]non ?-?commercial[- ]no ?-?deriv\w*", r"cc-by-nc-nd-[1234]\.0", r"creativecommons\.org/licenses/by-nc-nd/",
     r"attribution-noncommercial-noderiv\w+ \d\.\d"),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl", r"made available under the open database licen[cs]e"),
    ("odc-by", r"open data commons attribution licen[cs]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by", r"made available under the open data commons attribution"),
    ("pddl", r"public domain dedication and licen[cs]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl", r"made available under the public domain dedication"),
    ("proprietary", r"proprietary", r"licenseref-proprietary", r"example\.invalid/eula",
     r"no part of this (?:work|document|publication|software) may be (?:reproduced|copied|distributed)"),
]
#: kind -> (priority, pattern around the names of a license)
FORMS = {
    "tag": (100, r"spdx-license-identifier:\s{{0,4}}(?:{spdx})(?![\w.-])"),
    "text": (90, r"{text}"),
    "address": (85, r"(?:https?://)?(?:www\.)?{address}"),
    "grant": (75, r"(?:licen[cs]ed|released|distributed|available|published|provided|covered)\s(?:\w+\s){{0,3}}?(?:under|by)\s(?:the\s|a\s)?(?:terms\sof\s)?(?:the\s|a\s)?(?:{name})(?!\w)"),
    "name": (60, r"(?<!\w)(?:{name})[\s-]licen[cs]e(?:,?\s(?:version\s|v)?\d(?:\.\d)*)?(?!\w)"),
    "mention": (40, r"(?<!\w)(?:{long})(?!\w)"),
}
GENERIC = [("public-domain", 50, r"(?:released|dedicated|placed|is) (?:in|in ?to|to) the public domain"),
           ("all-rights-reserved", 30, r"all rights reserved"),
           ("copyright", 20, r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d")]
#: Names too short or too common to stand alone.
NEEDS_CONTEXT = {"mit", "isc", "zlib", "postgresql", "openssl", "proprietary", "unlicense"}


#: Keywords a gate's list has at most, and the least length of each.
MOST_WORDS, LEAST_LETTERS = 12, 2


def _exact(item) -> set[str] | None:
    """All strings that a piece of a parsed pattern matches, or None if they are many."""
    op, arg = item
    if op is _constants.LITERAL:
        return {chr(arg)}
    if op is _constants.IN:
        if arg == [(_constants.CATEGORY, _constants.CATEGORY_SPACE)]:
            return {" "}
        out = set()
        for kind, value in arg:
            if kind is _constants.LITERAL:
                out.add(chr(value))
            elif (kind, value) == (_constants.CATEGORY, _constants.CATEGORY_SPACE):
                out.add(" ")
            else:
                return None
        return out
    if op is _constants.SUBPATTERN:
        return _exact_all(arg[3])
    if op is _constants.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _exact(item)
        if more is None or len(out) * len(more) > MOST_WORDS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _lists(items) -> set[frozenset[str]]:
    """Lists of keywords, of each of which every match of the parsed pattern holds one.
    White space counts as a blank; what may be absent adds nothing."""
    found, run = [], {""}
    for item in items:
        exact = _exact(item)
        if exact is not None and len(run) * len(exact) <= MOST_WORDS:
            run = {a + b for a in run for b in exact}
            continue
        found.append(run)
        run = {""} if exact is None else exact
        op, arg = item
        if exact is None and op is _constants.SUBPATTERN:
            found += _lists(arg[3])
        elif exact is None and op is _constants.BRANCH:
            best = [max(_lists(p), key=lambda ws: (min(map(len, ws)), -len(ws), sorted(ws)), default=None) for p in arg[1]]
            if None not in best:
                found.append(set().union(*best))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] > 0:
            found += _lists(arg[2])
    found.append(run)
    return {frozenset(w for w in ws if not any(v != w and v in w for v in ws))
            for ws in found if min(map(len, ws)) >= LEAST_LETTERS}


def gate_of(pattern: str) -> tuple[frozenset[str], ...]:
    """The gate of a pattern, the longest keywords first; () if it has none."""
    return tuple(sorted(_lists(list(_parser.parse(pattern))), key=lambda ws: (-min(map(len, ws)), len(ws), sorted(ws))))


_compiled: list = []


def rules() -> list[tuple[str, int, re.Pattern, tuple[frozenset[str], ...]]]:
    """(label, priority, pattern, gate), highest priority first."""
    if _compiled:
        return _compiled
    out = []
    for label, name, spdx, address, text in LICENSES:
        for kind, (priority, form) in FORMS.items():
            if kind == "mention" and label in NEEDS_CONTEXT:
                continue
            out.append((label, priority, form.format(spdx=spdx, text=text, address=address, name=name, long=name)))
    out += [(label, p, pattern) for label, p, pattern in GENERIC]
    out = [(label, p, pattern.replace(" ", r"\s")) for label, p, pattern in out]
    _compiled.extend(sorted(((label, p, re.compile(pattern), gate_of(pattern)) for label, p, pattern in out), key=lambda r: -r[1]))
    return _compiled


def suppress(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(priority, start, end, label) without those inside a stronger interval: higher
    priority, then greater length, then earlier label."""
    kept, reach = [], {}            # reach: largest end so far of each priority
    # of intervals that hold an interval, all come before it in this order
    for d in sorted(set(found), key=lambda d: (d[1], -d[2], -d[0], d[3])):
        if not any(p >= d[0] and end >= d[2] for p, end in reach.items()):
            kept.append(d)
        reach[d[0]] = max(reach.get(d[0], 0), d[2])
    return sorted(kept, key=lambda d: (d[1], d[2], d[3]))


def detect(text: str) -> list[tuple[int, int, int, str]]:
    """Remaining detections (priority, start, end, label); offsets are code points of
    the text."""
    low = text.lower()
    if len(low) != len(text):           # some capitals have longer lower-case forms
        low = text.translate(_LOWER)
    flat, seen = re.sub(r"\s", " ", low), {}

    def has(words_: frozenset[str]) -> bool:
        if words_ not in seen:
            seen[words_] = any(w in flat for w in words_)
        return seen[words_]
    return suppress([(priority, m.start(), m.end(), label) for label, priority, pattern, gate in rules()
                     if all(map(has, gate)) for m in pattern.finditer(low)])


_LOWER = {c: c + 32 for c in range(65, 91)}


def base_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase, overlapping ones too."""
    line = b" " + b" ".join(ws) + b" "
    out = []
    for phrase, label in PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at, counted, n = line.find(needle), 0, 0
        while at >= 0:
            n += line.count(b" ", counted, at)
            counted = at
            out.append((n, label))
            at = line.find(needle, at + 1)
    return out


def scan(text: str | None) -> tuple:
    text = text or ""
    ws = words(text)
    base = base_places(ws)
    found = detect(text)
    labels = {label for _, label in base}
    first = [i for i, _ in base]
    score = max([p for p, *_ in found] + [BASE_PRIORITY] * bool(base), default=0) / 100
    return (len(ws), len(base), min(first, default=None), max(first, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {d[3] for d in found})), score,
            ",".join(f"{label}:{a}:{b}" for _, a, b, label in found))


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base counts and labels, all labels, the score and
    the detections as label:start:end. Null and empty texts have none."""
    return per_document(docs, lambda ids, texts: [(i, *scan(t)) for i, t in zip(ids, texts)],
                        f"doc_id {id_type(docs)}, n_words long, n_base long, first_word long, last_word long, "
                        "base_labels string, labels string, score double, detections string")
