"""Plain single-machine versions of the operators' contracts, for tests only."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        ws = alnum_words(text)
        if item is None or not ws:
            continue
        m = min(13, len(ws))
        for i in range(len(ws) - m + 1):
            windows[tuple(ws[i:i + m])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        ws, hit, found = alnum_words(text), set(), set()
        for m in sizes:
            for i in range(len(ws) - m + 1):
                w = windows.get(tuple(ws[i:i + m]))
                if w:
                    hit.update(range(i, i + m))
                    found |= w
        out[doc] = (len(ws), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(ws))
    return out


def shingles(text):
    ws = SPACED.findall((text or "").translate(LOWER))
    if not ws:
        return frozenset()
    if len(ws) < 5:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))


def components(docs, percent=75):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    reps = {}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for d, s in sets.items():
        if s:
            if s in reps:
                union(reps[s], d)
            reps.setdefault(s, d)
    index = defaultdict(list)
    for s, d in reps.items():
        for g in s:
            index[g].append(d)
    for s, d in reps.items():
        n = Counter(o for g in s for o in index[g] if o < d)
        for o, k in n.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                union(d, o)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def spans(kinds, text, valid):
    out = []
    for order, (kind, pattern) in enumerate(kinds.items()):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


SECRETS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def secret_spans(text):
    def valid(kind, m):
        return {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]()
    return spans(SECRETS, text, valid)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_spans(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m[0])
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15}[kind]()
    return spans(PII, text, valid)


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    ws = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    n = Counter(grams)
    rep = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(rep),
            len(ws) < 20 or 100 * len(rep) > 30 * len(ws))


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_places(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    ws = alnum_words(text)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
