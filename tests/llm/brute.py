"""Plain readings of the contracts, one document at a time or pair by pair."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def line_dedup(docs):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    result = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        result[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return result


def quality_figures(docs):
    result = {}
    for doc, text in docs:
        text = text or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        result[doc] = (
            len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed
        )
    return result


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_data(docs):
    result = {}
    for doc, text in docs:
        spans = []
        for kind, pattern in PLAIN.items():
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": True,
                    "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and _luhn(digits),
                    "phone": 9 <= len(digits) <= 15,
                }[kind]
                if good:
                    spans.append((kind, m.start(), m.end()))
        count = Counter(s[0] for s in spans)
        result[doc] = (*[count[k] for k in PLAIN], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
    return result


def repeated_positions(sequences, width):
    """For every sequence, whether each place is inside a window of this width that also starts anywhere else."""
    count = Counter(tuple(s[i : i + width]) if not isinstance(s, bytes) else s[i : i + width]
                    for s in sequences for i in range(len(s) - width + 1))
    marks = []
    for s in sequences:
        mark = [False] * len(s)
        for i in range(len(s) - width + 1):
            w = tuple(s[i : i + width]) if not isinstance(s, bytes) else s[i : i + width]
            if count[w] > 1:
                mark[i : i + width] = [True] * width
        marks.append(mark)
    return marks


def substring_dedup(docs, width=35):
    words = [WORD.findall(text or "") for _, text in docs]
    result = {}
    for (doc, _), w, mark in zip(docs, words, repeated_positions(words, width)):
        kept = [x for x, gone in zip(w, mark) if not gone]
        result[doc] = (len(w), sum(mark), sha(" ".join(kept)))
    return result


def byte_dedup(docs, width=200):
    texts = [(text or "").encode() for _, text in docs]
    result = {}
    for (doc, _), t, mark in zip(docs, texts, repeated_positions(texts, width)):
        spans = sum(gone and not before for gone, before in zip(mark, [False, *mark]))
        result[doc] = (len(t), sum(mark), spans, sha(bytes(b for b, gone in zip(t, mark) if not gone)))
    return result
