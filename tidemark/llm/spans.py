"""Spans of patterns in texts, by scanners that take time in proportion to the text.

Positions are code points with an exclusive end. Each scanner gives the
leftmost non-overlapping matches of its pattern, less those that fail its
further condition; no scanner looks at a stretch of text again and again.
"""

from __future__ import annotations

import hashlib
import re

Span = tuple[str, int, int]

# The patterns of the kinds of secrets and of personal data.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DOT = re.compile(r"[0-9]\.[0-9]")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def assigns(text: str) -> list[Span]:
    return [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]


def accesses(text: str) -> list[Span]:
    return [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []


def hexes(text: str) -> list[Span]:
    return [("hex", *m.span()) for m in HEX.finditer(text)]


def emails(text: str) -> list[Span]:
    """The part before an @ reaches back as far as its characters go or to the match before; the domain follows."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    """Each stretch of dotted numbers falls into fours from its left."""
    found = []
    for m in DOTTED.finditer(text) if DOT.search(text) else ():
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append(("ip", at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(LUHN[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    return found


def phones(text: str) -> list[Span]:
    found = []
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
