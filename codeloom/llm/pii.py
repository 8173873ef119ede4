"""Personal data with offsets into the source, through disguises too.

Plain identifiers are found in the text as it stands. Transducers then rewrite the text - look-alike characters, invisible
characters, spelled digits, at/dot disguises - while keeping, for each character written, the source span it came from.
What the same detectors find in the rewritten text is mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .langid import folded
from .scratch import carried, narrow_batches, spare, spread

KINDS = ("email", "ip", "card", "phone")

#: Numbers up to 255 as they are written with up to three digits.
_BYTES = frozenset(f"{k:0{n}d}" for k in range(256) for n in (1, 2, 3))

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots; each four of them in turn are what ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` finds, in one pass over any run of digits.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Latin look-alikes of other scripts, and characters that print as a sign of identifiers.
_ALIKE = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
#: Characters that are not seen: zero-width ones, soft hyphen, joiners, byte-order mark.
_UNSEEN = "­​‌‍⁠﻿"
# More letters that look like Latin ones.
_ALIKE.update({"ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ϲ": "c", "ϳ": "j"})
_ALIKE.update({chr(base + k): str(k) for base in (0x0660, 0x06F0, 0x0966) for k in range(10)})
_ALIKE.update({chr(base + k): chr(0x41 + k) for base in (0x1F150, 0x1F170) for k in range(26)})
#: Characters that compatibility folding makes several letters or digits.
_WIDE: dict[str, str] = {}


def _compatible() -> None:
    """Adds what Unicode's compatibility folding (NFKC) makes plain ASCII: full width, mathematical, circled and squared letters, raised digits and so on."""
    for low, high in ((0xA0, 0x2500), (0x3000, 0x3400), (0xFE50, 0xFFF0), (0x1D400, 0x1D800), (0x1F100, 0x1F200)):
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            plain = "".join(_ALIKE.get(x, x) for x in plain) if c not in _ALIKE else c
            if plain.isascii() and plain.isprintable():
                if len(plain) == 1:
                    _ALIKE[c] = plain
                elif plain.isalnum():
                    _WIDE[c] = plain


_compatible()
_FOLDED = re.compile("[" + "".join(map(re.escape, sorted(_WIDE))) + "]")
#: Signs for at and dot as a page's source writes them.
_ENTITY = re.compile(r"(?i)&(?:(?P<at>#0*64|#x0*40|commat)|#0*46|#x0*2e|period);")
_LETTERS = str.maketrans(_ALIKE)
_INVISIBLE = re.compile("[" + re.escape(_UNSEEN) + "]")

# Spelled digits.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_RUN_FIRST = "".join(sorted({w[0] for w in _SPELLED} | {"p"}))
#: At least two digits in a row, spelled or single; "plus" may lead, "dot"/"point" may stand between.
_RUN = re.compile(
    rf"(?i)(?<![^\W_])(?=[0-9{_RUN_FIRST}])(?:plus[\s.-]+)?(?:{_DIGIT_WORD}|[0-9])"
    rf"(?:[\s,.()-]*(?:(?:dot|point|punkt|punto)[\s,.-]+)?(?:{_DIGIT_WORD}|[0-9]))+(?![^\W_])"
)
_RUN_TOKEN = re.compile(rf"(?i)plus|dot|point|punkt|punto|{_DIGIT_WORD}|[0-9]")
#: Digits of a run that can be a phone or card number, and digits and dots of one that can be an address.
RUN_DIGITS, ADDRESS_DIGITS, ADDRESS_DOTS = 9, 4, 3

_OPENING, _CLOSING = r"[\[({<]", r"[\])}>]"
_DOT_NAMES = ("dot", "punkt", "punto", "point")
_DOT = rf"(?:\s*{_OPENING}\s*(?:{'|'.join(_DOT_NAMES)}|\.)\s*{_CLOSING}\s*|\s+(?:{'|'.join(_DOT_NAMES)})\s+|\.)"
#: The same read backwards.
_TOD = "|".join(w[::-1] for w in _DOT_NAMES)
_DOT_BACK = rf"(?:\s*{_CLOSING}\s*(?:{_TOD}|\.)\s*{_OPENING}\s*|\s+(?:{_TOD})\s+|\.)"
#: A sign for at without the white space around it; a bare word counts only together with a disguised dot.
_AT = re.compile(rf"(?i){_OPENING}\s*(?:at|@|arroba|ät)\s*{_CLOSING}|(?<=\s)(?:at|arroba)(?=\s)|@")
#: Labels joined by signs for dot: what follows a sign for at, and what stands before it, read backwards.
_HOST = re.compile(rf"(?i)[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++")
_LOCAL_BACK = re.compile(rf"(?i)[a-z0-9_%+-]++(?:{_DOT_BACK}[a-z0-9_%+-]++)*+")
_DOT_SIGN = re.compile(rf"(?i){_DOT}")
#: Four numbers joined by signs for dot.
_DISGUISED_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")
_BRACKETED = re.compile(rf"(?i){_OPENING}\s*(?:at|@|arroba|ät|dot|\.|punkt|punto|point)\s*{_CLOSING}")
_BARE = re.compile(r"(?i)\s(?:dot|punkt|punto|point)\s|\s@|@\s")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``_EMAIL.finditer``, started from each @ so that text without one is not scanned."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


@dataclass
class Signs:
    """Which searches can succeed in a text; all of them unless something is known of it."""

    ip: bool = True
    card: bool = True
    odd: bool = True
    spelled: bool = True
    at_dot: bool = True


_ANY = Signs()


def plain_spans(text: str, signs: Signs = _ANY) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail a check are dropped and not retried."""
    found: list[Span] = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if signs.ip:
        for m in _DOTTED.finditer(text):
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                end = at + len(own[0]) + len(own[1]) + len(own[2]) + len(own[3]) + 3
                if all(p in _BYTES or (len(p) > 3 and p.lstrip("0") in _BYTES) or not p.strip("0") for p in own):
                    found.append(("ip", at, end))
                at = end + 1
    if signs.card:
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Rewritten:
    """A text with, for each of its characters, the source span it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.edits = text, 0
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """``edits``: (start, end, by) in order, in places of this text. Each character of ``by`` stands for the whole replaced span."""
        if not edits:
            return self
        text, done = [], 0
        for s, e, by in edits:
            text += [self.text[done:s], by]
            done = e
        out = Rewritten("")
        out.text, out.edits = "".join([*text, self.text[done:]]), self.edits + len(edits)
        s, e, size = (np.array(x, np.int64) for x in ([x[0] for x in edits], [x[1] for x in edits], [len(x[2]) for x in edits]))
        kept = _outside(len(self.text), s, e)
        added = np.r_[0, np.cumsum(size)]
        to = np.arange(len(kept)) + added[np.searchsorted(s, kept, "right")]
        first = np.searchsorted(kept, s) + added[:-1]
        into = np.repeat(first - added[:-1], size) + np.arange(added[-1])
        out.starts, out.ends = np.empty(len(out.text), np.int64), np.empty(len(out.text), np.int64)
        out.starts[to], out.ends[to] = self.starts[kept], self.ends[kept]
        out.starts[into], out.ends[into] = np.repeat(self.starts[s], size), np.repeat(self.ends[e - 1], size)
        return out


def _outside(n: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Places below ``n`` in none of the disjoint spans [s, e)."""
    depth = np.zeros(n + 1, np.int8)
    depth[s] += 1
    depth[e] -= 1
    # where one span ends and the next begins both marks fall on one place and cancel
    return np.flatnonzero(np.cumsum(depth[:-1]) == 0)


def _characters(r: Rewritten) -> Rewritten:
    """Look-alikes by their letters; unseen characters away; entities for at and dot by their signs."""
    shown = r.text.translate(_LETTERS)
    out = Rewritten(shown)
    out.edits = int(shown != r.text)
    edits = [(m.start(), m.end(), "") for m in _INVISIBLE.finditer(shown)] + [(m.start(), m.end(), _WIDE[m.group()]) for m in _FOLDED.finditer(shown)]
    edits += [(m.start(), m.end(), "@" if m["at"] else ".") for m in _ENTITY.finditer(shown)] if "&" in shown else []
    return out.replaced(sorted(edits))


def _spelled_digits(r: Rewritten, least: int) -> Rewritten:
    """Runs with ``least`` or more spelled digits, and with digits enough for an identifier, become digits."""
    edits = []
    for run in _RUN.finditer(r.text):
        tokens = [(t.start(), t.end(), t.group().lower()) for t in _RUN_TOKEN.finditer(r.text, run.start(), run.end())]
        digits = sum(w in _SPELLED or w.isdigit() for _, _, w in tokens)
        dots = len(tokens) - digits + run.group().count(".")
        if digits < RUN_DIGITS and (digits < ADDRESS_DIGITS or dots < ADDRESS_DOTS) or sum(w in _SPELLED for _, _, w in tokens) < least:
            continue
        for (s, e, word), after in zip(tokens, [*tokens[1:], None], strict=True):
            by = {"plus": "+"}.get(word) or _SPELLED.get(word) or (word if word.isdigit() else ".")
            edits.append((s, after[0] if after and "." not in r.text[e : after[0]] else e, by))
    return r.replaced(edits)


def _at_and_dot(r: Rewritten) -> Rewritten:
    """Disguised addresses are grown from each sign for at, to the right and then to the left, never over the one before."""
    text, edits, done, n = r.text, [], 0, len(r.text)
    back = ""
    for sign in _AT.finditer(text):
        s, e = sign.span()
        if s < done:
            continue
        right = e
        while right < n and text[right].isspace():
            right += 1
        host = _HOST.match(text, right)
        if not host:
            continue
        disguised = [d for d in _DOT_SIGN.finditer(text, right, host.end()) if d.group() != "."]
        if sign.group().isalpha() and not disguised:
            continue
        left = s
        while left > done and text[left - 1].isspace():
            left -= 1
        back = back or text[::-1]
        local = _LOCAL_BACK.match(back, n - left, n - done)
        if not local:
            continue
        disguised = [d for d in _DOT_SIGN.finditer(text, n - local.end(), left) if d.group() != "."] + [(left, right)] + disguised
        if len(disguised) > 1 or right - left > 1:
            edits += [(left, right, "@") if isinstance(d, tuple) else (d.start(), d.end(), ".") for d in disguised]
            done = host.end()
    addresses = []
    for m in _DISGUISED_IP.finditer(text):
        i = bisect_left(edits, (m.start(), -1, ""))
        if (i == 0 or edits[i - 1][1] <= m.start()) and (i == len(edits) or edits[i][0] >= m.end()):
            addresses += [(d.start(), d.end(), ".") for d in _DOT_SIGN.finditer(text, m.start(), m.end()) if d.group() != "."]
    return r.replaced(sorted(edits + addresses))


def _merged(more: list[Span], held: list[Span], text: str) -> list[Span]:
    """Those of ``more`` that overlap none of ``held`` of their kind, or hold more than all that they overlap.

    Numbers that blanks part from a whole address are not of it. Spans of one kind in ``held`` are taken to have starts and
    ends in one order, or to be few.
    """
    own = {k: sorted((x for x in held if x[0] == k), key=lambda x: (x[2], x[1])) for k in {x[0] for x in more}}
    ends = {k: [x[2] for x in v] for k, v in own.items()}
    out = []
    for span in more:
        kind, s, e = span
        i, over = bisect_left(ends[kind], s + 1), []
        while i < len(own[kind]) and own[kind][i][1] < e:
            over.append(own[kind][i])
            i += 1
        if over:
            if any(x[1] < s or x[2] > e for x in over) or span in over:
                continue
            if kind == "ip" and any(c.isspace() for c in text[s : over[0][1]] + text[over[-1][2] : e]):
                continue
        out.append(span)
    return out


def disguised_spans(text: str, signs: Signs = _ANY) -> list[Span]:
    """Spans of ``text`` that the detectors find only after rewriting it.

    Runs of three or more spelled digits are rewritten first, then those of one or two as well: a single spelled digit
    beside a number may be no part of it, and must not hide what is found without it.
    """
    first = Rewritten(text)
    if signs.odd and not text.isascii() or "&" in text and _ENTITY.search(text):
        first = _characters(first)
    spelled = signs.spelled or first.edits > 0
    found: list[Span] = []
    edits = 0
    for least in (3, 1) if spelled else (3,):
        r = _spelled_digits(first, least) if spelled else first
        if least == 1 and r.edits == edits:
            break
        edits = r.edits
        if (signs.at_dot or r.edits) and (_BRACKETED.search(r.text) or _BARE.search(r.text)):
            r = _at_and_dot(r)
        if r.edits:
            found += _merged([(kind, int(r.starts[s]), int(r.ends[e - 1])) for kind, s, e in plain_spans(r.text)], found, text)
    return found


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_KEPT = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _keys_of(words: Iterable[str]) -> np.ndarray:
    """Words of at most eight bytes as numbers, sorted."""
    return np.unique(np.array([int.from_bytes(w.encode(), "little") for w in words], np.uint64))


def _is_any(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_DIGIT_WORDS = _keys_of(_SPELLED)
_DIGIT_STARTS = {n: _keys_of(w for w in _SPELLED if len(w.encode()) == n) for n in sorted({len(w.encode()) for w in _SPELLED})}
#: A word made of digits, spelled or not.
_COMPOUND = re.compile(rf"(?i)(?:plus|dot|point|punkt|punto|{_DIGIT_WORD}|[0-9]|\s)+")
_DOT_WORDS = _keys_of(_DOT_NAMES)
_PLUS = _keys_of(("plus",))
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 40, 41, 44, 45, 46]] = True
_AT_WORDS = _keys_of(("at", "arroba", "ät"))
_PART = np.zeros(256, bool)
_PART[48:58] = _PART[97:123] = _PART[128:] = True
_OPEN = np.zeros(256, bool)
_OPEN[[40, 60, 91, 123]] = True
#: First UTF-8 bytes of the characters that the first transducer rewrites.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[sorted({c.encode()[0] for c in [*_ALIKE, *_WIDE, *_UNSEEN]})] = True


def _number_runs(low: np.ndarray, at: np.ndarray, w: tb.Words, first8: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a row can hold a run of digits, some of them spelled, that is long enough for an identifier.

    A run is a row of numbers, spelled digits, words made of several, and words for dot and plus, with nothing but
    separators between. ``first8`` and ``key``: the first eight bytes of each word, and those of it alone if it has no more.
    """
    rows = len(at) - 1
    if not len(key):
        return np.zeros(rows, bool)
    size = w.end - w.start
    digits = np.r_[0, np.cumsum((low >= 48) & (low <= 57))]
    digits = digits[w.end] - digits[w.start]
    spelled, dot = _is_any(key, _DIGIT_WORDS), _is_any(key, _DOT_WORDS)
    mixed = (digits > 0) & (digits < size)
    for n, starts in _DIGIT_STARTS.items():
        mixed |= (size > n) & _is_any(first8 & _KEPT[n], starts)
    several = np.zeros(len(key), bool)
    for i in np.flatnonzero(mixed & ~spelled):
        word = low[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")
        if _COMPOUND.fullmatch(word):
            several[i], digits[i] = True, len(_RUN_TOKEN.findall(word))
        else:
            digits[i] = 0
    digits[spelled] = 1
    member = (digits > 0) | dot | _is_any(key, _PLUS)
    other = np.r_[0, np.cumsum(~_BETWEEN[low])]
    row = np.searchsorted(w.row_at, np.arange(len(key)), "right") - 1
    joined = np.zeros(len(key), bool)
    joined[1:] = member[1:] & member[:-1] & (other[w.start[1:]] == other[w.end[:-1]]) & (row[1:] == row[:-1])
    places = np.flatnonzero(member)
    if not len(places):
        return np.zeros(rows, bool)
    run = np.cumsum(~joined[places]) - 1
    first = np.flatnonzero(~joined[places])
    last = np.r_[first[1:], len(places)] - 1
    signs = np.r_[0, np.cumsum(low == 46)]
    dots = np.bincount(run, dot[places]) + signs[w.end[places[last]]] - signs[w.start[places[first]]]
    many = np.bincount(run, digits[places])
    some = np.bincount(run, (spelled | several)[places]) > 0
    found = some & ((many >= RUN_DIGITS) | (many >= ADDRESS_DIGITS) & (dots >= ADDRESS_DOTS))
    return np.bincount(row[places[first]], found, rows)[:rows] > 0


def signs_of(raw: np.ndarray, at: np.ndarray) -> list[Signs]:
    """Of each row; only what cannot be there is ruled out."""
    low = folded(raw)
    n = len(low)
    digit = (low >= 48) & (low <= 57)
    some = tb.row_sums(digit, at)
    dotted = np.zeros(n, bool)
    dotted[1:] = digit[:-1] & (low[1:] == 46)
    after_open = np.zeros(n, bool)
    if n:
        after_open[1:] = _OPEN[low[:-1]]
        blank = ~tb.NOT_SPACE[low] & after_open
        while blank.any():  # an opening bracket, then any white space
            further = np.flatnonzero(blank) + 1
            further = further[further < n]
            further = further[~after_open[further]]
            after_open[further] = True
            blank = np.zeros(n, bool)
            blank[further] = ~tb.NOT_SPACE[low[further]]
    w = tb.words(low, at, _PART)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    first8 = np.ndarray((n + 1,), np.dtype("<u8"), buffer=padded.data, strides=(1,))[w.start]
    size = w.end - w.start
    key = np.where(size <= 8, first8 & _KEPT[np.minimum(size, 8)], np.uint64(0))
    run = _number_runs(low, at, w, first8, key)
    dot_word = _is_any(key, _DOT_WORDS)
    at_word = _is_any(key, _AT_WORDS) & after_open[w.start] if n else np.zeros(0, bool)
    words = tb.row_sums(dot_word | at_word, w.row_at)
    marks = tb.row_sums((low == 64) | (low == 46) & after_open, at)
    odd = tb.row_sums(_ODD_LEAD[raw], at) > 0
    ip = (some >= 4) & (tb.row_sums(dotted, at) >= 3)
    return [Signs(bool(i), bool(c), bool(o), bool(s), bool(a)) for i, c, o, s, a in zip(ip, some >= 12, odd, run, (words > 0) | (marks > 0), strict=True)]


def spans_of(text: str | None, signs: Signs = _ANY) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans). A mapped span that overlaps a plain one of its kind counts only if it holds more than that."""
    if not text:
        return [], []
    base = _ordered(plain_spans(text, signs))
    more = _merged(disguised_spans(text, signs), base, text)
    return base, _ordered(base + more) if more else base


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, signs: Signs = _ANY) -> str | None:
    """``text`` with each span, or each run of overlapping ones, replaced by <KIND> of its first. Null stays null."""
    _, spans = spans_of(text, signs)
    if not spans:
        return text
    out, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: ``base`` and ``spans`` written as kind:start:end by start, then kind.

    Offsets count code points of the whole text, ends exclusive. Null and empty texts have none.
    """
    narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t"):
                found = [spans_of(t.as_py(), s) for t, s in zip(b.column("t"), signs_of(*tb.buffers(b.column("t"))), strict=True)]
                yield pa.record_batch([b.column("doc_id"), pa.array([written_spans(x) for x, _ in found], pa.string()), pa.array([written_spans(x) for _, x in found], pa.string())], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(tb.returning(run), "doc_id long, base string, spans string")


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its own columns; ``text`` redacted."""
    narrow_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    source, schema = carried(docs.withColumn(spare(docs.columns, "__none"), F.lit(None).cast("int")), [*others, spare(docs.columns, "__none")], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                clean = pa.array([redacted(t.as_py(), s) for t, s in zip(b.column(1), signs_of(*tb.buffers(b.column(1))), strict=True)], pa.string())
                yield pa.record_batch([b.column(0), clean], names=["kept", "clean"])

    return spread(source.mapInArrow(tb.returning(run), schema("clean string")), others, {"clean": text}).select(*[F.col(f"`{c}`") for c in docs.columns])
