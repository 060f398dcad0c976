"""Personal data in text, with disguises undone and every span given in source characters.

Transducers rewrite the text piece by piece and remember where each piece came from: look-alike
letters and digits, invisible characters, spelled digits, and words or brackets that stand for
"at" and "dot".  Identifiers are found in the rewritten text, and their spans are carried back.
"""
from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only begin where digits begin
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, and signs drawn like "@", ".", "+", "-" or a space.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "п": "n", "г": "r",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ε": "e", "τ": "t", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "İ": "I", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L", "ᴏ": "o", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "٠": "0", "۰": "0", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "﹒": ".", "﹫": "@", "＋": "+", "﹢": "+",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "null": "0", "zéro": "0", "cero": "0", "one": "1", "eins": "1", "un": "1", "uno": "1", "two": "2", "zwei": "2", "zwo": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3", "four": "4", "vier": "4", "quatre": "4", "cuatro": "4", "five": "5", "fünf": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "sept": "7", "siete": "7", "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}
AT, DOT, PLUS = ("at", "arroba", "chez"), ("dot", "punkt", "point", "punto"), ("plus", "más")


class _Fold(dict):
    """Code point -> its ASCII look-alike; one character for one, so offsets stay."""
    def __missing__(self, c: int) -> int:
        out = c
        if c > 127:
            ch = chr(c)
            plain = LOOKALIKES.get(ch) or unicodedata.normalize("NFKC", ch)
            digit = unicodedata.decimal(ch, None)
            out = 48 + digit if digit is not None else ord(plain) if len(plain) == 1 and plain.isascii() else c
        self[c] = out
        return out


FOLD = _Fold()
_words = lambda xs: "|".join(sorted(map(re.escape, xs), key=len, reverse=True))
_DIGITS = rf"(?:(?:{_words(TIMES)})[ -])?(?:{_words(SPELLED)})"
_GAP = r"(?:(?<!\s)\s+)?"  # begins at the first blank of a run only, or long runs would be tried from each blank
_DOTTED = rf"(?:{_GAP}[(\[{{<]\s*(?:{_words(DOT)}|\.)\s*[)\]}}>]\s*|(?<!\s)\s+(?:{_words(DOT)})\s+|(?<=[A-Za-z0-9])[_-](?:{_words(DOT)})[_-](?=[A-Za-z0-9]))"
REWRITE = re.compile(
    rf"(?P<gone>[{INVISIBLE}]+)"
    rf"|(?P<at>{_GAP}[(\[{{<]\s*(?:{_words(AT)}|@)\s*[)\]}}>]\s*|(?<=[A-Za-z0-9_])(?:\s+|[_-])(?:{_words(AT)})(?:\s+|[_-])(?!(?:the|a|an|this|that)\s)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOTTED})"
    rf"|(?<=[A-Za-z0-9_])(?P<tie>[_-])(?:{_words(AT)})(?P=tie)(?=[A-Za-z0-9-]+\.[A-Za-z0-9]))"
    rf"|(?P<dot>{_DOTTED})"
    rf"|(?P<plus>(?<![^\W_])(?:{_words(PLUS)})\s+(?=[0-9(]|(?:{_words(SPELLED)})(?![^\W_])))"
    rf"|(?P<run>(?<![^\W_]){_DIGITS}(?:[ ,-]{{1,2}}{_DIGITS})*(?![^\W_]))", re.IGNORECASE)
ONE = re.compile(rf"(?:(?P<times>{_words(TIMES)})[ -])?(?P<digit>{_words(SPELLED)})", re.IGNORECASE)

WORD = re.compile(r"[^\W_]+")
RULED = frozenset([*SPELLED, *AT, *DOT, *PLUS])
SIGNS = re.compile(rf"[{INVISIBLE}]|[(\[{{<]\s*[@.]\s*[)\]}}>]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Undisguised identifiers, by kind and then start; leftmost and non-overlapping per kind."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tape:
    """Output of a transducer with the way back to its input."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at: list[int] = []        # where each piece begins in the output
        self.source: list[tuple[int, int, bool]] = []  # its input range; True: copied as it is
        self.size = 0

    def put(self, text: str, start: int, end: int, copied: bool = False) -> None:
        if text:
            self.out.append(text)
            self.at.append(self.size)
            self.source.append((start, end, copied))
            self.size += len(text)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Input range of an output range, and whether any of it was rewritten."""
        i, j = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a, _, kept = self.source[i]
        c, d, held = self.source[j]
        first = a + (start - self.at[i]) if kept else a
        last = c + (end - self.at[j]) if held else d
        return first, last, i != j or not kept


def rewrite(text: str) -> tuple[str, Tape]:
    """``text`` (already folded) with disguises undone, and the tape that leads back."""
    tape, done = Tape(), 0
    for m in REWRITE.finditer(text):
        tape.put(text[done:m.start()], done, m.start(), True)
        done = m.end()
        if m.lastgroup == "run":
            for one in ONE.finditer(text, m.start(), m.end()):
                tape.put(SPELLED[one["digit"].lower()] * TIMES.get((one["times"] or "").lower(), 1), *one.span())
        else:
            tape.put({"gone": "", "at": "@", "dot": ".", "plus": "+"}[m.lastgroup], *m.span())
    tape.put(text[done:], done, len(text), True)
    return "".join(tape.out), tape


def may_change(text: str) -> bool:
    """False only where no transducer matches ``text`` (already folded): each needs a whole word of RULED, or SIGNS."""
    return not RULED.isdisjoint(WORD.findall(text.lower())) or SIGNS.search(text) is not None


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans with those of undone disguises; offsets in source characters.

    A disguised span is added where it meets no plain span of its kind, or holds such spans whole
    and is longer.
    """
    text = text or ""
    base = plain_spans(text)
    folded = text if text.isascii() else text.translate(FOLD)
    if folded == text and not may_change(text):
        return base, base
    changed, tape = rewrite(folded)
    if changed == text:
        return base, base
    added = []
    for kind, s, e in plain_spans(changed):
        a, b, _ = tape.back(s, e)
        met = [(x, y) for k, x, y in base if k == kind and x < b and a < y]
        if all(a <= x and y <= b and (x, y) != (a, b) for x, y in met):
            added.append((kind, a, b))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (plain spans), spans (all spans as
    kind:start:end, by kind and start).  A null text is an empty one."""
    def work(batches):
        for batch in batches:
            counts, sums, all_spans = [[] for _ in KINDS], [], []
            for text in batch.column(1):
                base, full = find_spans(text.as_py())
                for n, kind in zip(counts, KINDS):
                    n.append(sum(k == kind for k, _, _ in base))
                sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
                all_spans.append(digest(full))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(sums, pa.string()), pa.array(all_spans, pa.string())],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
