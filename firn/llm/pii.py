"""Personal data: plain patterns, and the same patterns behind disguises with spans in the source.

Transducers rewrite a text step by step. Every character of the result knows which stretch of
the source it stands for, so what is found in the rewritten text has exact source offsets.
"""

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from firn.llm.common import pieces

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: from a later one it fails or was consumed.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGIT_DOT = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text):
    """Leftmost non-overlapping addresses: a run of local characters, @, a domain with a dot.

    Looks around each @, so its time is linear in the text.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s):
    return [c for c in s if "0" <= c <= "9"]


def plain_spans(text):
    """(kind number, start, end) of every identifier written plainly, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT_DOT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip(
    "аеорсухіѕјһԁԛԝАВЕКМНОРСТХІЅЈοαρυνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxisjhdqwABEKMHOPCTXISJoapuviABEZHIKMNOPTYX"))
# Signs that look like a dot, a hyphen, an at sign or a plus.
LOOKALIKES |= {c: "." for c in "。․．｡"} | {c: "-" for c in "‐‑‒–—−﹘﹣－"} | {"＠": "@", "﹫": "@", "＋": "+"} | {c: " " for c in "     　"}
# Invisible characters.
INVISIBLE = "­​‌‍⁠﻿"
# The digits' names in English, German, French and Spanish.
DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Last labels of the domains that are taken as such without brackets around the dot.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "de", "fr", "es", "uk", "us", "ch", "at", "it", "nl", "example", "test", "invalid")

_STRANGE = re.compile(f"[^\\x00-\\x7f\\u00c0-\\u024f]|[{INVISIBLE} ]")
_SIGN = r"[\[({<]\s*(at|@|dot|\.|point|punkt|punto)\s*[\])}>]"
_BRACKETED = re.compile(_SIGN, re.I)
_BRACKET = re.compile(rf"\s*{_SIGN}\s*", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+(?:dot|punkt|punto)\s+(?=[A-Za-z0-9])", re.I)
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{'|'.join(ENDINGS)})(?![A-Za-z0-9-]))", re.I)
_NAME = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?<!\w)(?:{_NAME})(?:[\s,-]+(?:{_NAME}|dot|punkt|punto|[0-9]+))+(?!\w)", re.I)
_NAME_DIGIT = re.compile(rf"(?<!\w)(?:{_NAME})[\s,-]+[0-9]")
_TOKEN = re.compile(rf"{_NAME}|dot|punkt|punto|[0-9]", re.I)
_NAMES = frozenset(n.encode() for n in DIGIT_NAMES)
#: ASCII without letters counts as a space.
_WORDS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_PLUS = re.compile(r"(?<!\w)plus[\s-]+(?=[0-9])", re.I)


def _look(c):
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and " " < n <= "~" and unicodedata.category(c) != "No" else c


class Traced:
    """A rewritten text; character i stands for source[start[i]:end[i]]."""

    def __init__(self, text):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits):
        """Put (lo, hi, [(characters, from, to), ...]) in place of text[lo:hi], left to right."""
        text, start, end, last = [], [], [], 0
        for lo, hi, parts in edits:
            text.append(self.text[last:lo]); start += self.start[last:lo]; end += self.end[last:lo]
            for c, a, b in parts:
                text.append(c); start.append(self.start[a]); end.append(self.end[b - 1])
            last = hi
        text.append(self.text[last:]); start += self.start[last:]; end += self.end[last:]
        self.text, self.start, self.end = "".join(text), start, end

    def changed(self, lo, hi, source):
        a, b = self.start[lo], self.end[hi - 1]
        return source[a:b] != self.text[lo:hi]


def spoken_digits(low):
    """Whether two digit names follow each other, digits and punctuation aside, or one stands by a digit."""
    words = low.encode("utf-8", "replace").translate(_WORDS).split()
    if _NAMES.isdisjoint(words):
        return False
    flags = [w in _NAMES for w in words]
    return any(a and b for a, b in zip(flags, flags[1:])) or _NAME_DIGIT.search(low) is not None


def clear(text):
    """The text with look-alikes, bracketed and spoken signs and spoken digits written plainly, or None if it has none."""
    low = text.lower()
    strange = not text.isascii() and _STRANGE.search(text)
    signs = strange or "dot" in low or "punkt" in low or "punto" in low or "point" in low or _BRACKETED.search(text)
    if not (signs or "at" in low and _BARE_AT.search(text) or "plus" in low and _PLUS.search(text) or spoken_digits(low)):
        return None
    t = Traced(text)
    if strange:
        t.rewrite([(m.start(), m.end(), [(c, m.start(), m.end()) for c in _look(m[0])]) for m in _STRANGE.finditer(text) if _look(m[0]) != m[0]])
    sign = lambda x: DIGIT_NAMES.get(x.lower(), x if x.isdigit() else ".")
    spoken = lambda m: [(sign(x[0]), m.start() + x.start(), m.start() + x.end()) for x in _TOKEN.finditer(m[0])]
    t.rewrite([(*m.span(), spoken(m)) for m in _SPOKEN.finditer(t.text)])
    t.rewrite([(*m.span(), [("+", *m.span())]) for m in _PLUS.finditer(t.text)])
    t.rewrite([(*m.span(), [("@" if m[1].lower() in ("at", "@") else ".", *m.span())]) for m in _BRACKET.finditer(t.text)])
    t.rewrite([(*m.span(), [(".", *m.span())]) for m in _BARE_DOT.finditer(t.text)])
    t.rewrite([(*m.span(), [("@", *m.span())]) for m in _BARE_AT.finditer(t.text)])
    return t if t.text != text else None


def personal_spans(text):
    """(plain spans, all spans), each by kind, then start; an added one may hold a plain one but lies in none of its kind."""
    base = plain_spans(text)
    t = clear(text)
    if t is None:
        return base, base
    out = list(base)
    for kind, lo, hi in plain_spans(t.text):
        a, b = t.start[lo], t.end[hi - 1]
        if t.changed(lo, hi, text) and not any(k == kind and s <= a and b <= e for k, s, e in base):
            out.append((kind, a, b))
    return base, sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(df, id_col="doc_id", text_col="text"):
    """Per row: id, the counts of plain spans per kind, base_sha256 over them, all spans, n_added.

    Offsets count code points, ends are exclusive. A null text is an empty one; null ids stay;
    repeated rows give equal results; other columns are ignored; an empty table gives no rows.
    """
    d = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in pieces(batches, "text"):
            rows = []
            for text in b.column(1).to_pylist():
                base, every = personal_spans(text)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
            types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return d.mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
