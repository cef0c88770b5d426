"""Personal data in whole texts: base patterns, and identifiers in disguise found by
offset-preserving deobfuscation.

Three transducers rewrite a text and keep, for every output character, the source span
it came from: character references and look-alike characters to ASCII, at/dot disguises (in
brackets, words, underscores, or letter by letter) to ``@`` and ``.``, and runs of spelled
digits of four languages to digits. A run of ``PHONE_WORDS`` digit words or more that makes 10
to 15 digits is a phone, with or without its plus. Identifiers found in the rewritten text are mapped back
to source characters; one is added when a rewritten character lies in it and it overlaps
no base span of its kind, except those it wholly covers. Base spans always stay.

``n_email`` ... ``n_phone`` and ``base_sha256`` describe the base spans; ``spans`` lists all.
Matching is linear in the text's length (patterns start only where a match can start).

"name at host.tld" is an address where a part of it is in disguise, the name holds a digit
or a sign between letters, or a word like "write to" stands before it; a plain word ("look
at host.tld") is prose. What is found does not depend on the text around it otherwise.

Edge cases: null or empty text has no span (``base_sha256`` of the empty string); equal
rows give equal rows; a null doc_id stays null; numbers of any length are compared without
being converted; very long texts are scanned whole; an empty table gives no rows; no other
column is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.session import ship_package

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where no digit stands before: from inside a run of digits the
# same match would fail, or would have begun earlier.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find_emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: for each ``@``, the longest local part not yet used and
    the domain after it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def find_ips(text: str) -> list[Span]:
    """Leading zeros of any number count for nothing."""
    return [m.span() for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def find_cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def find_phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []


FINDERS = dict(zip(KINDS, (find_emails, find_ips, find_cards, find_phones), strict=True))


def find_base(text: str) -> dict[str, list[Span]]:
    return {k: f(text) for k, f in FINDERS.items()}


# --------------------------------------------------------------------------- transducers

def _look_alikes() -> dict[int, str]:
    """One character for one: full-width forms, digits of other scripts, letters that look
    like Latin ones, and variants of signs."""
    table = {0xFF01 + i: chr(0x21 + i) for i in range(94)}                       # full width
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {zero + d: chr(48 + d) for d in range(10)}
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D4D0, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):
        table |= {first + i: chr((65 if i < 26 else 71) + i) for i in range(52)}  # mathematical letters
    # Cyrillic and Greek letters and the Latin letters they look like.
    table |= str.maketrans("аеорсухіјѕԁһӏԛԝкмтвАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhlqwkmtbABEKMHOPCTYXIJS")
    table |= str.maketrans("αοινρυκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoivpuktABEZHIKMNOPTYX")
    table |= str.maketrans("﹫∙․‐‑‒–—−﹣", "@..-------")
    table |= {0x00A0: " ", 0x2007: " ", 0x202F: " ", 0x3000: " ", 0x3002: "."}
    return table


LOOK_ALIKES = _look_alikes()
INVISIBLE = "​‌‍⁠﻿­"

# The digit words of English, Spanish, French and German.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9", "plus": "+",
          "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
          "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
          "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7",
          "acht": "8", "neun": "9"}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
# A run of this many digit words that makes this many digits is a phone without its plus.
PHONE_WORDS, PHONE_DIGITS = 7, range(10, 16)
# Character references (of printable ASCII), and words between underscores.
_REFERENCE = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{1,4})|([0-9]{1,4}));?|&(commat|period|lowbar|hyphen|plus);")
_NAMED = {"commat": "@", "period": ".", "lowbar": "_", "hyphen": "-", "plus": "+"}
_UNDER_AT = re.compile(r"(?<=[A-Za-z0-9])_{1,3}at_{1,3}(?=[A-Za-z0-9-]{1,63}(?:_{1,3}dot_{1,3}|\.)[A-Za-z0-9])", re.I)
_UNDER_DOT = re.compile(r"(?<=[A-Za-z0-9])_{1,3}dot_{1,3}(?=[A-Za-z0-9])", re.I)
# Single characters with single blanks between them, with an "@" and a dot after it.
_SPACED = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+@-] ){5,255}[A-Za-z0-9](?!\S)")
_SPACED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digit words, or of digit words and digits; one word alone is prose.
_SPELLED = re.compile(rf"\b(?:{_WORD})(?:[ .,()-]{{1,3}}(?:{_WORD}|[0-9]+))+\b|(?<=[0-9][ .-])(?:{_WORD})(?:[ .-]{{1,3}}(?:{_WORD}))*\b", re.I)
_TOKEN = re.compile(rf"\b(?:{_WORD})\b", re.I)
_BRACKET_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba)\s{0,3}[\])}>]\s{0,3}", re.I)
_BRACKET_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|point|punto|punkt)\s{0,3}[\])}>]\s{0,3}", re.I)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9]) {1,3}dot {1,3}(?=[A-Za-z0-9])", re.I)
_WORD_AT = re.compile(r"(?<=[A-Za-z0-9._%+-]) {1,3}at {1,3}(?=([A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})(?![A-Za-z0-9]))", re.I)
# What tells "name at host.tld" from "look at host.tld": a name that no word is (a digit, or
# a sign between letters), or a word that says an address follows.
_MAILBOX = re.compile(r"(?=.*[A-Za-z]{2})(?:.*[0-9]|.*[A-Za-z0-9][._+][A-Za-z0-9])")
_CUE = re.compile(r"\b(?:e-?mail|mail|contact|write)(?: address)?(?: me| us)?(?: to| is|:) {0,2}$", re.I)
_PRONOUNS = frozenset(("me", "us", "him", "her", "it", "them", "you"))
_SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9._%+-]) {1,2}@ {0,2}(?=[A-Za-z0-9-]{1,63}\.[A-Za-z])|(?<=[A-Za-z0-9._%+-])@ {1,2}(?=[A-Za-z0-9-]{1,63}\.[A-Za-z])")

_TRIGGER = re.compile(r"&#|&(?:commat|period);|_at_|_dot_|\bdot\b|[\[({<]\s{0,3}(?:at|@|arroba|dot|\.|point|punto|punkt)\s{0,3}[\])}>]| @|@ ", re.I)
# Every match of _WORD_AT in a text not yet rewritten holds one of this.
_PLAIN_AT = re.compile(r" [aA][tT] {1,3}[A-Za-z0-9-]{1,63}\.[A-Za-z0-9-]")


class Tape:
    """A rewritten text with, for each character, its source span; ``touched`` marks
    characters that a transducer wrote. Source spans are kept as runs until needed."""

    def __init__(self, text: str):
        self.text = text
        self.start = range(len(text))
        self.end = range(1, len(text) + 1)
        self.touched: bytearray = bytearray(len(text))

    def translate(self, table: dict[int, str]) -> None:
        new = self.text.translate(table)
        if new != self.text:
            for i, (a, b) in enumerate(zip(self.text, new, strict=True)):
                if a != b:
                    self.touched[i] = 1
            self.text = new

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the given spans (sorted, disjoint). The first character written for a
        span takes its whole source span; an empty replacement deletes."""
        if not edits:
            return
        text, start, end, touched, done = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[done:a])
            start.extend(self.start[done:a])
            end.extend(self.end[done:a])
            touched += self.touched[done:a]
            text.append(new)
            start.extend([self.start[a]] * len(new))
            end.extend([self.end[b - 1]] * len(new))
            touched += b"\x01" * len(new)
            if not new and touched:
                touched[-1] = 1
            done = b
        text.append(self.text[done:])
        start.extend(self.start[done:])
        end.extend(self.end[done:])
        touched += self.touched[done:]
        self.text, self.start, self.end, self.touched = "".join(text), start, end, touched

    def source(self, span: Span) -> Span | None:
        """Source span of a match, or None if no character in it was rewritten."""
        a, b = span
        return (self.start[a], self.end[b - 1]) if 1 in self.touched[a:b] else None


def _is_address(tape: Tape, at: re.Match) -> bool:
    """Whether "name at host" is meant as an address: something in it is in disguise, or the
    name or the words before it say so."""
    start = at.start()
    while start > 0 and at.start() - start < 64 and tape.text[start - 1] in _LOCAL:
        start -= 1
    name = tape.text[start:at.start()]
    return (1 in tape.touched[start:at.start()] or 1 in tape.touched[at.start(1):at.end(1)]
            or _MAILBOX.match(name.strip("._%+-")) is not None
            or (name.lower() not in _PRONOUNS and _CUE.search(tape.text, max(0, start - 40), start) is not None))


def _referred(m: re.Match) -> str | None:
    """The printable ASCII character that a reference names, if it names one."""
    if m[3]:
        return _NAMED[m[3]]
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0x20 <= code < 0x7F else None


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None where no disguise can be."""
    plain = text.isascii()
    if plain and not _TRIGGER.search(text) and not _PLAIN_AT.search(text) and not _SPELLED.search(text):
        return None
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), c) for m in _REFERENCE.finditer(tape.text) if (c := _referred(m))])
    if not plain:
        tape.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]+", tape.text)])
        tape.translate(LOOK_ALIKES)
    tape.rewrite([(m.start() + i, m.start() + i + 1, "") for m in _SPACED.finditer(tape.text) if _SPACED_EMAIL.search(m[0].replace(" ", ""))
                  for i in range(1, len(m[0]), 2)])
    if _UNDER_AT.search(tape.text):
        for pattern, new in ((_UNDER_AT, "@"), (_UNDER_DOT, ".")):
            tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text)])
    for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, "."), (_WORD_DOT, "."), (_WORD_AT, "@"), (_SPACED_SIGN, "@")):
        tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text)
                      if pattern is not _WORD_AT or _is_address(tape, m)])
    edits = []
    for run in _SPELLED.finditer(tape.text):
        done = None
        words = [DIGITS[m[0].lower()] for m in _TOKEN.finditer(tape.text, run.start(), run.end())]
        digits = sum(w != "+" for w in words) + sum(c.isdigit() for c in run[0])
        before = tape.text[max(0, run.start() - 8):run.start()].rstrip(" (.-")[-1:]
        bare = "+" not in words and before != "+" and not before.isdigit()
        phone = "+" if bare and len(words) >= PHONE_WORDS and digits in PHONE_DIGITS else ""
        for m in _TOKEN.finditer(tape.text, run.start(), run.end()):
            a = m.start()
            # One separator between two digit words goes, so that digits close up.
            if done is not None and not tape.text[done:a].strip(" ,.-"):
                edits.append((done, a, ""))
            edits.append((a, m.end(), (phone if done is None else "") + DIGITS[m[0].lower()]))
            done = m.end()
    tape.rewrite(edits)
    return tape if 1 in tape.touched or len(tape.text) != len(text) else None


def find_disguised(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of identifiers that only the rewritten text shows."""
    tape = deobfuscate(text)
    if tape is None:
        return {k: [] for k in KINDS}
    out = {}
    for kind, finder in FINDERS.items():
        found = {s for m in finder(tape.text) if (s := tape.source(m))}
        taken = base[kind]
        out[kind] = sorted(s for s in found if not any(a < s[1] and s[0] < b and not (s[0] <= a and b <= s[1] and s != (a, b))
                                                       for a, b in _near(taken, s)))
    return out


def _near(taken: list[Span], span: Span) -> list[Span]:
    """Base spans (sorted, disjoint) that could overlap a span."""
    from bisect import bisect_left
    lo = max(0, bisect_left(taken, (span[0], -1)) - 1)
    hi = bisect_left(taken, (span[1], -1))
    return taken[lo:hi]


def render(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, KINDS.index(k), b, k) for k, found in spans.items() for a, b in found)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in rows)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with base counts, the base digest and all spans."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                base = find_base(text)
                more = find_disguised(text, base)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(render(base).encode()).hexdigest(),
                             render({k: base[k] + more[k] for k in KINDS}), sum(map(len, more.values()))))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                 "base_sha256 string, spans string, n_added long")
