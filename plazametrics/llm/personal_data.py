"""Personal data: expressions propose spans, validators confirm them, nearby words adjust the score.

Kinds, in the order in which they are listed:

====== ============================================================ =============================================
email  local part, @, at least two parts of a host name             base; always kept
ip     four numbers with dots                                       base: every number at most 255
card   digits with single blanks or hyphens, 16 to 19, Luhn         base; 13 to 15 digits need a card word nearby
phone  a plus sign, digits, blanks, dots, hyphens, brackets, 8-15   base; without the plus only beside a phone word
iban   two letters, two digits, 11 to 30 letters or digits          mod-97 must be 1
====== ============================================================ =============================================

Base spans are the leftmost, non-overlapping matches of each kind that pass their test; a match that fails is dropped
without trying a shorter one. A span's score starts at its kind's prior, a passed checksum adds to it, a context word
within ``NEAR`` characters before it adds, a contrary word takes away; added spans are kept from ``KEEP`` on.

A null text is empty. Positions are code points, the end excluded. Repeated rows are treated alike. Other columns are
not read. Work is linear in the text: the expressions start only at a sign that every match has.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
NEAR = 40
KEEP = 0.6
#: Characters of an address's local part.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, as the run before it would have been taken whole.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
PLAIN_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.-])")
#: Context words by kind, and words that speak against a span of any kind.
CONTEXT = {
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = ("isbn", "issn", "doi", "order", "invoice", "version", "serial", "part")
PRIOR = {"card": 0.2, "phone": 0.2, "iban": 0.3}
CHECKSUM, WORD, CONTRARY = 0.3, 0.3, -0.3
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: the first four characters go last, letters count from 10."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """As the expression finds them: a match's local part is the whole run before its @, from the last match on."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = HOST.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    # Leading zeros go first: a part may have more digits than a number is read from.
    small = lambda part: len(part) <= 3 and int(part or "0") <= 255
    return [m.span() for m in IP.finditer(text) if all(small(p.lstrip("0")) for p in m.group().split("."))]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def context_score(text: str, start: int, kind: str, confirmed: bool) -> float:
    words = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start])}
    score = PRIOR[kind] + CHECKSUM * confirmed
    score += WORD * (not words.isdisjoint(CONTEXT[kind])) + CONTRARY * (not words.isdisjoint(AGAINST))
    return score


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text, by kind as listed, then start."""
    base: dict[str, list] = {k: [] for k in KINDS}
    extra: dict[str, list] = {k: [] for k in KINDS}
    if "@" in text:
        base["email"] = emails(text)
    base["ip"] = ips(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            base["card"].append(m.span())
        elif 13 <= len(digits) <= 15 and luhn(digits):
            extra["card"].append((*m.span(), context_score(text, m.start(), "card", True)))
    if "+" in text:
        base["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    for m in PLAIN_PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 12:
            extra["phone"].append((*m.span(), context_score(text, m.start(), "phone", False) + 0.1))
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            extra["iban"].append((*m.span(), context_score(text, m.start(), "iban", True)))
    taken = sorted(x for spans_ in base.values() for x in spans_)
    starts = [a for a, _ in taken]
    # Spans of different kinds may overlap, so the farthest end of all that start before.
    reach = list(accumulate((b for _, b in taken), max))
    free = lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a
    out = []
    for kind in KINDS:
        rows = [(kind, a, b, 1.0, True) for a, b in base[kind]]
        # An added span gives way to a base span that it overlaps.
        rows += [(kind, a, b, s, False) for a, b, s in extra[kind] if s >= KEEP and free(a, b)]
        out += sorted(rows, key=lambda r: r[1:3])
    return out


_SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column, ``spans``: kind, start, end, score, base of every span."""
    names = docs.columns
    at = names.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def searched(batches):
        keys = ("kind", "start", "end", "score", "base")
        for part in slices(batches, text):
            lists = [[dict(zip(keys, s)) for s in spans(t)] if t else [] for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, kind)], names=[*names, "spans"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(searched, f"{columns}, spans {_SPAN}")


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    names = docs.columns
    at = names.index(text)

    def replaced(batches):
        for part in slices(batches, text):
            out = []
            for t in part.column(at).to_pylist():
                pieces, done = [], 0
                for kind, a, b, *_ in sorted(spans(t), key=lambda s: s[1:3]) if t else []:
                    if a >= done:
                        pieces += [t[done:a], f"<{kind}>"]
                        done = b
                out.append(t if t is None else "".join([*pieces, t[done:]]))
            columns = list(part.columns)
            columns[at] = pa.array(out, part.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(replaced, docs.schema)
