r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four kinds have a fixed base, found leftmost and without overlap inside a kind:

    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts of 255 at most
    card    [0-9]([\x20-]?[0-9])+, 16 to 19 digits that pass Luhn
    phone   \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits

A failing match is dropped and not tried again at another length.  Base spans are always
reported; words near them only move their score.

Other forms are proposed with a score of their own and reported from ``threshold`` on:
IBANs (mod-97 has to hold), shorter card numbers (Luhn has to hold), national
telephone numbers, United States social security numbers, version 6 addresses,
spelled-out mail addresses, and the telephone and card numbers inside a run of digits
that is too long for the base because another number follows.  A word of the kind within ``NEAR`` code points raises the
score, a word for other numbers (order, invoice, version ...) lowers it.  An added span
never overlaps a base span; of added spans that overlap, the one with the higher score
stays, then the earlier, then the kind listed first.

Each text is read once, whole, in its own row; nothing is shuffled.  All patterns run in
time proportional to the text: mail addresses are grown from their ``@``, and digit runs
are taken possessively.

Cases: null and empty texts have no spans; repeated rows, repeated and null ``doc_id``
are answered each for itself; other columns are ignored; an empty table gives no rows;
positions are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.worker import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn"]
NEAR = 40
THRESHOLD = 0.6
RAISE, LOWER = 0.3, 0.35

SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"

#: Words that speak for a kind when they stand near.
FOR_KIND = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "address", "host", "server", "client", "login"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "amex", "payment", "pan"},
    "phone": {"phone", "telephone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp"},
    "iban": {"iban", "account", "bank", "transfer", "bic", "swift"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
#: Words of other numbers that look alike.
AGAINST = {"order", "invoice", "version", "build", "isbn", "serial", "part", "ticket", "tracking", "model", "release"}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[\x20-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
_SSN = re.compile(r"(?<![0-9A-Za-z.-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
_SPELLED = re.compile(
    r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}[\x20]?[\[(]at[\])][\x20]?[A-Z0-9-]{1,63}"
    r"(?:[\x20]?(?:[\[(]dot[\])][\x20]?|\.)[A-Z0-9-]{1,63}){1,8}(?![A-Z0-9-])"
)
_WORD = re.compile(r"[a-z]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Check digit of card numbers: every second digit from the right counts double."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Check digits of an IBAN: the first four characters move to the end, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [
            ("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15
        ]
    return found


def _ibans(text: str) -> Iterator[tuple[str, int, int, float]]:
    """The longest start of a match, cut at its separators, for which mod-97 holds."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():
            code = re.sub(r"[\x20-]", "", text[m.start():end])
            if len(code) < 15:
                break
            if mod97(code):
                yield "iban", m.start(), end, 0.7
                break
            end = max(text.rfind(" ", m.start(), end), text.rfind("-", m.start(), end))


def _short_cards(text: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 15 and luhn(digits):
                issued = (len(digits), digits[0]) == (13, "4") or digits[:2] in {14: ("30", "36", "38"), 15: ("34", "37")}.get(
                    len(digits), ()
                )
                yield "card", *m.span(), 0.45 if issued else 0.3


def _leading_phones(text: str) -> Iterator[tuple[str, int, int, float]]:
    """The longest start of a match with too many digits that ends before a space and has 8 to 15."""
    for m in _PHONE.finditer(text):
        if len(_NOT_DIGIT.sub("", m[0])) > 15:
            digits, end = 0, None
            for at in range(m.start(), m.end()):
                if text[at] == " " and text[at - 1].isdigit() and digits >= 8:
                    end = at
                digits += text[at] in "0123456789"
                if digits > 15:
                    break
            if end:
                yield "phone", m.start(), end, 0.6


def _inner_cards(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Neighbouring groups of a run with too many digits that make 16 to 19 and pass Luhn, from the left."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() > 19:
            groups = [(g[0], m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
            if sum(len(digits) for digits, _, _ in groups) <= 19:
                continue
            at = 0
            while at < len(groups):
                size, last = 0, at
                while last < len(groups) and size < 16:
                    size += len(groups[last][0])
                    last += 1
                if 16 <= size <= 19 and luhn("".join(digits for digits, _, _ in groups[at:last])):
                    yield "card", groups[at][1], groups[last - 1][2], 0.6
                    at = last
                else:
                    at += 1


def _security_numbers(text: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span(), 0.45


def _version6(text: str) -> Iterator[tuple[str, int, int, float]]:
    for m in _IP6.finditer(text):
        if len(m[0]) > 4:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield "ip", *m.span(), 0.65


#: A string that has to occur before a proposal is worth its scan, and the proposal.
PROPOSALS: list[tuple[Callable[[str], bool], Callable[[str], Iterator[tuple[str, int, int, float]]]]] = [
    (lambda text: "+" in text, _leading_phones),
    (lambda text: True, _inner_cards),
    (lambda text: True, _short_cards),
    (lambda text: True, lambda text: (("phone", *m.span(), 0.4) for m in _NATIONAL.finditer(text))),
    (lambda text: "-" in text, _security_numbers),
    (lambda text: ":" in text, _version6),
    (
        lambda text: any(x in text for x in ("at]", "at)", "AT]", "AT)", "At]", "At)")),
        lambda text: (("email", *m.span(), 0.65) for m in _SPELLED.finditer(text)),
    ),
    (lambda text: True, _ibans),
]


def context_change(text: str, kind: str, start: int, end: int) -> float:
    """What the words within ``NEAR`` code points of a span add to its score."""
    near = set(_WORD.findall(text[max(0, start - NEAR):start].lower()))
    near |= set(_WORD.findall(text[end:end + NEAR].lower()))
    return RAISE * bool(near & FOR_KIND[kind]) - LOWER * bool(near & AGAINST)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind as listed, then start."""

    def scored(kind, start, end, prior):
        return round(min(1.0, max(0.0, prior + context_change(text, kind, start, end))), 4)

    base = [(kind, start, end, scored(kind, start, end, 0.9), True) for kind, start, end in base_spans(text)]
    if not re.search("[0-9]", text) and not any(x in text for x in ":[("):
        return base
    proposed = [x for needed, propose in PROPOSALS if needed(text) for x in propose(text)]
    added = [(kind, start, end, scored(kind, start, end, prior), False) for kind, start, end, prior in proposed]
    added = sorted((x for x in added if x[3] >= threshold), key=lambda x: (-x[3], x[1], KINDS.index(x[0])))
    if not added:
        return base
    taken = _Taken((start, end) for _, start, end, _, _ in base)
    kept = [x for x in added if taken.take(x[1], x[2])]
    return sorted(base + kept, key=lambda x: (KINDS.index(x[0]), x[1]))


class _Taken:
    """Places of a text that spans lie on; base spans of different kinds may share some."""

    def __init__(self, spans):
        self.places: set[int] = set()
        for start, end in spans:
            self.places.update(range(start, end))

    def take(self, start: int, end: int) -> bool:
        places = range(start, end)
        if not self.places.isdisjoint(places):
            return False
        self.places.update(places)
        return True


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score, base) of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_()),
    ]))
    names = ("kind", "start", "end", "score", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                found.append([dict(zip(names, x)) for x in find_spans(text, threshold)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all given spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``; in ``text`` every span becomes ``[KIND]``.

    Spans of different kinds that overlap are replaced together, under the kind of the
    one that starts first (at one start: the longest, then the kind listed first).  Null texts stay null.
    """
    bound_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def redact(text: str) -> str:
        parts, at = [], 0
        for kind, start, end, _, _ in sorted(find_spans(text, threshold), key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(place)]
            clean = pa.array([redact(t) if t else t for t in texts], batch.schema.field(place).type)
            columns = [clean if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
