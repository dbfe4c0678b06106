"""Personal data against the stated expressions as they are written, and the added spans case by case."""

import hashlib
import random
import re

import pytest

pytest.importorskip("skillweft.llm")

from skillweft.llm import personal_data, queries  # noqa: E402

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    total = 0
    for place, digit in enumerate(digits[::-1]):
        total += sum(map(int, str(int(digit) * (2 if place % 2 else 1))))
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and brute_luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute_base(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in STATED.items() for m in re.finditer(pattern, text or "") if holds(kind, m[0])
    ]


def card_number(rng, size):
    body = "".join(rng.choices("0123456789", k=size - 1))
    return next(body + c for c in "0123456789" if brute_luhn(body + c))


def random_text(rng):
    odd = ["a@b", "a@@b.c", "x.y@z.co@u.v.w", "@b.cd@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "+1", "+12",
           "+1 (555) 010-9999", "+49 30 1234567 88 99 00", "4111 1111 1111 1111", "4111-1111-1111-1112", "é@b.cd", "- 1 2-3 4",
           "12:30:45", "ß", "\n", "a.b", "...", "1" * 40, "𝔘", "+5 . . (0)", "name@host.example.com.", "1-1", "1 "]
    parts = []
    for _ in range(rng.randrange(14)):
        kind = rng.random()
        if kind < 0.5:
            parts.append(rng.choice(odd))
        elif kind < 0.7:
            parts.append(card_number(rng, rng.choice([13, 15, 16, 18, 19, 20])))
        else:
            parts.append("".join(rng.choices("ab1.@+-_ 0(9)", k=rng.randrange(12))))
    return rng.choice(["", " ", " x "]).join(parts)


def rows_of(spark, rows):
    full = [(i, t, "a", None, 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, spans string, kind string, start int")


def test_base_spans_equal_the_stated_expressions(spark, tmp_path):
    rng = random.Random(7)
    rows = [*enumerate(random_text(rng) for _ in range(1500)), (None, "a@b.cd"), (3, "a@b.cd"), (3, None), (9, "")]
    rows_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12(spark, str(tmp_path)).collect()
    expected = []
    for i, text in rows:
        base = brute_base(text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        expected.append((i, *(sum(k == kind for k, _, _ in base) for kind in STATED), digest))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, expected))
    assert sum(sum(x[1:5]) for x in expected) > 1000
    for i, text in rows:
        base = {(k, s, e) for k, s, e, _, own in personal_data.find_spans(text or "") if own}
        assert base == set(brute_base(text))


def added(text, **options):
    return [(k, text[s:e]) for k, s, e, _, base in personal_data.find_spans(text, **options) if not base]


@pytest.mark.parametrize("text,expected", [
    ("Pay to DE89 3704 0044 0532 0130 00 AND SO ON", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("Pay to GB82WEST12345698765432.", [("iban", "GB82WEST12345698765432")]),
    ("Pay to DE89 3704 0044 0532 0130 01", []),
    ("call me: 555-010-9999 today", [("phone", "555-010-9999")]),
    ("order 555-010-9999 today", []),
    ("the number 555-010-9999 today", []),
    ("amex card 378282246310005", [("card", "378282246310005")]),
    ("amex card 378282246310006", []),
    ("serial 378282246310005", []),
    ("his SSN is 123-45-6789", [("ssn", "123-45-6789")]),
    ("his SSN is 000-45-6789", []),
    ("part 123-45-6789", []),
    ("server fe80::1ff:fe23:4567:890a is up", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("at 12:30:45 we met", []),
    ("jane.doe [at] example [dot] org", [("email", "jane.doe [at] example [dot] org")]),
    ("+1 (826) 555-4081 190.137.223.204 du", [("phone", "+1 (826) 555-4081")]),
    ("4111 1111 1111 1111 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")] * 2),
    ("nothing here", []), ("", []),
])
def test_added_spans(text, expected):
    assert added(text) == expected


def test_context_moves_scores_and_base_spans_stay():
    plain, near, against = (
        personal_data.find_spans(text)[0] for text in ("x 4111111111111111", "card 4111111111111111", "order 4111111111111111")
    )
    assert near[3] > plain[3] > against[3] and all(x[4] for x in (plain, near, against))
    assert added("the number 555-010-9999 today", threshold=0.4) == [("phone", "555-010-9999")]
    far = "card" + " x" * 60 + " 378282246310005"
    assert added(far) == []


def test_very_long_texts_take_linear_time():
    size = 400_000
    for text in ("a" * size, "1" * size, "1 " * size, "a@" * size, "+" * size, "+1" + " " * size, "1." * size,
                 "A1" * size, "(at)" * 50_000, ":" * size, "x.y" * size + "@z.de"):
        assert [x[:3] for x in personal_data.find_spans(text) if x[4]] == brute_like(text)


def brute_like(text):
    """The one text above with base spans, and the versions of four parts."""
    if text.endswith("@z.de"):
        return [("email", 0, len(text))]
    if text.startswith("1."):
        return [("ip", 8 * k, 8 * k + 7) for k in range(len(text) // 8)]
    return []


def test_redaction_keeps_columns(spark):
    rows = [(1, "mail a@b.cd or +1 555 010 9999 190.1.1.1"), (2, None), (2, ""), (None, "ip 10.0.0.1, 10.0.0.1")]
    docs = rows_of(spark, rows)
    got = personal_data.redact_personal_data(docs)
    assert got.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["start"]) for r in got.collect()] == [
        (1, "mail [EMAIL] or [PHONE] [IP]", 3), (2, None, 3), (2, "", 3), (None, "ip [IP], [IP]", 3),
    ]


def test_empty_table(spark):
    empty = rows_of(spark, []).limit(0)
    assert personal_data.find_personal_data(empty).collect() == []
    assert personal_data.redact_personal_data(empty).collect() == []
