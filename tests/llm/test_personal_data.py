from __future__ import annotations

import random
import re

from plazametrics.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The base spans by the expressions as they are stated."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def base(text):
    return [s[:3] for s in P.spans(text) if s[4]]


def test_base_spans_of_random_texts():
    draw = random.Random(5)
    for alphabet in ("a1@.-+ ", "0123456789 -", "+0123456789().- ", "12.@a%é", "4 -0"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 50)))
            assert base(text) == plain_spans(text), text


def test_checksums_and_context():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB83WEST12345698765432")
    amex = "378282246310005"
    assert [s[0] for s in P.spans(f"My card number is {amex}.")] == ["card"]
    assert P.spans(f"See part {amex}.") == []
    assert [s[0] for s in P.spans("Send it to GB82 WEST 1234 5698 7654 32 today")] == ["iban"]
    assert [s[0] for s in P.spans("phone 030 123 4567")] == ["phone"] and P.spans("room 030 123 4567") == []


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, None, None), (2, "", "y"), (3, "9" * 40000 + " é b@c.de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = P.found(docs).select("doc_id", "kind", P.listed(F.col("spans")).alias("spans")).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in got) == [(0, ""), (1, "email:0:6"), (1, "email:0:6"), (2, ""), (3, "email:40003:40009")]
    assert P.masked(docs).where("doc_id = 1").first().text == "<email>"
    assert P.found(docs.limit(0)).count() == 0


def test_long_runs_of_digits_and_many_spans():
    import time

    assert P.ips("0" * 5000 + ".1.1.1 9" + "9" * 5000 + ".1.1.1 000.00.0.00000255") == [(0, 5006), (10015, 10032)]
    text = "phone 555 123 4567, mail a@b.co or 4.3.2.1; " * 6000
    began = time.time()
    found = P.spans(text)
    assert time.time() - began < 5 and len(found) > 12000
    base = sorted((a, b) for _, a, b, _, own in found if own)
    slow = [(k, a, b) for k, a, b, _, own in P.spans(text[:4400]) if not own]
    assert all(not any(x < b and a < y for x, y in base if y <= 4400) for _, a, b in slow) and slow
