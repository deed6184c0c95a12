"""Pseudonyms against a plain Feistel network, their forms, and what must stay."""

import datetime
import hashlib
import re

from llm_cases import EDGES, frame
from pyspark.sql import functions as F

from skirmish.llm import pii, queries

KEY = "k"


def shift(text, digest):
    out = ""
    for i, c in enumerate(text):
        step = int(digest[i * 4 % 128 :][:4], 16)
        base, size = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
        out += chr((ord(c) - base + step) % size + base)
    return out


def cipher(value, tweak):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        digest = lambda half: hashlib.sha512(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()  # noqa: B023, E731
        left, right = (shift(left, digest(right)), right) if i % 2 else (left, shift(right, digest(left)))
    return left + right


def luhn(digits):
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))


def masked(spark, *texts):
    rows = pii.pseudonymise(frame(spark, list(enumerate(texts))), KEY).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_cipher_is_a_permutation_and_equals_a_plain_network(spark):
    v = F.lpad(F.col("id").cast("string"), 3, "0")
    got = {r.v: r.c for r in spark.range(1000).select(v.alias("v"), pii.cipher(v, KEY, "t").alias("c")).collect()}
    assert len(set(got.values())) == 1000 and all(re.fullmatch(r"\d{3}", c) for c in got.values())
    assert all(got[x] == cipher(x, "t") for x in list(got)[::37])
    n = spark.range(4096).select(pii.cipher_number(F.col("id"), 12, KEY, "t").alias("c"))
    assert sorted(r.c for r in n.collect()) == list(range(4096))


def test_forms_stay_valid(spark):
    card, iban, iso, day, ip, ssn, phone, mail = masked(spark, "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "2024-02-29", "29.02.2024", "192.168.0.17", "123-45-6789", "(212) 555-0187", "John.Doe9@example.com")
    digits = card.replace(" ", "")
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", card) and luhn(digits) % 10 == 0 and digits[:-1] == cipher("411111111111111", "card")
    plain = iban.replace(" ", "")
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", iban) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[4:] == cipher("370400440532013000", "iban")
    assert datetime.date.fromisoformat(iso) and datetime.datetime.strptime(day, "%d.%m.%Y").date() == datetime.date.fromisoformat(iso)
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and ip != "192.168.0.17"
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", ssn) and ssn != "123-45-6789"
    assert re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", phone) and phone != "(212) 555-0187"
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{3}\d@example\.com", mail)


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    a, b, c, d = masked(spark, "card 4111-1111-1111-1111.", "4111111111111111", "ssn 123-45-6789, 123-45-6789", "x 123-45-6780 y")
    assert re.sub(r"\D", "", a) == b
    first, second = re.findall(r"[\d-]{11}", c)
    assert first == second and first not in d
    area = [f"2{k:02d}-555-0187" for k in range(100)]
    assert len(set(masked(spark, *area))) == 100


def test_invalid_values_and_plain_texts_stay(spark):
    texts = ["4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00", "2023-02-29", "31.04.2024", "300.1.1.1", "000-12-3456", "(112) 555-0187", "version 1.2.3", "no numbers", "", "@"]
    assert masked(spark, *texts) == texts


def test_numbers_beside_other_groups(spark):
    """A valid number is found beside an expiry date, CVV, year, currency or bank name, and those stay."""
    number, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    card, account, ssn, date = masked(spark, number, iban, "123-45-6789", "2024-02-29")
    beside = ["{} 12/27", "2024 {}", "{} 123", "12/27 {}", "27 {} 123 x", "{} 12.50", "1 2 {} 3 4", "ID12 {}", "QX12 {} 12/27", "12 {} {} 7", "AB12 {} {}"]
    assert masked(spark, *[x.replace("{}", number) for x in beside]) == [x.replace("{}", card) for x in beside]
    plain = card.replace(" ", "")
    assert masked(spark, "4111111111111111 123", "2024 4111-1111-1111-1111") == [f"{plain} 123", f"2024 {card.replace(' ', '-')}"]
    around = ["{} EUR", "{} BANK", "{} BANKING AG", "IBAN {} 2024", "NR12 {}", "{} 12 EUR", "{} EUR {} USD"]
    assert masked(spark, *[x.replace("{}", iban) for x in around]) == [x.replace("{}", account) for x in around]
    assert masked(spark, f"{iban} {number}", f"{number} 123-45-6789", f"{number} 2024-02-29", f"{number} {iban}") == [f"{account} {card}", f"{card} {ssn}", f"{card} {date}", f"{card} {account}"]
    long = "1 " * 30_000 + "1"
    assert len(masked(spark, long)[0]) == len(long)


def test_edges(spark):
    got = pii.pseudonymise(frame(spark, EDGES), KEY)
    assert got.columns == frame(spark, EDGES).columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, frame(spark, EDGES).collect()))
    assert pii.pseudonymise(frame(spark, []), KEY).count() == 0


def test_long_text(spark):
    text = "word " * 50_000 + "123-45-6789 " * 200
    (got,) = masked(spark, text)
    assert len(got) == len(text) and "123-45-6789" not in got and len(set(re.findall(r"\d{3}-\d\d-\d{4}", got))) == 1


def test_no_python_in_the_plan(spark):
    plan = pii.pseudonymise(frame(spark, EDGES), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


#: The forms that the table holds, found without the operator.
PLAIN = re.compile(r"(?P<mail>[a-z0-9.]+@[a-z0-9.]+[a-z])|(?P<phone>\(\d{3}\) \d{3}-\d{4})|(?P<ip>\d+(?:\.\d+){3})|(?P<card>\d{16})")


def test_query_over_the_whole_table(spark, sf, monkeypatch):
    """All else stays; cards and names equal the plain network's, the others are valid; pseudonyms are one to one over all documents."""
    monkeypatch.setattr(queries, "PII_KEY", KEY)
    before = spark.read.parquet(f"{sf}/documents.parquet")
    after = queries.op1_pii(spark, sf)
    assert after.columns == before.columns
    assert sorted(map(repr, after.drop("text").collect())) == sorted(map(repr, before.drop("text").collect()))
    new, pairs = {r.doc_id: r.text for r in after.collect()}, {}
    for r in before.collect():
        a, b = list(PLAIN.finditer(r.text or "")), list(PLAIN.finditer(new[r.doc_id] or ""))
        assert PLAIN.sub("*", r.text or "") == PLAIN.sub("*", new[r.doc_id] or "") and (r.text is None) == (new[r.doc_id] is None)
        for x, y in zip(a, b, strict=True):
            assert x.lastgroup == y.lastgroup and pairs.setdefault((x.lastgroup, x[0]), y[0]) == y[0]
    for kind in ("mail", "phone", "ip", "card"):
        values = {x: y for (k, x), y in pairs.items() if k == kind}
        assert values and len(set(values.values())) == len(values)
        for x, y in values.items():
            if kind == "card":
                assert y == x if luhn(x) % 10 else (y[:-1] == cipher(x[:-1], "card") and luhn(y) % 10 == 0)
            elif kind == "mail":
                (name, domain), moved = x.split("@"), iter(cipher(re.sub(r"[^a-z0-9]", "", x.split("@")[0]), "mail"))
                assert y == "".join(next(moved) if c.isalnum() else c for c in name) + "@" + domain
            elif kind == "ip":
                assert all(int(p) < 256 for p in y.split(".")) and (y != x or any(int(p) > 255 for p in x.split(".")))
            else:
                assert y == x if x[1] in "01" or x[6] in "01" else re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", y)
