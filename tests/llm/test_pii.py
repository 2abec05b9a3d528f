import hashlib
import random
import re

from kinfolio.llm import pii

A = pii.automaton()


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_patterns():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789.@+- ()ab1é2.-@_%") for _ in range(rng.randint(0, 50)))
        assert [s for s in pii.spans(t, A) if s[0] in pii.BASE] == brute(t), t
    digits = "4111 1111-1111 1111"
    assert [s for s in pii.spans("x " + digits, A) if s[0] == "card"] == [("card", 2, 2 + len(digits))]


def test_added_spans():
    t = "see https://a.example/x?y=1, iban: GB82 WEST 1234 5698 7654 32 and account number 12345678."
    found = {(k, t[a:b]) for k, a, b in pii.spans(t, A)}
    assert ("url", "https://a.example/x?y=1") in found
    assert ("account", "GB82 WEST 1234 5698 7654 32") in found
    assert ("account", "12345678") in found
    assert not [s for s in pii.spans("on account of the account holder", A)]


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000 + "@", "@" * 300_000, "1 " * 200_000, "+1" * 150_000, "1." * 200_000, "a@b." * 100_000, "account: " * 50_000, "http://" * 50_000):
        pii.spans(t, A)


def test_rows(spark):
    rows = [(1, "mail a@b.co", 1), (2, None, 1), (3, "", 1), (None, "1.2.3.4", 1), (1, "mail a@b.co", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    out = pii.find(df).collect()
    assert len(out) == 5
    one = [r for r in out if r.doc_id == 1]
    assert len(one) == 2 and one[0].spans == "email:5:11" and one[0].n_email == 1
    assert one[0].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    two = next(r for r in out if r.doc_id == 2)
    assert two.spans == "" and two.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(df.limit(0)).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "to a@b.co, call +1 (222) 555-1234!", 99, "en"), (2, None, 7, "en")], "doc_id long, text string, n_chars long, lang string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[1].text == "to [EMAIL], call [PHONE]!" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[2].n_chars == 7
    assert pii.redact(df).columns == df.columns


def test_account_before_many_words():
    anchors = pii.automaton()
    number = "DE89 3704 0044 0532 0130 00"
    text = f"iban {number} " + "a b c d e f g h " * 200
    assert [text[a:b] for k, a, b in pii.spans(text, anchors) if k == "account"] == [number]
    assert not [s for s in pii.spans("account " + "x" * 500 + "1", anchors) if s[0] == "account"]


def test_labels_in_any_case():
    number = {
        "Account Number: 12345678": "12345678", "ACCOUNT NUMBER: 12345678": "12345678", "Passport No. A1234567": "A1234567", "PASSPORT NO A1234567": "A1234567",
        "Social Security: 123-45-6789": "123-45-6789", "SOCIAL SECURITY NUMBER 123-45-6789": "123-45-6789", "Tax ID: 987654321": "987654321", "Driver License Nr: D12345678": "D12345678",
    }
    for lead in ("", "İé ẞ "):
        for t, n in number.items():
            assert [(lead + t)[a:b] for k, a, b in pii.spans(lead + t, A) if k == "account"] == [n], t
    assert [s for s in pii.spans("Https://A.example/x HtTp://b.example", A) if s[0] == "url"] == [("url", 0, 19), ("url", 20, 36)]


def test_redact_labels_in_any_case(spark):
    df = spark.createDataFrame([(1, "Account Number: 12345678; Passport No. A1234567")], "doc_id long, text string")
    assert pii.redact(df).first().text == "Account Number: [ACCOUNT]; Passport No. [ACCOUNT]"
