import hashlib
import random
import re

from palimpsest.llm import pii


def plain(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_against_plain_patterns():
    r = random.Random(3)
    parts = [*"0123456789..@@+- ()aé\nZ%", "12.3.4.5", "a@b.c", "4111 1111 1111 1111", "+1 234 567 890"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(60)))
        assert [x[:3] for x in pii.find_spans(text) if x[4]] == plain(text)


def test_added_kinds():
    kinds = lambda t: [x[0] for x in pii.find_spans(t) if not x[4]]
    assert kinds("my IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"] and kinds("my IBAN DE89 3704 0044 0532 0130 01 please") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("please call 030 1234 567") == ["phone"] and kinds("count 030 1234 567") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_linear_time_on_long_runs():
    for text in ("a" * 200000 + "@", "1" * 200000 + ".", "1.1" * 70000, "+1" + "(" * 200000, "1-" * 100000, "a@b" * 60000):
        pii.find_spans(text)


def test_digest_and_redaction(spark, odd_docs):
    rows = pii.digest(pii.find(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and pii.find(odd_docs.limit(0)).count() == 0
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    for r in rows:
        base = plain(texts.get(r.doc_id) or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and r.spans == written
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]
    clean = pii.redact(odd_docs)
    assert clean.columns == odd_docs.columns
    row = clean.filter("doc_id = 13").first()
    assert row.text == "mail <EMAIL>, call <PHONE>" and row.n_chars == len(row.text)
    assert clean.filter("doc_id = 6").first() == odd_docs.filter("doc_id = 6").first()
    assert pii.redact_text("abcdef", [("x", 1, 4, 0, True), ("y", 3, 5, 0, True)]) == "a<X>f"


def test_ibans_before_upper_case_words():
    spans = lambda t: [t[s:e] for kind, s, e, *_ in pii.find_spans(t) if kind == "iban"]
    for code in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00"):
        for after in ("", " BIC COBADEFF", " EUR 500", " I am", " GB82 WEST 1234 5698 7654 32"):
            assert spans(f"pay {code}{after}")[0] == code
    assert spans("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32") == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert spans("DE89370400440532013001 EUR 500") == []


# Labelled texts: what is to be found beyond the base kinds, if anything.
LABELLED = [
    ("please pay to IBAN DE89 3704 0044 0532 0130 00 by Friday", "iban"), ("DE89370400440532013000", "iban"), ("our bank account: GB82 WEST 1234 5698 7654 32", "iban"),
    ("serial DE89370400440532013000 of release 4", None), ("invoice with IBAN DE89370400440532013000", "iban"), ("DE88370400440532013000", None),
    ("her social security number is 536-22-1234", "ssn"), ("SSN: 536-22-1234", "ssn"), ("order 536-22-1234 has shipped", None), ("score 536-22-1234", None), ("ssn of the example: 536-22-1234", None),
    ("call me at 030 1234 567", "phone"), ("Tel. (0171) 234 5678", "phone"), ("fax 040/123 4567", "phone"), ("invoice 030 1234 567", None), ("lot 0301 234567 in row 4", None), ("mobile 0171-2345678 after six", "phone"),
]


def test_context_decides_on_labelled_texts():
    for text, kind in LABELLED:
        assert [x[0] for x in pii.find_spans(text) if not x[4]] == ([kind] if kind else []), text


def test_scores_follow_the_context():
    score = lambda t: pii.find_spans(t)[0][3]
    assert score("server address 10.1.2.3") > score("10.1.2.3") > score("version 10.1.2.3")
    assert score("visa 4111 1111 1111 1111") > score("4111 1111 1111 1111") > score("isbn 4111 1111 1111 1111")


def test_query_gives_the_scores(spark):
    docs = spark.createDataFrame([(1, "visa 4111 1111 1111 1111 from 10.1.2.3"), (2, None)], "doc_id long, text string")
    assert [(x.spans, x.scores) for x in pii.digest(pii.find(docs)).orderBy("doc_id").collect()] == [("card:5:24,ip:30:38", "1.00,0.70"), ("", "")]
