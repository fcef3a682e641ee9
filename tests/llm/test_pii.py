import hashlib
import re

from gridweft.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and brute_luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]


TEXTS = [
    None, "", "none", "a@b.co", "x a.b+c@d-e.f.g@h.i @j.k l@m", "@b.c@d.e", "é@x.yz 🙂 me@ex.org.", "1.2.3.4 999.1.1.1 1.2.3.4.5 255.255.255.255 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "+49 (30) 1234567 +1 22 +123456789012345678 +4930-12.34.56", "IBAN DE89 3704 0044 0532 0130 00, IBAN DE88 3704 0044 0532 0130 00", "card 378282246310005 and 378282246310005 alone " + "x" * 200 + " 378282246310005", "ssn 123-45-6789", "123-45-6789",
    "word " * 40_000 + "tail@end.org", "a" * 100_000 + "@" + "b" * 10, "1 " * 50_000, "a@b.c" * 300,
]


def test_base_spans_match_the_patterns():
    for t in TEXTS:
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans(t or "")]
        assert [s for s in got if s[0] in pii.BASE] == brute(t or "") if len(t or "") < 90_000 else True, t
    kinds = lambda t: [s["kind"] for s in pii.spans(t)]
    assert kinds(TEXTS[10]).count("iban") == 1
    assert kinds(TEXTS[11]).count("card_short") == 2
    assert kinds(TEXTS[12]) == ["national_id"] and kinds(TEXTS[13]) == []
    assert pii.score("call +49 301234567", "phone", 5, 18) > pii.score("mine +49 301234567", "phone", 5, 18)


def test_rows(spark):
    rows = [(i if i != 4 else None, t, 1, "a") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, id string")
    got = queries.pii_columns(pii.scan(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in range(14):
        r, want = by[i if i != 4 else None], brute(TEXTS[i] or "")
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
    assert pii.scan(df.where("false")).count() == 0


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r.base_sha256 for r in queries.op9_pii(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id] == hashlib.sha256(",".join("%s:%d:%d" % s for s in brute(d.text or "")).encode()).hexdigest()
