"""op4 and op10 against Python's regular expressions."""

import base64
import hashlib
import random
import re

from quarryline.llm import pii, secrets


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and _luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m, d: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m, d: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m, d: len(m.group()) >= 24),
]


def brute(text, kinds):
    out = []
    for rank, (kind, pattern, keep) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if keep(m, re.sub("[^0-9]", "", m.group())):
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def _fuzz(kinds):
    rng = random.Random(3)
    parts = {
        "pii": ["a@b.co", "c.d@e-f.g", "_x@y.z", "@", ".", "..", "4111 1111 1111 1111", "4111-1111", "79927398713", "0", "7", " ", "-", "10.0.0.1", "1.2.3.4.5", "300.1.1.1", "0001.2.3.4", "+1 (555) 123-4567", "+", "é", "😀", "x"],
        "secret": ["password", "API_KEY", "apikey", "Token", "=", ":", " ", '"', "'", "hunter22", "AKIA", "ABCDEFGHIJKLMNOP1", "deadbeef", "0123456789abcdef", "G", "é", "😀", "secret: a.b.c.d"],
    }[kinds]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


def test_pii_base_equals_brute_force(spark, sf, texts):
    for r in pii.op4_pii(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id], PII).encode()).hexdigest()
    made = _fuzz("pii")
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    for r in pii.find_pii(frame).collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.kind in pii.BASE)
        assert got == brute(made[r.doc_id], PII), made[r.doc_id]
        assert all(made[r.doc_id][s.start : s.end] == s.text for s in r.pii)


def test_secrets_base_equals_brute_force(spark, sf, texts):
    for r in secrets.op10_secrets(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id], SECRETS).encode()).hexdigest()
    made = _fuzz("secret")
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    for r in secrets.find_secrets(frame).collect():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind in secrets.BASE) == brute(made[r.doc_id], SECRETS)


def test_pii_checksums_and_context(spark):
    made = ["IBAN GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "part 123-45-6789", "invoice ssn 123-45-6789"]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii] for r in found] == [["iban"], [], ["ssn"], [], []]


def test_random_tokens(spark):
    rng = random.Random(1)
    tokens = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(40)]
    prose = ["antheredtionthinandereringhe", "internationalizationAndLocalization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "some_very_long_identifier_name_here"] * 5
    frame = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(tokens + prose)], "doc_id int, text string")
    hits = {r.doc_id for r in secrets.find_secrets(frame).collect() if any(s.kind == "random" for s in r.secrets)}
    assert len([i for i in hits if i < 40]) >= 32
    assert not [i for i in hits if i >= 40]


def test_redaction(spark):
    frame = spark.createDataFrame([("password = hunter22 and token: abcdef1",), (None,), ("é clean",)], "text string")
    assert [r.text for r in secrets.redact_secrets(frame).collect()] == ["[secret] and [secret]", None, "é clean"]


def test_long_texts_and_odd_rows(spark, odd):
    heavy = spark.createDataFrame([(1, "a" * 200_000), (2, "1" * 200_000), (3, "1 " * 50_000 + "@" * 1000), (4, "a.b" * 50_000 + "@"), (5, "password=abcdef1 " * 3000)], "doc_id int, text string")
    assert pii.find_pii(heavy).count() == 5
    counts = {r.doc_id: len(r.secrets) for r in secrets.find_secrets(heavy).collect()}
    assert counts[5] == 3000
    for found, name in ((pii.find_pii(odd), "pii"), (secrets.find_secrets(odd), "secrets")):
        assert found.count() == odd.count()
        assert set(found.columns) == {*odd.columns, name}
        assert found.limit(0).count() == 0
    assert secrets.redact_secrets(odd).columns == odd.columns
