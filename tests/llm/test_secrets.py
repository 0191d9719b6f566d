"""Secret scans against plain regular expressions, and what the ledger spares."""

import hashlib
import re

import pytest

from tallyloom.llm import secrets

A, B = "0123456789abcdef" * 2, "AKIA" + "Q" * 14
TEXTS = [
    f"key = {A}", f"API_KEY: '{A}' and Token=\"abc\" token=secret=abcdefghijklmnop", "token: secret: abcdefghijklmnop", f"é日本 {B} AKIA12 {B}x AKIAAKIA{B}", "password=short passwd = x1234567890/+=.-_", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
    "-----BEGIN RSA PRIVATE KEY-----\nabc", "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl", "see https://user:pa55@host/x and ftp://a:b@c", "", None, " ", "f" * 100_000, f"{A}.{A[:15]}g{A}", "nothing here", f"key = {A}",
]


def plain(text, rules=secrets.RULES):
    pick = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    base = {"assign": r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    spans = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(base.items()) for m in re.finditer(p, text or "") if pick[k](m)]
    more = [(s, n + 3, f"{r.kind}:{s}:{e}") for n, r in enumerate(secrets.MORE) if r in rules for s, e in ((m.start(), m.end()) for m in re.finditer(r.pattern, text or ""))]
    return spans, more


@pytest.fixture
def ledger(spark, tmp_path):
    return f"file://{tmp_path}/ledger"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(None, "api_key=abcdefghijklmnop", "x", "y", 1)], "doc_id long, text string, blob string, findings string, first int")


def test_equals_plain_expressions(spark, ledger):
    got = {r.doc_id: r for r in secrets.report(docs(spark, TEXTS), ledger).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        base, more = plain(text)
        joined = lambda spans: ",".join(s for *_, s in sorted(spans))
        assert got[i].spans == joined(base + more), text
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(n == k for _, n, _ in base) for k in range(3)]
    assert got[None].n_assign == 1 and got[6].spans.startswith("pem") and got[7].spans.startswith("jwt") and got[8].spans.count("url") == 2


def test_only_unseen_pairs_are_scanned(spark, ledger):
    """Copies once, a second run nothing, a new rule alone over old blobs, a new blob by all rules."""
    pairs = lambda: [(r.blob, v) for r in secrets.read_ledger(spark, ledger).collect() for v in r.findings]
    secrets.scan(docs(spark, TEXTS), ledger, rules=secrets.BASE).collect()
    first = pairs()
    assert len(first) == len(set(first)) == 3 * (len({t or "" for t in TEXTS}) + 1)
    again = secrets.scan(docs(spark, TEXTS), ledger, rules=secrets.BASE)
    assert pairs() == first and again.count() == len(TEXTS) + 1
    changed = secrets.Rule("hex", "[0-9a-f]+", 40)
    got = secrets.scan(docs(spark, [*TEXTS, "new " + A]), ledger, rules=(*secrets.BASE[:2], changed))
    assert len(got.where("doc_id = 12").first().hex) == 1 and not got.where("doc_id = 0").first().hex
    new = pairs()
    assert len(new) == len(set(new)) == len(first) + len({t or "" for t in TEXTS}) + 1 + 3
    assert secrets.scan(docs(spark, TEXTS), ledger, rules=secrets.BASE).where("doc_id = 0").first().hex


def test_versions_of_paths(spark, ledger):
    """Findings go back to every path and version that holds the blob."""
    rows = spark.createDataFrame([("a.env", 1, f"key {A}"), ("a.env", 2, "clean"), ("b.env", 1, f"key {A}"), ("c", 1, None)], "path string, version int, content string")
    got = secrets.scan(rows.withColumn("at", rows.path), ledger, name="at", content="content").collect()
    assert sorted((r.at, len(r.hex)) for r in got) == [("a.env", 0), ("a.env", 1), ("b.env", 1), ("c", 0)]


def test_no_rows_and_a_broken_ledger(spark, ledger, no_docs, tmp_path):
    assert secrets.report(no_docs, ledger).collect() == [] and not (tmp_path / "ledger").exists()
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        secrets.report(docs(spark, TEXTS), ledger).collect()
