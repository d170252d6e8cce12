import hashlib
import re

from coppice.llm import secrets as se
from tests.llm.fixtures import DOCS, SF, frame, prose

BASE = (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def plain(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    spans.sort()
    line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return [sum(s[3] == kind for s in spans) for kind, *_ in BASE] + [hashlib.sha256(line.encode()).hexdigest()], line


KEY = "0123456789abcdef" * 2
ODD = [None, "", "password", "PASSWORD=abcdefgh", "passwd = 'abcdefg'", "Secret: \"abc_def/9.=\"", "token=secret: abcdefghijk", "api_key=apikey=12345678", "API-KEY=12345678", "AKIA123456789012", "AKIA12345678901", "xAKIAKIAKIAKIAKIAKIA é", KEY, "g" + KEY + "0g", "paſſword=abcdefgh", "toKen=abcdefgh", "é token=" + KEY + " 日", "ghp_" + "a1B2" * 9, "xoxb-123456789012", "sk_live_" + "a" * 20, "https://user:secret@example.com/x", "-----BEGIN RSA PRIVATE KEY-----\nMIIB+/=\n-----END RSA PRIVATE KEY-----", "Bearer " + "a" * 24, "AIza" + "x" * 35, "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "word " * 30000 + "password=hunter2hunter2"]


def check(rows, texts):
    for r in rows:
        want, line = plain(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_query_and_awkward_texts(spark, tmp_path):
    texts = ODD + [prose(i, 50) for i in range(20)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = se.op3_secret_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    check(rows, dict(enumerate(texts)))
    kinds = {x.split(":")[0] for r in rows for x in r.spans.split(",") if x}
    assert kinds == {r.kind for r in se.RULES}
    clean = [r for r in rows if r.doc_id >= len(ODD)]
    assert all(r.spans == "" for r in clean)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = se.op3_secret_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert se.find_secrets(spark.createDataFrame([], DOCS)).collect() == []


def test_candidates_lose_nothing():
    scanner = se.Scanner()
    texts = [t or "" for t in ODD]
    scanner.index.build([t.encode() for t in texts])
    for (regex, rule), query in zip(scanner.rules, scanner.queries):
        hit = {i for i, t in enumerate(texts) if regex.search(t)}
        assert hit <= set(scanner.index.candidates(query).tolist()), rule.kind
    full = [r.kind for (_, r), q in zip(scanner.rules, scanner.queries) if q is True]
    assert full == ["hex"]


def test_scans_equal_plain_searches_for_every_rule(spark):
    """All spans, those of the method's own rules included, against each expression on each whole text."""
    scanner = se.Scanner()
    texts = [t or "" for t in ODD] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = scanner.scan(texts)
    for t, spans in zip(texts, found):
        want = [(m.start(), k, m.end()) for k, (regex, rule) in enumerate(scanner.rules) for m in regex.finditer(t) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        assert spans == sorted(want)


def test_queries_of_expressions():
    assert se.trigram_query("abcd") == ("all", (b"abc", b"bcd"))
    assert se.trigram_query("abc|xyz+") == ("any", (b"abc", b"xyz"))
    assert se.trigram_query("a[0-9]+b") is True
    assert se.trigram_query("(?:ab)?cde") == ("any", (("all", (b"abc", b"bcd", b"cde")), b"cde"))


def test_redaction():
    assert se.redact("a bb ccc", [(2, 0, 4), (3, 1, 6)]) == "a [REDACTED]cc"
    assert se.redact("abc", []) == "abc"
