"""Secret scan: base rules against independent regexes over code points, the lexer's own spans on planted text."""

import hashlib
import random
import re

from triplematch.llm import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ORDER = ["assign", "access", "hex"]


def brute(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ORDER.index(s[0])))


def joined(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def noise(rng):
    bits = ["password", "PassWD", "api_key", "APIKEY", "token", "secret", "=", ":", " ", "  ", '"', "'", "é", "日本", "ſecret",
            "toKen", "AKIA", "ABCDEFGH1234567890", "0123456789abcdef", "deadbeef", "abc", "xyz+/", "\n", "--", "=>", "<a>", "</"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(60)))


def test_base_spans_against_brute_force(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, noise(rng)) for i in range(400)] + [(900, None), (901, ""), (None, "token=abcdefabcdefabc"), (3, "x"),
            (902, "é token = 'abcdefghijkl'"), (903, "token " * 100000 + "= abcdefghijklmn"), (904, "a-" * 50000 + "=" * 50000)]
    docs = make_docs(rows)
    out = secret_scan.digest(secret_scan.scan(docs))
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256,
                  joined(s.split(":") for s in r.spans.split(",") if s and not s.startswith("named"))) for r in out.collect())
    want = []
    for d, t in rows:
        if d is not None:
            spans = brute(t or "")
            n = [sum(s[0] == k for s in spans) for k in ORDER]
            want.append((d, *n, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans)))
    assert got == sorted(want)


def named(text):
    return [(text.encode()[a:z].decode(), n) for k, a, z, n, _ in secret_scan.findings(text.encode()) if k == "named"]


def test_lexer_reads_pairs_of_many_syntaxes():
    for text in ['db_pwd = "k9#Lm2!qZ7vB"', "{'client_pwd': 'k9#Lm2!qZ7vB'}", 'conn["pwd"] = "k9#Lm2!qZ7vB"',
                 'pwd: str = "k9#Lm2!qZ7vB"', "pwd := `k9#Lm2!qZ7vB`", "run --pwd k9#Lm2!qZ7vB", "<pwd>k9#Lm2!qZ7vB</pwd>",
                 "postgres://me:k9#Lm2!qZ7vB@host/db", "Authorization: Bearer k9#Lm2!qZ7vB", ":pwd => 'k9#Lm2!qZ7vB'"]:
        assert [v for v, _ in named(text)] == ["k9#Lm2!qZ7vB"], text


def test_constants_propagate_in_reading_order():
    text = 'K = "k9#Lm2!qZ7vB"\nL = K\nlogin(pwd=L)\n'
    assert named(text) == [("k9#Lm2!qZ7vB", "pwd")]
    assert named('K = "k9#Lm2!qZ7vB"\nK = "red"\npwd = K') == []       # the last value counts
    assert named('pwd = K\nK = "k9#Lm2!qZ7vB"') == []                  # no use before the value
    assert named('A="q8Zr4Tk1"\nexport DB_PWD=${A}') == [("q8Zr4Tk1", "DB_PWD")]
    assert [v for v, _ in named('pwd = "k9#L" + "m2!qZ7vB"')] == ['k9#L" + "m2!qZ7vB']


def test_harmless_names_and_placeholders_add_nothing():
    for text in ['pwd_file = "k9#Lm2!qZ7vB"', 'pwd = "changeme-1234"', 'pwd = "${FROM_ENV_1}"', 'colour = "k9#Lm2!qZ7vB"',
                 "The secret: something nobody told", "pwd = None", "a == b", "http://host:8080/x"]:
        assert named(text) == [], text


def test_findings_carry_names_and_base_spans_stay():
    text = 'db_secret = "0123456789abcdef0123"'
    kinds = [(k, n) for k, _, _, n, _ in secret_scan.findings(text.encode())]
    assert kinds == [("assign", "db_secret"), ("hex", "db_secret")]


def test_empty_table(spark, make_docs):
    assert secret_scan.digest(secret_scan.scan(make_docs([]))).collect() == []
