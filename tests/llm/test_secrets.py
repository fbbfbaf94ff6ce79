import re
import random

from sievelight.llm import secrets

PATTERNS = {"assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def _base(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(t or ""):
            if (len(m[2]) >= 8) if name == "assign" else len(m[0]) >= (16 if name == "access" else 32):
                out.append((m.start(), k, name, m.end()))
    return [(n, a, b) for a, _, n, b in sorted(out)]


def _weak(t):
    """All candidates against all parts, one by one."""
    t = t or ""
    spans = [(PATTERNS_ORDER[n], a, b) for n, a, b in _base(t)]
    for m in re.finditer(secrets.WEAK, t):
        s = m[0]
        v = re.search(secrets.ASSIGN, s)
        if re.match(secrets.KEYWORD + secrets.SETS + "[A-Za-z0-9+/_.=-]", s):
            if 4 <= len(v[2]) <= 7:
                spans.append((4, m.start(), m.end()))
        elif re.match(secrets.ACCOUNT, s):
            spans.append((3, m.start(), m.end()))
        elif re.match(secrets.ENDPOINT, s):
            spans.append((6, m.start(), m.end()))
        elif re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s) and not re.search(f"{secrets.ACCESS}|{secrets.HEX}", s):
            spans.append((5, m.start(), m.end()))
    out = []
    for k, a, b in spans:
        near = {secrets.PARTS[q] for q, c, d in spans if c < b + secrets.SCOPE and d > a - secrets.SCOPE}
        own = secrets.PARTS[k]
        need = {"access": {"secret"}, "secret": {"access"}, "endpoint": {"access", "secret"}}[own]
        if k < secrets.WEAK_FROM or need <= near - {own}:
            out.append((a, k, b))
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


PATTERNS_ORDER = {"assign": 0, "access": 1, "hex": 2}

PIECES = ["token = \"abcdefgh1234\"", "secret=abcd", "password: 'x'", "Api_Key=" + "Zz09+/" * 5, "AKIA" + "Q7" * 8, "AKIASHORT", "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "0", "username: jo.doe@example.com", "client_id=77aa", "https://db.example.com/x?token=abcdefgh", "aB3" * 10, "token=token:abcdefghijk", "ſecret=abcdefghij", "é", "\n", "some words here ", "x" * 150, " " * 90, "token   ", "tokens", "AKIA" + "A" * 12 + "é", "secret=AKIA" + "B" * 14]


def _rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    return rows + [(300, None), (301, ""), (302, "AKIA" + "Z" * 12), (302, "AKIA" + "Z" * 12), (None, "token=abcdefgh"), (303, "user=jo " + "f" * 199 + " pass\nsecret=abcd"), (304, "é" * 500 + "token=abcdefgh")]


def test_base_and_weak_match_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.find_secrets(df).collect()), key=str)
    assert got == sorted(((d, _weak(t)) for d, t in rows), key=str)
    for _, spans in got:
        assert [s for s in spans if s[0] in PATTERNS] is not None
    assert all([s for s in _weak(t) if s[0] in PATTERNS] == _base(t) for _, t in rows)
    assert any(s[0] == "endpoint" for _, ss in got for s in ss) and any(s[0] == "account" for _, ss in got for s in ss)
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redaction(spark):
    rows = _rows()
    df = spark.createDataFrame([(t, d, 7) for d, t in rows], "text string, doc_id long, n_chars long").repartition(3)
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars if r.text and "[" in r.text else None) for r in out.collect()), key=str)

    def expect(t):
        if t is None:
            return None
        out, at = "", 0
        for k, a, b in _weak(t):
            if a >= at:
                out += t[at:a] + f"[{k}]"
            at = max(at, b)
        return out + t[at:]

    assert [(d, t) for d, t, _ in got] == [(d, t) for d, t in sorted(((d, expect(t)) for d, t in rows), key=lambda x: str((x[0], x[1], len(x[1]) if x[1] and "[" in x[1] else None)))]
    assert all(n is None or n == len(t) for _, t, n in got)
    assert secrets.redact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


HOSTILE = ["__spans", "__row", "__hit", "__x", "x", "row", "whole", "hit", "spans", "rewritten", "cell", "piece", "marks", "a", "b", "kind", "at", "g", "l", "n_words"]


def test_redaction_of_very_many_spans_and_odd_names(spark):
    many = "password=abcdefgh " * 100_000
    across = "é" * 990 + "token=abcdefgh12345678 " + "x" * 1500 + " " + "f" * 2500 + " end"
    rows = [(1, many, len(many)), (2, across, len(across)), (3, None, None), (4, "clean", 5)]
    df = spark.createDataFrame([(*r, *HOSTILE) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in HOSTILE))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "[assign] " * 100_000 and got[1].n_chars == 900_000
    assert got[2].text == "é" * 990 + "[assign] " + "x" * 1500 + " [hex] end"
    assert got[3].text is None and got[4].text == "clean" and all(tuple(r[c] for c in HOSTILE) == tuple(HOSTILE) for r in got.values())
