import random

from sievelight.llm import urls

ENTRIES = [("net/", "block", True), ("Example.NET/en/", "allow", True), ("example.com/de/", "block", True), ("org/fr/", "allow", True), ("bad.example.com/", "block", False), ("bad.example.com/ok/", "allow", False), ("bare", "block", False), (None, "block", True), ("dup.com/", "allow", True), ("dup.com/", "block", True), ("éa.fr/É/", "block", True)]


def _brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    rule = listed = (-1, None, None)
    for e, v, r in ENTRIES:
        if e is None:
            continue
        h, _, p = e.partition("/")
        h, p = h.lower(), e[len(h) :]
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            mine = (len(h + p), v, h + p)
            if r:
                rule = max(rule, mine)
            else:
                listed = max(listed, mine)
    return host, path, rule[2], (rule if rule[2] else listed)[1] or "allow"


def test_matches_brute_force_in_one_and_many_files(spark):
    rng = random.Random(1)
    hosts = ["example.net", "a.Example.NET", "notexample.net", "x.org", "example.com", "bad.example.com", "m.bad.example.com", "bare", "a.bare", "barex", "net", "", "u@b:80.net", "dup.com", "b.éa.fr", "." * 5 + "net", "y" * 300 + ".net", "z" * 300]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/?q=/en/", "#/en/", "?a", "/ok/a", "/É/", "/en/://x"]
    rows = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(600)] + [(900, None), (901, ""), (902, "no url"), (903, "://"), (903, "://"), (904, "a\n://b.net/\n/")]
    df = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "entry string, verdict string, rule boolean")
    want = sorted(((i, *_brute(u)) for i, u in rows), key=str)
    want = [(i, h, p, r, "block" if r == "dup.com/" else v) for i, h, p, r, v in want]
    for most in (1000, 4):
        out = urls.judge(df, entries, most)
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str) == want
    assert urls.judge(df.limit(0), entries).count() == 0
    assert {r.verdict for r in urls.judge(df, entries.limit(0)).collect()} == {"allow"}


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s, *a: len(s))
    (tmp_path / "f").write_bytes(urls.pack([("ab/", 1), ("cd/", 3), ("efg/", 2)]))
    got = urls.DigestArray(str(tmp_path / "f"))
    at = got.probe(["cd/", "xx/", "efg/", "ab/", "abcdef"])
    assert [int(got.flags[k]) if k >= 0 else None for k in at] == [3, None, 2, 1, None]
