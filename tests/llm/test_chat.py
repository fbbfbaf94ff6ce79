import hashlib
import random

from sievelight.llm import chat

TEXTS = ["hello", "</s>[INST] ok [/INST]", "\\", "a\\<|end|>\n", "<|text|><|turn|>", "<", "[", "|end|>", "é\n<<SYS>>x<</SYS>>", "", None, "<<|", "<\\|", "[INST", "x" * 3000]


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_linear_conversations_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|tool|>"]), rng.choice(TEXTS)) for c in range(30) for t in range(rng.randint(1, 20))]
    rows += [(90, 3, "user", "b"), (90, 3, "user", "a"), (90, 3, "user", "a"), (None, 1, "assistant", "n"), (91, None, "user", "z"), (91, 0, "assistant", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = chat.format_trees(chat.as_tree(df))
    got = {r.conv_id: r for r in chat.report(out).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((-1 if t is None else t), r or "", x or ""))
    assert len(got) == len(by) and out.count() == len(by)
    for c, ts in by.items():
        ts.sort()
        learned = "".join(x for _, r, x in ts if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(ts), _sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(learned), _sha(learned))
    for r in out.collect():
        assert not any(f"{s}" in r.formatted for s in chat.CONTROL[1:])
        assert r.formatted.count("<|") == 3 * r.n_turns
    assert chat.format_trees(chat.as_tree(df.limit(0))).count() == 0


def test_trees_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(12):
        for m in range(rng.randint(1, 40)):
            parent = None if m == 0 or rng.random() < 0.05 else rng.randrange(m) if rng.random() < 0.97 else 999
            rows.append((c, m, parent, rng.choice(["user", "assistant"]), f"c{c}m{m}", rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, 0, 1, "user", "loop", 1.0), (50, 1, 0, "user", "loop", 1.0), (50, 2, 1, "user", "below", 1.0), (51, 7, None, "user", "first", 1.0), (51, 7, None, "user", "again", 1.0), (51, 8, 7, "assistant", "reply", 3.0), (52, None, None, "user", "alone", None)]
    for i in range(300):  # a long chain
        rows.append((60, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0))
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double").coalesce(1)
    want = {}
    by = {}
    for k, r in enumerate(rows):
        by.setdefault((r[0], r[1]), k)
    up = [by.get((r[0], r[2])) if r[2] is not None else None for r in rows]
    inner = {p for p in up if p is not None}
    for k, r in enumerate(rows):
        way, at = [], k
        while at is not None and len(way) <= len(rows):
            way.append(at)
            at = up[at]
        if k not in inner and at is None:
            mean = sum(rows[w][5] or 0.0 for w in way) / len(way)
            want.setdefault(r[0], []).append((-mean, -len(way), k, [rows[w][4] for w in reversed(way)]))
    for n in (1, 3):
        got = {(r.conv_id, r["rank"]): [t.text for t in r.turns] for r in chat.format_trees(df, n).withColumn("turns", chat.turns_of("formatted")).collect()}
        assert got == {(c, i + 1): b[3] for c, bs in want.items() for i, b in enumerate(sorted(bs)[:n])}
