"""Chat formatting of reply trees.

Messages name the message that they reply to. Self-joins that double their reach each round give every message its way to the root:
its depth and the scores on the way. The best branches of each conversation are walked back, doubling again, and each is formatted as
one conversation. Texts are only joined to the chosen paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import numbered, stored

TURN, SAYS, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What a text may not say unescaped: the template's marks (all begin with <|) and the marks of common chat templates.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
SALTS = 64


def escaped(c: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations of one branch (rows by turn, then role and text) as messages, each the reply to the one before it."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = numbered(rows, "turns", "conv_id", "turn", "role", "text")
    before = at.select((F.col("at") + 1).alias("at"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_there"))
    reply = F.when(F.col("_there") & F.col("_conv").eqNullSafe(F.col("conv_id")), F.col("at") - 1)
    return at.join(before, "at", "left").select("conv_id", F.col("at").alias("message_id"), reply.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def reaches(nodes: DataFrame) -> list[DataFrame]:
    """From nodes (conv_id, node, parent, score), a table a round k: how far each node gets by 2**k steps towards its root.

    anc is where it gets to (null past the root), steps and total the nodes on the way and their scores. Rounds end when nothing moves;
    nodes in a cycle, or below one, never reach a root.
    """
    own = nodes.select("conv_id", "node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("steps"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    rounds = [stored(own, "reach")]
    n = rounds[0].count()
    while 1 << (len(rounds) - 1) <= n and rounds[-1].where("anc is not null").limit(1).count():
        now = rounds[-1]
        on = now.select(F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("steps").alias("more"), F.col("total").alias("add"))
        moved = now.where("anc is not null").join(on, "anc").select("conv_id", "node", F.col("next").alias("anc"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("add")).alias("total"))
        rounds.append(stored(now.where("anc is null").unionByName(moved), "reach"))
    return rounds


def chosen(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, path (its leaf), rank, score, node and position (from 0 at the root) of the best branches of each conversation.

    Branches rank by the mean score of their messages, then the longer, then the one whose leaf comes first. Leaves of one conversation
    are ranked in salted parts first, so that no task sees all of them.
    """
    rounds = reaches(nodes)
    parents = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = rounds[-1].where("anc is null").join(parents, "node", "left_anti").withColumn("score", F.col("total") / F.col("steps"))
    order = (F.desc("score"), F.desc("steps"), F.asc("node"))
    if branches == 1:
        best = leaves.groupBy("conv_id").agg(F.max(F.struct("score", "steps", (-F.col("node")).alias("minus"))).alias("b"))
        top = best.select("conv_id", (-F.col("b.minus")).alias("path"), F.lit(1).alias("rank"), "b.score", "b.steps")
    else:
        salted = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        first = salted.withColumn("r", F.row_number().over(W.partitionBy("conv_id", "salt").orderBy(*order))).where(F.col("r") <= branches)
        ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
        top = ranked.where(F.col("rank") <= branches).select("conv_id", F.col("node").alias("path"), "rank", "score", "steps")
    found = stored(top.select("*", F.col("path").alias("node"), (F.col("steps") - 1).alias("position")).drop("steps"), "paths")
    for k in range(len(rounds) - 2, -1, -1):  # every way up is a sum of such steps, each used once at most, the longest first
        far = rounds[k].where("anc is not null").select("node", "anc")
        more = found.join(far, "node").select("conv_id", "path", "rank", "score", F.col("anc").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        found = stored(found.unionByName(more), "paths")
    return found


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, rank, score, n_turns, formatted, and loss (start and end in code points of each text to learn) of the best branches.

    messages: conv_id, message_id, parent_id, role, text, score. A reply to a message that isn't there starts a tree of its own. Of
    repeated (conv_id, message_id) each is a message, and replies go to the first. Null roles and texts count as empty, null scores as 0.
    Messages that reply to each other in a circle, and what hangs from them, have no way to a root and are in no branch; a null
    message_id has no replies. An empty table gives no rows.
    """
    src = messages.select("conv_id", "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    kept = stored(src.withColumn("node", F.monotonically_increasing_id()), "messages")
    first = kept.where("message_id is not null").groupBy("conv_id", F.col("message_id").alias("parent_id")).agg(F.min("node").alias("parent"))
    ids = kept.select("conv_id", "node", "parent_id", "score").alias("k").join(first.alias("f"), F.col("k.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("k.parent_id") == F.col("f.parent_id")), "left")
    on = chosen(stored(ids.select("k.conv_id", "k.node", "f.parent", "k.score"), "tree"), branches)
    turns = on.join(kept.select("node", "role", "text"), "node")
    said = escaped(F.col("text"))
    before, after = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)), F.lit(END)
    turns = turns.select("conv_id", "path", "rank", "score", "position", F.concat(before, said, after).alias("s"), (F.col("role") == "assistant").alias("learn"), F.length(before).alias("head"))
    upto = F.sum(F.length("s")).over(W.partitionBy("path").orderBy("position"))
    end = upto - len(END)
    placed = turns.withColumn("from", upto - F.length("s") + F.col("head")).withColumn("to", end)
    rows = placed.groupBy("path").agg(*(F.first(c).alias(c) for c in ("conv_id", "rank", "score")), F.array_sort(F.collect_list(F.struct("position", "s", "learn", "from", "to"))).alias("l"))
    loss = F.transform(F.filter("l", lambda x: x["learn"]), lambda x: F.struct(x["from"].alias("start"), x["to"].alias("end")))
    return rows.select("conv_id", "rank", "score", F.size("l").cast("long").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["s"]), "").alias("formatted"), loss.alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: an array of (role, text)."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    one = lambda s: F.struct(unescaped(F.regexp_extract(s, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)).alias("role"), unescaped(F.regexp_extract(s, r"(?s)<\|text\|>(.*)$", 1)).alias("text"))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def report(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from formatted and loss alone."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    learned = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    read = formatted.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), F.array_join(learned, "").alias("learned"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
