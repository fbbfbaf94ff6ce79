"""Secret scans: patterns over whole texts, and multipart credentials linked by an interval join.

Access identifiers, secrets and endpoints are parts of one credential. Strong patterns are reported as they stand. Weak candidates
(an account name, a short or an opaque value, a URL) are reported only if the parts that complete them occur within the same scope,
a stretch of text around the candidate. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, stored


def _cases(pattern: str) -> str:
    """Each ASCII letter in either case, as a class; engines differ in what (?i) takes in beyond ASCII."""
    out, skip = [], False
    for ch in pattern:
        out.append(f"[{ch.upper()}{ch.lower()}]" if ch in LOWER + UPPER and not skip else ch)
        skip = ch == "\\"
    return "".join(out)


SETS = "[\"']? *[:=] *[\"']?"
KEYWORD = _cases("(password|passwd|secret|token|api_?key)")
ASSIGN = KEYWORD + SETS + "([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
ACCOUNT = _cases("(?:user(?:_?name)?|login|account|client_?id)") + SETS + "[A-Za-z0-9_.@+-]{3,}"
ENDPOINT = _cases("(?:https?|ftps?|jdbc|amqp|redis|postgres|postgresql|mysql|mongodb|s3)") + "://[^\\x00-\\x20\"'<>]+"
OPAQUE = "[A-Za-z0-9+/_-]{24,}"
#: Weak candidates lie between base tokens: one pass takes both, leftmost first, so that neither overlaps the other.
WEAK = f"{ASSIGN}|{ACCOUNT}|{ENDPOINT}|{ACCESS}|{HEX}|{OPAQUE}"
#: Kinds in the order that spans at one place are listed in, with the part of a credential that each is; weak ones from WEAK_FROM on.
KINDS = ("assign", "access", "hex", "account", "short", "opaque", "endpoint")
PARTS = ("secret", "access", "secret", "access", "secret", "secret", "endpoint")
WEAK_FROM = 3
#: How far, in code points, a scope reaches on either side of a candidate.
SCOPE = 200
#: Code points of a piece of a text that is rewritten.
PIECE = 1000


def _tokens(scan: int) -> Column:
    """Matches of one scan as structs: the gap before each, its length, the length of an assigned value, and its kind (-1: none)."""
    m, g = F.col(f"m{scan}"), F.split("text", SCANS[scan], -1)
    value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 2))
    if scan < 3:
        kind = lambda x: F.when(value(x) >= 8, 0).otherwise(-1) if scan == 0 else F.lit(scan)
    else:
        assigned = lambda x: x.rlike(f"^{KEYWORD}{SETS}[A-Za-z0-9+/_.=-]")
        mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]") & ~x.rlike(f"{ACCESS}|{HEX}")
        kind = lambda x: F.when(assigned(x), F.when(value(x).between(4, 7), 4).otherwise(-1)).when(x.rlike(f"^{ACCOUNT}"), 3).when(x.rlike(f"^{ENDPOINT}"), 6).when(mixed(x), 5).otherwise(-1)
    pairs = F.zip_with(m, g, lambda x, y: F.struct(F.lit(scan).alias("scan"), F.length(y).alias("gap"), F.length(x).alias("n"), F.coalesce(kind(x), F.lit(-1)).alias("kind")))
    return F.when(F.size(m) > 0, F.transform(pairs, lambda x, i: F.struct(x["scan"].alias("scan"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["kind"].alias("kind")))).otherwise(F.array())


SCANS = (ASSIGN, ACCESS, HEX, WEAK)
TOKEN = "array<struct<scan:int,i:int,gap:int,n:int,kind:int>>"


def _cells(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.withColumn("cell", F.explode(F.sequence(F.floor(start / SCOPE), F.floor((end - 1) / SCOPE))))


def linked(spans: DataFrame) -> DataFrame:
    """The weak ones among spans (row, kind, a, b) that have what completes them within SCOPE: an account a secret, a secret an
    access identifier, an endpoint both.

    An interval join by cells as long as a scope reaches: in a cell, the first start and the last end of each part say whether any
    of them lies in scope, as a scope has one border at most in a cell. So a cell gives three rows at most, however many parts it has.
    """
    part = F.element_at(F.array(*map(F.lit, PARTS)), F.col("kind") + 1)
    placed = spans.withColumn("part", part)
    there = _cells(placed, F.col("a"), F.col("b")).groupBy("row", "cell", "part").agg(F.min(F.greatest("a", F.col("cell") * SCOPE)).alias("first"), F.max(F.least("b", (F.col("cell") + 1) * SCOPE)).alias("last"))
    weak = placed.where(F.col("kind") >= WEAK_FROM).withColumnRenamed("part", "own")
    asked = _cells(weak, F.greatest(F.col("a") - SCOPE, F.lit(0)), F.col("b") + SCOPE)
    met = asked.join(there, ["row", "cell"]).where((F.col("own") != F.col("part")) & (F.col("first") < F.col("b") + SCOPE) & (F.col("last") > F.col("a") - SCOPE))
    has = lambda p: F.max(F.col("part") == p)
    found = met.groupBy("row", "kind", "a", "b", "own").agg(has("access").alias("access"), has("secret").alias("secret"))
    return found.where("case own when 'access' then secret when 'secret' then access else access and secret end").select("row", "kind", "a", "b")


def _tokens_of(df: DataFrame, *kept: Column | str) -> DataFrame:
    """kept columns and tokens of all scans; texts without a token are passed over by one test."""
    some = df.withColumn("hit", F.col("text").rlike(WEAK))
    matched = some.select(*kept, "text", *(F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m{k}") for k, p in enumerate(SCANS)))
    return matched.select(*kept, F.filter(F.concat(*(_tokens(k).cast(TOKEN) for k in range(len(SCANS)))), lambda x: x["n"].isNotNull()).alias("tokens"))


def _spans(rows: DataFrame) -> DataFrame:
    """row and spans (structs of kind, start, end; sorted) of the rows (row, tokens) that have any."""
    one = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    end = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("row", "scan").orderBy("i"))
    spans = stored(one.withColumn("b", end).where("kind >= 0").select("row", "kind", (F.col("b") - F.col("n")).alias("a"), "b"), "spans")
    told = spans.where(F.col("kind") < WEAK_FROM).unionByName(linked(spans))
    listed = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "kind", "b"))).alias("l"))
    names = F.array(*map(F.lit, KINDS))
    return listed.select("row", F.transform("l", lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["a"].alias("start"), x["b"].alias("end"))).alias("spans"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points by start, then kind as in KINDS, of every row of docs.

    A null text counts as empty. Rows without findings have an empty array; repeated rows and null doc_ids come back as often as they
    came; an empty table gives no rows. Columns besides doc_id and text are not read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = stored(_tokens_of(src, "row", "doc_id"), "secrets")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return rows.select("row", "doc_id").join(_spans(rows), "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each reported span of text replaced by [kind], and n_chars counted anew where such a column is.

    All rows stay, as often as they came, in the same columns, whatever these are called; a null text stays null. Spans that overlap are
    replaced together, by the first one's kind. Patterns are looked for once in each text; only texts that have a token are joined, all
    others pass through untouched. Such a text is cut into pieces of PIECE code points, each of which is rewritten by its own spans, so
    that the work grows with the text and the spans, not with their product. Empty and very long texts are read whole; an empty table
    gives no rows.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    flagged = stored(docs.select(row, F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").rlike(WEAK), F.lit(False)).alias("hit")), "redact")
    held = stored(flagged.where("hit").select("row", "whole"), "redact")
    texts = held.select("row", F.col("whole.text").alias("text"))
    changed = held.join(_rewritten(texts, _spans(_tokens_of(texts, "row"))), "row", "left").withColumn("text", F.coalesce("rewritten", "whole.text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    column = lambda c: (new[c] if c in new else F.col("whole").getField(c)).alias(c)
    return flagged.where("not hit").select("whole.*").unionByName(changed.select(*map(column, docs.columns)))


def _rewritten(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """row and rewritten (text with what spans cover replaced) of the rows (row, text) that have spans."""
    one = spans.select("row", F.explode("spans").alias("x")).select("row", F.col("x.kind").alias("kind"), F.col("x.start").alias("a"), F.col("x.end").alias("b"))
    by_start = W.partitionBy("row").orderBy("a", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    new = F.coalesce(F.col("a") >= F.max("b").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    joined = one.withColumn("new", new.cast("int")).withColumn("g", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    merged = joined.groupBy("row", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.when(F.col("new") == 1, F.col("kind"))).alias("kind"))
    # a piece is met by the spans that reach into it; the name of a span stands where it begins
    cell = F.explode(F.sequence(F.floor(F.col("a") / PIECE), F.floor((F.col("b") - 1) / PIECE))).alias("cell")
    marks = merged.select("row", "a", "b", "kind", cell).groupBy("row", "cell").agg(F.array_sort(F.collect_list(F.struct("a", "b", "kind"))).alias("marks"))
    pieces = texts.join(spans.select("row"), "row", "left_semi").select("row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("cell", "piece"))
    first = F.col("cell") * PIECE

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("piece"), (acc["at"] - first + 1).cast("int"), F.greatest(x["a"] - acc["at"], F.lit(0)).cast("int"))
        name = F.when(x["a"] >= first, F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(acc["out"], gap, name).alias("out"), x["b"].alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("piece"), F.least(acc["at"] - first + 1, F.lit(PIECE + 1)).cast("int"), F.lit(PIECE)))
    done = F.aggregate("marks", F.struct(F.lit("").alias("out"), first.cast("long").alias("at")), step, rest)
    rewritten = pieces.join(marks, ["row", "cell"], "left").select("row", "cell", F.coalesce(F.when(F.col("marks").isNotNull(), done), F.col("piece")).alias("piece"))
    listed = rewritten.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("cell", "piece"))).alias("l"))
    return listed.select("row", F.array_join(F.transform("l", lambda x: x["piece"]), "").alias("rewritten"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (as one string) of every row of docs."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:WEAK_FROM]))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:WEAK_FROM]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
