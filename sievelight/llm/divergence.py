"""Source divergence audit: how far the sources of a language lie from each other, by joint count histograms.

A pair of sources is compared over all terms that the language keeps. What f gives depends on a term's two counts alone, so the terms of
a pair are tallied by (count, count) and f is evaluated once a combination, times how many terms have it. Terms that one source or both
lack are never listed: their cells follow from each source's own histogram of counts and the number of kept terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, pieces, stored

#: Runs of letters and of all that is not ASCII; over UTF-8 bytes they are the same runs as over characters.
TERM, BREAK = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Counted terms that a task holds before it passes them on.
HELD = 200_000


def tallied(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs of rows (lang, source, text). What is held is looked at after every row, as a batch of them can have
    many times as many terms."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (all_, has) in held.items():
            terms, n = pa.array(all_.keys(), pa.binary()), len(all_)
            yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), terms, pa.array(all_.values(), pa.int64()), pa.array(map(has.__getitem__, all_), pa.int64())], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text")), strict=True):
            all_, has = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            own: set[bytes] = set()
            size -= len(all_)
            for piece in pieces(text.as_py(), BREAK):
                terms = TERM.findall(piece.lower())
                all_.update(terms)
                own.update(terms)
            has.update(own)
            size += len(all_)
            if size > most:
                yield from rows()
                held.clear()
                size = 0
    yield from rows()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows of docs that have it): several rows a term."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    most = HELD
    out = read.mapInArrow(lambda batches: tallied(batches, most), "lang string, source string, term binary, n long, docs long")
    return out.withColumn("term", F.col("term").cast("string"))


def audit(docs: DataFrame, least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language lies from each other one (part pair) and which terms
    set it apart from its language (part term, the first top of them).

    A language keeps the terms that least_docs rows of docs have. A kept term has p = 1 + floor(scale * (n + 1) / (N + V)) in a group,
    n its occurrences there, N all of kept terms there, V the number of kept terms; f = floor((p - q)^2 / q). Sums are exact and raise an
    error where they are past a long. Null text, lang and source count as empty ones, which are a language and a source like any other;
    a source without terms is a group of zeros; repeated rows count as often as they come; texts are read whole; an empty table gives no
    rows. Values that tie are ranked by item. Columns besides text, lang and source are not read.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    terms = stored(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("has"), F.sum("n").alias("lang_n"), F.min("source").alias("first")).where(F.col("has") >= least_docs)
    counts = stored(terms.join(kept.hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).cast("long").alias("once")), "counts")
    dropped(terms)

    langs = counts.groupBy("lang").agg(F.sum("once").alias("v"), F.sum("n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    none = F.lit(0).cast("long")
    groups = stored(groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "kinds", "v", "lang_total"))), "groups")
    return _pairs(counts, groups, scale).unionByName(_terms(counts, groups, scale, top))


def _p(n: str, total: str, v: str, scale: int) -> Column:
    return F.expr(f"1 + (cast({scale} as decimal(19,0)) * cast({n} + 1 as decimal(19,0))) div cast({total} + {v} as decimal(38,0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def joint_histograms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), na, nb and m: how many kept terms have na occurrences in a and nb in b; m is never 0.

    Only terms that both have are listed and tallied. What a has na times and b lacks is a's own number of such terms less what was
    tallied with na; what both lack is what is left of the kept terms.
    """
    x = counts.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    y = counts.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    both = x.join(y.hint("merge"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("m"))
    cell = lambda na, nb, m: F.struct(F.expr(na).cast("long").alias("na"), F.expr(nb).cast("long").alias("nb"), F.expr(m).cast("long").alias("m"))
    seen = both.select("lang", "a", "b", F.explode(F.array(cell("na", "nb", "m"), cell("na", "0", "-m"), cell("0", "nb", "-m"), cell("0", "0", "m"))).alias("x")).select("lang", "a", "b", "x.*")
    alone = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    one = groups.select("lang", F.col("source").alias("a"), F.col("kinds").alias("ka"), "v")
    pairs = one.join(groups.select("lang", F.col("source").alias("b"), F.col("kinds").alias("kb")), "lang").where("a < b")
    lone_a = pairs.join(alone.select("lang", F.col("source").alias("a"), F.col("n").alias("na"), "m"), ["lang", "a"]).select("lang", "a", "b", "na", F.lit(0).cast("long").alias("nb"), "m")
    lone_b = pairs.join(alone.select("lang", F.col("source").alias("b"), F.col("n").alias("nb"), "m"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("na"), "nb", "m")
    rest = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), (F.col("v") - F.col("ka") - F.col("kb")).alias("m"))
    cells = seen.unionByName(lone_a).unionByName(lone_b).unionByName(rest)
    return cells.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")).where("m <> 0")


def _pairs(counts: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    of = lambda c: groups.select("lang", F.col("source").alias(c), F.col("total").alias(f"total_{c}"), *(["v"] if c == "a" else []))
    cells = joint_histograms(counts, groups).join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    cells = cells.withColumns({"p": _p("na", "total_a", "v", scale), "q": _p("nb", "total_b", "v", scale)})
    total = lambda p, q: F.sum(F.col("m").cast("decimal(19,0)") * _f(p, q).cast("decimal(19,0)")).cast("long")
    found = cells.groupBy("lang", "a", "b").agg(total("p", "q").alias("ab"), total("q", "p").alias("ba"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    told = pairs.join(found, ["lang", "a", "b"], "left")
    side = lambda s, i, x: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.coalesce(F.col(x), F.lit(0)).cast("long").alias("value"))
    rows = told.select("lang", F.explode(F.array(side("a", "b", "ab"), side("b", "a", "ba"))).alias("x")).select("lang", "x.*")
    return _ranked(rows).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def _terms(counts: DataFrame, groups: DataFrame, scale: int, top: int) -> DataFrame:
    rows = counts.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "total", "v", scale), "q": _p("lang_n", "lang_total", "v", scale)})
    rows = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    return _ranked(rows).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
