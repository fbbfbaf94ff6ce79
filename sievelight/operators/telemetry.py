"""Windows over event logs: rates, runs, latencies, idleness, segments, matching in time."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from ..params import DEFAULT, Params
from ..sources.shared import dropped, stored

#: Parts that a group is dealt to, and rows of a group that a moving average takes at once.
SALTS, STRETCH = 32, 4096


def latest(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in this order: of salted parts first, so that no task sorts a whole group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    some = salted.withColumn("_k", F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_k") <= n)
    return some.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k", "_salt")


def latency_summary(df: DataFrame, by: str, value: str, *order: Column, params: Params = DEFAULT) -> DataFrame:
    """by, n, mean, p50, p95 and max of the last samples that are finite."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    last = latest(known.select(by, value, *(c for c in ("t_ms", "event_id") if c in df.columns)), [by], params.latency_window, *order)
    return last.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"))


def per_minute(df: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """df (by, t_ms, ...) with rate: events of its group in the window up to and with it, a minute.

    A window reaches from its bucket of time into the one before, at most: each event is counted in its own bucket and sent to the
    next, so that partitions are buckets, not groups.
    """
    w = params.rate_window_ms
    sent = df.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", F.floor(F.col("t_ms") / w) + F.col("_at"))
    upto = W.partitionBy(by, "_bucket").orderBy("t_ms").rangeBetween(-(w - 1), 0)
    return sent.withColumn("rate", F.count("*").over(upto) * (60_000 / w)).where("_at = 0").drop("_at", "_bucket")


def runs(df: DataFrame, by: str, event: Column, reset: Column, *order: Column) -> DataFrame:
    """df with run: how many events there were since the last reset, this row included; rows that are neither (or null) leave it as it
    is. Ranges of the order are counted apart; a range goes on from the events after the last reset before it."""
    flagged = df.withColumn("_event", F.coalesce(event, F.lit(False)).cast("int")).withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("int"))
    rows = stats.ranged(flagged, [by], F.struct(*order))
    upto = lambda *g: W.partitionBy(by, *g).orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("_group", F.sum("_reset").over(upto("_part")))
    inside = inside.withColumn("run", F.sum(F.when(F.col("_reset") == 1, 0).otherwise(F.col("_event"))).over(upto("_part", "_group")))
    ends = inside.groupBy(by, "_part").agg(F.max(F.struct("_group", "run")).alias("_end"))
    parts = W.partitionBy(by).orderBy("_part")
    since = ends.withColumn("_since", F.sum((F.col("_end._group") > 0).cast("int")).over(parts))
    tail = since.withColumn("_tail", F.sum("_end.run").over(W.partitionBy(by, "_since").orderBy("_part")))
    before = tail.select(by, "_part", F.coalesce(F.lag("_tail").over(parts), F.lit(0)).alias("_before"))
    out = stats.alike(inside, before, [by, "_part"])
    return out.withColumn("run", F.col("run") + F.when(F.col("_group") == 0, F.col("_before")).otherwise(0)).select(*df.columns, "run")


def idle(df: DataFrame, by: str, seen: Column, *order: Column, params: Params = DEFAULT) -> DataFrame:
    """df (by, t_ms, ...) with idle: nothing seen for idle_ms, counted from the group's first row until something is. Ranges of the order
    are looked at apart; a range goes on from the last sight before it."""
    rows = stats.ranged(df.withColumn("_seen", F.coalesce(seen, F.lit(False))), [by], F.struct(*order))
    sight = F.when(F.col("_seen"), F.col("t_ms"))
    ends = rows.groupBy(by, "_part").agg(F.max(sight).alias("_sight"), F.min("t_ms").alias("_t0"))
    earlier = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select(by, "_part", F.max("_sight").over(earlier).alias("_sight"), F.min("_t0").over(earlier).alias("_t0"))
    upto = W.partitionBy(by, "_part").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    out = stats.alike(rows.withColumn("_last", F.max(sight).over(upto)).withColumn("_first", F.min("t_ms").over(upto)), before, [by, "_part"])
    last = F.coalesce(F.greatest("_last", "_sight"), F.least("_first", "_t0"))
    return out.withColumn("idle", ~F.col("_seen") & (F.col("t_ms") - last >= params.idle_ms)).select(*df.columns, "idle")


def numbered(df: DataFrame, by: str, name: str, *order: Column) -> DataFrame:
    """df with name: 1, 2, ... in the group's order, counted from ranges of it."""
    return stats.positions(df, [by], F.struct(*order)).withColumn(name, F.col("_at") + 1).drop("_at")


def segments(df: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """df (by, t_ms, ...) with seg: which of equally long stretches of its group's time a row lies in."""
    span = df.groupBy(by).agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    at = F.floor(params.segments * (F.col("t_ms") - F.col("_t0")) / (F.col("_t1") - F.col("_t0") + 1e-9))
    return df.join(span, by).withColumn("seg", F.greatest(F.lit(0), F.least(F.lit(params.segments - 1), at)).cast("int")).drop("_t0", "_t1")


def detrended(df: DataFrame, by: str, value: str, half: int, *order: Column) -> DataFrame:
    """df with detrended: value less its centred moving average, cut off at the ends. A row goes to the stretch of places that it lies in
    and, near an end, to the one beside, so that partitions are stretches, not groups."""
    length = max(STRETCH, half)
    stretch = lambda at: F.floor(at / length)
    at = stats.positions(df, [by], F.struct(*order))
    sent = at.withColumn("_s", F.explode(F.sequence(stretch(F.greatest(F.col("_at") - half, F.lit(0))), stretch(F.col("_at") + half))))
    mean = F.avg(value).over(W.partitionBy(by, "_s").orderBy("_at").rowsBetween(-half, half))
    return sent.withColumn("detrended", F.col(value) - mean).where(F.col("_s") == stretch(F.col("_at"))).drop("_at", "_s")


def matched(expected: DataFrame, actual: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, e_id, a_id, dt: one-to-one pairs (id, t_ms) within match_ms, the nearest first, then the lower ids. Rows without an id or a
    time match nothing.

    Each round takes the pairs that are best for both of their sides, which the greedy order takes too; rounds go on until none is left.
    What a point is nearest to lies next to it in the order of time, so that rounds read points, never the pairs within reach.
    """
    side = lambda df, expected: df.select(by, F.lit(expected).alias("e"), "id", F.col("t_ms").alias("t")).dropna().distinct()
    left = stored(side(expected, True).unionByName(side(actual, False)), "points")
    again = left.groupBy(by, "e", "id").count().where("count > 1").limit(1).count() > 0
    taken = None
    while True:
        best = stored(_mutual(left, by, params.match_ms, again), "matched")
        if not best.limit(1).count():
            dropped(left)
            return best if taken is None else taken
        taken = best if taken is None else taken.unionByName(best)
        gone = best.select(by, F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(c).alias("id")) for e, c in ((True, "e_id"), (False, "a_id"))))).alias("x")).select(by, "x.*")
        last, left = left, stored(left.join(gone, [by, "e", "id"], "left_anti"), "points")
        dropped(last)


def _mutual(points: DataFrame, by: str, within: int, again: bool) -> DataFrame:
    """by, e_id, a_id and dt of the pairs of points (by, e: whether expected, id, t) that are the nearest for both of their sides.

    A point goes to its bucket of time and the two beside, and looks for the other side's last time before it and first after it. Points
    of one time are numbered by id: where their nearest time is one alone, and theirs is they, the greedy order takes first with first,
    second with second, and so on. Where two times are as near, and where ids come again, only the first ones are taken.
    """
    bucket = F.floor(F.col("t") / within)
    sent = points.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_b", bucket + F.col("_d"))
    upto, down = W.partitionBy(by, "_b").orderBy("t"), W.partitionBy(by, "_b").orderBy(F.desc("t"))
    other = lambda sign, w: F.when(F.col("e"), F.min(F.when(~F.col("e"), F.struct((sign * F.col("t")).alias("t"), "id"))).over(w)).otherwise(F.min(F.when(F.col("e"), F.struct((sign * F.col("t")).alias("t"), "id"))).over(w))
    seen = sent.withColumns({"_l": other(-1, upto), "_r": other(1, down)}).withColumn("_k", F.row_number().over(W.partitionBy(by, "_b", "e", "t").orderBy("id"))).where("_d = 0")
    seen = seen.withColumns({"_dl": F.col("t") + F.col("_l.t"), "_dr": F.col("_r.t") - F.col("t")})
    first = F.col("_r").isNull() | (F.col("_dl") < F.col("_dr")) | ((F.col("_dl") == F.col("_dr")) & (F.col("_l.id") <= F.col("_r.id")))
    near = seen.where("_l is not null or _r is not null").withColumn("_first", F.coalesce(first, F.lit(False)))
    near = near.withColumns({"dt": F.when(F.col("_first"), F.col("_dl")).otherwise(F.col("_dr")), "_to": F.when(F.col("_first"), -F.col("_l.t")).otherwise(F.col("_r.t")), "_id": F.when(F.col("_first"), F.col("_l.id")).otherwise(F.col("_r.id"))}).where(F.col("dt") <= within)
    two = F.coalesce((F.col("_dl") == F.col("_dr")) & (F.col("_dl") > 0), F.lit(False))
    if again:
        rank = F.struct("dt", "_id")
        near = near.withColumn("_best", F.min(rank).over(W.partitionBy(by, "e", "id"))).where((F.col("_k") == 1) & (F.col("_best") == rank))
    else:
        near = near.where((F.col("_k") == 1) | ~two)
    pair = [F.when(F.col("e"), F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("_te", "t", "_to"), ("_ta", "_to", "t"))]
    met = near.groupBy(by, *pair, "_k").agg(F.max(F.when(F.col("e"), F.col("id"))).alias("e_id"), F.max(F.when(~F.col("e"), F.col("id"))).alias("a_id"), F.max("dt").alias("dt"))
    found = met.where("e_id is not null and a_id is not null").select(by, "e_id", "a_id", "dt")
    return found.distinct() if again else found


def unmatched(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """side ("missing" or "extra") and key of what only one side has."""
    missing = expected.join(actual, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.unionByName(actual.join(expected, key, "left_anti").select(F.lit("extra").alias("side"), key))


def folded(rows: DataFrame, by: str, order: list[str], added: str, start: object, step: Callable, spread: bool = False) -> DataFrame:
    """rows in order with a column that step(state, row) gives together with the next state: a fold over each group's rows as they
    stream through a task, in constant memory.

    With spread a group's order is cut into ranges that are folded side by side, each from a guess of the state before it, then again
    from what the range before ended with, until no range begins otherwise than it was folded. States that forget (the last row kept, a
    slow average, a level) meet after few rows, so that few rounds do; where they don't within ROUNDS, the group is one fold.
    """
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), added])
    if spread:
        at = stats.ranged(rows, [by], F.struct(*order))
        entries = _entries(at, by, order, start, step)
        if entries is not None:
            dealt = stats.alike(at, entries, [by, "_part"]).repartition(by, "_part").sortWithinPartitions(by, "_part", *order)
            return dealt.mapInPandas(_fold(by, start, step, rows.columns, added.split()[0]), shape)
    dealt = rows.repartition(by).sortWithinPartitions(by, *order).select(*rows.columns)
    return dealt.mapInPandas(_fold(by, start, step, rows.columns, added.split()[0]), shape)


#: Rounds in which the states of ranges have to meet.
ROUNDS = 6


def _fold(by: str, start: object, step: Callable, names: list[str], added: str | None) -> Callable:
    """A fold over batches of sorted rows, by group, and by range (_part) from its entry (_entry, pickled) where these are there. Without
    added it gives each range's last state alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, ends = object(), start, []
        for b in batches:
            keys = list(zip(b[by], b["_part"], strict=True)) if "_part" in b else list(b[by])
            entries, out = b["_entry"].tolist() if "_entry" in b else None, []
            for k, (key, row) in enumerate(zip(keys, b[names].itertuples(index=False), strict=True)):
                if key != group:
                    if added is None and isinstance(group, tuple):
                        ends.append((*group, pickle.dumps(state)))
                    group = key
                    state = start if entries is None or entries[k] is None else pickle.loads(entries[k])
                state, value = step(state, row)
                out.append(value)
            if added is not None:
                yield b[names].assign(**{added: out})
        if added is None and isinstance(group, tuple):
            ends.append((*group, pickle.dumps(state)))
        if added is None:
            yield pd.DataFrame(ends, columns=[by, "_part", "_exit"])

    return run


def _entries(at: DataFrame, by: str, order: list[str], start: object, step: Callable) -> DataFrame | None:
    """by, _part and _entry of every range: the state that the one before ends with; None if they don't settle."""
    names = [c for c in at.columns if c not in ("_o", "_part")]
    kind = at.schema[by].dataType.simpleString()
    entries = stored(at.select(by, "_part").distinct().withColumn("_entry", F.lit(None).cast("binary")), "entries")
    asked, exits = entries, None
    for _ in range(ROUNDS):
        dealt = stats.alike(at, asked, [by, "_part"]).repartition(by, "_part").sortWithinPartitions(by, "_part", *order)
        now = dealt.mapInPandas(_fold(by, start, step, names, None), f"`{by}` {kind}, _part int, _exit binary")
        if exits is not None:
            now = now.unionByName(exits.join(asked.select(F.col(by).alias("_b"), F.col("_part").alias("_p")), F.col(by).eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p")), "left_anti"))
        exits = stored(now, "exits")
        before = F.lag("_exit").over(W.partitionBy(by).orderBy("_part"))
        new = stored(exits.select(by, "_part", before.alias("_entry")), "entries")
        old = entries.select(F.col(by).alias("_b"), F.col("_part").alias("_p"), F.col("_entry").alias("_was"))
        asked = new.join(old, F.col(by).eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).where(~F.col("_entry").eqNullSafe(F.col("_was"))).select(by, "_part", "_entry")
        entries = new
        if not asked.limit(1).count():
            return entries
    return None
