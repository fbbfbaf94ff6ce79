"""Queries over texts: names of regions, clipped sentences, the location guard, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = str([x for row in text.REGIONS for x in row])
REGION = f"{NAMES}[cast(least(2, (3 * (2 * r + 1)) // 80) * 3 + least(2, (3 * (2 * c + 1)) // 80) + 1 as int)]"
SIDES = ", ".join(f"('{w}', '{s}')" for s, ws in text.SIDES.items() for w in ws)


def _cells(df):
    return df.withColumn("r", (F.col("event_id") % 40).cast("int")).withColumn("c", (F.col("user_id") % 40).cast("int"))


@query(f"select event_id, {REGION} as region from (select event_id, event_id % 40 as r, user_id % 40 as c from events)")
def region_name(spark, sf_dir):
    return _cells(table(spark, sf_dir, "events")).select("event_id", text.region(F.col("r"), F.col("c"), 40, 40).alias("region"))


@query("select doc_id, cast(len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w : w <> '')) as bigint) as n from documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("""with f as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from documents), s as (select doc_id, regexp_extract(t, '^[^.!?]*[.!?]?') as s from f),
w as (select doc_id, s, list_filter(string_split(s, ' '), lambda w : w <> '') as w from s)
select doc_id, case when len(w) > 25 then regexp_replace(array_to_string(w[1:25], ' '), '[,;:]+$', '') || '.' else s end as clipped from w""")
def clip_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text")).alias("clipped"))


@query(f"""with side(word, side) as (values {SIDES}), facts as (select event_id, 'the ' || event_type || ' is ' || case user_id % 5 when 0 then 'at the upper LEFT' when 1 then 'in the centre' when 2 then 'top centre' when 3 then 'right-most below' else 'nowhere' end as t, {REGION} as region,
  least(2, (3 * (2 * r + 1)) // 80) as vb, least(2, (3 * (2 * c + 1)) // 80) as hb from (select *, event_id % 40 as r, user_id % 40 as c from events)),
tok as (select event_id, vb, hb, unnest(regexp_split_to_array(lower(t), '[^a-z]+')) as w, unnest(range(len(regexp_split_to_array(lower(t), '[^a-z]+')))) as i from facts),
named as (select tok.*, s.side, case s.side when 'top' then vb = 0 when 'bottom' then vb = 2 when 'left' then hb = 0 when 'right' then hb = 2 else false end as own from tok join side s on s.word = tok.w),
judged as (select *, case when side = 'centre' then (vb = 1 and hb = 1) or (((vb = 1) <> (hb = 1)) and bool_or(own) over (partition by event_id)) else own end as ok from named)
select f.event_id, j.word from facts f left join (select event_id, arg_min(w, i) as word from judged where not ok group by event_id) j using (event_id)""")
def location_guard(spark, sf_dir):
    """The first word of a sentence that contradicts where its region is."""
    says = F.when(F.col("user_id") % 5 == 0, "at the upper LEFT").when(F.col("user_id") % 5 == 1, "in the centre").when(F.col("user_id") % 5 == 2, "top centre").when(F.col("user_id") % 5 == 3, "right-most below").otherwise("nowhere")
    e = _cells(table(spark, sf_dir, "events")).withColumn("t", F.concat(F.lit("the "), "event_type", F.lit(" is "), says))
    return e.select("event_id", text.guarded(F.col("t"), text.region(F.col("r"), F.col("c"), 40, 40)).alias("word"))


@query(f"""select event_id, concat('Reject ', printf('%03d', event_id % 1000), ': anomaly covering ', printf('%.1f', (event_id % 100)::double / 2), ' % of the part at the ', {REGION}, ', ', printf('%.2f', 1 + (event_id % 50)::double / 4), '× the learned limit.') as sentence
from (select *, event_id % 40 as r, user_id % 40 as c from events)""")
def defect_sentence(spark, sf_dir):
    e = _cells(table(spark, sf_dir, "events"))
    return e.select("event_id", text.defect_sentence((F.col("event_id") % 1000).cast("int"), (F.col("event_id") % 100) / 2.0, text.region(F.col("r"), F.col("c"), 40, 40), 1 + (F.col("event_id") % 50) / 4.0).alias("sentence"))


@query("select doc_id, sha256(text) as digest from documents")
def fingerprint_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
