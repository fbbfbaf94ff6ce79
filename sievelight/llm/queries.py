"""The queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, divergence, editprint, huffman, language, ngram_join, packing, quality, secrets, simhash, urls
from .common import shared_dir, stored, table

#: Words and windows by position; a document word is hit if a window that occurs covers it.
OP3 = """
with norm as (
  select 'd' as kind, cast(doc_id as varchar) as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
  union all
  select 'b', cast(item_id as varchar), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark
), item as (
  select id, least(len(w), 10) as m, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from norm where kind = 'b' and len(w) > 0
), windows as (
  select distinct id as item_id, m, array_to_string(w[i : i + m - 1], ' ') as words from item
), lengths as (
  select distinct m from windows
), place as (
  select n.id, l.m, n.w, unnest(range(1, len(n.w) - l.m + 2)) as i from norm n, lengths l where n.kind = 'd' and len(n.w) >= l.m
), found as (
  select p.id, p.i, p.m, x.item_id from (select id, i, m, array_to_string(w[i : i + m - 1], ' ') as words from place) p join windows x on p.m = x.m and p.words = x.words
), covered as (
  select id, count(distinct j) as n_hit from (select id, unnest(range(i, i + m)) as j from (select distinct id, i, m from found)) group by id
), named as (
  select id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct id, item_id from found) group by id
)
select d.doc_id, cast(len(n.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(x.n_items, 0) as n_items,
  sha256(coalesce(x.names, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from documents d join norm n on n.kind = 'd' and n.id = cast(d.doc_id as varchar) left join covered c on c.id = n.id left join named x on x.id = n.id
"""


#: Positions from the gaps between matches; weak candidates against all parts of their document.
OP4 = f"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), scan(scan, pattern) as (values {", ".join(f"({k}, '" + p.replace("'", "''") + "')" for k, p in enumerate(secrets.SCANS))}
), matched as (
  select r, scan, regexp_extract_all(t, pattern) as m, regexp_split_to_array(t, pattern) as g from doc, scan where regexp_matches(t, pattern)
), one as (
  select r, scan, unnest(range(1, len(m) + 1)) as i, m, g from matched
), placed as (
  select r, scan, m[i] as s, sum(length(g[i]) + length(m[i])) over (partition by r, scan order by i) as b from one
), valued as (
  select r, scan, s, b, length(regexp_extract(s, '{secrets.ASSIGN.replace("'", "''")}', 2)) as v from placed
), kinds as (
  select r, b - length(s) as a, b, case scan when 0 then if(v >= 8, 0, -1) when 1 then 1 when 2 then 2 else
    case when regexp_matches(s, '^{(secrets.KEYWORD + secrets.SETS).replace("'", "''")}[A-Za-z0-9+/_.=-]') then if(v between 4 and 7, 4, -1)
         when regexp_matches(s, '^{secrets.ACCOUNT.replace("'", "''")}') then 3
         when regexp_matches(s, '^{secrets.ENDPOINT.replace("'", "''")}') then 6
         when regexp_matches(s, '[0-9]') and regexp_matches(s, '[a-z]') and regexp_matches(s, '[A-Z]') and not regexp_matches(s, '{secrets.ACCESS}|{secrets.HEX}') then 5
         else -1 end end as kind from valued
), spans as (
  select r, kind, a, b, {list(secrets.PARTS)}[kind + 1] as part from kinds where kind >= 0
), linked as (
  select x.r, x.kind, x.a, x.b from spans x join spans y on x.r = y.r and y.a < x.b + {secrets.SCOPE} and y.b > x.a - {secrets.SCOPE} and x.part <> y.part
  where x.kind >= {secrets.WEAK_FROM} group by x.r, x.kind, x.a, x.b, x.part
  having case x.part when 'access' then bool_or(y.part = 'secret') when 'secret' then bool_or(y.part = 'access') else bool_or(y.part = 'access') and bool_or(y.part = 'secret') end
), told as (
  select r, kind, a, b, concat({list(secrets.KINDS)}[kind + 1], ':', a, ':', b) as s from (select r, kind, a, b from spans where kind < {secrets.WEAK_FROM} union all select * from linked)
), summed as (
  select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(s, ',' order by a, kind) filter (kind < {secrets.WEAK_FROM}) as base, string_agg(s, ',' order by a, kind) as spans from told group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from doc left join summed using (r)
"""

#: Every rule and every listed name against every page.
OP8 = """
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), known(h, p, verdict, ruled) as (
  values ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true), ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true)
  union all select n || '.' || d, '/', 'block', false
  from (values ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n), (values ('example.com'), ('example.net'), ('example.org')) b(d)
), fit as (
  select h.page_id, k.h || k.p as entry, k.verdict, k.ruled from h join known k on (h.host = k.h or h.host like '%.' || k.h) and starts_with(h.path, k.p)
), best as (
  select page_id, max_by(entry, length(entry)) filter (ruled) as rule, max_by(verdict, length(entry)) filter (ruled) as ruled,
    max_by(entry, length(entry)) filter (not ruled) as listed, max_by(verdict, length(entry)) filter (not ruled) as unruled from fit group by page_id
)
select h.page_id, h.host, h.path, b.rule, coalesce(b.ruled, b.unruled, 'allow') as verdict, b.listed from h left join best b using (page_id)
"""


def _escaped_sql(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


OP9 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(chat.TURN + chat.SAYS + chat.END)}) as bigint) as formatted_chars
from c group by conv_id
"""


#: Every kept term of a language in every source, zeros included.
OP11 = """
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents
), kept as materialized (
  select lang, term, count(*) as n from d group by lang, term having count(distinct r) >= 3
), g as materialized (
  select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), c as materialized (
  select g.lang, g.source, k.term, coalesce(x.n, 0) as n, k.n as lang_n
  from g join kept k using (lang) left join (select lang, source, term, count(*) as n from d group by all) x using (lang, source, term)
), t as (
  select lang, source, sum(n) as total, count(*) as v, sum(lang_n) as lang_total from c group by lang, source
), s as materialized (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (total + v)::hugeint as p, 1 + (1000000000::hugeint * (lang_n + 1)) // (lang_total + v)::hugeint as q
  from c join t using (lang, source)
), pair as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), told as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pair p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from s where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from told
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 200
"""


def _op13(k: int, rounds: int) -> str:
    """Each round: all distances, the nearest, and the floor of each mean."""
    steps = [f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as f from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), x as materialized (
  select r, unnest(range(64)) as i, unnest(f) as x from v
), c0 as materialized (
  select c, unnest(range(64)) as i, unnest(f) as x from (select row_number() over (order by sha256('1:' || vec_id), f) - 1 as c, f from v order by c limit {k})
)"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (
  select r, arg_min(c, d * {k} + c) as c, min(d) as d from (select r, c, sum((x.x - y.x) * (x.x - y.x)) as d from x join c{t} y using (i) group by r, c) group by r
)""")
        if t < rounds:
            steps.append(f"""m{t} as (select c, i, cast(sum(x) as hugeint) as s, count(*) as n from x join a{t} using (r) group by c, i
), c{t + 1} as materialized (
  select c, i, cast(coalesce(s // n - case when s % n < 0 then 1 else 0 end, y.x) as bigint) as x from c{t} y left join m{t} using (c, i)
)""")
    return ",\n".join(steps) + f"""
select vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, h.centroid_sha256
from v join a{rounds} a using (r) join (select c, sha256(string_agg(x, ',' order by i)) as centroid_sha256 from c{rounds} group by c) h on h.c = a.c
"""


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/sievelight-tokens-{uuid.uuid4().hex}"
    huffman.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return huffman.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judged(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


#: Host and path, verdict: these decide before any list.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Listed names of advertisers and the like, under each of the domains.
URL_LISTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
URL_DOMAINS = ("example.com", "example.net", "example.org")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [(e, v, True) for e, v in URL_RULES] + [(f"{n}.{d}/", "block", False) for n in URL_LISTED for d in URL_DOMAINS]
    entries = spark.createDataFrame(known, "entry string, verdict string, rule boolean")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), entries).select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return chat.report(stored(chat.format_trees(chat.as_tree(turns)), "chats"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.judged(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, scale=1_000_000_000, top=200)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), size=3, ratio=(9, 10))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op4_secrets": OP4, "op8_url_filter": OP8, "op9_chat": OP9, "op11_divergence": OP11, "op13_yinyang": _op13(16, 3)}
