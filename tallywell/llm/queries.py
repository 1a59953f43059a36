"""The registered queries of this subpackage and their SQL.

Each query applies one operator, with production parameters, to whole tables;
digest columns are derived here from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import langid, packing, partenum, periodic, pieces, privacy, quantise, secretscan, sitetree, spelling, urlfilter, warc, winnowing
from tallywell.llm.spans import spans_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def _of_kind(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        "live", "examples",
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_of_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        "weighed", (F.size("spans") - F.size("base")).cast("long").alias("n_term"), F.size("removed").cast("long").alias("n_removed"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return quantise.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sitetree.extract(_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_texts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), change=spelling.slip)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), change=periodic.loop_ends)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"top.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL_WARC = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.first_id < p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id < p.page_id then f.first_id end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""

SQL_DECONTAMINATION = """
with d as (
  select doc_id, row_number() over () as k, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
  where item_id is not null
), bw as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)
), dw as (
  select k, i, n, array_to_string(w[i:i + n - 1], ' ') as t
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
), hits as (select dw.k, dw.i, dw.n, bw.item_id from dw join bw on dw.t = bw.t and dw.n = bw.n),
places as (select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from (select distinct k, i, n from hits)) group by k),
items as (select k, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by k)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(p.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.ids, '')) as items_sha256,
  coalesce(p.n_hit, 0) > 0 and 20 * coalesce(p.n_hit, 0) >= len(d.w) as contaminated
from d left join places p on d.k = p.k left join items i on d.k = i.k
"""

SQL_URLS = """
with r(verdict, rhost, rpath) as (values
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), u as (
  select page_id, row_number() over () as k,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, k,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), m as (
  select p.page_id, p.k, p.host, p.path, r.rhost || r.rpath as rule, r.verdict,
    row_number() over (partition by p.k order by length(r.rhost || r.rpath) desc nulls last, length(r.rhost) desc) as n
  from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL_JACCARD = f"""
with recursive d as (
  select doc_id, row_number() over () as k,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select distinct k, array_to_string(w[i:i + 3], ' ') as shingle
  from (select k, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) as i from d)
), n as (select k, count(*) as n from s group by k),
pairs as (select a.k as a, b.k as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.k <> b.k group by 1, 2),
links as (select a, b from pairs join n x on a = x.k join n y on b = y.k where 100 * common >= 85 * (x.n + y.n - common)),
reach(k, r) as (select k, k from d union select reach.k, links.b from reach join links on reach.r = links.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.least as component_id
from d left join n on d.k = n.k join (select reach.k, min(e.doc_id) as least from reach join d e on reach.r = e.k group by 1) c on d.k = c.k
"""

# Every candidate of a kind with its place: a text split by a pattern and the pattern's matches alternate.
_PLACES = """
select k, {order} as o, '{kind}' as kind, m, stop - length(m) as start, stop from (
  select k, ms[i] as m, sum(length(gs[i]) + length(ms[i])) over (partition by k order by i) as stop
  from (select k, ms, gs, unnest(range(1, len(ms) + 1)) as i from (
    select k, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gs from d)))
where {holds}
"""
_ASSIGN_SQL = """((?i:password|passwd|secret|token|api_?key))["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS_SQL = " union all ".join(_PLACES.format(order=o, kind=k, pattern=p, holds=h) for o, (k, p, h) in enumerate((
    ("assign", _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
    ("hex", "[0-9a-f]{16,}", "true"),
    ("generic", "[A-Za-z0-9+_=-]{24,}", "regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')"
     " and regexp_matches(m, '[0-9].*[0-9].*[0-9]') and len(list_distinct(string_split(m, ''))) >= 12"),
)))
_PLACEHOLDER_SQL = secretscan.PLACEHOLDER.replace("'", "''")
SQL_SECRETS = f"""
with d as (select doc_id, row_number() over () as k, coalesce(text, '') as t, coalesce(source, '') as owner, coalesce(cast(doc_id as varchar), '') as repo from documents),
c0 as ({_SECRETS_SQL}),
f as (select m, count(distinct owner) as owners, count(distinct repo) as repos from c0 join d on c0.k = d.k group by 1),
c as (
  select c0.*, case when f.owners >= {secretscan.EXAMPLE_OWNERS} or (f.owners > {secretscan.LIVE_OWNERS} and f.repos >= {secretscan.EXAMPLE_REPOS})
    or regexp_matches(c0.m, '{_PLACEHOLDER_SQL}') then 'example' when f.owners <= {secretscan.LIVE_OWNERS} then 'live' else '' end as class
  from c0 join f on c0.m = f.m
),
base as (select * from c where o < 3),
added as (
  select c.* from c where c.o = 3 and c.class = 'live'
    and not exists (select 1 from base b where b.k = c.k and c.start < b.stop and b.start < c.stop)
), b as (
  select k, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
    string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, o) as spans from base group by 1
), a as (
  select k, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, o) as spans,
    count(*) filter (class = 'live') as live, count(*) filter (class = 'example') as examples
  from (select * from base union all select * from added) group by 1
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b.spans, '')) as base_sha256, coalesce(a.spans, '') as spans,
  coalesce(a.live, 0)::bigint as live, coalesce(a.examples, 0)::bigint as examples
from d left join b on d.k = b.k left join a on d.k = a.k
"""

# crc32 byte by byte, its table from the polynomial; letters beyond ASCII here are two bytes of UTF-8.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({s}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint]
  else [(192 + unicode(c) // 64)::bigint, (128 + unicode(c) % 64)::bigint] end))), lambda crc, b: xor(crc // 256, {t}[(xor(crc, b) % 256 + 1)::int])), 4294967295::bigint)"""
SQL_SPELLING = f"""
with recursive t as (select list_transform(range(256), lambda c: list_reduce(list_prepend(c::bigint, range(8)), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)) as t),
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_UPPER.lower()}') as run from documents),
k as (select doc_id, run, count(*) as k from r group by 1, 2),
h as (select run, k, {_CRC_SQL.format(s="doc_id::varchar || ':' || run", t="t.t")} as h from k, t where doc_id is not null union all select run, k, 1 from k where doc_id is null),
w as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n from h group by 1 having length(word) >= 5 and sum(k) >= 3),
v as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from (select word, n, unnest(range(0, length(word)))::int as i from w)),
p as (select a.word, a.n, b.word as other, b.n as m from v a join v b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select v.word, v.n, w.word, w.n from v join w on v.v = w.word union select w.word, w.n, v.word, v.n from v join w on v.v = w.word),
b as (select word, any_value(n) as n, count(*) as n_near, max(m) as m from p group by 1),
f as (select b.word, b.n_near, case when b.m >= 2 * b.n then min(p.other) end as form, case when b.m >= 2 * b.n then b.m end as form_n from b join p on b.word = p.word and b.m = p.m group by b.word, b.n, b.n_near, b.m),
c as (select word, form as last from f where form is not null union all select c.word, f.form from c join f on c.last = f.word where f.form is not null),
e as (select c.word, c.last from c left join f on c.last = f.word where f.form is null)
select w.word, f.form, coalesce(e.last, w.word) as root, w.n, coalesce(f.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n from w left join f on w.word = f.word left join e on w.word = e.word
"""

# Equal words at a distance p, of which three fit into the text, stand in unbroken stretches; of equal stretches the least p is the period.
SQL_RUNS = f"""
with t as (select list_transform(range(256), lambda c: list_reduce(list_prepend(c::bigint, range(8)), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)) as t),
d as (select doc_id, row_number() over () as k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
h as (select d.*, len(w) as n, case when doc_id is null then 1 else {_CRC_SQL.format(s="coalesce(doc_id, 0)::varchar", t="t.t")} end as h from d, t),
a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from h),
b as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
x as (select k, n, i, w[(case when a is not null and i >= a then a + (i - a) % p else i end + 1)::int] as word from (select k, n, w, a, p, unnest(range(0, n)) as i from b)),
e as (select x.k, y.i - x.i as p, x.i from x join x y on x.k = y.k and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
l as (select k, p, i, i - row_number() over (partition by k, p order by i) as stretch from e),
s as (select k, p, min(i) as start, count(*) + p as length from l group by k, p, stretch having count(*) + p >= greatest(24, 3 * p)),
r as (select k, start, length, min(p) as period from s group by 1, 2, 3),
m as (select k, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by 1),
o as (select k, start, length, period, row_number() over (partition by k order by length::double / period desc, start, period) as best from r),
g as (select distinct k, unnest(range(start + period, start + length)) as i from r),
c as (select x.k, string_agg(x.word, ' ' order by x.i) as kept from x left join g on x.k = g.k and x.i = g.i where g.i is null group by 1)
select d.doc_id, coalesce(m.n_runs, 0)::bigint as n_runs, o.start::bigint as start, o.length::bigint as length, o.period::bigint as period, (1000 * o.length // o.period)::bigint as exponent_milli,
  sha256(coalesce(m.runs, '')) as runs_sha256, sha256(coalesce(c.kept, '')) as collapsed_sha256
from d left join m on d.k = m.k left join o on d.k = o.k and o.best = 1 left join c on d.k = c.k
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_personal_data": op7_personal_data,
    "op8_url_filters": op8_url_filters,
    "op9_nearest": op9_nearest,
    "op10_main_text": op10_main_text,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}
#: op1, op4, op7, op9, op10 and op11 are tested against brute force or on fixtures instead.
ORACLES = {
    "op2_warc": SQL_WARC,
    "op3_decontamination": SQL_DECONTAMINATION,
    "op5_secret_scan": SQL_SECRETS,
    "op6_jaccard_join": SQL_JACCARD,
    "op8_url_filters": SQL_URLS,
    "op12_spelling_variants": SQL_SPELLING,
    "op13_periodic_runs": SQL_RUNS,
}
