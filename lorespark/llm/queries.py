"""The queries opN_<name>: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_round_trip
from .centroids import centroid_clusters
from .common import scratch, small, table
from .decontamination import find_contamination
from .embedding_dedup import embedding_duplicates
from .language_id import fit_language_id, identify_language, is_held_out
from .minhash import near_duplicates
from .pii import find_pii
from .quality import fit_quality, score_quality
from .spelling import spelling_variants
from .token_counts import token_counts
from .token_files import token_index, write_token_files
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document (see token_counts)."""
    return token_counts(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the labelled rows that are not held out; a null doc_id counts as not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic")
    held_out = is_held_out("doc_id", 3, 1)
    model = fit_toxicity(documents.where(~held_out).join(small(labels.where(~held_out)), "doc_id"))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors (see embedding_duplicates)."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document by a model of the rows that are not held out; a null doc_id counts as not held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit_language_id(documents.where(~is_held_out()))
    found = identify_language(documents.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document (see find_contamination); no items give the digest of an empty string."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document (see bpe_round_trip)."""
    return bpe_round_trip(table(spark, sf_dir, "documents"))


#: Of the contract: verdict, host and path prefix.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page (see filter_urls)."""
    found = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document (see near_duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written to the shared folder and read back (see write_token_files, token_index)."""
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document (see find_pii)."""
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors (see centroid_clusters)."""
    found = centroid_clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the labelled rows that are not held out; a null doc_id counts as not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality")
    held_out = is_held_out("doc_id", 5, 0)
    model = fit_quality(documents.where(~held_out).join(small(labels.where(~held_out)), "doc_id"))
    scored = score_quality(documents, model)
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words (see spelling_variants)."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_toxicity,
        op3_embedding_dedup,
        op4_language_id,
        op5_decontamination,
        op6_bpe_round_trip,
        op7_url_filter,
        op8_minhash,
        op9_token_files,
        op10_pii,
        op11_centroid_clusters,
        op12_quality,
        op13_spelling_variants,
    )
}
def _clusters_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """All distances in every round; floors of means by remainders that are never negative."""
    steps = []
    for r in range(rounds + 1):
        near = f"""
a{r} as materialized (
  select i, any_value(vec_id) as vec_id, any_value(p) as p, min({{'d': d, 'c': c}}) as best
  from (select v.i, v.vec_id, v.p, m.c, list_sum(list_transform(list_zip(v.p, m.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from v, c{r} m) group by i)"""
        moved = f"""
c{r + 1} as materialized (
  select old.c, coalesce(new.p, old.p) as p from c{r} old left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as p from (
      select best.c as c, j, sum(p[j]) as s, count(*) as n from a{r}, (select unnest(range(1, {dim + 1})) as j) group by 1, 2)
    group by c) new using (c))"""
        steps += [near] + [moved] * (r < rounds)
    return f"""
with v as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as p
  from embeddings where len(embedding) = {dim} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
c0 as materialized (
  select row_number() over (order by h, p) - 1 as c, p from (
    select sha256('1:' || vec_id::varchar) as h, p from v where vec_id is not null order by h, p limit {k})),{",".join(steps)}
select vec_id, best.c::int as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia,
       (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(m.p, ',')) as centroid_sha256
from a{rounds} join c{rounds} m on m.c = best.c
"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clusters": _clusters_sql(),
    # crc32 by its table of 256 remainders; near words by what is left when one code point is taken out
    "op13_spelling_variants": """
with recursive crc as materialized (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from (select unnest(range(256)) as i))),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as run
  from documents),
own as (select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all),
raw as (
  select doc_id, run, n,
         list_transform(string_split(doc_id::varchar || ':', ''), lambda c: unicode(c)::bigint)
         || flatten(list_transform(string_split(run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195, unicode(c)::bigint - 64] end)) as b
  from own),
hashed as (
  select run, n, length(run) as size,
         xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h
  from raw, crc),
kept as (
  select case when coalesce(h % 31 = 0, false) then substr(run, 1, (h % size)::int) || substr(run, (h % size)::int + 2) else run end as word, n from hashed),
w as materialized (select word, sum(n)::bigint as n from kept where length(word) >= 7 group by word having sum(n) >= 2),
cut as materialized (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1))::int as i from w)),
near as materialized (
  select a.word, b.word as other from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select cut.word, w.word from cut join w on cut.rest = w.word
  union select w.word, cut.word from cut join w on cut.rest = w.word),
best as (
  select near.word, count(*) as n_near, min({'m': -o.n, 'w': o.word}) as b from near join w o on near.other = o.word group by near.word),
f as materialized (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -b.m >= 10 * w.n then b.w end as form, case when -b.m >= 10 * w.n then -b.m end as form_n
  from w left join best using (word)),
walk as (
  select word, form as at from f where form is not null
  union all select walk.word, f.form from walk join f on walk.at = f.word where f.form is not null),
ends as (select walk.word, walk.at as root from walk join f on walk.at = f.word where f.form is null)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n::bigint as form_n from f left join ends on f.word = ends.word
""",
    "op5_decontamination": """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
bw as (
  select item_id, least(len(w), 10) as k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + 9))) as win
  from b where len(w) > 0),
ks as (select distinct k from bw),
dw as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from d, ks where len(w) >= k),
hit as (
  select dw.doc_id, dw.i, dw.k, bw.item_id
  from (select doc_id, k, i, list_slice(w, i, i + k - 1) as win from dw) dw join bw on dw.win = bw.win and dw.k = bw.k),
pos as (select distinct doc_id, unnest(range(i, i + k)) as p from hit),
nh as (select doc_id, count(*) as n_hit from pos group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(nh.n_hit, 0)::bigint as n_hit, coalesce(it.n_items, 0)::bigint as n_items,
       sha256(coalesce(it.ids, '')) as items_sha256, coalesce(nh.n_hit, 0) > 0 as contaminated
from d left join nh using (doc_id) left join it using (doc_id)
""",
    "op3_embedding_dedup": """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link as (
  select a.vec_id as a, b.vec_id as b
  from e a join e b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) as (
  select a, b from link
  union
  select r.a, l.b from reach r join link l on r.b = l.a),
n as (select a, count(*) as n_links from link group by a),
c as (select a, min(b) as least from reach group by a)
select vec_id, coalesce(n.n_links, 0)::bigint as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) as kept
from embeddings left join n on vec_id = n.a left join c on vec_id = c.a
""",
    "op7_url_filter": """
with p as (
  select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as pos from pages),
h as (
  select page_id, url, case when pos > 0 then regexp_extract(substr(url, pos + 3), '^[^/?#]*') else '' end as rawhost,
         case when pos > 0 then substr(url, pos + 3) else '' end as rest from p),
u as (
  select page_id, url, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(rawhost) + 1), '^[^?#]*') as path from h),
m as (
  select *, case
      when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
      when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
      when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
      when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from u),
v as (
  select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as fixed from m),
d as (select distinct url, fixed from v),
g as (
  select url, fixed, unnest(list_transform(range(1, length(url) + 1), lambda i: substr(chr(2) || chr(2) || chr(2) || url, i, 4))) as gram
  from d where length(url) > 0),
t as (
  select gram, count(*) filter (where fixed = 'allow')::double as a, count(*) filter (where fixed = 'block')::double as r from g group by gram),
k as (select unnest(range(0, 4)) as k),
tails as (select k, substr(gram, 4 - k) as tail, sum(a) as a, sum(r) as r from t, k group by all),
ctx as (select k, substr(tail, 1, k) as c, sum(a) as ca, sum(r) as cr from tails group by all),
w as (select tails.k, tail, a, r, ca, cr from tails join ctx on tails.k = ctx.k and substr(tail, 1, tails.k) = c),
s0 as (select gram, (w.a + 4 * (1 / 256.0::double)) / (ca + 4) as pa, (w.r + 4 * (1 / 256.0::double)) / (cr + 4) as pr from t join w on w.k = 0 and tail = substr(gram, 4)),
s1 as (select gram, (w.a + 4 * pa) / (ca + 4) as pa, (w.r + 4 * pr) / (cr + 4) as pr from s0 join w on w.k = 1 and tail = substr(gram, 3)),
s2 as (select gram, (w.a + 4 * pa) / (ca + 4) as pa, (w.r + 4 * pr) / (cr + 4) as pr from s1 join w on w.k = 2 and tail = substr(gram, 2)),
s3 as (select gram, ln((w.a + 4 * pa) / (ca + 4)) - ln((w.r + 4 * pr) / (cr + 4)) as ratio from s2 join w on w.k = 3 and tail = gram),
sc as (select url, avg(ratio) as score from g join s3 using (gram) group by url),
x as (select d.url, fixed, round(coalesce(score, 0), 9) as score from d left join sc using (url)),
f as (
  select avg(score) filter (where fixed = 'allow') as ma, avg(score) filter (where fixed = 'block') as mr,
         stddev_pop(score) filter (where fixed = 'allow') as sa, stddev_pop(score) filter (where fixed = 'block') as sr from x),
l as (select round(coalesce(case when sa + sr > 0 then (ma * sr + mr * sa) / (sa + sr) else (ma + mr) / 2 end, 0), 9) as line from f)
select page_id, host, path, rule, coalesce(v.fixed, case when score >= line then 'allow' else 'block' end) as verdict
from v join x using (url), l
""",
}
