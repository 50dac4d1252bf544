"""Queries over documents, benchmark and labels: extraction, curation, splits, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, curate, metrics, stores

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.exploded_sentences(read(spark, sf_dir, "documents"), "doc_id", "text")


#: SQL of the sentence table that many queries start from.
SENTENCES = r"""
s0 as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？!?.])', '\1' || chr(10), 'g'), '[\r\n]+'),
                                            lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: length(x) > 0) as l
  from documents),
s as (select doc_id, unnest(range(0, len(l)))::int as pos, unnest(l) as sentence from s0)
"""


@query(f"with {SENTENCES} select doc_id, pos, sentence from s")
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 over whole documents."""
    return doc_rows(spark, sf_dir)


#: The latin profile: the subject is a sentence's first word.
SUBJECT = r"^([\p{L}]{2,24})[ ,]"


def with_subjects(rows: DataFrame) -> DataFrame:
    found = F.regexp_extract("sentence", SUBJECT, 1)
    return rows.withColumn("subject", F.lower(found)).where("subject <> ''")


SUBJECTS = SENTENCES + r""",
c as (select doc_id, pos, sentence, lower(regexp_extract(sentence, '^([\p{L}]{2,24})[ ,]', 1)) as subject from s
      where regexp_extract(sentence, '^([\p{L}]{2,24})[ ,]', 1) <> '')
"""


@query(f"with {SUBJECTS} select subject, count(*) as n, count(distinct doc_id) as n_docs from c group by subject having count(*) >= 2")
def doc_subject_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of at least two sentences."""
    rows = with_subjects(doc_rows(spark, sf_dir))
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n >= 2")


CANDIDATES = SUBJECTS + r""",
k as (select *, row_number() over (partition by subject, sentence order by doc_id, pos) as first from c where length(sentence) between 12 and 120)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_subjects(doc_rows(spark, sf_dir)).where(F.length("sentence").between(12, 120))
    rows = rows.withColumn("ord", F.struct("doc_id", "pos"))
    return stores.first_per_key(rows, "subject", "sentence")


@query(f"with {CANDIDATES} select doc_id, pos, subject, sentence from k where first = 1")
def doc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 with W1: sentences of bounded length with a subject, once each."""
    return candidates(spark, sf_dir).select("doc_id", "pos", "subject", "sentence")


@query(
    f"""with {CANDIDATES},
f as (select *, count(*) over (partition by subject) as freq from k where first = 1),
r as (select *, row_number() over (partition by subject order by length(sentence), doc_id, pos) as one from f),
t as (select subject, freq, sentence, doc_id, row_number() over (order by freq desc, length(sentence), subject) as place from r where one = 1)
select 'probe-' || lpad(place::varchar, 3, '0') as row_id, subject, freq, sentence, doc_id from t where place <= 20"""
)
def doc_ranked_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 subjects with the most candidates, each with its shortest sentence."""
    rows = candidates(spark, sf_dir)
    freq = rows.groupBy("subject").agg(F.count("*").alias("freq"))
    best = rows.groupBy("subject").agg(F.min_by(F.struct("sentence", "doc_id"), F.struct(F.length("sentence"), F.col("doc_id"), F.col("pos"))).alias("b"))
    order = [F.desc("freq"), F.length("sentence"), F.col("subject")]
    top = freq.join(best, "subject").select("subject", "freq", "b.*").orderBy(*order).limit(20)
    return stores.numbered(top, order, "probe").select("row_id", "subject", "freq", "sentence", "doc_id")


SCORE = "length(sentence) - 4 * (length(sentence) - length(replace(sentence, ',', '')))"


@query(
    f"""with {CANDIDATES},
r as (select subject, sentence, {SCORE} as score, row_number() over (partition by subject order by {SCORE} desc, doc_id, pos) as rank from k where first = 1)
select subject, sentence, score, rank from r where rank <= 3"""
)
def doc_topk_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subject the three best sentences."""
    rows = candidates(spark, sf_dir).withColumn("score", F.expr(SCORE))
    return curate.top_k(rows, "subject", [F.desc("score"), F.col("doc_id"), F.col("pos")], 3).select("subject", "sentence", "score", "rank")


@query(
    f"""with {CANDIDATES},
r as (select subject, sentence, row_number() over w as rank, sum(length(sentence)) over (partition by subject order by doc_id, pos rows unbounded preceding) as total
      from k where first = 1 window w as (partition by subject order by doc_id, pos))
select subject, string_agg(sentence, ' ' order by rank) as merged, count(*) as n from r where rank = 1 or total <= 280 group by subject"""
)
def doc_budget_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's sentences in order up to 280 characters, joined."""
    rows = curate.within_budget(candidates(spark, sf_dir), "subject", [F.col("doc_id"), F.col("pos")], F.length("sentence"), 280)
    lists = rows.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("l"), F.count("*").alias("n"))
    return lists.select("subject", F.array_join(F.transform("l", lambda r: r["sentence"]), " ").alias("merged"), "n")


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text having count(*) > 1")
def doc_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat; digests, not texts, are shuffled."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return rows.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("d")


PROMPT_KEY = r"lower(regexp_replace(regexp_replace(replace(text, '？', '?'), '[\s\p{Z}]+', '', 'g'), '[。.!！?？]+$', ''))"


@query(f"select min(doc_id) as doc_id, count(*) as copies, count(distinct text) as variants from documents group by {PROMPT_KEY} having count(*) > 1")
def doc_normalized_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal under the prompt key, and how many spellings they have."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.prompt_key(F.col("text")), 256).alias("k"), F.sha2("text", 256).alias("d"))
    return rows.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.countDistinct("d").alias("variants")).where("copies > 1").drop("k")


COLLAPSE = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(
    f"""select doc_id, sha256({COLLAPSE.format('source')} || chr(10) || {COLLAPSE.format('text')}) as fingerprint,
('0x' || substr(sha256(source), 1, 16))::ubigint % 10000 as bucket from documents"""
)
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N14, N15."""
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", text.pair_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), text.hash_bucket(F.col("source")).alias("bucket"))


@query(
    f"""with {SUBJECTS}
select subject, count(distinct sentence) as answers, min(length(sentence)) as shortest, max(length(sentence)) as longest,
       max(length(sentence)) >= 2.5 * min(length(sentence)) as length_conflict
from c group by subject having count(distinct sentence) > 1"""
)
def doc_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with several answers, and whether their lengths conflict."""
    rows = with_subjects(doc_rows(spark, sf_dir)).withColumn("n", F.length("sentence"))
    found = rows.groupBy("subject").agg(F.countDistinct("sentence").alias("answers"), F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return found.where("answers > 1").withColumn("length_conflict", F.col("longest") >= 2.5 * F.col("shortest"))


#: W8 in closed form: of the rows (k, text, place) those that the greedy pass keeps. Heads are a forest by prefix; kept are
#: the topmost of the rows that come first in their subtree, and short texts once each.
GREEDY = """
once{n} as (select k, text, min(place) as place from {rows} group by k, text),
heads{n} as (select k, substr(text, 1, ceil(length(text) * 0.8::double)::int) as head, min({{'p': place, 't': text}}) as r from once{n} where length(text) >= 8 group by 1, 2),
least{n} as materialized (select a.k, a.head, any_value(a.r) as r, min(b.r.p) as least from heads{n} a join heads{n} b on a.k = b.k and starts_with(b.head, a.head) group by a.k, a.head),
top{n} as materialized (select k, head, r from least{n} where r.p = least),
below{n} as (select b.k, b.head from top{n} a join top{n} b on a.k = b.k and a.head <> b.head and starts_with(b.head, a.head)),
kept{n} as (select k, r.p as place, r.t as text from top{n} where (k, head) not in (select (k, head) from below{n})
            union all select k, place, text from once{n} where length(text) < 8)"""


@query(
    f"""with {SENTENCES}, {GREEDY.format(n="", rows="(select doc_id as k, sentence as text, pos as place from s)")}
select k as doc_id, place as pos, text as sentence from kept"""
)
def doc_near_prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 over the sentences of each document."""
    return curate.greedy_prefix_dedup(doc_rows(spark, sf_dir), "doc_id", "pos", "sentence")


SPLIT = "case when source = 'src3' or ('0x' || substr(sha256(source || ':' || (doc_id % 50)::varchar), 1, 16))::ubigint % 10000 < 2000 then 'validation' else 'train' end"


@query(f"select doc_id, {SPLIT} as split from documents")
def doc_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserved sources, and a fifth of the other keys by hash."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")).alias("key"))
    split = curate.hash_split(rows, F.col("key"), 0.2)
    return split.select("doc_id", F.when(F.col("source") == "src3", "validation").otherwise(F.col("split")).alias("split"))


@query(
    f"""with d as (select doc_id, source, lang, {SPLIT} as split from documents),
t as (select distinct lang from d where split = 'train')
select source, split, count(*) as n, count(*) filter (where lang in (select lang from t)) as seen from d group by source, split"""
)
def doc_role_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split sizes by source, and how many rows have a language that the training side has."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(doc_hash_split(spark, sf_dir), "doc_id")
    known = rows.where("split = 'train'").select("lang").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "lang", "left").groupBy("source", "split").agg(F.count("*").alias("n"), F.count("known").alias("seen"))


@query(
    f"""with d as (select sha256(text) as h, {SPLIT} as split from documents)
select count(*) as leaked from (select h from d where split = 'train' intersect select h from d where split = 'validation')"""
)
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on both sides of the split."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(doc_hash_split(spark, sf_dir), "doc_id")
    found = curate.leaked(rows.where("split = 'train'"), rows.where("split = 'validation'"), "h")
    return found.agg(F.count("*").alias("leaked"))


@query(
    f"""with {SENTENCES}, b0 as (
  select item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？!?.])', '\\1' || chr(10), 'g'), '[\\r\\n]+'),
         lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: length(x) >= 20) as l from benchmark),
b as (select distinct item_id, unnest(l) as sentence from b0)
select item_id, count(distinct doc_id) as n_docs, count(distinct sentence) as n_sentences from b join s using (sentence) group by item_id"""
)
def benchmark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose sentences (20 characters or more) occur as sentences of documents."""
    items = curate.exploded_sentences(read(spark, sf_dir, "benchmark"), "item_id", "text").where(F.length("sentence") >= 20)
    found = items.select("item_id", "sentence").distinct().join(doc_rows(spark, sf_dir), "sentence")
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("sentence").alias("n_sentences"))


@query(
    """with n as (select lang, count(*) as n from documents group by lang), m as (select max(n) as most from n)
select lang, least(most, n * 3)::bigint as n, n as distinct_docs from n, m"""
)
def doc_role_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages repeated up to the largest one, three times at most."""
    rows = curate.balanced(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 3)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("distinct_docs"))


@query("select doc_id, unnest(range(1, case when quality = 1 then 3 when toxic = 1 then 0 else 1 end + 1))::int as copy from labels")
def doc_weighted_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows three times, toxic poor ones not at all."""
    weight = F.when(F.col("quality") == 1, 3).when(F.col("toxic") == 1, 0).otherwise(1)
    rows = read(spark, sf_dir, "labels").withColumn("w", weight).where("w > 0")
    return curate.oversampled(rows, F.col("w")).select("doc_id", "copy")


@query(
    f"""with {CANDIDATES}, q as (select distinct subject from k where first = 1)
select subject, unnest([subject || '?', 'what is ' || subject || '?', 'define ' || subject]) as question from q"""
)
def doc_query_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three question forms of each subject."""
    rows = candidates(spark, sf_dir).select("subject").distinct()
    forms = F.array(F.concat("subject", F.lit("?")), F.concat(F.lit("what is "), "subject", F.lit("?")), F.concat(F.lit("define "), "subject"))
    return rows.select("subject", F.explode(forms).alias("question"))


TOKENS = "len(regexp_split_to_array(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), ' '))"


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text.collapse(F.col("text")), " ")).alias("n"))


@query(
    f"""with d as (select doc_id, {TOKENS} as n from documents)
select doc_id, unnest(list_distinct(list_concat(range(0, n - 64, 32), [n - 65])))::int as start from d where n >= 65"""
)
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of blocks of 64 tokens, 32 apart, with the tail."""
    return token_lengths(spark, sf_dir).select("doc_id", F.explode(curate.window_starts(F.col("n"), 64, 32)).alias("start"))


@query(f"with d as (select doc_id, {TOKENS} as n from documents) select doc_id, unnest(range(0, (n + 63) // 64))::int as chunk, n from d")
def exact_once_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 tokens that cover a document once."""
    rows = token_lengths(spark, sf_dir)
    return rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 64).cast("int"))).alias("chunk"), "n")


@query(f"with d as (select doc_id, {TOKENS} as n from documents) select doc_id, n, greatest(5, round_even(n * 0.1, 0))::int as held from d")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens held out at the end."""
    return token_lengths(spark, sf_dir).select("doc_id", "n", curate.tail_size(F.col("n"), 0.1, 5).alias("held"))


@query(
    f"""with d as (select doc_id, {TOKENS} as n from documents),
w as (select doc_id, n, list_distinct(list_concat(range(0, n - 64, 96), [n - 65])) as st from d where n >= 65),
p as (select doc_id, n, unnest(st) as st from w),
c as (select distinct doc_id, n, unnest(range(st + 1, st + 65)) as target from p)
select doc_id, n - 1 as targets, count(*) as covered from c group by doc_id, n"""
)
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that windows of 64 tokens, 96 apart, cover."""
    rows = token_lengths(spark, sf_dir).where("n >= 65").withColumn("starts", F.array_sort(curate.window_starts(F.col("n"), 64, 96)))
    step = lambda s, x: F.struct((s["covered"] + F.least(F.lit(64), x - s["last"])).alias("covered"), x.alias("last"))
    start = F.struct(F.lit(0).alias("covered"), F.lit(-64).alias("last"))
    return rows.select("doc_id", (F.col("n") - 1).alias("targets"), F.aggregate("starts", start, step, lambda s: s["covered"]).cast("long").alias("covered"))


@query(
    r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
'(?s)<[^>]*>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'), '^[・＊*#>\-\s]+', '')) as cleaned from pages"""
)
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup and bullets, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return read(spark, sf_dir, "pages").select("page_id", text.clean_statement(bare).alias("cleaned"))


@query(
    r"""with g as (select l.toxic as grp, d.n_chars::double / 1000 as before_score, length(regexp_replace(d.text, '[\s\p{Z}]+', ' ', 'g'))::double / 1000 as after_score
from labels l join documents d using (doc_id))
select grp, count(*) as n, round(avg(after_score - before_score), 9) as mean_gain, count(*) filter (where after_score - before_score > 1e-6) as improved,
count(*) filter (where abs(after_score - before_score) <= 1e-6) as same, count(*) filter (where after_score - before_score < -1e-6) as regressed from g group by grp"""
)
def gain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 over lengths before and after white space is collapsed, by label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("b"), (F.length(F.regexp_replace("text", r"[\s\p{Z}]+", " ")) / 1000).alias("a"))
    rows = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grp")).join(docs, "doc_id")
    return metrics.gain_summary(rows, F.col("b"), F.col("a"), "grp").withColumn("mean_gain", F.round("mean_gain", 9))


@query(
    """with p as (select quality = 1 as truth, n_chars >= 1000 as guess from labels join documents using (doc_id)),
r as (select count(*) as n, count(*) filter (where truth and guess) / count(*) filter (where truth)::double as a,
count(*) filter (where not truth and not guess) / count(*) filter (where not truth)::double as b from p)
select n, round(a, 9) as accepted_known, round(b, 9) as rejected_unknown, round((a + b) / 2, 9) as balanced_accuracy from r"""
)
def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length gate against the quality label."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    found = metrics.rates(rows, F.col("quality") == 1, F.col("n_chars") >= 1000)
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("accepted_known", "rejected_unknown", "balanced_accuracy")])


@query(
    """with d as (select doc_id, row_number() over (order by sha256(doc_id::varchar)) as k, round(count(*) over () * 0.1) as most from documents)
select doc_id from d where k <= most"""
)
def doc_replay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, exactly, by hash rank."""
    return audit.taken_by_hash(read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 0.1).where("taken").select("doc_id")


@query(
    """with d as (select source, row_number() over (order by sha256(doc_id::varchar)) <= round(count(*) over () * 0.05) as held from documents)
select source, count(*) filter (where held) as held, count(*) filter (where not held) as train from d group by source"""
)
def doc_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an exact split by hash rank."""
    rows = audit.taken_by_hash(read(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id"), 0.05)
    return rows.groupBy("source").agg(F.count(F.when(F.col("taken"), 1)).alias("held"), F.count(F.when(~F.col("taken"), 1)).alias("train"))
