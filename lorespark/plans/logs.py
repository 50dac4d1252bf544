"""Queries over conversations, embeddings, events and the star schema: pairs, memories, vectors, lifecycles, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grammar, text
from ..operators import audit, curate, lifecycle, metrics, stores
from .documents import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant turn that follows a user turn, with its fingerprint and a source by conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"user": F.lag("text").over(w), "before": F.lag("role").over(w)})
    rows = rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "user", F.col("text").alias("assistant"))
    source = F.element_at(F.array(*map(F.lit, ("chat-auto", "manual", "approved", "chat-recovery"))), (F.col("conv_id") % 4 + 1).cast("int"))
    return rows.withColumn("source", source).withColumn("fingerprint", text.pair_fingerprint(F.col("user"), F.col("assistant")))


PAIRS = r"""
w as (select *, lag(text) over (partition by conv_id order by turn) as u, lag(role) over (partition by conv_id order by turn) as before from conversations),
p as (select conv_id, turn, u as "user", text as assistant, ['chat-auto', 'manual', 'approved', 'chat-recovery'][conv_id % 4 + 1] as source,
      sha256(trim(regexp_replace(u, '[\s\p{Z}]+', ' ', 'g')) || chr(10) || trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) as fingerprint
      from w where role = 'assistant' and before = 'user')
"""


@query(f'with {PAIRS} select conv_id, turn, "user", assistant, source, fingerprint from p')
def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


PRIORITY = "case source when 'chat-recovery' then 3 when 'manual' then 2 when 'approved' then 1 else 0 end"


@query(
    f"""with {PAIRS}, r as (select *, row_number() over (partition by fingerprint order by {PRIORITY} desc, conv_id * 1000 + turn) as k from p)
select fingerprint, source, conv_id, turn from r where k = 1"""
)
def conv_trust_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal pairs the most trusted, then the first."""
    rows = pairs(spark, sf_dir).withColumns({"priority": F.expr(PRIORITY), "ord": F.col("conv_id") * 1000 + F.col("turn")})
    return stores.best_per_key(rows, "fingerprint", "priority").select("fingerprint", "source", "conv_id", "turn")


@query(
    f"""with {PAIRS} select conv_id, turn, fingerprint from p
where fingerprint not in (select fingerprint from p where conv_id % 3 = 0) and fingerprint not in (select fingerprint from p where source = 'manual')"""
)
def conv_pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are neither trained nor logged."""
    rows = pairs(spark, sf_dir)
    return stores.pending_pairs(rows, rows.where("conv_id % 3 = 0"), rows.where("source = 'manual'")).select("conv_id", "turn", "fingerprint")


@query(
    f"""with {PAIRS} select conv_id, turn, case when fingerprint in (select fingerprint from p where conv_id % 3 = 0)
and fingerprint in (select fingerprint from p where conv_id % 2 = 0) then 'historical' else 'pending' end as membership from p"""
)
def conv_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in both sets are historical."""
    rows = pairs(spark, sf_dir)
    return stores.membership(rows, rows.where("conv_id % 3 = 0"), rows.where("conv_id % 2 = 0")).select("conv_id", "turn", "membership")


KEY = r"regexp_replace(regexp_replace(lower({}), '[\s\p{{Z}}]+', '', 'g'), '[。、,.!?！？:：;；「」『』（）()\[\]{{}}]', '', 'g')"
GRAMS = "(case when length({0}) = 0 then [] else list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2))) end)"
JACCARD = "case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end"
COVERAGE = "case when len(b) = 0 then 1.0 else len(list_intersect(a, b))::double / len(b) end"


@query(
    f"""with {PAIRS}, k as (select conv_id, turn, {KEY.format('"user"')} as ku, {KEY.format('assistant')} as ka from p),
g as (select conv_id, turn, {GRAMS.format('ku')} as a, {GRAMS.format('ka')} as b from k)
select conv_id, turn, round({JACCARD}, 9) as similarity, round({COVERAGE}, 9) as coverage from g"""
)
def bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2 between question and answer."""
    u, a = F.col("user"), F.col("assistant")
    return pairs(spark, sf_dir).select(
        "conv_id", "turn", F.round(metrics.jaccard(u, a), 9).alias("similarity"), F.round(metrics.coverage(u, a), 9).alias("coverage")
    )


@query(
    f"""with c as (select conv_id, turn, {KEY.format('text')} as k from conversations where role = 'user'),
g as (select conv_id, turn, {GRAMS.format('k')} as g from c),
j as (select x.conv_id, x.turn, y.turn as old_turn, x.g as a, y.g as b from g x join g y on x.conv_id = y.conv_id and y.turn < x.turn),
s as (select conv_id, turn, old_turn, round({JACCARD}, 9) as score from j),
r as (select *, row_number() over (partition by conv_id, turn order by score desc, old_turn) as k from s where score >= 0.2)
select conv_id, turn, old_turn, score from r where k = 1"""
)
def conv_history_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user turn the most similar earlier one of its conversation, the earliest of equals."""
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    old = rows.select("conv_id", F.col("turn").alias("old_turn"), F.col("text").alias("old"))
    both = rows.join(old, "conv_id").where("old_turn < turn").withColumn("score", F.round(metrics.jaccard(F.col("text"), F.col("old")), 9))
    best = both.where("score >= 0.2").groupBy("conv_id", "turn").agg(F.max_by(F.struct("old_turn", "score"), F.struct("score", -F.col("old_turn"))).alias("b"))
    return best.select("conv_id", "turn", "b.*")


@query(
    f"""with c as (select conv_id, text, {KEY.format('text')} as k from conversations where role = 'user' and turn = 0),
g as (select conv_id, text, {GRAMS.format('k')} as g from c),
j as (select x.conv_id, y.conv_id as other, length(y.text) as n, x.g as a, y.g as b from g x join g y on x.conv_id <> y.conv_id),
s as (select conv_id, other, {JACCARD} as score, least(n / 200.0, 0.2) as bonus from j),
r as (select *, row_number() over (partition by conv_id order by round(score + bonus, 12) desc, other) as k from s where score >= 0.5)
select conv_id, other, round(score, 9) as score from r where k = 1"""
)
def conv_recovery_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each first question its best match of at least 0.5 among all others."""
    rows = read(spark, sf_dir, "conversations").where("role = 'user' and turn = 0").select("conv_id", "text")
    found = audit.best_similar(rows, "conv_id", "text", 0.5)
    return found.withColumn("score", F.round("score", 9))


SPACE_FREE = r"lower(regexp_replace(regexp_replace(translate({}, '？', '?'), '[\\s\\p{{Z}}]+', '', 'g'), '[。.!！?？]+$', ''))".replace("\\\\", "\\")


@query(
    f"""with {PAIRS}, r as (select conv_id % 7 as k, "user" as u, assistant as v, {SPACE_FREE.format('"user"')} as p, {SPACE_FREE.format('assistant')} as q from p),
x as (select 'topic ' || k as u, v, 'topic' || k as p, q from r)
select 'exact' as "check", u as prompt, count(distinct v) as n from x group by u having count(distinct v) > 1
union all select 'normalized', p, count(distinct q) from x group by p having count(distinct q) > 1
union all select 'length', p, count(*) from x group by p having count(*) > 1 and max(greatest(length(q), 1)) >= 2.5 * min(greatest(length(q), 1))
union all select 'unknown_target', u, count(*) from x where contains(v, 'the') group by u"""
)
def conv_conflict_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of answers by topic (seven of them, so that answers do conflict); `the` stands for the unknown
    reply."""
    rows = pairs(spark, sf_dir).withColumn("topic", F.concat(F.lit("topic "), (F.col("conv_id") % 7).cast("string")))
    return audit.conflicts(rows, "topic", "assistant", "the")


@query()
def conv_near_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose first two words are at least 0.55 alike (whole prompts here never are), with answers less than
    0.45 alike."""
    rows = pairs(spark, sf_dir).withColumn("user", F.substring_index("user", " ", 2))
    rows = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "user", "assistant")
    found = audit.near_conflicts(rows, "id", "user", "assistant", prompt=0.55)
    return found.select("a", "b", F.round("prompt_sim", 9).alias("prompt_sim"), F.round("answer_sim", 9).alias("answer_sim"))


def _share(n: int) -> str:
    g = f"list_transform(range(1, length(k) - {n - 1} + 1), lambda i: substr(k, i, {n}))"
    return f"list_max(map_values(list_histogram({g})))::double / (length(k) - {n - 1}) > 0.45"


@query(
    f"""with c as (select conv_id, turn, text, {KEY.format('text')} as k from conversations)
select conv_id, turn, (text = '' or contains(text, chr(65533)) or (length(k) >= 8 and ({' or '.join(map(_share, (1, 2, 3, 4)))}))) as malformed from c"""
)
def malformed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E23."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", grammar.malformed(F.col("text")).alias("malformed"))


@query()
def seq_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3."""
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.sequence_ratio("user", "assistant"), 9).alias("ratio"))


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as prompt, count(*) as turns from conversations group by conv_id")
def conv_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as one prompt."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    lines = F.transform("l", lambda r: F.concat(r["role"], F.lit(": "), r["text"]))
    return rows.select("conv_id", F.array_join(lines, "\n").alias("prompt"), F.size("l").cast("long").alias("turns"))


@query(
    "with r as (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) select conv_id, turn, role from r where k <= 3"
)
def conv_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns."""
    return curate.top_k(read(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "role")


# --- embeddings


@query(
    """with u as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings),
m as (select label, i, avg(x) as x from u group by label, i),
c as (select label as cand, list(x order by i) as v from m group by label),
s as (select vec_id, e.label, cand, list_cosine_similarity(embedding::double[], v) as score from embeddings e, c),
r as (select *, row_number() over (partition by vec_id order by score desc, cand) as k, lead(score) over (partition by vec_id order by score desc, cand) as next from s)
select vec_id, label, cand as best, round(score, 6) as score, round(score - next, 6) as margin from r where k = 1"""
)
def emb_centroid_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    found = metrics.centroid_margin(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return found.withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query(
    """with e as (select vec_id, label, embedding::double[] as v from embeddings)
select a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) as agreement from e a join e b on a.label = b.label and a.vec_id < b.vec_id group by a.label"""
)
def emb_pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6: mean cosine of all pairs of a label, from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))
    parts = rows.select("label", F.posexplode(F.transform("v", lambda a: a / norm)).alias("i", "x"))
    sums = parts.groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.max("n").alias("n"))
    return total.where("n > 1").select("label", F.round((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("agreement"))


# --- events

EVENT_MOVES = {("pending", "signup"): "active", ("active", "purchase"): "customer", ("customer", "error"): "active", ("active", "error"): "pending"}
_CASES = " ".join(f"when acc = '{a}' and x = '{e}' then '{b}'" for (a, e), b in EVENT_MOVES.items())


@query(
    f"""with l as (select user_id, list(event_type order by event_id) as e from events group by user_id)
select user_id, list_reduce(list_prepend('pending', e), lambda acc, x: case {_CASES} else acc end) as status from l"""
)
def event_lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L6's shape over events: the state of each user after the ordered log."""
    return lifecycle.fold_states(read(spark, sf_dir, "events"), "user_id", "event_type", EVENT_MOVES, "pending", "event_id").select("user_id", "status")


@query(
    """select user_id, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'click') as click,
count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type not in ('view', 'click', 'purchase')) as other,
count(*) as total from events group by user_id"""
)
def event_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return stores.status_counts(read(spark, sf_dir, "events"), "event_type", ["view", "click", "purchase"], "user_id")


@query(
    """select user_id, min(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id"""
)
def event_last_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last values at the place of the first event."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return stores.last_value_first_place(rows, "user_id", order="event_id")


# --- relations


@query(
    """select n_name as subject, 'part_of' as relation, r_name as value, n_name || ' is part of ' || r_name || '.' as statement,
unnest([n_name || '?', 'what is ' || n_name || '?', 'where is ' || n_name || '?']) as question from nation join region on n_regionkey = r_regionkey"""
)
def relation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples rendered, with three question forms."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = F.array(*[F.concat(F.lit(a), "n_name", F.lit("?")) for a in ("", "what is ", "where is ")])
    return rows.select(
        F.col("n_name").alias("subject"),
        F.lit("part_of").alias("relation"),
        F.col("r_name").alias("value"),
        F.concat("n_name", F.lit(" is part of "), "r_name", F.lit(".")).alias("statement"),
        F.explode(forms).alias("question"),
    )


@query(
    """with c as (select c_nationkey as k, count(*) as customers from customer where c_nationkey % 3 <> 0 group by 1),
s as (select s_nationkey as k, count(*) as suppliers from supplier where s_nationkey % 2 = 0 group by 1)
select coalesce(c.k, s.k) as concept, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from c full outer join s on c.k = s.k"""
)
def unified_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' concepts with what either knows."""
    c = read(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("concept")).agg(F.count("*").alias("customers"))
    s = read(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("concept")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "concept", "full_outer").fillna(0, ["customers", "suppliers"])
