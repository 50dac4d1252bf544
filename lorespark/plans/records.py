"""Queries of records, memories and rules over the tables: conversations as logs of pairs, parts, orders and events as what
the rules are applied to."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, propositions, text
from ..operators import knowledge, lifecycle, memory, metrics, resolve, runs, stores
from ..session import materialize, partitions
from .documents import read
from .logs import GRAMS, KEY, PAIRS, SPACE_FREE, _share, pairs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


# --- conditions of parts

_MODIFIER = "case p_partkey % 6 when 0 then '高温' when 1 then '夜間' when 2 then '赤い' when 3 then '雨の日' when 4 then '実行時' else '古い' end"
_BRAND = "replace(p_brand, '#', '-')"


_SAID = f"concat({_MODIFIER}, 'の', {_BRAND}, 'は', p_type, 'である。')"


def part_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_size, surface: `高温のBrand-2はSMALLである`."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", text.surface(F.expr(_SAID)).alias("surface"))


PART_STATEMENTS = f"""
ps as (select p_partkey, p_size, {_MODIFIER} as m, {_BRAND} as b, p_type || 'である' as v from part),
pc as (select *, m not in ('赤い', '古い') as proven from ps)
"""


@query(f"with {PART_STATEMENTS} select p_partkey, case when proven then b || 'は、' || m || 'の場合、' || v else m || 'の' || b || 'は' || v end as normalized, proven as transformed from pc")
def part_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modifier of a subject as its condition where that is proven."""
    return part_statements(spark, sf_dir).withColumn("r", grammar.rewritten(F.col("surface"))).select("p_partkey", "r.normalized", "r.transformed")


def part_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose statements are conditionals. The grammar runs once a distinct statement, in as many tasks as shuffles
    have; its results are written, or its filter would be pushed down to every part of a file's one task."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(_SAID).alias("said"))
    once = rows.select("said").distinct().repartition(partitions(spark), "said")
    once = once.select("said", text.surface(F.col("said")).alias("surface")).withColumn("s", grammar.conditional_statement(F.col("surface")))
    rows = rows.join(materialize(once.select("said", "s"), "conditionals").where("s is not null"), "said")
    return rows.select("s.*", (F.col("p_size") % 2 == 0).alias("condition_polarity"), F.col("p_partkey").alias("ord"), "p_size")


@query(f"with {PART_STATEMENTS} select b as subject, m as condition, v as predicate, count(*) as n from pc where proven group by all")
def part_condition_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit or rewritten conditionals, counted."""
    return part_conditions(spark, sf_dir).groupBy("subject", "condition", "predicate").agg(F.count("*").alias("n"))


@query(
    f"""with {PART_STATEMENTS},
q as (select distinct b, m, case p_partkey % 3 when 0 then b || 'が' || m || 'のときは？' when 1 then m || 'の場合' || b || 'はどうなる？' else b || 'は、' || m || 'の場合、どうなる？' end as question from pc),
f as (select b, m, v, min(p_partkey) as ord from pc where proven and p_size % 2 = 0 group by b, m, v),
a as (select b, m, b || 'は、' || m || 'の場合、' || string_agg(v, '、' order by ord) || '。' as answer from f group by b, m)
select question, coalesce(answer, '') as answer from q left join a using (b, m)"""
)
def part_conditional_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms of questions about a part's brand under a condition."""
    forms = F.expr(
        f"""case p_partkey % 3 when 0 then concat({_BRAND}, 'が', {_MODIFIER}, 'のときは？') when 1 then concat({_MODIFIER}, 'の場合', {_BRAND}, 'はどうなる？')
        else concat({_BRAND}, 'は、', {_MODIFIER}, 'の場合、どうなる？') end"""
    )
    asked = read(spark, sf_dir, "part").select(forms.alias("question")).distinct().withColumn("qid", F.col("question"))
    return resolve.answer_conditional(asked, part_conditions(spark, sf_dir)).select("question", "answer")


@query(
    f"""with {PART_STATEMENTS}, n as (select b as subject, m as condition, v as predicate, min(p_partkey) as ord from pc where proven group by all)
select * from n where (subject, condition) not in (select (b, m) from pc where p_size = 1 and proven) and subject not in (select b from pc where p_partkey % 50 = 0)"""
)
def part_condition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals that are neither stored nor pending, once each."""
    new = part_conditions(spark, sf_dir)
    stored = new.where("p_size = 1").select("subject", "condition").distinct()
    fresh = new.join(stored, ["subject", "condition"], "left_anti")
    brands = read(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.expr(_BRAND).alias("subject")).distinct()
    fresh = fresh.join(brands, "subject", "left_anti").select("subject", "condition", "predicate", "ord")
    none = fresh.where("false")
    return lifecycle.queue_candidates(fresh, none, none, ["subject", "condition", "predicate"], F.lit(False))


# --- states of parts: dispatch, truth, provenance

_STATES = tuple(resolve.DISPATCH)
_STATE = f"{list(_STATES)}[p_partkey % 8 + 1]"
_TRUTH = "case p_partkey % 7 when 0 then 'true' when 1 then 'False' when 2 then 'OUTDATED' when 3 then 'contested' when 4 then ' FALSE ' when 5 then 'UNVERIFIED' end"


@query(
    f"""with s as (select p_partkey, {_STATE} as state, p_brand as answer, coalesce(upper(trim({_TRUTH})), 'UNVERIFIED') as truth, case when p_partkey % 7 in (1, 2) and p_size < 25 then p_type else '' end as fix,
  case when p_partkey % 2 = 0 then '' else p_type end as reason from part),
d as (select *, {list(v[0] for v in resolve.DISPATCH.values())}[p_partkey % 8 + 1] as a, {list(v[1] for v in resolve.DISPATCH.values())}[p_partkey % 8 + 1] as r, truth in ('FALSE', 'OUTDATED') as wrong from s)
select p_partkey, state, truth, case when wrong and fix <> '' then 'RETRIEVE' when wrong then 'BLOCK' else a end as action,
  case when wrong and fix <> '' then 'truth-state correction' when wrong then 'truth-state block' else r end as route,
  case when wrong then fix else answer end as answer, case when truth = 'TRUE' then 'PASS' when wrong and fix <> '' then 'CORRECTED' when wrong then 'BLOCK' else 'WARN' end as runtime_status,
  case truth when 'TRUE' then '' when 'UNVERIFIED' then 'knowledge is unverified' when 'CONTESTED' then 'knowledge is contested' || case when reason <> '' then ': ' || reason else '' end
    else case when fix <> '' then 'original knowledge is ' || lower(truth) || '; stored correction applied' else 'knowledge is ' || lower(truth) end end as warning from d"""
)
def part_truth_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part in one of the states, with or without a truth record."""
    part = read(spark, sf_dir, "part").withColumn("concept", F.concat(F.lit("Part"), "p_partkey"))
    state = F.get(F.array(*map(F.lit, _STATES)), (F.col("p_partkey") % 8).cast("int"))
    rows = resolve.dispatch(part.select("p_partkey", state.alias("state"), F.col("concept").alias("focus"), F.col("p_brand").alias("answer")))
    fix = F.expr("case when p_partkey % 7 in (1, 2) and p_size < 25 then p_type else '' end")
    records = part.where("p_partkey % 7 < 6").select("concept", text.truth_state(F.expr(_TRUTH)).alias("truth"), F.expr("case when p_partkey % 2 = 0 then '' else p_type end").alias("reason"), fix.alias("correction"))
    return resolve.apply_truth(rows, records).select("p_partkey", "state", "truth", "action", "route", "answer", "runtime_status", "warning")


@query(
    f"""with s as (select p_partkey, {_STATE} as state, p_type as source, case when p_size % 3 = 0 then '' else p_brand end as origin, {list(v[2] for v in resolve.DISPATCH.values())}[p_partkey % 8 + 1] as priority from part)
select p_partkey, priority, 'source=' || source || ', origin=' || case when origin = '' then '-' else origin end || ', priority=' || priority as compact from s"""
)
def part_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6."""
    state = F.get(F.array(*map(F.lit, _STATES)), (F.col("p_partkey") % 8).cast("int"))
    p = resolve.provenance(state, F.col("p_type"), F.expr("case when p_size % 3 = 0 then '' else p_brand end"))
    return read(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.priority", "p.compact")


# --- logs of pairs

WORDED = (
    PAIRS
    + r""",
l as (select *, conv_id * 1000 + turn as ord, lower(regexp_extract("user", '([\p{L}]{5,20})', 1)) as concept from p)
"""
)


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with ord and the first long word of the question as their concept."""
    return pairs(spark, sf_dir).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn")).withColumn("concept", F.lower(F.regexp_extract("user", r"([\p{L}]{5,20})", 1)))


@query(f"with {PAIRS} select distinct fingerprint from p where source in ('manual', 'approved')")
def conv_initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints that a store begins with."""
    return knowledge.initial_state(pairs(spark, sf_dir))


@query(f"with {PAIRS} select distinct conv_id, turn, fingerprint from p where fingerprint not in (select fingerprint from p where conv_id % 5 = 0)")
def conv_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained fingerprints without those to be trained again."""
    rows = pairs(spark, sf_dir)
    return knowledge.unmarked(rows.select("conv_id", "turn", "fingerprint"), rows.where("conv_id % 5 = 0"))


@query(f"with {PAIRS} select distinct fingerprint from p where conv_id % 3 = 0 and fingerprint not in (select fingerprint from p where conv_id % 2 = 0)")
def conv_subset_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: what a candidate's fingerprints lack of the production side."""
    rows = pairs(spark, sf_dir)
    return memory.subset_missing(rows.where("conv_id % 3 = 0"), rows.where("conv_id % 2 = 0"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    f"""with {WORDED}, t as (select distinct {_STRIP.format('"user"')} as u from l where conv_id % 2 = 0),
k as (select {_STRIP.format('"user"')} as u, {_STRIP.format('assistant')} as a, ord from l where source in ('manual', 'approved', 'chat-recovery'))
select u as "user", arg_max(a, ord) as answer from k where a <> '' and u in (select u from t) group by u"""
)
def conv_expected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last trusted answer of every question of even conversations."""
    rows = worded(spark, sf_dir)
    targets = rows.where("conv_id % 2 = 0").select(text.strip(F.col("user")).alias("user")).distinct()
    return knowledge.expected_answers(rows, targets)


_RANKS = {"manual": 3, "approved": 2, "chat-recovery": 1}


@query(
    f"""with {WORDED}, k as (select *, {SPACE_FREE.format('"user"')} as key, case source when 'manual' then 3 when 'approved' then 2 when 'chat-recovery' then 1 else 0 end as pr from l),
r as (select *, row_number() over (partition by key order by pr desc, ord desc) as n from k), v as (select key, count(distinct assistant) as variants from k group by key)
select key, "user", assistant, source, ord, variants from r join v using (key) where n = 1"""
)
def conv_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each prompt form the row of the best source, then the last line."""
    return memory.canonical_rows(worded(spark, sf_dir), _RANKS)


@query(
    f"""with {WORDED}, f as (select concept, fingerprint, min(ord) as o from l group by all), s as (select concept, source, min(ord) as o from l group by all),
a as (select concept, string_agg(fingerprint, ',' order by o) as fingerprints from f group by concept), b as (select concept, string_agg(source, ',' order by o) as sources from s group by concept),
m as (select concept, arg_max("user", ord) as latest_question, arg_max(source, ord) as latest_source, count(*) as trained_pairs from l group by concept)
select * from m join a using (concept) join b using (concept)"""
)
def conv_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each concept the latest question, its fingerprints and sources in order."""
    rows = memory.registry(worded(spark, sf_dir).withColumnRenamed("user", "question"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("fingerprints", "sources")})


_RELATION = "case turn % 3 when 0 then 'definition' when 1 then 'function' else 'property' end"


@query(
    f"""with {WORDED}, r as (select concept, assistant as statement, {_RELATION} as relation, source, ord from l),
a as (select concept, statement, min(ord) as o from r group by all), b as (select concept, relation, min(ord) as o from r group by all), c as (select concept, source, min(ord) as o from r group by all)
select concept, evidence, relations, sources, dominant_relation from (select concept, string_agg(statement, ' / ' order by o) as evidence from a group by concept)
  join (select concept, string_agg(relation, ',' order by o) as relations, arg_min(relation, o) as dominant_relation from b group by concept) using (concept)
  join (select concept, string_agg(source, ',' order by o) as sources from c group by concept) using (concept)"""
)
def conv_corpus_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each concept and its dominant relation."""
    rows = worded(spark, sf_dir).select(F.col("concept").alias("subject"), F.col("assistant").alias("statement"), F.expr(_RELATION).alias("relation"), "source", "ord")
    found = memory.corpus_memory(rows).drop("fingerprint")
    return found.withColumns({c: F.array_join(c, ",") for c in ("relations", "sources")})


@query(
    f"""with {WORDED}, s as (select concept, assistant, row_number() over (order by ord) - 1 as ord from l where conv_id % 2 = 0),
n as (select concept, assistant, row_number() over (order by ord) - 1 as ord from l where conv_id % 2 = 1),
z as (select concept, arg_max(assistant, ord) as assistant, max(ord) as ord from n group by concept), f as (select concept, min(ord) as place from s group by concept),
e as (select coalesce(max(ord), -1) as last from s)
select concept, assistant, ord from s where concept not in (select concept from n)
union all select z.concept, z.assistant, coalesce(place, last + 1 + z.ord) from z left join f using (concept), e"""
)
def conv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: the answers of odd conversations take the places of those of even ones."""
    from ..operators.ranges import positions

    rows = worded(spark, sf_dir).select("conv_id", "concept", "assistant", "ord")
    numbered = lambda part: positions(rows.where(part), [], ["ord"], "at").select("concept", "assistant", (F.col("at") - 1).alias("ord"))
    return stores.upsert(numbered("conv_id % 2 = 0"), numbered("conv_id % 2 = 1"), "concept")


@query(f"with {WORDED} select concept, ord from l where conv_id % 2 = 0 union all select concept, ord from l where conv_id % 2 = 1 and concept not in (select concept from l where conv_id % 2 = 0)")
def conv_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New concepts are added, known ones stay."""
    rows = worded(spark, sf_dir).select("conv_id", "concept", "ord")
    return stores.insert_absent(rows.where("conv_id % 2 = 0").drop("conv_id"), rows.where("conv_id % 2 = 1").drop("conv_id"), "concept")


@query(
    f"""with {WORDED}, t as (select distinct concept, fingerprint from l where conv_id % 5 in (0, 1)),
a as (select l.* from l join t using (concept, fingerprint) where concept <> '')
select concept, max(ord) as ord, arg_max(fingerprint, ord) as fingerprint from a group by concept"""
)
def conv_under_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each concept the newest record with an active task."""
    rows = worded(spark, sf_dir)
    status = F.expr("case conv_id % 5 when 0 then 'pending' when 1 then 'retrain' when 2 then 'verified' else 'failed' end")
    tasks = rows.select(F.concat(F.lit(" "), "concept", F.lit(" ")).alias("concept"), "fingerprint", status.alias("status"))
    return knowledge.under_verification(rows.select("concept", "fingerprint", "ord"), tasks).select("concept", "ord", "fingerprint")


@query(
    f"""with {WORDED}, q as (select *, concept || 'とは' as question, sha256(concept || 'とは' || chr(10) || trim(regexp_replace(assistant, '[\\s\\p{{Z}}]+', ' ', 'g'))) as fp from l where concept <> ''),
g as (select * from q where source in ('manual', 'approved', 'chat-recovery') and {_STRIP.format('assistant')} <> '' and concept not in (select concept from l where conv_id % 11 = 0)
      and fp in (select fp from q where conv_id % 4 < 3) and fp not in (select fp from q where conv_id % 7 = 0))
select concept, max(ord) as ord, arg_max(fp, ord) as fingerprint from g group by concept"""
)
def conv_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest trusted pair of each concept that is in the checkpoint and in no exclusion set."""
    rows = worded(spark, sf_dir).where("concept <> ''").withColumn("user", F.concat("concept", F.lit("とは")))
    rows = rows.withColumn("fingerprint", text.pair_fingerprint(F.col("user"), F.col("assistant")))
    return knowledge.protected(rows, rows.where("conv_id % 4 < 3"), rows.where("conv_id % 7 = 0"), worded(spark, sf_dir).where("conv_id % 11 = 0"), "log").select("concept", "ord", "fingerprint")


_TASK = "case conv_id % 3 when 0 then 'pending' when 1 then 'retrain' else 'verified' end"


@query(f"with {WORDED} select fingerprint, min(ord) as ord from l where conv_id % 3 < 2 and concept <> '' and \"user\" <> '' and assistant <> '' group by fingerprint")
def conv_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active tasks with all fields, once each."""
    rows = worded(spark, sf_dir).withColumn("status", F.expr(_TASK)).withColumnsRenamed({"user": "question", "assistant": "teacher_answer"})
    return memory.repair_plan(rows.select("ord", "concept", "question", "teacher_answer", "fingerprint", "status")).select("fingerprint", "ord")


_SIGN = "sha256(case when conv_id % 2 = 0 then 'UNKNOWN_KNOWLEDGE' else 'LEARNING_GAP' end || '|' || (turn % 3)::varchar || chr(10) || concept)"


@query(
    f"""with {WORDED}, r as (select *, {_SIGN} as fp from l where concept <> ''), n as (select * from r where conv_id % 3 > 0),
f as (select fp, min(ord) as ord from n where fp not in (select fp from r where conv_id % 3 = 0) group by fp)
select n.fp as fingerprint, n.ord, case when n.conv_id % 2 = 0 then 'UNKNOWN_KNOWLEDGE' else 'LEARNING_GAP' end as resolution,
  case when n.concept in (select concept from r where conv_id % 10 = 1) and n.conv_id % 2 = 1 then 'resolved' else 'pending' end as status
from f join n on f.fp = n.fp and f.ord = n.ord"""
)
def conv_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes are queued once whatever their status; answered ones are resolved."""
    kind = F.when(F.col("conv_id") % 2 == 0, "UNKNOWN_KNOWLEDGE").otherwise("LEARNING_GAP")
    rows = worded(spark, sf_dir).where("concept <> ''").select("conv_id", "ord", kind.alias("resolution"), (F.col("turn") % 3).cast("string").alias("reason"), F.col("concept").alias("user"))
    sign = text.pair_fingerprint(F.concat("resolution", F.lit("|"), "reason"), F.col("user"))
    queue = rows.where("conv_id % 3 = 0").select(sign.alias("fingerprint"))
    fresh = memory.route_once(queue, rows.where("conv_id % 3 > 0"))
    upper = F.translate("user", ascii_lowercase, ascii_uppercase)  # a to z: `ß` would not come back from `SS`
    answered = rows.where("conv_id % 10 = 1").select("resolution", F.concat(F.lit("  "), upper).alias("user"))
    return memory.resolve_routes(fresh, answered).select("fingerprint", "ord", "resolution", "status")


@query(
    f"""with {PAIRS}, a as (select conv_id, turn, case when conv_id % 3 = 0 then '未学習です' when conv_id % 17 = 1 then '' else assistant end as gated, case when turn % 4 = 1 then '未学習です' else assistant end as raw from p)
select conv_id, turn, case when coalesce(gated, '') = '' or coalesce(raw, '') = '' then 'PARSE_FAIL' when gated <> '未学習です' then 'PASS' when raw <> '未学習です' then 'FALSE_REJECT' else 'MODEL_FAIL' end as label from a"""
)
def conv_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gating did to every answer."""
    gated = F.expr("case when conv_id % 3 = 0 then '未学習です' when conv_id % 17 = 1 then '' else assistant end")
    raw = F.expr("case when turn % 4 = 1 then '未学習です' else assistant end")
    return pairs(spark, sf_dir).select("conv_id", "turn", grammar.rejection_label(gated, raw).alias("label"))


@query(f"""with {PAIRS} select conv_id, turn, {_STRIP.format("regexp_replace(assistant, '(?s)(\\r?\\n|AI:|人:).*$', '')")} as line from p""")
def conv_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies up to their first line end."""
    return pairs(spark, sf_dir).select("conv_id", "turn", text.first_line(F.col("assistant")).alias("line"))


@query(
    f"""with {WORDED}, c as (select ord, trim(regexp_replace(concept, '[\\s\\p{{Z}}]+', ' ', 'g')) as subject, trim(regexp_replace(concept || 'は、' || assistant || case when turn % 2 = 1 then 'のために使う。' else '。' end, '[\\s\\p{{Z}}]+', ' ', 'g')) as statement, turn from l),
r as (select *, regexp_replace(substr(regexp_replace(statement, '。$', ''), length(subject) + 3), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as object from c where subject <> '')
select subject, statement, min(ord) as ord, case when any_value(turn) % 2 = 1 then 'function' else 'property' end as relation, any_value(object) as object from r where object <> '' group by subject, statement"""
)
def conv_role_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and object of every statement about a concept."""
    rows = worded(spark, sf_dir).where("concept <> ''")
    said = F.concat("concept", F.lit("は、"), "assistant", F.when(F.col("turn") % 2 == 1, "のために使う。").otherwise("。"))
    return knowledge.role_memory(rows.select("ord", "concept", said.alias("answer")))


# --- events, orders, line items

_LEGACY = "case event_type when 'error' then 'resolved' when 'view' then 'pending' when 'click' then 'promoted' when 'purchase' then 'verified' else 'other' end"


@query(
    f"""with e as (select event_id, user_id % 40 as k, event_id // 50 as part, {_LEGACY} as status from events), r as (select *, case status when 'pending' then 1 when 'promoted' then 2 when 'verified' then 3 end as rank from e),
b as (select k, part, arg_max(status, rank) filter (where status <> 'resolved' and rank is not null) as best from r group by k, part)
select event_id, case when status = 'resolved' then coalesce(best, 'pending') else status end as status from r join b using (k, part) where status <> 'other'"""
)
def event_legacy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy rows take the strongest status of their key."""
    rows = read(spark, sf_dir, "events").select("event_id", F.concat_ws("/", F.col("user_id") % 40, F.floor(F.col("event_id") / 50)).alias("k"), F.expr(_LEGACY).alias("status"))
    return lifecycle.strongest_status(rows.where("status <> 'other'"), "k", "status", {"pending": 1, "promoted": 2, "verified": 3}).select("event_id", "status")


@query(
    """with c as (select o_orderkey, case o_orderstatus when 'P' then 'pending' else 'rejected' end as status from orders),
n as (select o_orderkey from c where status = 'pending' order by o_orderkey limit 1 offset 99)
select o_orderkey, case when o_orderkey in (select o_orderkey from n) then 'approved' else status end as status from c"""
)
def order_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundredth pending order is approved."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected").alias("status"))
    return lifecycle.approve(rows, "o_orderkey", "status", 100)


@query(
    """with t as (select l_returnflag, l_linestatus, l_quantity / 10 as loss, l_linenumber as rank, 0.5 + l_discount as p, l_tax as p2 from lineitem)
select l_returnflag, l_linestatus, round(avg(loss), 9) as mean_loss, round(exp(least(avg(loss), 20.0)), 6) as perplexity, round(avg((rank = 1)::int), 9) as accuracy, round(avg(p), 9) as mean_confidence,
  min(p) as min_confidence, round(avg(p - p2), 9) as mean_margin from t group by all"""
)
def lineitem_token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, A14, M9 over line items as tokens."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "l_quantity / 10 as loss", "l_linenumber as rank", "0.5D + l_discount as p", "l_tax as p2")
    found = memory.token_scores(rows, "l_returnflag", "l_linestatus")
    return found.withColumns({"perplexity": F.round("perplexity", 6)} | {c: F.round(c, 9) for c in ("mean_loss", "accuracy", "mean_confidence", "mean_margin")})


@query(
    """select n_nationkey, form::int as form, n_name || tail as question, n_name || 'は、' || r_name || 'の一部である。' as sentence
from nation join region on n_regionkey = r_regionkey, (values (0, ''), (1, 'とは'), (2, 'について教えて'), (3, 'を説明して'), (4, 'って何')) as t(form, tail)"""
)
def nation_relation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations as sentences under the five questions about a concept."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    empty = F.lit("")
    said = propositions.relation_sentence(F.col("n_name"), F.lit("part_of"), F.col("r_name"), empty, empty, F.lit(True))
    return rows.select("n_nationkey", F.posexplode(propositions.question_forms(F.col("n_name"))).alias("form", "question"), said.alias("sentence"))


_QUESTION = "case c_custkey % 4 when 0 then concat(name, 'とは') when 1 then name when 2 then 'あなた' else concat(name, ' or not') end"


@query(
    f"""with c as (select c_custkey, c_nationkey, 'C' || c_custkey as name from customer), o as (select o_custkey, count(*) as n from orders group by 1),
q as (select c_custkey, name, case when c_custkey % 4 in (0, 1) then name when c_custkey % 4 = 2 then '' else '' end as focus from c)
select q.c_custkey, focus, case when focus = '' then false when c_nationkey % 2 = 0 then false when q.c_custkey % 4 = 0 and coalesce(n, 0) >= 9 then false else true end as unknown
from q join c on q.c_custkey = c.c_custkey left join o on o_custkey = q.c_custkey"""
)
def customer_unknown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about customers; those of even nations are known, raw text counts orders."""
    rows = read(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("C"), "c_custkey"))
    asked = rows.select(F.col("c_custkey").alias("qid"), F.expr(_QUESTION).alias("question"))
    known = rows.where("c_nationkey % 2 = 0").select(F.lower("name").alias("concept"))
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("C"), "o_custkey").alias("concept"), "n")
    return resolve.unknown_gate(asked, known, counts, 9).withColumnRenamed("qid", "c_custkey")


# --- runs of gates

_GENERATED = "case conv_id % 4 when 0 then assistant when 1 then concat(assistant, ' and more') when 2 then \"user\" else repeat('ab', 20) end"


def _malformed(key: str) -> str:
    """E23 over a key (N4); the texts here are not empty and hold no replacement character."""
    return f"(length({key}) >= 8 and (" + " or ".join(_share(n).replace("length(k)", f"length({key})").replace("substr(k,", f"substr({key},") for n in (1, 2, 3, 4)) + "))"


PROBES = (
    WORDED
    + f""",
g0 as (select conv_id, turn, concept, assistant as teacher, {_GENERATED} as generated from l where assistant <> ''),
g1 as (select *, {KEY.format('teacher')} as kt, {KEY.format('generated')} as kg, {KEY.format('concept')} as kc from g0),
g2 as (select *, {GRAMS.format('kt')} as b, {GRAMS.format('kg')} as a,
         regexp_replace(case when kc <> '' and starts_with(kt, kc) then substr(kt, length(kc) + 1) else kt end, '^(?:は|とは)', '') as term from g1),
g3 as (select *, case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end as sem,
         case when len(b) = 0 then 1.0 else len(list_intersect(a, b))::double / len(b) end as lex, case when length(term) < 2 or contains(kg, term) then 1.0::double else 0.0::double end as req, {_malformed('kg')} as bad from g2),
g4 as (select *, list_filter([case when sem < 0.8 then 'semantic ' || printf('%.3f', sem) || ' < 0.800' end, case when lex < 0.35 then 'lexical ' || printf('%.3f', lex) || ' < 0.350' end,
         case when req < 0.5 then 'required ' || printf('%.3f', req) || ' < 0.500' end], lambda x: x is not null) as fails from g3),
g5 as (select *, len(fails) = 0 and not bad as passed, case when len(fails) > 0 then 'composite teacher fidelity: ' || array_to_string(fails, '; ')
         when bad then 'malformed/repetitive output' else 'composite teacher fidelity passed' end as reason from g4)
"""
)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as teachers; as generated ones they themselves, longer ones, the questions, and repetitions."""
    generated = F.expr(_GENERATED.replace('"', ""))
    rows = worded(spark, sf_dir).where("assistant <> ''").withColumn("user", F.col("user"))
    rows = rows.select("conv_id", "turn", "concept", F.col("assistant").alias("teacher"), generated.alias("generated"))
    return runs.probe_verdicts(rows.withColumn("semantic", metrics.jaccard(F.col("generated"), F.col("teacher"))))


@query(f"with {PROBES} select conv_id, turn, round(sem, 9) as semantic, round(lex, 9) as lexical, req as required, passed, reason from g5")
def conv_probe_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer as a probe of the gate."""
    rows = probes(spark, sf_dir).select("conv_id", "turn", "semantic", "lexical", "required", "passed", "reason")
    return rows.withColumns({c: F.round(c, 9) for c in ("semantic", "lexical")})


@query(f"with {PROBES} select conv_id % 8 as run, count(*) as targets, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, bool_and(passed) as ok from g5 group by 1")
def conv_gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight runs of the repair gate."""
    return runs.gate_summary(probes(spark, sf_dir).withColumn("run", F.col("conv_id") % 8), "run")


_COLLAPSED = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


@query(
    f"""with {WORDED}, s as (select distinct concept as subject from l where concept <> ''),
m as (select concept as subject, {_COLLAPSED.format("arg_min(assistant, ord)")} as value, -1 as o from l where concept <> '' and conv_id % 2 = 0 group by concept),
gen as (select concept as subject, {_COLLAPSED.format('assistant')} as value, 3 * ord as o from l where concept <> '' union all select concept, {_COLLAPSED.format('"user"')}, 3 * ord + 1 from l where concept <> ''
        union all select concept, repeat('ab', 20), 3 * ord + 2 from l where concept <> ''),
k as (select *, {KEY.format('value')} as k from gen), ok as (select subject, value, o from k where value <> '' and not {_malformed('k')} union all select * from m where value <> ''),
one as (select subject, value, min(o) as o from ok group by subject, value),
e as (select subject, string_agg(value, ' / ' order by o) as evidence, count(*)::int as items from one group by subject),
c as (select concept as subject, any_value({_COLLAPSED.format('assistant')}) as said from l where concept <> '' group by concept having count(*) = 1 and any_value(conv_id) % 3 = 0 and any_value(assistant) <> '')
select s.subject, evidence, coalesce(items, 0)::int as items, m.subject is not null as memory_hit, case when evidence is not null then coalesce(said, {_COLLAPSED.format('evidence')}) end as answer, case when evidence is not null then said is null end as used_fallback
from s left join e using (subject) left join m on m.subject = s.subject and m.value <> '' left join c on c.subject = s.subject"""
)
def conv_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from memory and from distinct usable generations; the composed answer or what the slots give."""
    rows = worded(spark, sf_dir).where("concept <> ''").withColumnRenamed("concept", "subject")
    known = rows.where("conv_id % 2 = 0").groupBy("subject").agg(F.min_by("assistant", "ord").alias("evidence"))
    texts = F.array(F.col("assistant"), F.col("user"), F.expr("repeat('ab', 20)"))
    found = rows.select("subject", "ord", F.posexplode(texts).alias("i", "generated")).withColumn("ord", F.col("ord") * 3 + F.col("i"))
    composed = rows.groupBy("subject").agg(F.count("*").alias("n"), F.first("conv_id").alias("c"), F.first("assistant").alias("generated")).where("n = 1 and c % 3 = 0")
    return runs.two_pass_functions(rows.select("subject").distinct(), known, found, composed)


# --- the cascade of stores, its dispatch and the truth overlay


_CASE = "concat('C', lpad(cast(c_custkey as varchar(9)), 6, '0'))"
_ASKED = "case c_custkey % 4 when 0 then concat(name, 'とは') when 1 then name when 2 then concat(name, 'の特徴は') else concat('some text about ', name, ' then') end"
_ACTIONS = "case state " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in resolve.DISPATCH.items()) + " end"
_ROUTES = "case state " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in resolve.DISPATCH.items()) + " end"


@query(
    f"""with c as (select c_custkey as k, {_CASE} as name, c_custkey % 24 // 4 as store, c_mktsegment as seg, c_custkey % 4 as form, {_ASKED.replace('name', _CASE)} as asked from customer),
o as (select o_custkey, count(*) as n from orders group by 1),
s as (select c.*, coalesce(n, 0) as n, store < 4 as known from c left join o on o_custkey = k),
r as (select *, form = 1 and not known as blocked, case when form = 1 and known then name || 'とは' else asked end as question from s),
t as (select *, case when blocked then 'UNKNOWN' when form = 3 then 'NON_CONCEPT' when form = 2 then case when store = 0 then 'TYPED' else 'UNKNOWN' end
    when store = 0 then 'TYPED' when store = 1 then 'CANONICAL' when store = 2 then 'UNIFIED' when store = 3 then case when k % 7 < 4 then 'INTERNALIZED' else 'INTERNALIZED_STALE' end
    when n >= 9 then 'RAW_CORPUS_ONLY' else 'UNKNOWN' end as state from r),
u as (select *, case when form = 3 then '' when form = 2 and state = 'UNKNOWN' then name || 'の特徴' else name end as focus,
    case state when 'TYPED' then name || 'は、' || seg || 'である。' when 'CANONICAL' then 'canonical ' || seg when 'UNIFIED' then 'unified ' || seg else '' end as said,
    case when state = 'TYPED' then 'property' else '' end as predicate_type, state not in ('UNKNOWN', 'NON_CONCEPT') as overlaid from t),
v as (select *, case when not overlaid then null when k % 5 = 0 then 'FALSE' when k % 5 = 1 then 'TRUE' when k % 5 = 2 then 'CONTESTED' when k % 5 = 3 then 'OUTDATED' else 'UNVERIFIED' end as truth,
    case when k % 10 = 0 then 'fixed' else '' end as fix from u)
select k as qid, question, state, focus, case when truth in ('FALSE', 'OUTDATED') then fix else said end as answer, predicate_type, blocked as bare_blocked,
  case when truth in ('FALSE', 'OUTDATED') then case when fix <> '' then 'RETRIEVE' else 'BLOCK' end else {_ACTIONS} end as action,
  case when truth in ('FALSE', 'OUTDATED') then case when fix <> '' then 'truth-state correction' else 'truth-state block' end else {_ROUTES} end as route, truth,
  case when truth = 'TRUE' then 'PASS' when truth in ('FALSE', 'OUTDATED') then case when fix <> '' then 'CORRECTED' else 'BLOCK' end when truth is not null then 'WARN' end as runtime_status,
  case truth when 'TRUE' then '' when 'UNVERIFIED' then 'knowledge is unverified' when 'CONTESTED' then 'knowledge is contested: ' || seg
    when 'FALSE' then case when fix <> '' then 'original knowledge is false; stored correction applied' else 'knowledge is false' end
    when 'OUTDATED' then case when fix <> '' then 'original knowledge is outdated; stored correction applied' else 'knowledge is outdated' end end as warning from v"""
)
def customer_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about customers, of whom each store knows a part, bare ones among them."""
    rows = read(spark, sf_dir, "customer").withColumn("name", F.expr(_CASE)).withColumn("store", F.floor(F.col("c_custkey") % 24 / 4))
    part = lambda i: rows.where(F.col("store") == i)
    asked = rows.select(F.col("c_custkey").alias("qid"), F.expr(_ASKED).alias("question"))
    facts = part(0).select(F.col("name").alias("subject"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("ord"))
    canonical = part(1).select(F.lower("name").alias("concept"), F.concat(F.lit("canonical "), "c_mktsegment").alias("answer"))
    unified = part(2).select(F.col("name").alias("concept"), F.concat(F.lit("unified "), "c_mktsegment").alias("assistant"), F.col("c_custkey").alias("ord"))
    trained = part(3).select(F.lower("name").alias("concept"), (F.col("c_custkey") % 7 < 4).alias("bound"))
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("n"))
    counts = orders.select(F.expr(_CASE).alias("concept"), "n")
    state = F.get(F.array(*map(F.lit, ("FALSE", "TRUE", "CONTESTED", "OUTDATED"))), (F.col("c_custkey") % 5).cast("int"))
    fix = F.when(F.col("c_custkey") % 10 == 0, "fixed").otherwise("")
    truth = rows.where("c_custkey % 5 < 4").select(F.lower("name").alias("concept"), state.alias("truth"), F.col("c_mktsegment").alias("reason"), fix.alias("correction"))
    return resolve.facade(asked, facts, canonical, unified, trained, counts, truth, 9)


@query(
    f"""with {PAIRS}, x as (select "user" as u, assistant as v, {SPACE_FREE.format('"user"')} as p, {SPACE_FREE.format('assistant')} as q from p
  union all select "user", lead(assistant) over (order by conv_id, turn), {SPACE_FREE.format('"user"')}, {SPACE_FREE.format('lead(assistant) over (order by conv_id, turn)')} from p where conv_id % 4 = 0
  union all select "user" || '！！', '未学習です', {SPACE_FREE.format("\"user\" || '！！'")}, {SPACE_FREE.format("'未学習です'")} from p where conv_id % 6 = 1)
select 'exact' as "check", u as prompt, count(distinct v) as n from x where v is not null group by u having count(distinct v) > 1
union all select 'normalized', p, count(distinct q) from x where v is not null group by p having count(distinct q) > 1
union all select 'length', p, count(*) from x where v is not null group by p having count(*) > 1 and max(greatest(length(q), 1)) >= 2.5 * min(greatest(length(q), 1))
union all select 'unknown_target', u, count(*) from x where contains(v, '未学習です') group by u"""
)
def conv_planted_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of whole prompts, with conflicts planted among them: the answer of the next pair, and the unknown
    reply under another punctuation."""
    from ..operators import audit
    from ..operators.ranges import positions

    rows = pairs(spark, sf_dir).select("conv_id", "turn", "user", "assistant")
    some = positions(rows.where("conv_id % 4 = 0"), [], ["conv_id", "turn"], "at")
    following = some.select((F.col("at") - 1).alias("at"), F.col("assistant").alias("next"))
    swapped = some.join(following, "at").select("user", F.col("next").alias("assistant"))
    unknown = rows.where("conv_id % 6 = 1").select(F.concat("user", F.lit("！！")).alias("user"), F.lit("未学習です").alias("assistant"))
    return audit.conflicts(rows.select("user", "assistant").unionByName(swapped).unionByName(unknown), "user", "assistant", "未学習です")
