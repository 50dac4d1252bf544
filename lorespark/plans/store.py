"""Queries through the versioned knowledge store: promotion of requests that the orders give, and facts that events assert
and retract, each in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import promotion
from ..session import forget, materialize, partitions, scratch
from ..sources.versions import VersionedTables
from .documents import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


#: A customer's name as a concept: with a space it is no bare concept, empty it is refused.
_NAME = "case {0} % 5 when 0 then concat('customer ', {0}) when 1 then '' else concat('Customer', {0}) end"
_SAID = """case o_orderkey % 4 when 0 then concat(name, 'は、', o_orderpriority, 'を利用するであり、', o_orderstatus, '装置である。')
  when 1 then concat(name, 'は', o_orderpriority) when 2 then concat('Other', 'は、', o_orderstatus, 'である。')
  else concat(name, 'は、', o_orderpriority, 'である。') end"""
REQUESTS = f"""
r0 as (select o_orderkey as ord, o_custkey, o_orderkey, o_orderpriority, o_orderstatus, {_NAME.format('o_custkey')} as concept from orders),
r1 as (select *, case when concept = '' then 'Nobody' else concept end as name from r0),
r as (select ord, o_custkey, concept, {_SAID} as statement, ord % 4 as kind, o_orderpriority, o_orderstatus from r1),
q as (select distinct {_NAME.format('c_custkey')} as concept from customer where c_custkey % 7 <> 0),
queue as (select concept from q where concept <> ''),
j as (
  select r.*, queue.concept is not null as asked, concept not like '% %' as routed,
    case when concept = '' then 'concept must be non-empty' when kind = 1 then 'statement must use semantic proposition form: XはYである'
         when kind = 2 then 'statement subject does not match promotion concept: Other' end as bad
  from r left join queue using (concept)),
first as (select concept, min(ord) as first from j where bad is null and asked group by concept),
t as (select j.*, bad is null and asked and (not routed or ord = first) as taught from j left join first using (concept))
"""


def filled_store(spark: SparkSession, sf_dir: str, batches: int = 3) -> VersionedTables:
    """A store whose queue holds customers and whose batches are the orders' requests by ranges of keys."""
    orders = read(spark, sf_dir, "orders").withColumn("concept", F.expr(_NAME.format("o_custkey")))
    orders = orders.withColumn("name", F.when(F.col("concept") == "", "Nobody").otherwise(F.col("concept")))
    requests = orders.select(F.col("o_orderkey").alias("ord"), "concept", F.expr(_SAID).alias("statement"))
    store = promotion.open_store(spark, scratch(spark, "store"))
    asked = read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.expr(_NAME.format("c_custkey")).alias("concept"))
    promotion.enqueue(store, "queue", asked)
    end = (requests.agg(F.max("ord")).first()[0] or 0) + 1
    for k in range(batches):
        promotion.promote(store, f"requests-{k}", requests.where(F.col("ord").between(end * k // batches, end * (k + 1) // batches - 1)))
    return store


@query(
    f"""with {REQUESTS} select ord, concept, taught and routed as promoted,
  case when bad is not null then bad when not taught then '{promotion.NO_REQUEST}' when not routed then '{promotion.NOT_ROUTED}' else '{promotion.PROMOTED}' end as reason,
  case when not taught then 0 when kind = 0 then 2 else 1 end as n from t"""
)
def promotion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every request."""
    return filled_store(spark, sf_dir).read("results").drop("statement")


@query(
    f"""with {REQUESTS},
v as (select concept, ord, 0 as pos, case when kind = 0 then o_orderpriority || 'を利用する' else o_orderpriority end as value, case when kind = 0 then 'relation' else 'property' end as type from t where taught
      union all select concept, ord, 1, o_orderstatus || '装置', 'definition' from t where taught and kind = 0),
f as (select concept, value, any_value(type) as type, min((ord, pos)) as place from v group by concept, value),
k as (select concept, type, min(place) as place from f group by concept, type),
s as (select concept, string_agg(type, ',' order by place) as predicate_types from k group by concept)
select concept, any_value(concept) || 'は、' || string_agg(value, 'であり、' order by place) || 'である。' as assistant, count(*)::int as atomic_count, any_value(predicate_types) as predicate_types
from f join s using (concept) group by concept"""
)
def promotion_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified store after all batches; deltas of each touched the subjects it taught."""
    rows = filled_store(spark, sf_dir).read("unified")
    return rows.withColumn("predicate_types", F.array_join("predicate_types", ","))


@query(
    f"""with {REQUESTS}, p as (select distinct concept from t where taught and routed)
select concept, case when p.concept is null then 'pending' else 'promoted' end as status from queue left join p using (concept)"""
)
def promotion_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after all batches."""
    return filled_store(spark, sf_dir).read("queue").drop("statement")


@query(
    """with e as (select 'user ' || user_id as subject, 'value ' || ((props->>'$.k')::int % 10) as value, event_id, event_type = 'error' as minus from events),
c as (select *, max(event_id) filter (where minus) over (partition by subject, value) as cut from e),
f as (select subject, value, min(event_id) as place from c where not minus and event_id > coalesce(cut, -1) group by subject, value)
select subject, subject || 'は、' || string_agg(value, 'であり、' order by place) || 'である。' as assistant, count(*)::int as atomic_count from f group by subject"""
)
def event_fact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L12 with retractions: errors retract what other events assert; four batches, then a compaction."""
    value = F.concat(F.lit("value "), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    subject = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    changes = read(spark, sf_dir, "events").select(subject.alias("subject"), value.alias("value"), F.col("event_id").alias("ord"), F.lit(0).alias("pos"), sign.alias("sign"))
    # a file may be one task: the events are read and parsed once, in as many tasks as shuffles have
    changes = materialize(changes.repartition(partitions(spark)), "changes")
    store = promotion.open_store(spark, scratch(spark, "store"))
    end = (changes.agg(F.max("ord")).first()[0] or 0) + 1
    for k in range(4):
        promotion.apply_changes(store, f"events-{k}", changes.where(F.col("ord").between(end * k // 4, end * (k + 1) // 4 - 1)))
    store.compact()
    forget(changes)
    return store.read("unified").select(F.col("concept").alias("subject"), "assistant", "atomic_count")
