"""Queries that check the answers of conversations, with questions in the frames that the gates read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates
from ..operators import consistency
from .logs import GRAMS, JACCARD, KEY, PAIRS, pairs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


_QUESTION = """case (conv_id + turn) % 8 when 0 then concat(w1, 'とは') when 1 then concat(w1, 'とは') when 2 then concat(w1, 'について教えて')
  when 3 then concat(w1, 'と', w2, 'の違い') when 4 then concat(w1, 'と', w2, 'の違い') when 7 then concat('Unit-', conv_id % 9, 'について教えて') else user_text end"""
_ANSWER = """case (conv_id + turn) % 8 when 1 then concat(w1, 'です。') when 2 then concat(w1, 'は、', assistant)
  when 3 then concat(w1, 'は', w2, 'より', assistant) when 5 then coalesce(before, assistant)
  when 7 then concat('unit-', conv_id % 5, ' ', assistant) else assistant end"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer of the answered turns; some answers repeat the question before (stale ones), some only
    echo, some name another unit."""
    words = [F.regexp_extract("user", r"([\p{L}]{5,20})", 1), F.regexp_extract("user", r"[\p{L}]{5,20}[^\p{L}].*?([\p{L}]{5,20})", 1)]
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.col("user").alias("user_text"), "assistant", words[0].alias("w1"), words[1].alias("w2"))
    rows = rows.withColumn("question", F.expr(_QUESTION))
    rows = rows.withColumn("before", F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", "question", F.expr(_ANSWER).alias("answer"))


def _any(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _sim(a: str, b: str) -> str:
    return JACCARD.replace("len(a)", f"len({a})").replace("len(b)", f"len({b})").replace("(a, b)", f"({a}, {b})")


_SURFACE = "regexp_replace({}, '(?:です|である|だ)$', '')"
#: The concepts here are Latin words without aliases or categories.
CHECKED = f"""
u as (select conv_id, turn, "user" as user_text, assistant, regexp_extract("user", '([\\p{{L}}]{{5,20}})', 1) as w1,
        regexp_extract("user", '[\\p{{L}}]{{5,20}}[^\\p{{L}}].*?([\\p{{L}}]{{5,20}})', 1) as w2 from p),
u1 as (select *, {_QUESTION} as question from u),
u2 as (select *, lag(question) over (partition by conv_id order by turn) as before from u1),
t as (select conv_id, turn, question, {_ANSWER} as answer, row_number() over (partition by conv_id order by turn) as place from u2),
t1 as (select *, trim(question) as q, {KEY.format('question')} as kq, {KEY.format('answer')} as ka,
         list_filter(regexp_extract_all(question, '([A-Za-z][A-Za-z0-9_+.#-]{{1,39}})'),
           lambda e: not list_contains({list(gates.KNOWN_ENTITIES)}, upper(e)) and (regexp_matches(e, '[0-9-]') or (length(e) >= 5 and regexp_matches(e, '[a-z]') and regexp_matches(e, '^.+[A-Z]')))) as found
       from t),
t2 as (select *, list_filter(list_filter(found, lambda e, i: list_position(found, e) = i), lambda e: not contains(lower(answer), lower(e))) as missing,
         {GRAMS.format('kq')} as gq, {GRAMS.format('ka')} as ga,
         coalesce(nullif(regexp_extract(regexp_replace(q, '[。！？!?]+$', ''), '^(.+?)とは(?:何)?$', 1), ''), nullif(regexp_extract(regexp_replace(q, '[。！？!?]+$', ''), '^(.+?)について(?:教えて|説明して)$', 1), ''), '') as focus,
         '^\\s*([^\\s、。！？?と]{{1,30}})\\s*と\\s*([^\\s、。！？?]{{1,30}}?)\\s*(?:を|の)?(?:違い|差|比較|違う点)' as pair
       from t1),
t3 as (select *, case when regexp_matches(lower(q), 'こんにちは|こんばんは|おはよう|お疲れ|はじめまして|やあ|hello|hi') then 'greeting'
         when regexp_matches(q, pair) then 'comparison' when focus <> '' then 'definition' else 'general' end as intent from t2),
t4 as (select *, case intent when 'comparison' then [regexp_extract(q, pair, 1), regexp_extract(q, pair, 2)] when 'definition' then [focus] else [] end as slots from t3),
t5 as (select *, list_filter(slots, lambda s: contains(lower(answer), lower(s))) as held,
         array_to_string(list_transform(slots, lambda s: s || case when contains(lower(answer), lower(s)) then ':lexical' else ':miss' end), ', ') as evidence,
         {KEY.format('focus')} as kf from t4),
t6 as (select *, case
    when len(missing) > 0 then 'unknown entity missing: ' || array_to_string(missing, ', ')
    when intent = 'greeting' then case when {_any('lower(answer)', consistency.GREETING_TERMS)} then 'greeting matched' else 'greeting intent mismatch' end
    when len(slots) = 0 then 'no required slots'
    when intent = 'definition' and {_SURFACE.format('ka')} = {_SURFACE.format('kf')} then 'definition answer is only an echo'
    when intent = 'definition' and (({_any('ka', gates.VACUOUS)} and not {_any('ka', gates.INFORMATIVE)}) or length(regexp_replace(replace(ka, kf, ''), '{gates.PARTICLES}', '', 'g')) < 2)
      then 'definition answer is uninformative'
    when intent = 'definition' and len(held) = len(slots) then 'definition slot covered'
    when len(held) = len(slots) and regexp_matches(answer, '{consistency.COMPARISON_CUES}') then 'comparison slots covered'
    when len(held) = len(slots) then 'concept-aware slots: ' || evidence else 'concept slot missing: ' || evidence end as reason from t5),
t7 as (select *, case when len(missing) > 0 then 0.0 when intent = 'greeting' then (reason = 'greeting matched')::int::double when len(slots) = 0 then 1.0 else len(held)::double / len(slots) end as coverage,
         case when len(missing) > 0 then 0.0 else {_sim('gq', 'ga')} end as current_sim,
         reason in ('no required slots', 'definition slot covered', 'comparison slots covered') or starts_with(reason, 'concept-aware') as still from t6),
h as (select n.conv_id, n.place, {_sim('o.gq', 'n.ga')} as to_answer, {_sim('o.gq', 'n.gq')} as to_question
      from t7 n join t2 o on n.conv_id = o.conv_id and o.place between n.place - 3 and n.place - 1 where n.still),
b as (select conv_id, place, max(to_answer) as previous, max(to_answer) filter (where to_question < 0.82) as suspect from h group by conv_id, place)
"""


@query(
    f"""with {PAIRS}, {CHECKED},
e as (select t7.*, previous, coalesce(suspect > current_sim + 0.05, false) as stained from t7 left join b using (conv_id, place))
select conv_id, turn, (still or reason = 'greeting matched') and not stained as ok, case when stained then 'history contamination' else reason end as reason, intent,
  array_to_string(slots, ',') as slots, round(coverage, 9) as coverage, round(current_sim, 9) as current_sim, round(coalesce(previous, -1.0), 9) as previous_best from e"""
)
def conv_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and first reason of every answered turn."""
    rows = consistency.consistency_gate(asked(spark, sf_dir))
    return rows.withColumn("slots", F.array_join("slots", ",")).withColumns({c: F.round(c, 9) for c in ("coverage", "current_sim", "previous_best")})
