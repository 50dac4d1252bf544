"""Queries over statements that the tables give: words, names and numbers are put into the Japanese frames that the
grammars read, so that these run over data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge, resolve
from .documents import GREEDY, SENTENCES, doc_rows, read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


#: Frames of a subject (the first word of a sentence) and the rest of it, dealt by doc_id + pos.
FRAMES = (("", "は、", "。"), ("", "の定義は、", ""), ("雨の場合、", "は", ""), ("", "も", ""), ("観測上、", "は", ""), ("", "とは", "ではない"), ("", "は", "と観測される"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, sentence: sentences of the documents that begin with a word of seven letters or more, framed."""
    rows = doc_rows(spark, sf_dir).withColumn("subject", F.regexp_extract("sentence", r"^([\p{L}]{7,20}) ", 1)).where("subject <> ''")
    rest = F.substr("sentence", F.length("subject") + 2)
    frames = F.array(*[F.concat(F.lit(a), "subject", F.lit(b), rest, F.lit(c)) for a, b, c in FRAMES])
    return rows.select(F.struct("doc_id", "pos").alias("ord"), F.get(frames, ((F.col("doc_id") + F.col("pos")) % len(FRAMES)).cast("int")).alias("sentence"))


_FRAMED = " ".join(f"when {i} then '{a}' || subject || '{b}' || rest || '{c}'" for i, (a, b, c) in enumerate(FRAMES))
STATED = (
    SENTENCES
    + rf""",
w as (select doc_id, pos, regexp_extract(sentence, '^([\p{{L}}]{{7,20}}) ', 1) as subject, sentence from s),
st as (select doc_id, pos, subject, (doc_id + pos) % {len(FRAMES)} as frame, substr(sentence, length(subject) + 2) as rest from w where subject <> ''),
framed as (select doc_id, pos, subject, frame, case frame {_FRAMED} end as sentence from st)
"""
)

def _after(tail: str) -> str:
    return f"(case when starts_with(b, concept || '{tail}') then substr(b, length(concept) + {len(tail) + 1}) else '' end)"


def _tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^、', ''), '^[ 。]+|[ 。]+$', '', 'g')"


#: The concepts that begin a statement: the first form that matches decides, and what it takes must be plausible.
_FORMS = ", ".join(f"nullif(regexp_extract(statement, '^([^、。！？!?]{{2,24}}){tail}', 1), '')" for tail in ("は", "も", "とは", "の定義は"))
DISCOVERED = f"""
lines as (select {{'doc_id': doc_id, 'pos': pos}} as ord, regexp_replace(trim(regexp_replace(sentence, '[\\s\\p{{Z}}]+', ' ', 'g')), '^[・＊*#>\\-\\s]+', '') as statement from framed),
lead as (select regexp_replace(trim(coalesce({_FORMS})), '(?:も|が|を|に|で)$', '') as concept from lines),
con as (select concept, count(*) as n from lead where length(concept) between 2 and 24 and not regexp_matches(concept, '[\\s、。！？!?：:；;,]')
        group by concept having count(*) >= 2 order by n desc, concept limit 200)"""
_LOOSE = "{'p': 'related_statement', 'o': regexp_replace(b, '。+$', '')}"
PROPOSED = f"""
clean as (select statement, min(ord) as ord from lines group by 1),
hold as (select concept, statement, ord, starts_with(statement, '雨の場合、') as given,
           case when starts_with(statement, '雨の場合、') then substr(statement, 6) else statement end as b
         from clean join con on contains(statement, concept) where length(statement) <= 180),
prop as (
  select concept, statement, ord, b, case when given then '雨の場合' else '' end as condition, case when contains(b, '観測上') then '観測上' else '' end as context,
         not contains(b, 'ではない') as polarity,
         case when {_after('は')} <> '' then {{'p': case when contains({_after('は')}, '観測') then 'observed_as' else 'is' end, 'o': {_tidy(_after('は'))}}}
              when {_after('も')} <> '' then {_LOOSE}
              when {_after('の定義は')} <> '' then {{'p': 'definition', 'o': {_tidy(_after('の定義は'))}}}
              when {_after('とは')} <> '' then {{'p': case when contains({_after('とは')}, '観測') then 'observed_as' else 'is' end, 'o': {_tidy(_after('とは'))}}}
              when contains(b, concept) then {_LOOSE} end as p
  from hold),
scored as (
  select concept, statement, ord, condition, context, polarity, p.p as predicate, p.o as object,
         {{'a': -((case p.p when 'definition' then 12 when 'related_statement' then 2 else 8 end) + (case when condition <> '' then 2 else 0 end)
                + (case when context <> '' then 1 else 0 end) + (case when polarity then 0 else 1 end)),
          'b': abs(length(p.o) - 55), 'c': length(p.o), 'd': ord}} as place
  from prop where p is not null and p.o <> ''),
{GREEDY.format(n="p", rows="(select {'c': concept, 'y': polarity} as k, regexp_replace(object, '[、。\\s]', '', 'g') as text, place from scored)")},
chosen as (
  select * from (select scored.*, row_number() over (partition by concept order by scored.place) as rank
                 from scored join keptp on keptp.k.c = concept and keptp.place = scored.place) where rank <= 8)"""


@query(f"with {STATED}, {DISCOVERED} select concept, n from con")
def stated_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that begin two statements or more, the 200 most frequent ones."""
    return knowledge.discovered_concepts(stated(spark, sf_dir))


@query(f"with {STATED}, {DISCOVERED}, {PROPOSED} select concept, rank::int as rank, statement as source, predicate, object, condition, context, polarity from chosen")
def stated_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best propositions of every discovered concept."""
    rows = stated(spark, sf_dir)
    return knowledge.merged_propositions(rows, knowledge.discovered_concepts(rows)).drop("ord")


_CLAUSE = """case when predicate = 'definition' then concept || 'の定義は、' || o when predicate = 'related_statement' and starts_with(o, concept) then o else concept || 'は、' || o end"""


@query(
    f"""with {STATED}, {DISCOVERED}, {PROPOSED},
said as (select *, regexp_replace(trim(object), '。+$', '') as o from chosen),
c0 as (select *, {_CLAUSE} as c from said),
c1 as (select * exclude (c), case when condition <> '' and not starts_with(c, condition) then condition || '、' || c else c end as c from c0),
c2 as (select * exclude (c), regexp_replace(case when context <> '' and not contains(c, context) then context || 'では、' || c else c end, '。+$', '') || '。' as c from c1),
c3 as (select concept, rank, c, sum(length(c)) over (partition by concept order by rank) as used from c2 where rank <= 6),
ans as (select concept, string_agg(case when rank = 1 then c else 'また、' || case when starts_with(c, concept || 'は、') then substr(c, length(concept) + 3) else c end end, '' order by rank) as assistant
        from c3 where rank = 1 or used <= 280 group by concept),
num as (select concept, count(*) as n from chosen group by concept)
select concept, concept || tail as "user", assistant, form::int as form, n
from ans join num using (concept), (values (0, 'とは'), (1, 'について教えて'), (2, 'を説明して'), (3, 'って何')) as t(form, tail)"""
)
def stated_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 end to end: discovered concepts, their propositions without near repeats, one answer of six clauses at most."""
    rows = stated(spark, sf_dir)
    return knowledge.semantic_merge(knowledge.merged_propositions(rows, knowledge.discovered_concepts(rows)))


_VALUE = "case p_partkey % 3 when 0 then p_brand when 1 then concat(p_type, 'を処理できる') else concat(p_brand, '装置') end"
_ENDS = ("の特徴は", "は何ができる", "の定義は", "")
_KINDS = ("property", "capability", "definition")


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, value, ord: parts by their names and by the last words of these, three kinds of facts."""
    part = read(spark, sf_dir, "part")
    subjects = F.explode(F.array(F.col("p_name"), F.substring_index("p_name", " ", -1))).alias("subject")
    return part.select(subjects, F.expr(_VALUE).alias("value"), F.col("p_partkey").alias("ord"))


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: whole texts of documents, each followed by a question about the part that its id names."""
    docs, part = read(spark, sf_dir, "documents"), read(spark, sf_dir, "part")
    n = part.agg(F.greatest(F.count("*"), F.lit(1))).first()[0]
    named = docs.select("doc_id", "text", (F.col("doc_id") % n).alias("p_partkey")).join(part.select("p_partkey", "p_name"), "p_partkey")
    ends = F.array(*map(F.lit, _ENDS))
    question = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit("。"), "p_name", F.get(ends, (F.col("doc_id") % 4).cast("int")))
    return named.select(F.col("doc_id").alias("qid"), question.alias("question"))


PART_FACTS = f"""
pf as (select unnest([p_name, string_split(p_name, ' ')[-1]]) as subject, {_VALUE} as value, p_partkey as ord, {list(_KINDS)}[case p_partkey % 3 when 0 then 1 when 1 then 2 else 3 end] as kind from part),
pq as (select doc_id as qid, regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g') || '。' || p_name || {list(_ENDS)}[doc_id % 4 + 1] as question, {list(_KINDS) + [None]}[doc_id % 4 + 1] as kind
       from documents join part on p_partkey = doc_id % (select count(*) from part))
""".replace("None", "null")


@query(
    f"""with {PART_FACTS},
names as (select distinct subject from pf),
held as (select qid, max({{'n': length(subject), 's': subject}}).s as subject from pq join names on contains(question, subject) where kind is not null group by qid),
vals as (select subject, kind, value, min(ord) as ord from pf group by all),
ans as (select subject, kind, subject || 'は、' || string_agg(value, 'であり、' order by ord, value) || 'である。' as answer from vals group by subject, kind)
select qid, pq.kind as typed_predicate, held.subject as typed_subject, ans.answer as typed_answer from pq left join held using (qid) left join ans on ans.subject = held.subject and ans.kind = pq.kind"""
)
def part_typed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest part name that each text holds, and its facts of the kind asked for."""
    return resolve.typed_lookup(part_questions(spark, sf_dir), part_facts(spark, sf_dir)).drop("question")
