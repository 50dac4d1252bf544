"""Training data by concept over the documents, and golden cases of rules and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, text
from ..operators import curate, knowledge
from . import golden as cases
from .documents import SENTENCES, doc_rows, read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def golden(columns: str, rows: list[tuple]):
    def keep(f):
        cases.golden(columns, rows)(f)
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = cases.QUERIES[f.__name__], cases.ORACLE_SQL[f.__name__]
        return f

    return keep


#: The concepts: words of seven letters or more that begin a sentence of the benchmark.
CONCEPTS = (
    SENTENCES
    + r""",
b0 as (select list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。！？!?.])', '\1' || chr(10), 'g'), '[\r\n]+'),
         lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: length(x) > 0) as l from benchmark),
n as (select distinct regexp_extract(x, '^([\p{L}]{7,24})[ ,]', 1) as concept from (select unnest(l) as x from b0) where regexp_matches(x, '^[\p{L}]{7,24}[ ,]'))
"""
)


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.exploded_sentences(read(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.select(F.regexp_extract("sentence", r"^([\p{L}]{7,24})[ ,]", 1).alias("concept")).where("concept <> ''").distinct()


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_rows(spark, sf_dir).select(F.struct("doc_id", "pos").alias("ord"), "sentence")


@query(
    f"""with {CONCEPTS},
f as (select concept, sentence, row_number() over (partition by concept order by doc_id, pos) as rank,
        (length(sentence) - length(replace(sentence, concept, ''))) // length(concept) as k from s join n on contains(sentence, concept)),
c as (select concept, sum(k)::bigint as n_exact, count(*) as n_units, string_agg(sentence, ' | ' order by rank) filter (where rank <= 3) as contexts from f group by concept)
select concept, coalesce(n_exact, 0)::bigint as n_exact, coalesce(n_units, 0)::bigint as n_units, coalesce(n_exact, 0) >= 2 as known, coalesce(contexts, '') as contexts
from n left join c using (concept)"""
)
def doc_concept_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and where the documents hold the concepts."""
    found = knowledge.concept_contexts(ordered(spark, sf_dir), concepts(spark, sf_dir))
    return found.withColumn("contexts", F.array_join("contexts", " | "))


#: Statements as the operators clean them; the data are Latin, so only the length, 。 and question marks score.
STATEMENTS = r"""
k0 as (select doc_id, pos, regexp_replace(regexp_replace(trim(regexp_replace(sentence, '[\s\p{Z}]+', ' ', 'g')), '^[・＊*#>\-\s]+', ''), '^ +| +$', '', 'g') as statement from s),
k1 as (select statement, min((doc_id, pos)) as ord from k0 group by statement),
"""


@query(
    f"""with {CONCEPTS}, {STATEMENTS}
u as (select concept, statement, ord, -abs(length(statement) - 55) as fit,
        (case when contains(statement, '。') then 1 else 0 end) - 3 * (case when contains(statement, '?') then 1 else 0 end) - 3 * (case when contains(statement, '？') then 1 else 0 end) as score
      from k1 join n on contains(statement, concept)
      where length(statement) between 12 and 120 and not regexp_matches(statement, '[！？!?]\\s*$') and not contains(statement, 'RT ') and not contains(statement, 'http://')
        and not contains(statement, 'https://') and (length(statement) - length(replace(statement, concept, ''))) // length(concept) <= 4),
r as (select *, row_number() over (partition by concept order by score desc, fit desc, length(statement), ord) as rank from u)
select concept, concept || tail as "user", statement as assistant, rank::int as source_rank, form::int as form
from r, (values (0, 'とは'), (1, 'について教えて'), (2, 'を説明して')) as t(form, tail) where rank <= 12"""
)
def doc_knowledge_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best statements of each concept under three questions."""
    return knowledge.many_answers(ordered(spark, sf_dir), concepts(spark, sf_dir))


CORPUS = ["CPUは命令を実行する装置である", "・CPUは命令を実行する装置であると言う", "CPUも熱を持つと多分思う", "CPUとは計算を進める装置のことである", "GPUは速いですか？", "CPUは命令を実行する装置である"]


@golden(
    "concept, user, assistant",
    [("CPU", "CPU" + tail, "CPUとは計算を進める装置のことである。CPUは命令を実行する装置であると言う。CPUも熱を持つと多分思う。") for tail in ("とは", "について教えて", "を説明して", "って何")],
)
def golden_one_answer(spark: SparkSession) -> DataFrame:
    """Definitions first, of near repeats the one that fits better, nothing of a concept that is only asked for."""
    rows = spark.createDataFrame(list(enumerate(CORPUS)), "ord int, sentence string")
    names = spark.createDataFrame([("CPU",), ("GPU",)], "concept string")
    return knowledge.one_answer(rows, names).select("concept", "user", "assistant")


@golden("id, usable, present, entities", [(0, True, True, []), (1, False, False, ["Rx-7", "GPT4"]), (2, False, False, ["PyTorch"]), (3, False, True, [])])
def golden_statement_rules(spark: SparkSession) -> DataFrame:
    """F4, F5, E15."""
    rows = spark.createDataFrame([(0, "CPUは中央処理装置である"), (1, "Rx-7 と GPT4 と Rx-7 の話"), (2, "PyTorchとGPUは速い！"), (3, "CPU CPU CPU CPU CPU")], "id int, a string")
    cpu = F.lit("CPU")
    return rows.select("id", gates.usable_statement(cpu, F.col("a"), 8, 40).alias("usable"), gates.slot_present(cpu, F.col("a")).alias("present"), gates.suspicious_entities(F.col("a")).alias("entities"))


TAUGHT = [
    ("AIとは", "人工知能です"),
    ("CPUとは", "CPUは命令を実行する装置です"),
    ("CPUとは", "CPUは同じものです"),
    ("GPUとは", "GPUは画像を描くための言語モデルの並列装置です"),
    ("GPUとは", "GPUは画像を描くための部品です"),
    ("本は好きですか", "はい"),
]


@golden(
    "id, ok, reason",
    [
        (0, False, "definition teaching answer is only an echo; teach category/function/property, not only a synonym"),
        (1, True, "teaching answer accepted"),
        (2, False, "definition teaching answer is uninformative; include category, function, or distinguishing property"),
        (3, False, "answer concept conflict for GPU: 言語モデル"),
        (4, True, "teaching answer accepted"),
        (5, True, "teaching answer accepted"),
    ],
)
def golden_teaching(spark: SparkSession) -> DataFrame:
    """F7, F9, E27."""
    rows = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(TAUGHT)], "id int, q string, a string")
    return rows.select("id", gates.teaching_answer(F.col("q"), F.col("a")).alias("r")).select("id", "r.ok", "r.reason")


@golden("id, hint", [(0, "GPUは多数の演算を並列に処理するプロセッサです。"), (1, "重力について、分類・機能・特徴のいずれかを含む説明を教えてください。"), (2, "Provide a concrete, correct answer with the key concept and function.")])
def golden_hints(spark: SparkSession) -> DataFrame:
    """Z3."""
    rows = spark.createDataFrame([(0, "GPUとは"), (1, "重力って何"), (2, "やあ")], "id int, q string")
    return rows.select("id", gates.teaching_hint(F.col("q")).alias("hint"))


@golden(
    "id, ok, reason, n",
    [
        (0, True, "validated semantic proposition", 2),
        (1, False, "statement subject does not match promotion concept: GPU", 0),
        (2, False, "statement must use semantic proposition form: XはYである", 0),
        (3, False, "concept must be non-empty", 0),
    ],
)
def golden_promotion(spark: SparkSession) -> DataFrame:
    """F8."""
    rows = [(0, "CPU", "CPUは装置であり、部品である。"), (1, "CPU", "GPUは装置である"), (2, "CPU", "CPUが速い"), (3, " 。", "CPUは装置である")]
    df = spark.createDataFrame(rows, "id int, c string, s string").select("id", knowledge.promotion(F.col("c"), F.col("s")).alias("r"))
    return df.select("id", "r.ok", "r.reason", F.size("r.values").alias("n"))


@golden("subject, statement, relation, object", [("CPU", "CPUは、計算する装置である。", "definition", "計算する装置である"), ("空", "空は青い", "property", "青い")])
def golden_role_memory(spark: SparkSession) -> DataFrame:
    """D10."""
    rows = [(0, "CPU", "CPUは、計算する装置である。"), (1, "空", "空は青い"), (2, "空", "空は 青い"), (3, "空", "空は青い"), (4, "海", "海は")]
    found = knowledge.role_memory(spark.createDataFrame(rows, "ord int, concept string, answer string"))
    return found.where("ord <> 2").select("subject", "statement", "relation", "object")


LOG = [(0, "CPUとは", "古い", "manual"), (1, "CPUとは", "新しい", "approved"), (2, "GPUとは", "速い", "chat-recovery"), (3, "GPUとは", "噂", "web"), (4, "AIとは", "技術", "manual"), (5, "AIとは", " ", "manual")]


@golden(
    "what, concept, answer",
    [("protected", "cpu", "新しい"), ("expected", "CPUとは", "新しい"), ("expected", "GPUとは", "速い"), ("verify", "cpu", "古い"), ("unmarked", "4", ""), ("initial", "4", "")],
)
def golden_repair_records(spark: SparkSession) -> DataFrame:
    """Of a log with trusted and other rows. CPU stays protected, GPU is excluded by its
    fingerprint, AI by its name; one of the five fingerprints is to be trained again."""
    log = spark.createDataFrame(LOG, "ord int, user string, assistant string, source string")
    marks = log.where("source <> 'web'").withColumn("fingerprint", text.pair_fingerprint(F.col("user"), F.col("assistant")))
    gone = spark.createDataFrame([("ai",)], "concept string")
    kept = knowledge.protected(log, marks, marks.where("user = 'GPUとは'"), gone).select(F.lit("protected").alias("what"), "concept", "answer")
    targets = spark.createDataFrame([("CPUとは",), ("GPUとは",)], "user string")
    expected = knowledge.expected_answers(log, targets).select(F.lit("expected").alias("what"), F.col("user").alias("concept"), "answer")
    records = marks.select("ord", F.lit("CPU").alias("concept"), F.col("assistant").alias("answer"), "fingerprint")
    tasks = marks.where("ord in (0, 1)").select(F.lit("cpu").alias("concept"), "fingerprint", F.when(F.col("ord") == 0, "retrain").otherwise("verified").alias("status"))
    verify = knowledge.under_verification(records, tasks).select(F.lit("verify").alias("what"), "concept", "answer")
    count = lambda name, df: df.agg(F.count("*").cast("string").alias("concept")).select(F.lit(name).alias("what"), "concept", F.lit("").alias("answer"))
    left = knowledge.unmarked(marks.select("fingerprint"), log.where("ord = 1"))
    return kept.union(expected).union(verify).union(count("unmarked", left)).union(count("initial", knowledge.initial_state(log, "baseline")))


@golden("ord", [(2,)])
def golden_best_candidate(spark: SparkSession) -> DataFrame:
    """Strict runs first, then fidelity, then the smaller weight; a run without scores never."""
    columns = "ord int, strict boolean, total double, learned double, baseline double, unknown double, stability double, manual double, rate double"
    rows = [(0, False, 9.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1), (1, True, 5.0, 1.0, 1.0, 1.0, 1.0, 3.0, 0.1), (2, True, 5.0, 1.0, 1.0, 1.0, 1.0, 2.0, 0.1), (3, True, None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.1)]
    return knowledge.best_candidate(spark.createDataFrame(rows, columns)).select("ord")
