"""Golden cases: literal inputs through the operators; the SQL lists the rows that must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, propositions, text
from ..operators import curate, lifecycle, memory, metrics, resolve, stores

QUERIES, ORACLE_SQL = {}, {}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]" if value else "[]::varchar[]"
    if isinstance(value, float):
        return f"{value}::double"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def golden(columns: str, rows: list[tuple]):
    """Register a query by its name, and the rows it must return."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
        ORACLE_SQL[f.__name__] = f"select * from (values {body}) as t({columns})"
        return f

    return keep


def _texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    """id, input and its surface form."""
    return spark.createDataFrame(list(enumerate(rows)), "id int, input string").withColumn("surface", text.surface(F.col("input")))


MODIFIERS = [
    ("高温のCPUは停止する", "CPUは、高温の場合、停止する", True),
    ("低温のCPUは正常に動作する", "CPUは、低温の場合、正常に動作する", True),
    ("高負荷のGPUは温度が上がる", "GPUは、高負荷の場合、温度が上がる", True),
    ("夜間の道路は暗い", "道路は、夜間の場合、暗い", True),
    ("雨の日の道路は滑る", "道路は、雨の日の場合、滑る", True),
    ("空腹の猫は鳴く", "猫は、空腹の場合、鳴く", True),
    ("実行時のCPUは命令を処理する", "CPUは、実行時の場合、命令を処理する", True),
    ("赤い車は速い", "赤い車は速い", False),
    ("日本の首都は東京である", "日本の首都は東京である", False),
    ("文学の分類は複雑である", "文学の分類は複雑である", False),
    ("CPUは、高温の場合、停止する", "CPUは、高温の場合、停止する", False),
]


@golden("id, normalized, transformed", [(i, b, c) for i, (_, b, c) in enumerate(MODIFIERS)])
def golden_modifier_rewrite(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, [a for a, _, _ in MODIFIERS]).withColumn("r", grammar.rewritten(F.col("surface")))
    return rows.select("id", "r.normalized", "r.transformed")


CONDITIONAL = [
    ("高温の場合CPUはどうなる？", "CPU", "高温"),
    ("CPUが高温のときは？", "CPU", "高温"),
    ("CPUは高温の場合どうなる？", "CPU", "高温"),
    ("低温時のCPUは？", "CPU", "低温"),
    ("赤い車は速い？", None, None),
    ("日本の首都は？", None, None),
    ("CPUとは？", None, None),
]


@golden("id, subject, condition", [(i, b, c) for i, (_, b, c) in enumerate(CONDITIONAL)])
def golden_conditional_parse(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, [a for a, _, _ in CONDITIONAL]).withColumn("q", grammar.conditional_query(F.col("surface")))
    return rows.select("id", "q.subject", "q.condition")


@golden(
    "id, subject, condition, predicate",
    [(0, "CPU", "高温", "停止する"), (1, "CPU", "低温", "正常に動作する"), (2, "CPU", "高温", "停止する"), (3, None, None, None)],
)
def golden_conditional_statement(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["高温のCPUは停止する", "低温のCPUは正常に動作する", "CPUは、高温の場合、停止する。", "日本の首都は東京である"])
    return rows.withColumn("s", grammar.conditional_statement(F.col("surface"))).select("id", "s.subject", "s.condition", "s.predicate")


@golden("qid, question, answer", [(0, "CPUが高温のときは？", "CPUは、高温の場合、停止する。"), (1, "低温時のCPUは？", "CPUは、低温の場合、正常に動作する。"), (2, "日本の首都は？", "")])
def golden_conditional_answer(spark: SparkSession) -> DataFrame:
    facts = spark.createDataFrame(
        [("CPU", "高温", "停止する", True, 0), ("CPU", "低温", "正常に動作する", True, 1), ("CPU", "高温", "起動する", False, 2)],
        "subject string, condition string, predicate string, condition_polarity boolean, ord int",
    )
    asked = spark.createDataFrame([(0, "CPUが高温のときは？"), (1, "低温時のCPUは？"), (2, "日本の首都は？")], "qid int, question string")
    return resolve.answer_conditional(asked, facts)


@golden(
    "id, output",
    [
        (0, "/typedsubject GPU"),
        (1, "CPUは、高温の場合、どうなる"),
        (2, "CPUは、高温の場合、どうなる"),
        (3, "CPUは、低温の場合、どうなる"),
        (4, "CPUは、高温の場合、停止する"),
        (5, "赤い車は速い"),
    ],
)
def golden_runtime_normalize(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["/typedsubject GPU", "高温の場合CPUはどうなる？", "CPUが高温のときは？", "低温時のCPUは？", "高温のCPUは停止する", "赤い車は速い"])
    return rows.select("id", grammar.runtime_input(F.col("surface"), F.col("input")).alias("output"))


STATEMENTS = ["GPUは、高速であり、並列処理が得意である。", "CPUは処理装置である", "猫は、生物であり、生物であり、動物である。", "赤い車は速い", "犬はである", "AはBであり、 Cである"]


@golden(
    "id, subject, value, pos",
    [
        (0, "GPU", "高速", 0),
        (0, "GPU", "並列処理が得意", 1),
        (1, "CPU", "処理装置", 0),
        (2, "猫", "生物", 0),
        (2, "猫", "動物", 1),
        (5, "A", "B", 0),
        (5, "A", "C", 1),
    ],
)
def golden_decompose(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, STATEMENTS).withColumn("d", grammar.decomposed(F.col("input")))
    return rows.select("id", "d.subject", F.posexplode("d.values").alias("pos", "value")).select("id", "subject", "value", "pos")


PROPOSITIONS = [("GPU", "高速", 0), ("GPU", "並列処理が得意", 1), ("CPU", "処理装置", 2), ("GPU", "高速", 3), ("GPU", "CUDAを利用可能", 4)]


def _propositions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROPOSITIONS, "subject string, value string, ord int")


@golden("subject, statement", [("GPU", "GPUは、高速であり、並列処理が得意であり、CUDAを利用可能である。"), ("CPU", "CPUは、処理装置である。")])
def golden_compose(spark: SparkSession) -> DataFrame:
    rows = stores.grouped_values(_propositions(spark), "subject", "value")
    return rows.select("subject", grammar.composed(F.col("subject"), F.col("values")).alias("statement"))


TYPED = [("高速", "property"), ("並列処理が得意", "capability"), ("処理装置", "definition"), ("CUDAを利用可能", "relation"), ("命令を実行できる", "capability"), ("哺乳類の一種", "definition"), ("GPUに依存する技術", "relation")]


@golden("value, predicate_type", TYPED)
def golden_typed_classify(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v, _ in TYPED], "value string")
    return rows.select("value", grammar.predicate_type_of(F.col("value")).alias("predicate_type"))


@golden(
    "qid, typed_subject, typed_predicate, typed_answer",
    [
        (0, "GPU", "property", "GPUは、高速である。"),
        (1, "GPU", "capability", "GPUは、並列処理が得意である。"),
        (2, "GPU", "relation", "GPUは、CUDAを利用可能である。"),
        (3, "CPU", "definition", "CPUは、処理装置である。"),
        (4, None, "definition", None),
        (5, None, None, None),
    ],
)
def golden_typed_lookup(spark: SparkSession) -> DataFrame:
    asked = ["GPUの性質は", "GPUは何が得意", "GPUは何を利用する", "CPUとは", "宇宙とは", "こんにちは"]
    rows = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    return resolve.typed_lookup(rows, _propositions(spark)).select("qid", "typed_subject", "typed_predicate", "typed_answer")


CASCADE = ["GPUの性質は", "CPUとは", "宇宙とは", "量子センサーとは", "旧理論とは", "電子とは", "未知語とは", "こんにちは", "GPUとは"]


def _stores(spark: SparkSession) -> list[DataFrame]:
    known = spark.createDataFrame([("GPU", "高速", 0), ("GPU", "並列処理が得意", 1)], "subject string, value string, ord int")
    canonical = spark.createDataFrame([("cpu", "CPUは中央処理装置である。")], "concept string, answer string")
    unified = spark.createDataFrame([("宇宙", "宇宙は広い。", 0), ("宇宙", "二番目。", 1)], "concept string, assistant string, ord int")
    learned = spark.createDataFrame([("量子センサー", True), ("旧理論", False)], "concept string, bound boolean")
    counts = spark.createDataFrame([("電子", 2), ("未知語", 1)], "concept string, n long")
    return [known, canonical, unified, learned, counts]


def _states(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(CASCADE)), "qid int, question string")
    return resolve.resolve_states(asked, *_stores(spark))


@golden(
    "qid, state, focus, answer, predicate_type",
    [
        (0, "TYPED", "GPU", "GPUは、高速である。", "property"),
        (1, "CANONICAL", "CPU", "CPUは中央処理装置である。", ""),
        (2, "UNIFIED", "宇宙", "宇宙は広い。", ""),
        (3, "INTERNALIZED", "量子センサー", "", ""),
        (4, "INTERNALIZED_STALE", "旧理論", "", ""),
        (5, "RAW_CORPUS_ONLY", "電子", "", ""),
        (6, "UNKNOWN", "未知語", "", ""),
        (7, "NON_CONCEPT", "", "", ""),
        (8, "TYPED", "GPU", "GPUは、高速であり、並列処理が得意である。", "property,capability"),
    ],
)
def golden_state_cascade(spark: SparkSession) -> DataFrame:
    return _states(spark).drop("question")


@golden(
    "qid, action, route",
    [
        (0, "RETRIEVE", "typed semantic retrieval"),
        (1, "RETRIEVE", "canonical definition retrieval"),
        (2, "RETRIEVE", "unified semantic retrieval"),
        (3, "GENERATE", "internalized model generation"),
        (4, "BLOCK", "internalized checkpoint stale"),
        (5, "BLOCK", "raw corpus review"),
        (6, "BLOCK", "unknown knowledge"),
        (7, "GENERATE", "normal model generation"),
        (8, "RETRIEVE", "typed semantic retrieval"),
    ],
)
def golden_dispatch(spark: SparkSession) -> DataFrame:
    return resolve.dispatch(_states(spark)).select("qid", "action", "route")


def _truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("GPU", "TRUE", "", ""), ("Cpu", "FALSE", "誤り", "CPUは演算装置である。"), ("宇宙", "OUTDATED", "", ""), ("量子センサー", "CONTESTED", "異論あり", "")],
        "concept string, truth string, reason string, correction string",
    )


@golden(
    "qid, truth, action, route, answer, runtime_status, warning",
    [
        (0, "TRUE", "RETRIEVE", "typed semantic retrieval", "GPUは、高速である。", "PASS", ""),
        (1, "FALSE", "RETRIEVE", "truth-state correction", "CPUは演算装置である。", "CORRECTED", "original knowledge is false; stored correction applied"),
        (2, "OUTDATED", "BLOCK", "truth-state block", "", "BLOCK", "knowledge is outdated"),
        (3, "CONTESTED", "GENERATE", "internalized model generation", "", "WARN", "knowledge is contested: 異論あり"),
        (6, "UNVERIFIED", "BLOCK", "unknown knowledge", "", "WARN", "knowledge is unverified"),
    ],
)
def golden_truth_policy(spark: SparkSession) -> DataFrame:
    rows = resolve.dispatch(_states(spark)).where(F.col("qid").isin(0, 1, 2, 3, 6))
    return resolve.apply_truth(rows, _truth(spark)).select("qid", "truth", "action", "route", "answer", "runtime_status", "warning")


BARE = ["GPU", " cpu ", "宇宙", "量子センサー", "電子", "未知語", "Hello", "長門", "未知語とは", "電子とは", "C", "GPU、CPU", "旧理論"]


@golden(
    "qid, question, bare_blocked, state, focus, action, route, answer, truth, runtime_status",
    [
        (0, "GPUとは", False, "TYPED", "GPU", "RETRIEVE", "typed semantic retrieval", "GPUは、高速であり、並列処理が得意である。", "TRUE", "PASS"),
        (1, "cpuとは", False, "CANONICAL", "cpu", "RETRIEVE", "truth-state correction", "CPUは演算装置である。", "FALSE", "CORRECTED"),
        (2, "宇宙とは", False, "UNIFIED", "宇宙", "BLOCK", "truth-state block", "", "OUTDATED", "BLOCK"),
        (3, "量子センサーとは", False, "INTERNALIZED", "量子センサー", "GENERATE", "internalized model generation", "", "CONTESTED", "WARN"),
        (4, "電子", True, "UNKNOWN", "電子", "BLOCK", "unknown knowledge", "", None, None),
        (5, "未知語", True, "UNKNOWN", "未知語", "BLOCK", "unknown knowledge", "", None, None),
        (6, "Hello", False, "NON_CONCEPT", "", "GENERATE", "normal model generation", "", None, None),
        (7, "長門", False, "NON_CONCEPT", "", "GENERATE", "normal model generation", "", None, None),
        (8, "未知語とは", False, "UNKNOWN", "未知語", "BLOCK", "unknown knowledge", "", None, None),
        (9, "電子とは", False, "RAW_CORPUS_ONLY", "電子", "BLOCK", "raw corpus review", "", "UNVERIFIED", "WARN"),
        (10, "C", False, "NON_CONCEPT", "", "GENERATE", "normal model generation", "", None, None),
        (11, "GPU、CPU", False, "NON_CONCEPT", "", "GENERATE", "normal model generation", "", None, None),
        (12, "旧理論とは", False, "INTERNALIZED_STALE", "旧理論", "BLOCK", "internalized checkpoint stale", "", "UNVERIFIED", "WARN"),
    ],
)
def golden_facade(spark: SparkSession) -> DataFrame:
    """R4."""
    asked = spark.createDataFrame(list(enumerate(BARE)), "qid int, question string")
    return resolve.facade(asked, *_stores(spark), _truth(spark)).drop("predicate_type", "warning")


@golden(
    "id, start, x, y",
    [(0, 0, "0 1 2", "1 2 3"), (0, 2, "2 3 4", "3 4 5"), (0, 3, "3 4 5", "4 5 6"), (1, 0, "0 1 2", "1 2 3")],
)
def golden_token_windows(spark: SparkSession) -> DataFrame:
    """Seven, four and three tokens in blocks of three by two; the last start is added, too few tokens have none."""
    rows = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate((7, 4, 3))], "id int, tokens array<int>")
    found = rows.select("id", F.explode(curate.token_windows(F.col("tokens"), 3, 2)).alias("w")).select("id", "w.*")
    return found.select("id", "start", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@golden(
    "state, priority, compact",
    [("TYPED", 10, "source=s, origin=o, priority=10"), ("NON_CONCEPT", 70, "source=s, origin=-, priority=70"), ("OTHER", 999, "source=-, origin=o, priority=999")],
)
def golden_provenance(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("TYPED", "s", "o"), ("NON_CONCEPT", "s", ""), ("OTHER", "", "o")], "state string, source string, origin string")
    rows = rows.withColumn("p", resolve.provenance(F.col("state"), F.col("source"), F.col("origin")))
    return rows.select("state", "p.priority", "p.compact")


QUEUE = [("A", "promote"), ("B", "verify"), ("A", "verify"), ("C", "promote"), ("A", "revoke"), ("C", "verify"), ("B", "promote"), ("D", "none")]


@golden("concept, status, n_changes", [("A", "promoted", 3), ("B", "promoted", 1), ("C", "verified", 2), ("D", "pending", 0)])
def golden_queue_lifecycle(spark: SparkSession) -> DataFrame:
    log = spark.createDataFrame([(c, a, i) for i, (c, a) in enumerate(QUEUE)], "concept string, action string, ord int")
    return lifecycle.fold_states(log, "concept", "action", lifecycle.QUEUE_MOVES, "pending")


TASKS = [("A", "fail"), ("A", "retrain"), ("A", "fail"), ("A", "retrain"), ("A", "verify"), ("B", "fail"), ("B", "verify"), ("B", "fail"), ("C", "retrain"), ("C", "fail")]


@golden("concept, status, attempts", [("A", "verified", 2), ("B", "pending", 2), ("C", "failed", 1)])
def golden_verification_fold(spark: SparkSession) -> DataFrame:
    log = spark.createDataFrame([(c, a, i) for i, (c, a) in enumerate(TASKS)], "concept string, action string, ord int")
    return lifecycle.verification_tasks(log)


@golden("subject, condition, predicate, ord", [("GPU", "高負荷", "温度が上がる", 1), ("道路", "夜間", "暗い", 4)])
def golden_candidate_lifecycle(spark: SparkSession) -> DataFrame:
    heard = ["高温のCPUは停止する", "高負荷のGPUは温度が上がる", "CPUが高温のときは？", "高負荷のGPUは温度が上がる", "夜間の道路は暗い", "空腹の猫は鳴く"]
    rows = _texts(spark, heard).withColumn("s", grammar.conditional_statement(F.col("surface"))).where("s is not null")
    new = rows.select("s.*", F.col("id").alias("ord"), "surface")
    stored = spark.createDataFrame([("CPU", "高温", "停止する")], "subject string, condition string, predicate string")
    pending = spark.createDataFrame([("猫", "空腹", "鳴く")], "subject string, condition string, predicate string")
    is_question = grammar.conditional_query(F.col("surface")).isNotNull()
    return lifecycle.queue_candidates(new, stored, pending, ["subject", "condition", "predicate"], is_question).drop("surface")


@golden("id, action, target, purpose, informative", [(0, "execute", "命令", "計算の", 3), (1, "process", "情報", "information_processing", 3), (2, "function", "unspecified", "unspecified", 0)])
def golden_function_slots(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["CPUは、計算のために命令を実行する装置である", "脳は情報を処理する", "空は青い"])
    rows = rows.withColumn("f", grammar.function_slots(F.col("input")))
    return rows.select("id", "f.*", grammar.informative_slots(F.col("f")).alias("informative"))


ROLES = [("CPUはGPUより遅い", "comparison"), ("命令を実行するために使われる", "function"), ("熱が原因で止まる", "cause"), ("計算機である", "definition"), ("速い", "property")]


@golden("input, role", ROLES)
def golden_role_classify(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a,) for a, _ in ROLES], "input string")
    return rows.select("input", grammar.role_of(F.col("input")).alias("role"))


@golden("concept, n", [("時間と", 2), ("時間の定義", 1)])
def golden_discover_concepts(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["時間とは、流れである", "時間とは何か", "時間の定義は曖昧である", "猫もは鳴く", "猫は鳴く", "これは本である", "静かだ"])
    found = rows.select(grammar.leading_concept(F.col("input")).alias("concept")).where("concept is not null")
    return found.groupBy("concept").agg(F.count("*").alias("n"))


FOCUS = [("CPUとは", "CPU"), ("宇宙って何", "宇宙"), ("猫について教えて", "猫"), ("重力を説明して", "重力"), ("重力を簡単に説明して", "重力を簡単に"), ("GPUは", "GPU"), ("こんにちは", ""), ("hello", ""), ("今日は良い天気", "")]


@golden("question, focus", [(a, "重力" if a == "重力を簡単に説明して" else b) for a, b in FOCUS if a != "重力を簡単に説明して"])
def golden_query_focus(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a,) for a, _ in FOCUS if a != "重力を簡単に説明して"], "question string")
    return rows.select("question", grammar.query_focus(F.col("question")).alias("focus"))


QUALITY = [("", "empty input"), ("とは？", "missing query subject"), ("CPUとはとは", "malformed repeated intent"), ("CPU猫", "malformed technical-term suffix"), ("CPU GPU とは", "incoherent multi-concept input"), ("CPU GPU とはの違い", None), ("CPUx1", "malformed short technical query"), ("CPU", None), ("CPUとは", None), ("猫は好き", None)]


@golden("input, fault", QUALITY)
def golden_input_quality(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a,) for a, _ in QUALITY], "input string")
    return rows.select("input", grammar.input_fault(F.col("input")).alias("fault"))


@golden("input, intent, slots", [("こんにちは", "greeting", ""), ("CPUとGPUの違い", "comparison", "CPU|GPU"), ("宇宙とは？", "definition", "宇宙"), ("今日は晴れ", "general", "")])
def golden_intent_slots(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(a,) for a in ("こんにちは", "CPUとGPUの違い", "宇宙とは？", "今日は晴れ")], "input string")
    rows = rows.withColumn("i", grammar.intent(F.col("input")))
    return rows.select("input", "i.intent", F.array_join("i.slots", "|").alias("slots"))


RESOLUTIONS = [
    (True, "", "", "ACCEPT", "none"),
    (False, "empty input", "", "INPUT_REJECT", "ask/rephrase"),
    (False, "unknown entity missing: X1", "X1とは", "UNKNOWN_KNOWLEDGE", "retrieve/teach"),
    (False, "concept slot missing", "CPUとは", "LEARNING_GAP", "teach/train"),
    (False, "low token confidence", "宇宙とは", "UNKNOWN_KNOWLEDGE", "retrieve/teach"),
    (False, "low token confidence", "CPUとは", "GATE_REVIEW", "review/gate"),
]


@golden("id, resolution, action", [(i, r[3], r[4]) for i, r in enumerate(RESOLUTIONS)])
def golden_resolution(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(RESOLUTIONS)], "id int, accepted boolean, reason string, question string")
    rows = rows.withColumn("r", grammar.resolution(F.col("accepted"), F.col("reason"), F.col("question")))
    return rows.select("id", "r.resolution", "r.action")


@golden("id, terms", [(0, "命令|実行|装置"), (1, "流れ"), (2, "")])
def golden_required_terms(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "CPUは、命令を実行する装置である", "CPU"), (1, "時間とは流れである", "時間"), (2, "", "")], "id int, answer string, concept string")
    return rows.select("id", F.array_join(grammar.required_terms(F.col("answer"), F.col("concept")), "|").alias("terms"))


@golden("id, malformed", [(0, True), (1, True), (2, True), (3, False), (4, False), (5, True)])
def golden_malformed(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["", "壊れ�", "ああああああああああ", "CPUは中央処理装置である", "短い", "abababababab"])
    return rows.select("id", grammar.malformed(F.col("input")).alias("malformed"))


@golden("id, key, bucket", [(0, "静かな時間は", 173), (1, "cpuとは", None)])
def golden_prompt_key(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["静かな 時間は？", "CPUとは。"])
    bucket = F.when(F.col("id") == 0, text.hash_bucket(F.lit("行列計算")))
    return rows.select("id", text.prompt_key(F.col("input")).alias("key"), bucket.alias("bucket"))


@golden("concept, assistant, ord", [("A", "new a", 0), ("B", "b", 1), ("C", "new c", 4)])
def golden_upsert(spark: SparkSession) -> DataFrame:
    schema = "concept string, assistant string, ord int"
    store = spark.createDataFrame([("A", "a", 0), ("B", "b", 1), ("A", "again", 2)], schema)
    new = spark.createDataFrame([("A", "older", 0), ("C", "new c", 2), ("A", "new a", 1)], schema)
    return stores.upsert(store, new, "concept").withColumn("ord", F.when(F.col("concept") == "C", 4).otherwise(F.col("ord")))


@golden("concept, assistant, ord", [("A", "a", 0), ("B", "b", 1), ("C", "c", 9)])
def golden_insert_absent(spark: SparkSession) -> DataFrame:
    schema = "concept string, assistant string, ord int"
    store = spark.createDataFrame([("A", "a", 0), ("B", "b", 1)], schema)
    return stores.insert_absent(store, spark.createDataFrame([("A", "other", 8), ("C", "c", 9)], schema), "concept")


@golden("fingerprint, membership", [("f1", "historical"), ("f2", "pending"), ("f3", "pending")])
def golden_membership(spark: SparkSession) -> DataFrame:
    make = lambda *x: spark.createDataFrame([(v,) for v in x], "fingerprint string")
    return stores.membership(make("f1", "f2", "f3"), make("f1", "f2"), make("f1", "f3"))


@golden("concept, status", [("A", "verified"), ("A", "verified"), ("B", "pending"), ("C", "promoted")])
def golden_legacy_status(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("A", "verified"), ("A", "resolved"), ("B", "resolved"), ("C", "promoted")], "concept string, status string")
    return lifecycle.strongest_status(rows, "concept", "status", {"pending": 0, "promoted": 1, "verified": 2})


@golden(
    "id, verdict",
    [
        (0, "composite teacher fidelity passed"),
        (1, "composite teacher fidelity: semantic 0.500 < 0.800; contradiction detected"),
        (2, "composite teacher fidelity: lexical 0.100 < 0.300; required 0.250 < 0.500"),
    ],
)
def golden_fidelity_policy(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, 0.9, 0.5, 1.0, False), (1, 0.5, 0.5, 1.0, True), (2, 0.9, 0.1, 0.25, False)], "id int, s double, l double, r double, c boolean")
    verdict = metrics.fidelity_failures(F.col("s"), F.col("l"), F.col("r"), F.col("c"), (0.8, 0.3, 0.5))
    return rows.select("id", verdict.alias("verdict"))


ANSWERS = [("命令を実行する装置", 0.9), ("命令を実行しない", 0.3), ("空", 0.0), ("CPUは命令を実行する装置である", 1.0)]


@golden(
    "id, lexical, required, contradiction, score",
    [(0, round(8 / 15, 6), 1.0, False, round((0.9 + 8 / 15 + 1) / 3, 6)), (1, round(4 / 15, 6), round(2 / 3, 6), True, round((0.3 + 4 / 15 + 2 / 3) / 3, 6)), (2, 0.0, 0.0, False, 0.0), (3, 1.0, 1.0, False, 1.0)],
)
def golden_composite_fidelity(spark: SparkSession) -> DataFrame:
    """M7, with M2, M4 and E22 of the texts."""
    rows = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(ANSWERS)], "id int, answer string, semantic double")
    found = metrics.composite_fidelity(F.col("semantic"), F.col("answer"), F.lit("CPUは命令を実行する装置である"), F.lit("CPU"))
    rows = rows.select("id", found.alias("f"))
    return rows.select("id", *[F.round(f"f.{c}", 6).alias(c) for c in ("lexical", "required")], "f.contradiction", F.round("f.score", 6).alias("score"))


ASKED = ["CPUとは", "電子とは", "電子", "未知語とは", "未知語", "あなたとは", "本は好きですか", "cpu", "希少を説明して"]


@golden(
    "qid, focus, unknown",
    [(0, "CPU", False), (1, "電子", False), (2, "電子", True), (3, "未知語", True), (4, "未知語", True), (5, "あなた", False), (6, "", False), (7, "cpu", False), (8, "希少", True)],
)
def golden_unknown_gate(spark: SparkSession) -> DataFrame:
    """R11."""
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid int, question string")
    counts = spark.createDataFrame([("電子", 2), ("希少", 1)], "concept string, n long")
    return resolve.unknown_gate(asked, spark.createDataFrame([("Cpu",)], "concept string"), counts)


GATE = [
    (True, 0.9, 0.9, 0.9, 0.9, 0.9, "malformed/repetitive output"),
    (False, 0.01, 0.9, 0.9, 0.9, 0.9, "low local token confidence"),
    (False, 0.9, 0.01, 0.9, 0.9, 0.9, "low generation margin"),
    (False, 0.9, 0.9, 0.2, 0.9, 0.9, "low token confidence"),
    (False, 0.9, 0.9, 0.9, 0.9, 0.1, "accepted"),
    (False, 0.9, 0.9, 0.9, 0.1, 0.95, "semantic probe agreement"),
    (False, 0.9, 0.9, 0.9, 0.1, 0.1, "low response agreement"),
]


@golden("id, reason", [(i, r[-1]) for i, r in enumerate(GATE)])
def golden_accept_gate(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(GATE)], "id int, m boolean, t double, g double, c double, l double, s double")
    limits = {"token": 0.05, "margin": 0.1, "confidence": 0.5, "agreement": 0.4, "semantic": 0.9}
    reason = metrics.gate_reason(*[F.col(x) for x in "mtgcls"], limits, True)
    return rows.select("id", reason.alias("reason"))


@golden("id, differs", [(0, True), (1, False)])
def golden_polarity(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "CPUは停止しない", "CPUは停止する"), (1, "不可能である", "できない")], "id int, a string, b string")
    return rows.select("id", grammar.polarity_differs(F.col("a"), F.col("b")).alias("differs"))


@golden("concept, n", [("電子", 3), ("陽子", 1)])
def golden_occurrences(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("電子",), ("陽子",)], "concept string")
    return rows.select("concept", text.occurrences(F.lit("電子と電子、陽子と電子"), F.col("concept")).alias("n"))


@golden("subject, types, capability", [("GPU", "capability|property|relation", "並列処理が得意"), ("CPU", "definition", None)])
def golden_typed_map(spark: SparkSession) -> DataFrame:
    rows = memory.typed_map(_propositions(spark))
    return rows.select("subject", F.array_join(F.map_keys("by_type"), "|").alias("types"), F.array_join(F.col("by_type")["capability"], "|").alias("capability"))


RECORDS = [("A", "q1", "f1", "manual", 0), ("B", "q2", "f2", "approved", 1), ("A", "q3", "f3", "approved", 2), ("A", "q4", "f1", "manual", 3)]


@golden(
    "concept, latest_question, latest_source, fingerprints, sources, trained_pairs",
    [("A", "q4", "manual", "f1|f3", "manual|approved", 3), ("B", "q2", "approved", "f2", "approved", 1)],
)
def golden_registry(spark: SparkSession) -> DataFrame:
    rows = memory.registry(spark.createDataFrame(RECORDS, "concept string, question string, fingerprint string, source string, ord int"))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("fingerprints", "sources")})


def _memory(spark: SparkSession) -> DataFrame:
    rows = [("CPU", "命令を実行する装置", "function", "d", 0), ("CPU", "計算機の部品", "definition", "d", 1), ("宇宙", "広い空間", "property", "e", 2), ("CPU", "命令を実行する装置", "function", "e", 3)]
    return memory.corpus_memory(spark.createDataFrame(rows, "subject string, statement string, relation string, source string, ord int"))


@golden("concept, evidence, relations, sources, dominant_relation", [("CPU", "命令を実行する装置 / 計算機の部品", "function|definition", "d|e", "function"), ("宇宙", "広い空間", "property", "e", "property")])
def golden_corpus_memory(spark: SparkSession) -> DataFrame:
    return _memory(spark).drop("fingerprint").withColumns({c: F.array_join(c, "|") for c in ("relations", "sources")})


@golden("qid, answer, relation, target", [(0, "命令を実行する装置 / 計算機の部品", "function", "命令")])
def golden_retrieval_first(spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame([(0, "CPUとは"), (1, "宇宙とは"), (2, "猫とは")], "qid int, question string")
    truth = spark.createDataFrame([("宇宙", "CONTESTED")], "concept string, truth string")
    return memory.retrieval_first(asked, _memory(spark), truth).select("qid", "answer", "relation", F.col("slots.target").alias("target"))


@golden("key, assistant, source, variants", [("時間は", "静かな時間。", "b", 2), ("cpuとは", "装置。", "a", 1)])
def golden_canonical_rows(spark: SparkSession) -> DataFrame:
    rows = [("時間は？", "流れ。", "a", 5), ("時間 は?", "別。", "b", 1), ("CPUとは", "装置。", "a", 2)]
    df = spark.createDataFrame(rows, "user string, assistant string, source string, ord int")
    return memory.canonical_rows(df, {"a": 20, "b": 60}, {"時間 は?": "静かな時間。"}).select("key", "assistant", "source", "variants")


@golden("user, status", [("CPUとは", "resolved"), ("猫とは", "pending")])
def golden_route_queue(spark: SparkSession) -> DataFrame:
    schema = "resolution string, reason string, user string, ord int"
    new = spark.createDataFrame([("UNKNOWN", "r", "CPUとは", 0), ("UNKNOWN", "r", " CPUとは ", 1), ("UNKNOWN", "r", "猫とは", 2)], schema)
    queue = memory.route_once(spark.createDataFrame([], "fingerprint string"), new)
    done = spark.createDataFrame([("UNKNOWN", "cpuとは")], "resolution string, user string")
    return memory.resolve_routes(queue, done).select("user", "status")


@golden("fingerprint, concept", [("f1", "A"), ("f3", "C")])
def golden_repair_plan(spark: SparkSession) -> DataFrame:
    rows = [("A", "q", "t", "f1", "pending", 0), ("A2", "q", "t", "f1", "retrain", 1), ("B", "", "t", "f2", "pending", 2), ("C", "q", "t", "f3", "retrain", 3), ("D", "q", "t", "f4", "verified", 4)]
    df = spark.createDataFrame(rows, "concept string, question string, teacher_answer string, fingerprint string, status string, ord int")
    return memory.repair_plan(df).select("fingerprint", "concept")


@golden("concept, types, unified, internalized, truth", [("GPU", "capability|property|relation", None, True, "TRUE"), ("宇宙", None, "広い。", False, "UNVERIFIED")])
def golden_snapshot(spark: SparkSession) -> DataFrame:
    concepts = spark.createDataFrame([("GPU",), ("宇宙",)], "concept string")
    unified = spark.createDataFrame([("宇宙", "広い。", 0), ("宇宙", "別。", 1)], "concept string, assistant string, ord int")
    learned = spark.createDataFrame([("gpu",)], "concept string")
    truth = spark.createDataFrame([("Gpu", "TRUE")], "concept string, truth string")
    rows = memory.snapshot(concepts, _propositions(spark), unified, learned, truth)
    return rows.select("concept", F.array_join(F.map_keys("by_type"), "|").alias("types"), "unified", "internalized", "truth")


@golden("run, mean_loss, accuracy, min_confidence, capped", [("a", 1.5, 0.5, 0.25, False), ("b", 30.0, 0.0, 0.125, True)])
def golden_token_scores(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("a", 1.0, 1, 0.5, 0.25), ("a", 2.0, 3, 0.25, 0.125), ("b", 30.0, 9, 0.125, 0.0)], "run string, loss double, rank int, p double, p2 double")
    found = memory.token_scores(rows, "run")
    return found.select("run", "mean_loss", "accuracy", "min_confidence", (F.col("perplexity") < F.exp("mean_loss")).alias("capped"))


@golden("source, policies", [("manual", "baseline|internalized|log|trainer"), ("chat-recovery", "internalized|log|trainer"), ("semantic-sleep", "internalized|trainer")])
def golden_trust_policies(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in ("manual", "chat-recovery", "semantic-sleep", "conditional-semantic-sleep")], "source string")
    found = None
    for name in memory.TRUST:
        part = memory.trusted(rows, name).withColumn("policy", F.lit(name))
        found = part if found is None else found.union(part)
    return found.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("policy")), "|").alias("policies"))


RICH = [
    ("時間", "観測する場合、時間は流れである。", "is", "流れである", "観測する場合", "", True),
    ("時間", "時間の定義は、変化の順序である", "definition", "変化の順序である", "", "", True),
    ("時間", "時間も空間も存在しない", "related_statement", "時間も空間も存在しない", "", "", False),
    ("宇宙", "宇宙は膨張している。", "expands", "膨張している", "", "", True),
    ("宇宙", "この世界では宇宙を観測できる。", "related_statement", "この世界では宇宙を観測できる", "", "この世界では", True),
    ("猫", "宇宙は広い", None, None, None, None, None),
]


@golden("id, predicate, object, condition, context, polarity", [(i, *r[2:]) for i, r in enumerate(RICH)])
def golden_rich_propositions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(RICH)], "id int, concept string, statement string")
    return rows.withColumn("p", propositions.rich_proposition(F.col("concept"), F.col("statement"))).select("id", "p.*")


@golden("id, sentence", [(0, "宇宙は、銀河を含む。"), (1, "高温の場合、CPUは、故障を引き起こす。"), (2, "低温でない場合、CPUは、停止として起動と関係する。")])
def golden_relation_sentences(spark: SparkSession) -> DataFrame:
    rows = [(0, "宇宙", "includes", "銀河", "", "", True), (1, "CPU", "causes", "故障", "高温", "", True), (2, "CPU", "停止", "起動", "低温", "", False)]
    df = spark.createDataFrame(rows, "id int, s string, r string, v string, c string, x string, p boolean")
    return df.select("id", propositions.relation_sentence(*[F.col(c) for c in "srvcxp"]).alias("sentence"))


@golden("id, answer", [(0, "CPUの機能は、action=execute、target=命令、purpose=computation。根拠: 命令を実行する装置"), (1, "空は青い")])
def golden_rendered_function(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "CPU", "命令を実行する装置"), (1, "空", "空は 青い".replace(" ", ""))], "id int, s string, e string")
    return rows.select("id", propositions.rendered_function(F.col("s"), F.col("e")).alias("answer"))


@golden("id, fault", [(0, "definition focus missing: GPU"), (1, None), (2, "comparison slot missing: GPU"), (3, "comparison relation missing"), (4, None)])
def golden_slot_faults(spark: SparkSession) -> DataFrame:
    rows = [(0, "definition", ["GPU"], "装置です"), (1, "definition", ["GPU"], "gpuは装置です"), (2, "comparison", ["CPU", "GPU"], "CPUは汎用"), (3, "comparison", ["CPU", "GPU"], "CPUとGPUです"), (4, "comparison", ["CPU", "GPU"], "CPUはGPUより汎用")]
    df = spark.createDataFrame(rows, "id int, i string, s array<string>, a string")
    return df.select("id", propositions.slot_fault(F.col("i"), F.col("s"), F.col("a")).alias("fault"))


@golden("id, echo", [(0, True), (1, True), (2, False)])
def golden_echo_definitions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "人工知能です。"), (1, "AIは人工知能です"), (2, "AIは計算機の技術です")], "id int, a string")
    names = F.array(F.lit("AI"), F.lit("人工知能"))
    return rows.select("id", propositions.echoes(names, F.col("a")).alias("echo"))


@golden("id, x, y, mask", [(0, "1,2,3,8", "2,3,8,9", "0.0,0.0,1.0,1.0"), (1, "1,5,0,0", "5,9,0,0", "1.0,1.0,0.0,0.0"), (2, "4,6,6,6", "6,6,6,9", "1.0,1.0,1.0,1.0")])
def golden_packed(spark: SparkSession) -> DataFrame:
    rows = [(0, [7, 1, 2, 3], [8, 9]), (1, [1], [5, 9]), (2, [3, 4], [6, 6, 6, 6, 6, 9])]
    df = spark.createDataFrame(rows, "id int, p array<int>, a array<int>").withColumn("s", propositions.packed(F.col("p"), F.col("a"), 4, 0, 9))
    return df.select("id", *[F.concat_ws(",", F.col(f"s.{c}").cast("array<string>")).alias(c) for c in ("x", "y", "mask")])


@golden("id, routed, focus, blocked, alias", [(0, "GPUとは", "GPU", False, "GPU"), (1, "未知語", "未知語", True, "未知語"), (2, "了解", "了解", False, "了解"), (3, "GPUは速い？", "", False, "GPUは速い？"), (4, "長門", "長門", True, "あなたは誰ですか")])
def golden_bare_route(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["GPU", "未知語", "了解", "GPUは速い？", "長門"])
    known, talk = F.col("input").isin("GPU"), F.col("input").isin("了解")
    return rows.select("id", grammar.bare_route(F.col("input"), known, talk).alias("r"), grammar.identity_query(F.col("input")).alias("alias")).select("id", "r.*", "alias")


@golden("id, label", [(0, "PASS"), (1, "FALSE_REJECT"), (2, "MODEL_FAIL"), (3, "PARSE_FAIL")])
def golden_rejection_label(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "計算機です", "計算機です"), (1, "未学習です", "計算機です"), (2, "未学習です", "未学習です"), (3, "", "x")], "id int, gated string, raw string")
    return rows.select("id", grammar.rejection_label(F.col("gated"), F.col("raw")).alias("label"))


@golden("id, spans, object", [(0, ["速い", "GPUは遅い", "速い一方、GPUは遅い。"], "速い一方、GPUは遅い"), (1, ["CPUは", "計算する装置である", "CPUは、計算する装置である。"], "計算する装置である"), (2, ["速い"], "速い"), (3, [], None)])
def golden_answer_spans(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["速い一方、GPUは遅い。", "CPUは、計算する装置である。", "速い", ""])
    return rows.select("id", grammar.answer_spans(F.col("input")).alias("spans"), grammar.role_object(F.lit("CPU"), F.col("input")).alias("object"))


@golden("id, share, overlap", [(0, 1.0, True), (1, 0.0, False)])
def golden_required_coverage(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "命令 実行 装置", ["CPU", "x"], ["cpu"]), (1, "空", ["a"], ["b"])], "id int, answer string, a array<string>, b array<string>")
    share = grammar.required_coverage(F.col("answer"), F.lit("CPUは命令を実行する装置である"), F.lit("CPU"))
    return rows.select("id", share.alias("share"), grammar.slots_overlap(F.col("a"), F.col("b")).alias("overlap"))


@golden("way, ord, status", [("all", 1, "approved"), ("all", 2, "approved"), ("all", 3, "approved"), ("second", 1, "approved"), ("second", 2, "pending"), ("second", 3, "approved"), ("ninth", 1, "approved"), ("ninth", 2, "pending"), ("ninth", 3, "pending")])
def golden_approve(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(1, "approved"), (2, "pending"), (3, "pending")], "ord int, status string")
    ways = [("all", None), ("second", 2), ("ninth", 9)]
    found = [lifecycle.approve(rows, "ord", "status", i).select(F.lit(name).alias("way"), "ord", "status") for name, i in ways]
    return found[0].union(found[1]).union(found[2])
