"""Small rules, prompts and runs of gates: literal cases."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import grammar, propositions
from lorespark.operators import metrics, runs, stores
from lorespark.plans.catalogue import QUERIES
from lorespark.sources import jsonl


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_queue_concept(spark):
    asked = ["CPUとは。", " GPUって何", "量子について教えて", "LLMを説明して", "LLMを簡単に説明して", "猫は", "メモリ", "two words", "x" * 40, "x" * 41, "", "なぜ？", "CPUとはGPUとは"]
    want = ["CPU", "GPU", "量子", "LLM", "LLM", "猫", "メモリ", "", "x" * 40, "", "", "", "CPUとはGPU"]
    got = column(spark, asked, grammar.queue_concept)
    assert got == want


def test_pair_copies(spark):
    rows = [("あなたは誰ですか", "", "identity", 9), ("読書は楽しい", "はい", "persona", 1), ("元気", "私は長門有希", "persona", 1), ("GPUって何", "", "paraphrase", 4), ("GPUの話", "", "knowledge", 3), ("天気", "", "other", 1)]
    df = spark.createDataFrame([(i, u, a) for i, (u, a, *_) in enumerate(rows)], "i int, u string, a string")
    weights = {"identity": 9, "persona": 0, "paraphrase": 4, "knowledge": 3}
    got = df.select("i", grammar.pair_class(F.col("u"), F.col("a")).alias("c"), grammar.pair_copies(F.col("u"), F.col("a"), weights).alias("n")).orderBy("i").collect()
    assert [(r.c, r.n) for r in got] == [(c, n) for *_, c, n in rows]


def test_upsert_truth(spark):
    store = spark.createDataFrame([("CPU", "TRUE", 0), ("猫", "FALSE", 1), ("cpu", "OUTDATED", 2)], "concept string, truth string, ord int")
    new = spark.createDataFrame([("Cpu", "CONTESTED", 0), ("犬", "TRUE", 1)], "concept string, truth string, ord int")
    got = [tuple(r) for r in stores.upsert_truth(store, new).orderBy("ord").collect()]
    assert got == [("Cpu", "CONTESTED", 0), ("猫", "FALSE", 1), ("犬", "TRUE", 4)]


def test_agreement_threshold(spark):
    rows = [("definition", True, 1.0, 0.3), ("comparison", True, 1.0, 0.3), ("general", True, 1.0, 0.6), ("definition", False, 1.0, 0.6), ("definition", True, 0.5, 0.6)]
    df = spark.createDataFrame(rows, "intent string, ok boolean, coverage double, want double")
    found = df.withColumn("x", runs.agreement_threshold(F.col("intent"), F.col("ok"), F.col("coverage"), 0.6)).collect()
    assert all(r.x == r.want for r in found)
    assert df.limit(1).select(runs.agreement_threshold(F.col("intent"), F.col("ok"), F.col("coverage"), 0.2).alias("x")).first().x == 0.2


def test_prompts(spark):
    slots = F.struct(F.lit("execute").alias("action"), F.lit("命令").alias("target"), F.lit("計算の").alias("purpose"))
    row = spark.range(1).select(
        propositions.concept_prompts(F.lit("CPU"), F.lit("definition")).alias("c"),
        propositions.role_prompts(F.lit("CPU"), F.lit("function")).alias("r"),
        propositions.evidence_queries(F.lit(" CPU ")).alias("e"),
        propositions.function_prompts(F.lit("CPU"), slots).alias("f"),
        propositions.inference_prompts(F.lit("CPU")).alias("i"),
        propositions.compose_prompt(F.lit("CPU"), F.lit("証拠  文"), slots).alias("p"),
    ).first()
    assert row.c[0].startswith("概念: CPU\n関係: definition\n要求: ") and row.c[1] == "主語=CPU / 関係=definition\nこの関係に対応する説明を回答してください"
    assert row.r[1] == "subject=CPU relation=function -> ?" and row.r[0].startswith("主語: CPU\n意味役割: function\n要求: ")
    assert row.e == ["CPUとは", "CPUは何をするものですか", "CPUの役割は何ですか"]
    assert row.f[1] == "subject=CPU function.action=execute function.target=命令 function.purpose=計算の -> ?"
    assert row.i[1] == "subject=CPU relation=function function.action=? function.target=? function.purpose=? -> ?"
    assert "根拠: 証拠 文\n要求: " in row.p


def test_corpus_falls_back(spark, tmp_path):
    (tmp_path / "b.txt").write_text("一\n二\n", encoding="utf-8")
    assert [r.line for r in jsonl.read_corpus(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("ord").collect()] == ["一", "二"]
    with pytest.raises(FileNotFoundError):
        jsonl.read_corpus(spark, str(tmp_path / "a.txt"))


def test_gate_runs(spark):
    rows = [("CPU", "CPUは命令を実行する装置である", "CPUは命令を実行する装置である", 1.0), ("CPU", "CPUは命令を実行する", "CPUは命令を実行しない", 0.9), ("CPU", "CPUは命令を実行する", "夢", 0.1), ("CPU", "ああああああああああ", "ああああああああああ", 1.0)]
    found = runs.probe_verdicts(spark.createDataFrame(rows, "concept string, teacher string, generated string, semantic double")).collect()
    by = {(r.teacher, r.generated): (r.passed, r.reason) for r in found}
    assert by[rows[0][1], rows[0][2]] == (True, "composite teacher fidelity passed")
    assert by[rows[1][1], rows[1][2]][1].endswith("contradiction detected")
    assert by[rows[2][1], rows[2][2]][1].startswith("composite teacher fidelity: semantic 0.100 < 0.800; lexical 0.000 < 0.350")
    assert by[rows[3][1], rows[3][2]] == (False, "malformed/repetitive output")
    verdicts = spark.createDataFrame([(True,), (False,)], "passed boolean")
    assert runs.gate_summary(verdicts).first().asDict() == {"targets": 2, "passed": 1, "failed": 1, "ok": False}
    empty = verdicts.where("false")
    assert not runs.gate_summary(empty).first().ok and runs.gate_summary(empty, needs_probes=False).first().ok


def test_two_pass(spark):
    subjects = spark.createDataFrame([("CPU",), ("猫",), ("無",)], "subject string")
    memory = spark.createDataFrame([("CPU", "CPUは、計算のために命令を実行する装置である")], "subject string, evidence string")
    said = [("CPU", 0, "CPUは速い"), ("CPU", 1, "CPUは、計算のために命令を実行する装置である"), ("CPU", 2, "あああああああああ"), ("猫", 0, "猫は鳴く"), ("無", 0, " ")]
    composed = spark.createDataFrame([("猫", "猫は鳴く動物"), ("CPU", "ああああああああああ")], "subject string, generated string")
    got = {r.subject: r for r in runs.two_pass_functions(subjects, memory, spark.createDataFrame(said, "subject string, ord int, generated string"), composed).collect()}
    assert got["CPU"].evidence == "CPUは、計算のために命令を実行する装置である / CPUは速い" and got["CPU"].memory_hit and got["CPU"].used_fallback
    assert got["CPU"].answer.startswith("CPUの機能は、action=execute、target=命令")
    assert (got["猫"].answer, got["猫"].used_fallback, got["猫"].memory_hit) == ("猫は鳴く動物", False, False)
    assert (got["無"].evidence, got["無"].answer, got["無"].items) == (None, None, 0)


def test_figures_of_failures_are_rounded_by_their_binary_values(spark):
    values = [0.3125, 0.0625, 0.2125, 0.0005, 0.0015, 0.2135, 17 / 80, 0.0, 0.34999, -0.0625, *[(2 * i + 1) / 2000 for i in range(300)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    said = metrics.fidelity_failures(F.lit(1.0), F.col("v"), F.lit(1.0), F.lit(False), (0.8, 0.35, 0.5))
    got = [r.s for r in df.select("i", said.alias("s")).orderBy("i").collect()]
    assert got == [f"composite teacher fidelity: lexical {v:.3f} < 0.350" for v in values]


def test_routes_of_words_whose_upper_case_does_not_come_back(spark, tmp_path):
    rows = [(1, 0, "user", "straße"), (1, 1, "assistant", "ja"), (11, 0, "user", "Straße"), (11, 1, "assistant", "nein"), (21, 0, "user", "wagen"), (21, 1, "assistant", "ja")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.ord, r.status) for r in QUERIES["conv_routes"](spark, str(tmp_path)).collect())
    assert got == [(1001, "resolved")]


def test_grammars_run_once_a_surface_and_match_once(spark, tmp_path):
    """Parts whose surfaces repeat; the plan deals distinct surfaces before the grammar."""
    rows = [(6 * i + 1, i % 2, "Brand#2", "SMALL TIN") for i in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["part_condition_facts"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("Brand-2", "夜間", "SMALL TINである", 50)]
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    asked = spark.createDataFrame([("猫は、動物である。",)], "t string")
    plan = asked.select(grammar.decomposed(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.*?)は") == 2  # two patterns, each once
