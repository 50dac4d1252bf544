"""The consistency gate: verdicts by reading its rules, and the history of one long conversation against a plain loop."""

import random

from pyspark.sql import functions as F

from lorespark.operators import consistency

CASES = [
    ("LLMとは", "LLMです。", False, "definition answer is only an echo", 1.0),
    ("AIとは", "人工知能です", False, "definition answer is only an echo", 1.0),
    ("GPUとは", "GPUは画像処理装置です。", True, "definition slot covered", 1.0),
    ("GPUとは", "GPUは同じものです。", False, "definition answer is uninformative", 1.0),
    ("量子力学とは", "微視的な世界の理論です。", True, "concept-aware slots: 量子力学:category(理論)", 1.0),
    ("時間とは", "流れて戻らないものの名前", False, "concept slot missing: 時間:miss", 0.0),
    ("CPUとGPUの違い", "CPUは汎用でGPUは並列が得意", True, "comparison slots covered", 1.0),
    ("CPUとGPUの違い", "CPUとGPUがあります", True, "concept-aware slots: CPU:lexical, GPU:lexical", 1.0),
    ("CPUとGPUの違い", "CPUは速い", False, "concept slot missing: CPU:lexical, GPU:miss", 0.5),
    ("こんにちは", "はい、何について話しましょうか", True, "greeting matched", 1.0),
    ("こんにちは", "装置です", False, "greeting intent mismatch", 0.0),
    ("RTX-9000はいつ出る", "来年です", False, "unknown entity missing: RTX-9000", 0.0),
    ("RTX-9000とGen7とRTX-9000", "gen7です", False, "unknown entity missing: RTX-9000", 0.0),
    ("今日の天気", None, True, "no required slots", 1.0),
    (None, None, True, "no required slots", 1.0),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, 0, q, a) for i, (q, a, *_) in enumerate(CASES)], "conv_id int, turn int, question string, answer string")
    got = [(r.ok, r.reason, r.coverage) for r in consistency.consistency_gate(rows).orderBy("conv_id").collect()]
    assert got == [(ok, reason, c) for _, _, ok, reason, c in CASES]
    assert consistency.consistency_gate(rows.where("false")).collect() == []


def grams(t):
    t = "".join(t.split()).lower()
    return {t[i : i + 2] for i in range(max(len(t) - 1, 1))} if t else set()


def similar(a, b):
    x, y = grams(a), grams(b)
    return 1.0 if not x and not y else 0.0 if not x or not y else len(x & y) / len(x | y)


def test_history_of_a_long_conversation(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("かきくけこさしすせそ") for _ in range(4))
    rows, asked = [], []
    for turn in range(600):
        question = rng.choice(asked[-3:]) if asked and rng.random() < 0.1 else " ".join(word() for _ in range(3))
        answer = rng.choice(asked[-5:]) if asked and rng.random() < 0.4 else rng.choice([question, word()])
        asked.append(question)
        rows.append((1, turn * 2, question, answer))
    df = spark.createDataFrame(rows + [(2, 0, "かき", "くけ")], "conv_id int, turn int, question string, answer string").repartition(5)
    got = {r.turn: r for r in consistency.consistency_gate(df).where("conv_id = 1").collect()}
    stained = 0
    for i, (_, turn, question, answer) in enumerate(rows):
        now = similar(question, answer)
        old = [(similar(o, answer), similar(o, question)) for o in asked[max(0, i - 3) : i]]
        bad = max([s for s, q in old if q < 0.82], default=-1.0) > now + 0.05
        stained += bad
        r = got[turn]
        assert (r.ok, r.reason) == (not bad, "history contamination" if bad else "no required slots")
        assert abs(r.previous_best - max([s for s, _ in old], default=-1.0)) < 1e-12 and abs(r.current_sim - now) < 1e-12
    assert 50 < stained < 500


def test_another_similarity(spark):
    rows = spark.createDataFrame([(1, 0, "あ", "い"), (1, 1, "う", "い")], "conv_id int, turn int, question string, answer string")
    by_letter = lambda a, b: F.when((a == "あ") & (b == "い"), 0.9).otherwise(0.1)
    got = consistency.consistency_gate(rows, similarity=by_letter).orderBy("turn").collect()
    assert [r.reason for r in got] == ["no required slots", "history contamination"]


def test_a_comparison_without_second_word(spark):
    rows = [(0, 0, "thededとの違い", "thededはより速い"), (1, 0, "thededとの違い", "thededのより速い"), (2, 0, "thededとcpuのの違い", "thededはcpuより速い")]
    got = consistency.consistency_gate(spark.createDataFrame(rows, "conv_id int, turn int, question string, answer string")).orderBy("conv_id").collect()
    assert [(r.slots, r.coverage) for r in got] == [(["theded", "の"], 0.5), (["theded", "の"], 1.0), (["theded", "cpu"], 1.0)]
    assert got[0].reason == "concept slot missing: theded:lexical, の:miss"
