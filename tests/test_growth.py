"""Work that must not be repeated or spread over every piece of a text: literal results and plans."""

import random
import time

from pyspark.sql import functions as F

from conftest import SF
from lorespark.functions import grammar, text
from lorespark.operators import audit, curate, knowledge, metrics, promotion
from lorespark.plans import records, store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_concepts_in_texts_without_their_pieces(spark):
    rows = spark.createDataFrame([(1, "alphabeta alpha"), (2, "gamma"), (3, None), (4, "")], "ord int, t string")
    names = spark.createDataFrame([("alpha",), ("beta",), ("phab",), ("",), (None,), ("alpha",)], "c string")
    want = [(1, "alpha"), (1, "beta"), (1, "phab")]
    for small in (100, 0):  # an automaton; too many concepts for one
        found = knowledge.containing(rows, "t", names, "c", small)
        assert sorted((r.ord, r.c) for r in found.collect()) == want
    assert "explode" not in plan(knowledge.containing(rows, "t", names, "c"))


def test_statements_are_first_of_those_with_a_concept(spark):
    rows = spark.createDataFrame([(2, "the alpha"), (1, "the  alpha"), (3, "nothing"), (4, "alpha beta")], "ord int, sentence string")
    names = spark.createDataFrame([("alpha",), ("beta",)], "concept string")
    found = knowledge._statements(rows, names)
    assert sorted((r.ord, r.statement, r.concept) for r in found.collect()) == [(1, "the alpha", "alpha"), (4, "alpha beta", "alpha"), (4, "alpha beta", "beta")]
    text = plan(found)
    assert text.index("Aggregate") < text.index("MapInArrow")  # what holds no concept is not shuffled


def test_grammar_of_parts_is_not_pushed_to_their_scan(spark):
    assert "regexp" not in plan(records.part_conditions(spark, SF))


def test_cues_in_long_questions(spark):
    rows = spark.createDataFrame([("x " * 9 + "の\n特徴は",), ("何が 得\t意",), ("AとB の関係",), ("Aと は",), ("none",), (None,)], "q string")
    found = rows.select(grammar.asked_predicate_type(F.col("q")).alias("x"))
    assert [r.x for r in found.collect()] == ["property", "capability", "relation", "definition", None, None]
    assert "RLIKE" not in plan(found)


def test_slots_of_long_evidence(spark):
    rows = spark.createDataFrame([("word " * 200_000,)], "e string")
    slots = rows.select(grammar.function_slots(F.col("e")).alias("s")).select("s.*")
    start = time.time()
    assert tuple(slots.first()) == ("function", "unspecified", "unspecified")
    assert time.time() - start < 5


def test_malformed_sorts_only_what_repeats(spark):
    long = [("".join(chr(97 + i * i % 23 + j % 3) for i in range(3000)),) for j in range(300)]
    rows = spark.createDataFrame([*long, ("ab" * 20,), ("aaaaabcde",), ("",)], "t string").repartition(1)
    start = time.time()
    assert rows.where(grammar.malformed(F.col("t"))).count() == 3
    assert time.time() - start < 8


def test_required_terms_once(spark):
    rows = spark.createDataFrame([("CPUは命令を処理する装置です", "CPU"), ("plain text", "plain")], "a string, c string")
    got = rows.select(grammar.required_terms(F.col("a"), F.col("c")).alias("t"), grammar.required_coverage(F.lit("命令と装置"), F.col("a"), F.col("c")).alias("s")).collect()
    assert [r.t for r in got] == [["命令", "処理", "装置"], ["text"]]
    assert [round(r.s, 9) for r in got] == [0.666666667, 0.0]
    size = len(plan(rows.select(grammar.required_coverage(F.col("a"), F.col("a"), F.col("c")))))
    assert size < 6000


def test_prefix_dedup_joins_by_order_not_by_heads(spark):
    rows = spark.createDataFrame([("k", 1, "abcdefghij"), ("k", 2, "abcdefghik"), ("k", 3, "xbcdefghij"), ("l", 1, "abcdefghij"), ("k", 4, "short"), ("k", 5, "short"), ("k", 6, "abcdefghij")], "k string, ord int, t string")
    found = curate.greedy_prefix_dedup(rows, "k", "ord", "t")
    assert sorted((r.k, r.ord) for r in found.collect()) == [("k", 1), ("k", 3), ("k", 4), ("l", 1)]
    assert "_head" not in plan(found)


def test_events_are_parsed_once(spark, monkeypatch):
    plans = []
    apply = promotion.apply_changes
    monkeypatch.setattr(promotion, "apply_changes", lambda s, b, changes, *a: (plans.append(plan(changes)), apply(s, b, changes, *a)))
    store.event_fact_store(spark, SF).count()
    assert len(plans) == 4 and not any("get_json_object" in p for p in plans)


def test_ngrams_of_short_and_long_texts(spark):
    rows = spark.createDataFrame([("",), ("a",), ("ab",), ("abab",), ("𠮷野家",), (None,)], "t string")
    got = [r.g for r in rows.select(metrics.char_ngrams(F.col("t"), 2).alias("g")).collect()]
    assert got == [[], ["a"], ["ab"], ["ab", "ba"], ["𠮷野", "野家"], []]


def test_promotion_reads_requests_in_one_pass(spark):
    """Ends are stripped without patterns, which try every place; NFKC, the one Python step, runs once."""
    said = ["\u3000 CPU。は、、\u00a0装置であり、速い である！ ", "A\nBは速いである", "ＣＰＵは演算である。", "は速いである", "CPUは速い", "", None]
    rows = spark.createDataFrame([(i, " CPU。", s) for i, s in enumerate(said)], "ord long, concept string, statement string")
    got = rows.select("ord", knowledge.promotion(F.col("concept"), F.col("statement")).alias("p")).orderBy("ord").select("p.*").collect()
    form = "statement must use semantic proposition form: XはYである"
    other = "statement subject does not match promotion concept: A\nB"
    ok = "validated semantic proposition"
    assert [(r.reason, r["values"]) for r in got] == [(ok, ["装置", "速い"]), (other, []), (ok, ["演算"]), *[(form, [])] * 4]
    stripped = plan(rows.select(text.fragment(F.col("concept")), text.plain_surface(F.col("statement"))))
    assert "regexp" not in stripped
    spaces = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("x"))
    assert {r.id for r in spaces.where(F.col("x").rlike(text.SPACE)).collect()} == {ord(c) for c in text.SPACES}
    pending = spark.createDataFrame([("CPU",)], "concept string")
    passes = []
    keep = promotion.materialize
    promotion.materialize = lambda df, name: (passes.append(df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")), keep(df, name))[1]
    try:
        found = promotion.judged(rows, pending).orderBy("ord").collect()
    finally:
        promotion.materialize = keep
    assert passes == [1]
    assert [r.taught for r in found] == [True] + [False] * 6


def test_best_rows_of_blocks(spark, monkeypatch):
    """A block returns one other row a row, and is read once; both ways to find pairs give the same best rows."""
    rng = random.Random(4)
    texts = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 60))) for _ in range(300)} | {"?", "", "abc", "abc."})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "id long, q string")
    got = {}
    for by_prefix in (True, False):
        monkeypatch.setattr(audit, "selective", lambda *_: by_prefix)  # noqa: B023
        got[by_prefix] = sorted(map(tuple, audit.best_similar(rows, "id", "q", 0.3).collect()))
    assert got[True] == got[False] and len(got[True]) > 250
    assert plan(audit.best_similar(rows, "id", "q", 0.3)).count("InArrow") == 1
    forms = rows.where(F.col("id") < len(texts))
    assert audit.best_others(forms, "id", "q", 0.3).count() <= 2 * len(texts) < audit.similar_pairs(forms, "id", "q", 0.3).count()


def test_best_rows_are_tied_to_twelve_places(spark, monkeypatch):
    """0.7 + 20 / 200 is less than 0.6 + 40 / 200 only by a rounding error."""
    rows = spark.createDataFrame([(0, "abcdefghijk"), (1, "abcdefgh".ljust(20)), (2, "efghijk".ljust(40))], "id long, q string")
    for by_prefix in (True, False):
        monkeypatch.setattr(audit, "selective", lambda *_: by_prefix)  # noqa: B023
        found = {r.id: (r.other, round(r.score, 9)) for r in audit.best_similar(rows, "id", "q", 0.5).collect()}
        assert found == {0: (1, 0.7), 1: (0, 0.7), 2: (0, 0.6)}


def test_deltas_apart_are_read_without_a_merge(spark, tmp_path):
    """Results of batches have other keys each: no shuffle; where keys may meet, the newest row wins."""
    tables = promotion.open_store(spark, str(tmp_path / "store"))
    rows = lambda at, why: spark.range(*at).select(F.col("id").alias("ord"), *[F.lit(None).alias(c) for c in ("concept", "statement", "promoted", "n")], F.lit(why).alias("reason"))
    for why, at in {"a": (0, 5), "none": (0, 0), "b": (5, 9)}.items():
        stage = tables.begin(why)
        stage.put("results", rows(at, why))
        stage.commit()
    found = tables.read("results")
    assert "Aggregate" not in plan(found) and sorted((r.ord, r.reason) for r in found.collect()) == [(i, "a" if i < 5 else "b") for i in range(9)]
    stage = tables.begin("c")
    stage.put("results", rows((4, 6), "c"), rows((8, 9), "c"))
    stage.commit()
    assert sorted((r.ord, r.reason) for r in tables.read("results").collect()) == [*[(i, "a") for i in range(4)], (4, "c"), (5, "c"), (6, "b"), (7, "b")]
    assert len(tables.read("results", 3).collect()) == 9


def test_promotion_joins_only_valid_requests(spark, monkeypatch, tmp_path):
    """Faulty requests, of which one concept may have most, are not shuffled to the queue; queued names meet Python once."""
    passes = {}
    keep = promotion.materialize
    monkeypatch.setattr(promotion, "materialize", lambda df, name: (passes.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    tables = promotion.open_store(spark, str(tmp_path / "store"))
    promotion.enqueue(tables, "queue", spark.createDataFrame([("CPU。",), (" ",), ("two words",), ("CPU",)], "concept string"))
    said = [("", "は、速いである。"), ("CPU", "CPUは速い"), ("CPU", "CPUは、速いである。"), ("CPU", "CPUは、重いである。"), ("GPU", "GPUは、速いである。"), ("two words", "two wordsは、速いである。"), (None, None)]
    promotion.promote(tables, "p", spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "ord long, concept string, statement string"))
    assert [(r.ord, r.concept, r.status) for r in tables.read("queue").select(F.lit(0).alias("ord"), "concept", "status").orderBy("concept").collect()] == [(0, "CPU", "promoted"), (0, "two words", "pending")]
    form = "statement must use semantic proposition form: XはYである"
    want = [(False, "concept must be non-empty", 0), (False, form, 0), (True, promotion.PROMOTED, 1), (False, promotion.NO_REQUEST, 0), (False, promotion.NO_REQUEST, 0), (False, promotion.NOT_ROUTED, 1), (False, form, 0)]
    assert [(r.promoted, r.reason, r.n) for r in tables.read("results").orderBy("ord").collect()] == want
    assert passes["queue-names"].count("ArrowEvalPython") == passes["read-requests"].count("ArrowEvalPython") == 1
    assert "Filter" not in passes["queue-names"]
    judged = passes["judged-requests"]
    assert "Python" not in judged and "isnull(fault" in judged  # only rows without fault are joined


def test_compiled_propositions_are_the_same(spark):
    said = ["Aは、xであり、yである。", "Aはx であり ，, y\u3000であり、x である", "Aはであり、である", "はxである", "AはBはcである", "Aはx", "Aである", "", None, "A\nは\n、x\nyである！", "Aは、、である"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    want = [(r.i, r.p and r.p.subject, r.p and r.p["values"]) for r in rows.select("i", grammar.decomposed(F.col("t")).alias("p")).orderBy("i").collect()]
    found = grammar.with_decomposed(rows, "t")
    assert [(r.i, r.subject, r["values"]) for r in found.orderBy("i").collect()] == want
    assert [w[1:] for w in want[:5]] == [("A", ["x", "y"]), ("A", ["x", "y"]), ("A", []), (None, None), ("A", ["Bはc"])]
    assert "lambda" not in plan(found.select("subject")) and "RLIKE" not in plan(rows.select(grammar.predicate_type_of(F.col("t"))))
    kinds = {"演算装 置。": "definition", "装置\u0085": "definition", "装置だ": "property", "鳥の一種だ": "definition", "計算ができる": "capability", "GPUを利用する装置": "relation", "": "property"}
    values = spark.createDataFrame([(v,) for v in kinds], "v string")
    assert {r.v: r.k for r in values.select("v", grammar.predicate_type_of(F.col("v")).alias("k")).collect()} == kinds
