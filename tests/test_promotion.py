"""The knowledge store: batches against a full rebuild and a plain loop, failed and repeated batches, writers that meet."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import promotion
from lorespark.sources.versions import Conflict

VALUES = ["演算装置", "並列処理ができる", "熱を持つ", "命令を利用する", "速い"]


def plain_facts(changes):
    facts = {}
    for subject, value, ord_, pos, sign in sorted(changes, key=lambda c: c[2:4]):
        if sign < 0:
            facts.pop((subject, value), None)
        else:
            facts.setdefault((subject, value), (ord_, pos))
    return facts


def contents(df):
    return sorted(map(str, df.collect()))


def test_batches_equal_a_rebuild(spark, tmp_path):
    store = promotion.open_store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read("unified").collect() == []
    rng = random.Random(1)
    changes = [(f"S{rng.randrange(12)}", rng.choice(VALUES), i // 2, i % 2, rng.choice([1, 1, 1, -1])) for i in range(400)]
    schema = "subject string, value string, ord long, pos int, sign int"
    for k in range(4):
        part = spark.createDataFrame(changes[100 * k : 100 * k + 100], schema)
        assert promotion.apply_changes(store, f"b{k}", part) == k + 1
        facts = store.read("facts")
        assert {(r.subject, r.value): (r.ord, r.pos) for r in facts.collect()} == plain_facts(changes[: 100 * k + 100])
        for table, rows in promotion.derived(facts).items():
            assert contents(store.read(table)) == contents(rows), table
    assert promotion.apply_changes(store, "b2", spark.createDataFrame(changes[:50], schema)) == 3  # once only
    assert store.version() == 4
    old = contents(store.read("unified", 2))
    assert store.compact() == 5
    assert contents(store.read("unified", 2)) == old
    for table, rows in promotion.derived(store.read("facts")).items():
        assert contents(store.read(table)) == contents(rows)
    gone = spark.createDataFrame([(s, v, 1000, 0, -1) for s, v in plain_facts(changes)], schema)
    promotion.apply_changes(store, "last", gone)
    assert all(store.read(t).collect() == [] for t in ("facts", "subjects", "typed", "unified"))


def test_only_touched_subjects_are_written(spark, tmp_path):
    store = promotion.open_store(spark, str(tmp_path / "store"))
    schema = "subject string, value string, ord long, pos int, sign int"
    promotion.apply_changes(store, "a", spark.createDataFrame([(f"S{i}", "速い", i, 0, 1) for i in range(50)], schema))
    promotion.apply_changes(store, "b", spark.createDataFrame([("S7", "赤い", 90, 0, 1), ("S8", "速い", 91, 0, 1), ("S9", "速い", 92, 0, -1)], schema))
    folder = store.manifests()[-1]["folder"]
    written = spark.read.parquet(f"{store.root}/{folder}/unified").collect()
    assert sorted((r.concept, r._gone) for r in written) == [("S7", False), ("S9", True)]
    assert store.read("unified").where("concept = 'S7'").first().assistant == "S7は、速いであり、赤いである。"


def test_a_failed_batch_leaves_the_old_version(spark, tmp_path):
    store = promotion.open_store(spark, str(tmp_path / "store"))
    schema = "subject string, value string, ord long, pos int, sign int"
    promotion.apply_changes(store, "a", spark.createDataFrame([("S", "速い", 0, 0, 1)], schema))
    bad = spark.createDataFrame([("S", "赤い", 1, 0, 1)], schema)
    broken = {"results": spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("ord"), *[F.lit(None).alias(c) for c in ("concept", "statement", "promoted", "reason", "n")])}
    with pytest.raises(Exception, match="lost"):
        promotion.apply_changes(store, "b", bad, broken)
    assert store.version() == 1
    assert [r.assistant for r in store.read("unified").collect()] == ["Sは、速いである。"]
    assert promotion.apply_changes(store, "b", bad) == 2
    assert [r.assistant for r in store.read("unified").collect()] == ["Sは、速いであり、赤いである。"]


def test_writers_that_meet(spark, tmp_path):
    store = promotion.open_store(spark, str(tmp_path / "store"))
    one, two = store.begin("one"), store.begin("two")
    rows = lambda name: spark.createDataFrame([(name, "pending", None)], "concept string, status string, statement string")
    one.put("queue", rows("a"))
    two.put("queue", rows("b"))
    assert two.commit() == 1
    with pytest.raises(Conflict):
        one.commit()
    assert [r.concept for r in store.read("queue").collect()] == ["b"]


def plain_promotion(requests, pending):
    """The requests one after the other."""
    pending, out = set(pending), []
    for _, concept, statement in sorted(requests):
        head, _, body = statement.rstrip("。").partition("は、")
        if not concept:
            out.append((False, "concept must be non-empty"))
        elif not body.endswith("である"):
            out.append((False, "statement must use semantic proposition form: XはYである"))
        elif head != concept:
            out.append((False, f"statement subject does not match promotion concept: {head}"))
        elif concept not in pending:
            out.append((False, promotion.NO_REQUEST))
        elif " " in concept:
            out.append((False, promotion.NOT_ROUTED))
        else:
            pending.discard(concept)
            out.append((True, promotion.PROMOTED))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_promotion(spark, tmp_path, batches):
    rng = random.Random(3)
    names = ["CPU", "GPU", "two words", "LLM", "", "メモリ", "not asked"]
    rows = []
    for i in range(90):
        name = rng.choice(names)
        rows.append((i, name, rng.choice([f"{name}は、{rng.choice(VALUES)}である。", f"{name}は、{rng.choice(VALUES)}であり、重いである。", f"{name}は速い", "他は、重いである。"])))
    store = promotion.open_store(spark, str(tmp_path / "store"))
    promotion.enqueue(store, "queue", spark.createDataFrame([(n,) for n in names[:6]], "concept string"))
    for k in range(batches):
        part = rows[k * 90 // batches : (k + 1) * 90 // batches]
        promotion.promote(store, f"p{k}", spark.createDataFrame(part, "ord long, concept string, statement string"))
    got = [(r.promoted, r.reason) for r in store.read("results").orderBy("ord").collect()]
    want = plain_promotion(rows, names[:4] + names[5:6])
    assert got == want and sum(p for p, _ in want) == 4
    status = {r.concept: r.status for r in store.read("queue").collect()}
    assert status == {"CPU": "promoted", "GPU": "promoted", "LLM": "promoted", "メモリ": "promoted", "two words": "pending"}
    for table, df in promotion.derived(store.read("facts")).items():
        assert contents(store.read(table)) == contents(df)
    taught = {r.concept for r in store.read("unified").collect()}
    assert taught == {"CPU", "GPU", "LLM", "メモリ", "two words"}
