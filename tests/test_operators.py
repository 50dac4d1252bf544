"""Sources, streaming and order-dependent operators against plain Python."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from lorespark.operators import curate, lifecycle, metrics, stores
from lorespark.sources import jsonl
from lorespark.streaming.lifecycle import stream_states


def test_strict_jsonl_names_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"user": "あ"}\n\n{broken\n', encoding="utf-8")
    with pytest.raises(Exception, match="line 3"):
        jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), "user string").collect()
    rows = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), "user string", strict=False).collect()
    assert [(r.ord, r.user) for r in rows] == [(1, "あ")]


def test_recursive_discovery_and_state(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.jsonl").write_text('{"user": "1"}\n')
    (tmp_path / "x" / "y" / "b.jsonl").write_text('{"user": "2"}\n')
    (tmp_path / "x" / "c.txt").write_text("no")
    rows = jsonl.read_jsonl(spark, str(tmp_path / "x"), "user string", recursive=True).collect()
    assert sorted(r.user for r in rows) == ["1", "2"]
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "trained_fingerprints": ["b", "a", "b"]}))
    assert sorted(r.fingerprint for r in jsonl.read_fingerprints(spark, str(tmp_path / "s.json")).collect()) == ["a", "b"]


def test_chat_source_and_round_trip(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"user": "u", "assistant": "a"}\n{"user": "v", "assistant": "b", "source": "manual"}\nnot json\n')
    rows = jsonl.read_chat(spark, str(tmp_path / "c.jsonl"))
    assert [r.source for r in rows.orderBy("ord").collect()] == ["chat-auto", "manual"]
    jsonl.write_jsonl(rows, str(tmp_path / "out"))
    jsonl.write_jsonl(rows, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_prefixed_pairs(spark):
    lines = ["# note", "人: a", "人: b", "AI: c", "AI: d", "人: e", "other", "AI: f"]
    rows = jsonl.pair_prefixed(spark.createDataFrame(list(enumerate(lines)), "ord int, line string"))
    assert [(r.user, r.assistant) for r in rows.orderBy("ord").collect()] == [("b", "c"), ("e", "f")]


def test_greedy_prefix_dedup(spark):
    texts = ["abcdefghij", "abcdefghzz", "abcdxxxxxx", "short", "short", "abcdefgh", "abcdxxxxyy1"]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, ord int, t string")
    kept = []
    for t in dict.fromkeys(texts):
        def same(o):
            n = min(len(o), len(t))
            p = next((i for i in range(n) if o[i] != t[i]), n)
            return n >= 8 and p / n >= 0.8
        if not any(same(o) for o in kept):
            kept.append(t)
    got = [r.t for r in curate.greedy_prefix_dedup(rows, "k", "ord", "t").orderBy("ord").collect()]
    assert got == kept


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", ""), ("同じ文", "同じ文")]
    got = spark.createDataFrame(pairs, "a string, b string").select(metrics.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, *p).ratio() for p in pairs]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    log = [("A", "promote", 0), ("B", "verify", 1), ("A", "verify", 2), ("A", "revoke", 3), ("B", "promote", 4)]
    rows = spark.createDataFrame(log, "concept string, action string, ord int")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    states = stream_states(stream, "concept", "action", lifecycle.QUEUE_MOVES, "pending")
    q = states.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = lifecycle.fold_states(rows, "concept", "action", lifecycle.QUEUE_MOVES, "pending")
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, batch.collect()))


def test_unknown_states_raise(spark):
    from lorespark.functions import text
    from lorespark.operators import resolve

    with pytest.raises(Exception, match="unsupported truth state"):
        spark.range(1).select(text.truth_state(F.lit("maybe"))).collect()
    with pytest.raises(Exception, match="unsupported knowledge state"):
        resolve.dispatch(spark.createDataFrame([("NEW",)], "state string")).collect()


def test_stores_on_empty_tables(spark):
    empty = spark.createDataFrame([], "concept string, assistant string, ord int")
    some = spark.createDataFrame([("A", "a", 0)], "concept string, assistant string, ord int")
    assert stores.upsert(empty, some, "concept").count() == 1
    assert stores.upsert(some, empty, "concept").collect() == some.collect()
    assert stores.first_per_key(empty, "concept").count() == 0


def test_similarity_joins_lose_no_pair(spark):
    import difflib
    import random

    from lorespark.operators import audit

    random.seed(4)
    texts = ["".join(random.choice("abcdé ") for _ in range(random.randint(0, 14))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts[:20]] + texts[:3]
    df = spark.createDataFrame([(i, t, t[::-1] * (i % 3)) for i, t in enumerate(texts)], "id int, q string, a string")
    clean = lambda t: re.sub(r"[。.!！?？]+$", "", re.sub(r"\s+", "", t)).lower()
    ratio = lambda x, y: difflib.SequenceMatcher(None, clean(x), clean(y)).ratio()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(clean(t), i)
    at = sorted(first.values())
    answer = lambda i: texts[i][::-1] * (i % 3)
    want = {(i, j) for i in at for j in at if i < j and ratio(texts[i], texts[j]) >= 0.7 and ratio(answer(i), answer(j)) < 0.45}
    got = {(r.a, r.b) for r in audit.near_conflicts(df, "id", "q", "a", prompt=0.7).collect()}
    assert got == {p for p in want if clean(texts[p[0]]) and clean(texts[p[1]])} and got

    def grams(t):
        k = re.sub(r"\s+", "", t.lower())
        return {k[i : i + 2] for i in range(max(len(k) - 1, 1))} if k else set()

    best = {r.id: (r.other, round(r.score, 9)) for r in audit.best_similar(df.where("length(trim(q)) > 1"), "id", "q", 0.5).collect()}
    rows = [i for i, t in enumerate(texts) if len(t.strip(" ")) > 1]
    for i in rows:
        score = lambda j: len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j]))  # noqa: B023, E731
        found = [(-round(score(j) + min(len(texts[j]) / 200, 0.2), 9), j) for j in rows if j != i and score(j) >= 0.5]
        assert (i in best) == bool(found)
        if found:
            assert best[i][0] == min(found)[1]


def test_exact_samples_by_hash(spark):
    from hashlib import sha256

    from lorespark.operators import audit

    for n, ratio in ((0, 0.5), (1, 0.4), (7, 0.5), (1000, 0.137), (50, 1.0), (50, 0.0)):
        got = {r.id for r in audit.taken_by_hash(spark.range(n), F.col("id"), ratio).where("taken").collect()}
        assert got == set(sorted(range(n), key=lambda i: sha256(str(i).encode()).hexdigest())[: int(n * ratio + 0.5)])


def test_snapshot_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    first = jsonl.write_snapshot(rows, str(tmp_path), "s1", "before").first()
    assert (first.n, first.note) == (3, "before")
    assert jsonl.write_snapshot(rows.orderBy("id", ascending=False), str(tmp_path), "s2").first().checksum == first.checksum
    with pytest.raises(Exception, match="(?i)exist"):
        jsonl.write_snapshot(rows.limit(1), str(tmp_path), "s1")
    empty = jsonl.write_snapshot(rows.limit(0), str(tmp_path), "s3").first()
    assert (empty.n, empty.checksum) == (0, None)


def test_prefixed_pairs_keep_their_file(spark):
    lines = [("f", 0, "人: a"), ("g", 0, "人: b"), ("f", 1, "AI: x"), ("g", 1, "AI: y")]
    rows = jsonl.pair_prefixed(spark.createDataFrame(lines, "file string, ord int, line string"))
    assert sorted(map(tuple, rows.collect())) == [("f", 1, "a", "x"), ("g", 1, "b", "y")]


def test_near_conflicts_of_edited_prompts(spark):
    """Whole prompts with edits planted in them, at several thresholds, against all pairs."""
    import difflib
    import random

    from lorespark.operators import audit

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(2, 12))) for _ in range(40)]
    prompts = list(base)
    for t in base:
        for share in (0.05, 0.15, 0.3):
            cs = list(t)
            for _ in range(max(1, int(len(cs) * share))):
                i = rng.randrange(len(cs))
                cs[i : i + 1] = rng.choice([[], ["z"], [cs[i], "y"]])
                cs = cs or ["a"]
            prompts.append("".join(cs))
    rows = [(i, t, rng.choice(["yes it is", "no never", t])) for i, t in enumerate(prompts)]
    clean = lambda t: re.sub(r"[。.!！?？]+$", "", re.sub(r"\s+", "", t)).lower()
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    first = {}
    for i, t, a in rows:
        first.setdefault(clean(t), (i, clean(a)))
    df = spark.createDataFrame(rows, "id int, q string, a string")
    for prompt in (0.6, 0.82, 0.95):
        keys = sorted((i, p, a) for p, (i, a) in first.items() if p)
        want = {(i, j) for i, p, a in keys for j, r, b in keys if i < j and ratio(p, r) >= prompt and ratio(a, b) < 0.45}
        got = {(r.a, r.b) for r in audit.near_conflicts(df, "id", "q", "a", prompt=prompt).collect()}
        assert got == want and got


def test_ratio_is_the_one_of_difflib():
    """Short and long texts: from 200 characters on, frequent characters begin no match."""
    import difflib
    import random

    from lorespark.operators import metrics

    rng, ratio = random.Random(3), metrics.Ratio()
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghij ", "eeeeeetttaaoinshrdlxqzjv") for n in (0, 1, 7, 40, 199, 200, 350, 900)]
    texts += [t[5:] + t[:20] for t in texts]
    assert all(ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio() for a in texts for b in texts)


def test_joins_in_blocks_lose_no_pair(spark, monkeypatch):
    """With prefixes that pass nearly all pairs every pair is counted in blocks; by prefixes the same rows come out."""
    import random

    from lorespark.operators import audit

    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abcdef ") for _ in range(rng.randint(2, 12))) for _ in range(700)})
    df = spark.createDataFrame([(i, t, rng.choice(["yes it is", "no never", t])) for i, t in enumerate(texts)], "id int, q string, a string")
    found = {}
    for by_prefix in (True, False):
        monkeypatch.setattr(audit, "selective", lambda *_: by_prefix)  # noqa: B023
        found[by_prefix] = [{tuple(r) for r in rows.collect()} for rows in (audit.similar_pairs(df, "id", "q", 0.4), audit.near_conflicts(df, "id", "q", "a", 0.6))]
        assert [len(f) for f in found[by_prefix]] == [len({p[:2] for p in f}) for f in found[by_prefix]]
    assert found[True] == found[False] and all(len(f) > 100 for f in found[True])


def test_conflicts_in_blocks_are_those_of_difflib(spark, monkeypatch):
    """Three blocks, prompts of one and of several words of bits, answers on both sides of difflib's 200 characters and
    missing ones, code points beyond 16 bits, keys that are no numbers; texts are compared without Python."""
    import difflib
    import random

    from lorespark.operators import audit

    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    prompts = {word("abcdefgh日😀", rng.randint(1, 11)) for _ in range(560)}
    for n in (40, 64, 65, 130, 200, 260):
        base = word("abcdefgh日😀", n)
        prompts |= {base} | {base[:i] + word("abc", k) + base[i + k :] for i, k in ((3, n // 3), (n // 2, n // 3), (n // 4, n // 2))}
    common = [word("ab  cdefghijklmnopqrstuvwxyz😀", 30) for _ in range(12)]
    long = lambda: "".join(rng.choice(common)[: rng.randint(3, 30)] + word("eeetaoinshr", 9) for _ in range(rng.randint(1, 14)))
    answers = [long() for _ in range(90)] + [None, "", "a"]
    rows = [(f"k{i:04}", p, rng.choice(answers)) for i, p in enumerate(sorted(prompts, key=lambda p: word("abcd", 8)))]
    df = spark.createDataFrame(rows, "id string, q string, a string")
    monkeypatch.setattr(audit, "selective", lambda *_: False)
    found = audit.near_conflicts(df, "id", "q", "a", 0.6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    clean = lambda t: "".join((t or "").split())
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    known, want = {}, set()
    for i, (a, p, v) in enumerate(rows):
        for b, q, w in rows[i + 1 :]:
            if 2 * min(len(p), len(q)) >= 0.6 * (len(p) + len(q)) and (by_prompt := ratio(p, q)) >= 0.6:
                if (v, w) not in known:
                    known[v, w] = ratio(clean(v), clean(w))
                if known[v, w] < 0.45:
                    want.add((a, b, by_prompt, known[v, w]))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1000 and sum(len(p) > 30 for a, p, _ in rows if any(a in w for w in want)) > 5
    empty = audit.near_conflicts(df.where("q = ''"), "id", "q", "a", 0.6)
    assert empty.columns == found.columns and not empty.collect()


def test_low_thresholds_go_by_blocks(spark):
    from lorespark.operators import audit

    import random

    rng = random.Random(8)
    rows = spark.createDataFrame([(i, "".join(rng.choice("abcdef") for _ in range(40))) for i in range(300)], "id int, q string")
    tokens = rows.select("id", F.explode(F.split("q", "")).alias("token")).distinct()
    assert not audit.selective(audit.prefixes(tokens, "id", 0.5), "id")
    apart = rows.select("id", F.col("id").cast("string").alias("token"))
    assert audit.selective(audit.prefixes(apart, "id", 0.5), "id")
