"""Centroid clustering, compression quality and spelling variants: against plain versions, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lorespark.llm import centroids, quality, spelling
from lorespark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds, dim, scale=64):
    """Lloyd's rounds with Python's integers: {position of row: (cluster, distance)}, centroids."""
    kept = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = [int(np.floor(scale * float(x))) for x in v]
    named = [i for i in kept if rows[i][0] is not None]
    named.sort(key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), np.array(kept[i], "<i4").tobytes()))
    middle = [kept[i] for i in named[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds if middle else 0):
        of = {i: near(x)[1] for i, x in kept.items()}
        for j in range(len(middle)):
            own = [kept[i] for i in kept if of[i] == j]
            if own:
                middle[j] = [sum(c) // len(own) for c in zip(*own)]
    return {i: near(x)[::-1] for i, x in kept.items()} if middle else {}, middle


@pytest.mark.parametrize("k,rounds,dim,spread", [(16, 3, 4, 1.0), (5, 6, 2, 0.05), (1, 2, 3, 1.0), (40, 4, 3, 0.02), (6, 3, 4, 30000.0)])
def test_centroid_clusters(spark, k, rounds, dim, spread):
    rng = np.random.default_rng(k)
    rows = [(i, [float(np.float32(x)) for x in spread * (rng.integers(-3, 4, dim) + rng.standard_normal(dim))]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [float("nan")] * dim), (904, [None] * dim), (905, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, id int")
    got = centroids.centroid_clusters(df.repartition(3), k, rounds, dim).collect()
    want, middle = plain_clusters(rows, k, rounds, dim)
    inertia = Counter()
    for c, d in want.values():
        inertia[c] += d
    rows_of = sorted((str(rows[i][0]), c, d, inertia[c], sum(inertia.values()), str(middle[c])) for i, (c, d) in want.items())
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, str(r.centroid)) for r in got) == rows_of
    assert len(got) == 303


def test_centroids_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.centroid_clusters(none).collect() == []
    unnamed = spark.createDataFrame([(None, [1.0] * 64), (1, None)], "vec_id long, embedding array<double>")
    assert centroids.centroid_clusters(unnamed).collect() == []
    big = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scaled components"):
        centroids.centroid_clusters(big).collect()


def test_exponion_keeps_ties_and_scans_less():
    """Ties at equal distance go to the smaller number in every round, and bounds spare most of the scans."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-2, 3, (2000, 2)) * 4, rng.integers(-2, 3, (2000, 2)) * 4 + 1])
    middle, before, state = np.unique(rng.integers(-8, 9, (30, 2)), axis=0), None, ()
    for _ in range(6):
        search = centroids.Exponion(middle, before)
        state = search.assign(x, *state)
        d = centroids.squared(x, middle)
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] >= np.sqrt(d.min(axis=1))).all()
        rest = d.astype(float)
        rest[np.arange(len(x)), state[0]] = np.inf
        assert (state[2] <= rest.min(axis=1)).all()
        before, middle = middle, middle.copy()
        for j in np.unique(state[0]):
            middle[j] = x[state[0] == j].sum(axis=0) // (state[0] == j).sum()
    blobs = rng.integers(-500, 500, (64, 8))
    points = np.concatenate([b + rng.integers(-9, 10, (50, 8)) for b in blobs])
    search = centroids.Exponion(blobs)
    state = search.assign(points)
    search = centroids.Exponion(blobs + 1, blobs)
    assert (search.assign(points, *state)[0] == centroids.squared(points, blobs + 1).argmin(axis=1)).all()
    assert search.scanned < len(points) * len(blobs) / 10


def test_large_integers():
    x, c = np.array([[2**27, -(2**27)], [1, 0]]), np.array([[-(2**27), 2**27], [2**27, 0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert centroids.squared(x, c).tolist() == want


def sizes(raw, dictionary):
    import zstandard

    c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
    return sum(len(c.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK))


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


def test_quality_scores(spark):
    """Scores are the formula over whole texts, compressed one by one."""
    model = quality.fit_quality(labelled(spark, "/root/testdata/sf0.01"))
    texts = [None, "", "Good", "!! " * 3000, "the of and a to " * 9000, "é" * 777]
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)] + [(None, "b", "x", 2), (0, None, "x", 2)], "doc_id long, text string, score string, n int")
    got = quality.score_quality(df, model)
    assert got.columns == ["doc_id", "text", "n", "score", "predicted"]
    for r in got.collect():
        raw = (r.text or "").encode()
        d = (sizes(raw, model.dictionaries[0]) - sizes(raw, model.dictionaries[1])) / max(len(raw), 1)
        logit = model.prior + (model.weight * d + model.bias) * len(raw) / (len(raw) + quality.SHORT)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-12)
        assert r.predicted == int(r.score >= 0.3)
        if not raw:
            assert 0.7 < r.score < 0.95
    assert quality.score_quality(df.where("false"), model).collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r for r in QUERIES["op12_quality"](spark, sf).collect()}
    rows = [(r.quality, scored[r.doc_id]) for r in labelled(spark, sf).where("quality is not null").collect()]
    held = [(y, r) for y, r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    assert len(held) > 50 and len(scored) == 1000
    good, bad = [r.score for y, r in held if y == 1], [r.score for y, r in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted == y for y, r in held]) > 0.93
    assert np.mean([r.predicted for y, r in held if y == 1]) > 0.97
    assert abs(np.mean([r.score for _, r in held]) - np.mean([y for y, _ in held])) < 0.06


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = quality.fit_quality(none)
    one = quality.fit_quality(spark.createDataFrame([(1, "a b", 1), (2, None, 0), (3, "x", None), (4, "y", 7)], none.schema))
    df = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    assert {r.score for r in quality.score_quality(df, model).collect()} == {0.5}
    assert all(0.5 <= r.score <= 1 for r in quality.score_quality(df, one).collect())


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_variants(rows, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            if i is not None:
                h = zlib.crc32(f"{i}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
            holes.setdefault((i, cut), []).append(w)
    for group in holes.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda o: (-words[o], o))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def spelled(df, **kw):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **kw).collect()), key=str)


def test_spelling_variants(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spelled(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got == plain_variants(rows)
    assert sum(r[1] is not None for r in got) > 3


def test_planted_spellings(spark):
    """Insertions, deletions and replacements at every place, repeated letters, chains of forms, runs next to other letters."""
    base = ["aaaaaaaa", "abababab", "mississippi", "éèàçùöü", "aaaaaaab", "ÀÉtranger", "xyzzyxyzzy"]
    rng = np.random.default_rng(3)
    made = list(base)
    for w in base:
        for i in range(len(w) + 1):
            made += [w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :], w[:i] + "é" + w[i:], w[:i] + w[i : i + 1] + w[i:]]
    made += ["".join(rng.choice(list("abé"), int(rng.integers(7, 10)))) for _ in range(1500)]
    chain = [("chainaaa", 2), ("chainaab", 20), ("chainabb", 200), ("chainbbb", 2000), ("chainbbc", 20000)]
    text = [w for w in made for _ in range(2)] + [w for w, n in chain for _ in range(n)]
    rows = [(None, " ".join(text)), (5, "Mississippi,MISSISSIPPI1mississippi÷x ŝmississippi ÿÿÿÿÿÿÿ×ÿÿÿÿÿÿÿ"), (6, None), (7, ""), (8, "short 12 ..."), (9, "x" * 100_000), (10, "x" * 100_000), (5, "mississippi")]
    rows += [(i, "Slippery words like mississippi and rendezvous in many documents") for i in range(11, 400)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert spelled(df) == plain_variants(rows)
    roots = {r[0]: r[2] for r in spelled(df)}
    assert roots["chainaaa"] == "chainbbc"
    assert spelled(df.where("false")) == []


def test_rarest_share(spark):
    """The filter's claim: near words share a key, whatever the frequencies."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        w = "".join(rng.choice(list("abc"), int(rng.integers(7, 12))))
        i, c = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("abcd")))
        o = [w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]][int(rng.integers(0, 2))]
        if o == w or abs(len(o) - len(w)) + sum(a != b for a, b in zip(o, w)) * (len(o) == len(w)) != 1:
            continue
        grams = {x[k : k + 2] for x in (w, o) for k in range(len(x) - 1)}
        frequency = {g: int(rng.integers(1, 4)) for g in grams}
        keys = lambda x, longer: set().union(*(spelling._keys(x, p, longer) for p in spelling.rarest(x, frequency)))
        assert keys(w, False) & keys(o, len(o) > len(w))


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "~" if v is None else str(v)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_spelling_variants"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    rows = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows.collect()) == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_workers_keep_one_vocabulary():
    """A task of another operator drops what a worker has kept of an encoder."""
    from lorespark.llm import byte_bpe, common

    assert byte_bpe._loaded is common.KEPT["byte_bpe"]
    byte_bpe.byte_bpe("byte_bpe_50k.json")
    list(common.lean(iter, "byte_bpe")(iter([])))
    assert len(byte_bpe._loaded) == 1
    list(common.lean(iter)(iter([])))
    assert len(byte_bpe._loaded) == 0
