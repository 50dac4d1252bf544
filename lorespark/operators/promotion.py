"""The knowledge store: propositions as the source of truth, and the subject, typed and unified stores derived from them.
Batches change propositions; the change is carried on to the rows of the subjects it touches, without a rebuild, and becomes
visible in all stores at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, text
from ..session import forget, materialize, partitions, ship
from ..sources.versions import VersionedTables
from . import knowledge

TABLES = {
    "facts": ("subject string, value string, ord long, pos int", ["subject", "value"]),
    "subjects": ("subject string, statements array<string>", ["subject"]),
    "typed": ("subject string, predicate_type string, statements array<string>", ["subject", "predicate_type"]),
    "unified": ("concept string, assistant string, atomic_count int, predicate_types array<string>", ["concept"]),
    "queue": ("concept string, status string, statement string", ["concept"]),
    "results": ("ord long, concept string, statement string, promoted boolean, reason string, n int", ["ord"]),
}
NO_REQUEST = "no pending UNKNOWN_KNOWLEDGE request for concept"
NOT_ROUTED = "promotion stored but bare semantic routing not enabled"
PROMOTED = "knowledge promoted to validated semantic layer"


def open_store(spark: SparkSession, root: str) -> VersionedTables:
    ship(spark)
    return VersionedTables(spark, root, TABLES)


def derived(facts: DataFrame) -> dict[str, DataFrame]:
    """The subject, typed and unified stores of propositions (subject, value, ord, pos), each subject's in order."""
    lists = facts.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "value"))).alias("l"))
    return _stores(lists.select("subject", _typed("l").alias("l")))


def _typed(entries: str) -> Column:
    """The structs of an array with the predicate type of their value."""
    return F.transform(entries, lambda r: r.withField("type", grammar.predicate_type_of(r["value"])))


def _stores(lists: DataFrame) -> dict[str, DataFrame]:
    """The derived stores of subjects with their propositions (subject, l: value and type in order); no shuffle."""
    said = lambda r: grammar.atomic_statement(F.col("subject"), r["value"])
    types = F.array_distinct(F.transform("l", lambda r: r["type"]))
    by_type = lists.select("subject", "l", F.explode(types).alias("predicate_type"))
    values = F.transform("l", lambda r: r["value"])
    return {
        "subjects": lists.select("subject", F.transform("l", said).alias("statements")),
        "typed": by_type.select("subject", "predicate_type", F.transform(F.filter("l", lambda r: r["type"] == F.col("predicate_type")), said).alias("statements")),
        "unified": lists.select(
            F.col("subject").alias("concept"), grammar.composed(F.col("subject"), values).alias("assistant"), F.size("l").alias("atomic_count"), types.alias("predicate_types")
        ),
    }


def _net(changes: DataFrame, retracts: bool) -> DataFrame:
    """Of the changed propositions (subject, value): whether they are reset by a retraction, and put (the place of their
    first assertion after it, null if there is none). Changes apply in order: the last retraction counts."""
    place = F.struct("ord", "pos")
    key = ["subject", "value"]
    asserted = F.col("sign") > 0
    if not retracts:
        return changes.groupBy(*key).agg(F.min(place).alias("put")).select(*key, F.lit(False).alias("reset"), "put")
    cut = changes.groupBy(*key).agg(F.max(F.when(~asserted, place)).alias("cut"))
    after = changes.join(cut, key).where(asserted & (F.col("cut").isNull() | (place > F.col("cut"))))
    put = after.groupBy(*key).agg(F.min(place).alias("put"))
    return cut.join(put, key, "left").select(*key, F.col("cut").isNotNull().alias("reset"), "put")


def _touched(facts: DataFrame, net: DataFrame) -> DataFrame:
    """Of the subjects with a changed proposition: subject, l (all of their propositions that are or were, by place: ord and
    pos, null of what is gone, value, had, moved, type). Facts and changes meet in one shuffle by subject; they are added
    up, so no join sorts them."""
    was = facts.select("subject", "value", F.col("ord").alias("was_ord"), F.col("pos").alias("was_pos"))
    put = net.select("subject", "value", "reset", F.col("put.ord").alias("put_ord"), F.col("put.pos").alias("put_pos"))
    rows = was.unionByName(put, allowMissingColumns=True).repartition("subject")
    rows = rows.groupBy("subject", "value").agg(F.max("reset").alias("reset"), *[F.max(c).alias(c) for c in ("was_ord", "was_pos", "put_ord", "put_pos")])
    had, fresh = F.col("was_ord").isNotNull(), F.coalesce("reset", F.lit(False)) | F.col("was_ord").isNull()
    now = [F.when(fresh, F.col(f"put_{c}")).otherwise(F.col(f"was_{c}")).alias(c) for c in ("ord", "pos")]
    rows = rows.select("subject", "value", had.alias("had"), "was_ord", "was_pos", *now)
    moved = ~(F.col("was_ord").eqNullSafe(F.col("ord")) & F.col("was_pos").eqNullSafe(F.col("pos")))
    rows = rows.select("subject", F.struct("ord", "pos", "value", "had", moved.alias("moved")).alias("r"))
    lists = rows.groupBy("subject").agg(F.collect_list("r").alias("l"), F.max("r.moved").alias("any")).where("any")
    return lists.select("subject", F.array_sort("l").alias("l")).select("subject", _typed("l").alias("l"))


def _near(facts: DataFrame, net: DataFrame, few: int = 100_000) -> DataFrame:
    """The facts of changed subjects if these are few, else all, which are dealt to the subjects anyway."""
    subjects = net.select("subject").distinct()
    return facts.join(F.broadcast(subjects), "subject", "left_semi") if subjects.limit(few + 1).count() <= few else facts


def apply_changes(store: VersionedTables, batch: str, changes: DataFrame, others: dict[str, DataFrame] | None = None, retracts: bool = True) -> int:
    """Apply a batch of changes (subject, value, ord, pos, sign: 1 asserts, -1 retracts) and commit it with the rows of
    other tables; returns its version. A batch that is committed already changes nothing, one that fails leaves the version
    before. Only subjects with a changed proposition get new rows. (ord, pos) must be distinct and grow over batches.
    retracts: False if all changes assert."""
    done = store.committed(batch)
    if done is not None:
        return done
    stage = store.begin(batch)
    net = materialize(_net(changes, retracts), "net-changes")
    touched = materialize(_touched(_near(store.read("facts"), net), net), "touched-subjects")  # what all stores are derived from
    moved = touched.select("subject", F.explode(F.filter("l", lambda r: r["moved"])).alias("r")).select("subject", "r.value", "r.ord", "r.pos")
    stage.put("facts", moved.where("ord is not null"), moved.where("ord is null"))
    there = F.filter("l", lambda r: r["ord"].isNotNull())
    types = lambda entries: F.transform(entries, lambda r: r["type"])
    lost = touched.where(F.size(there) == 0)  # something of theirs has moved, so they had something
    lost_types = F.explode(F.array_except(types(F.filter("l", lambda r: r["had"])), types(there))).alias("predicate_type")
    gone = {"subjects": lost.select("subject"), "typed": touched.select("subject", lost_types), "unified": lost.select(F.col("subject").alias("concept"))}
    for table, rows in _stores(touched.select("subject", there.alias("l")).where(F.size("l") > 0)).items():
        stage.put(table, rows, gone[table] if retracts else None)
    for table, rows in (others or {}).items():
        stage.put(table, rows)
    version = stage.commit()
    forget(net, touched)
    return version


def enqueue(store: VersionedTables, batch: str, concepts: DataFrame) -> int:
    """Concepts that the queue lacks become pending requests."""
    done = store.committed(batch)
    if done is not None:
        return done
    names = concepts.repartition(partitions(concepts.sparkSession))  # a file may be one task
    names = names.select(text.fragment(F.col("concept")).alias("concept")).distinct()
    names = materialize(names, "queue-names")  # else the test of names is pushed to their scan, and Python runs there too
    fresh = names.where("concept <> ''").join(store.read("queue"), "concept", "left_anti")
    stage = store.begin(batch)
    stage.put("queue", fresh.select("concept", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("statement")))
    version = stage.commit()
    forget(names)
    return version


def judged(requests: DataFrame, pending: DataFrame) -> DataFrame:
    """Ord, concept, statement, values, taught, promoted, reason of promotion requests (ord, concept, statement).

    A request is valid by F8, needs a pending concept, is taught, and closes the concept's pending request if the concept
    by itself is a question that the store answers (R4). So the first valid request of such a concept is promoted and later
    ones find none pending; a concept that is not routed stays pending, and all of its valid requests are taught.
    """
    rows = read_requests(requests)
    return valid_requests(rows, pending).unionByName(faulty_requests(rows))


def read_requests(requests: DataFrame) -> DataFrame:
    """Requests with fault (F8), values and routed (R4). The grammar runs once, for the rows and for the first ones of
    concepts."""
    rows = requests.repartition(partitions(requests.sparkSession), "ord")  # a file may be one task, which the grammar would fill
    rows = rows.select("ord", "concept", text.strip(F.col("statement")).alias("statement"))
    names, said = text.nfkc(F.col("concept")), text.nfkc(F.col("statement"))
    rows = rows.select("ord", names.alias("concept"), "statement", said.alias("said"))  # one pass of Python
    rows = rows.select("ord", text.plain_fragment(F.col("concept")).alias("concept"), "statement", "said")
    rows = knowledge.with_promotion(rows, "concept", "said")
    routed = grammar.bare_concept(F.col("concept")) != ""
    return materialize(rows.select("ord", "concept", "statement", "fault", "values", routed.alias("routed")), "read-requests")


def valid_requests(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """What becomes of the read requests without fault."""
    valid = rows.where("fault is null")
    first = valid.groupBy("concept").agg(F.min("ord").alias("first")).join(pending, "concept", "left_semi")
    valid = valid.join(first, "concept", "left")
    taught = F.col("first").isNotNull() & (~F.col("routed") | (F.col("ord") == F.col("first")))
    reason = F.when(~taught, NO_REQUEST).when(~F.col("routed"), NOT_ROUTED).otherwise(PROMOTED)
    return valid.select("ord", "concept", "statement", "values", taught.alias("taught"), (taught & F.col("routed")).alias("promoted"), reason.alias("reason"))


def faulty_requests(rows: DataFrame) -> DataFrame:
    """They need nothing of the queue, and of one faulty concept there may be very many."""
    none, no = F.array().cast("array<string>").alias("values"), F.lit(False)
    return rows.where("fault is not null").select("ord", "concept", "statement", none, no.alias("taught"), no.alias("promoted"), F.col("fault").alias("reason"))


def promote(store: VersionedTables, batch: str, requests: DataFrame) -> int:
    """Judge the requests of a batch, teach, carry the change to all stores, mark the queue, record the results: one
    version. requests: ord (distinct, growing over batches), concept, statement."""
    done = store.committed(batch)
    if done is not None:
        return done
    queue = store.read("queue")
    rows = read_requests(requests)
    found = materialize(valid_requests(rows, queue.where("status = 'pending'")), "judged-requests")
    taught = found.where("taught").select(F.col("concept").alias("subject"), "ord", F.posexplode("values").alias("pos", "value"), F.lit(1).alias("sign"))
    marked = found.where("promoted").select("concept", F.lit("promoted").alias("status"), "statement")
    results = found.unionByName(faulty_requests(rows)).select("ord", "concept", "statement", "promoted", "reason", F.when(F.col("taught"), F.size("values")).otherwise(0).alias("n"))
    version = apply_changes(store, batch, taught, {"queue": marked, "results": results}, retracts=False)
    forget(rows, found)
    return version
