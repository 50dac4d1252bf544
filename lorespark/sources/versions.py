"""Keyed tables that change by versions. A version is a folder of deltas, one Parquet table for each changed table, and
becomes visible by one atomic step, the rename of its manifest; until then, and if it fails, readers see the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def apart(ranges: list[list[int | None] | None]) -> bool:
    """Whether ranges (least, greatest; both null of no rows) are all known and no two of them meet."""
    if None in ranges:
        return False
    held = sorted(r for r in ranges if r[0] is not None)
    return all(a[1] < b[0] for a, b in zip(held, held[1:], strict=False))


class VersionedTables:
    """Tables under a root. tables: {name: (schema as DDL, key columns)}.

    A delta row replaces the row with its key, or removes it if `_gone`. Reading merges the deltas since the last base, the
    newest row of a key wins; `compact` writes a base. Where the first key column is a long, manifests hold each delta's least
    and greatest; deltas whose ranges do not meet have no key in common and are read as they are. The rename of a manifest must fail if it exists (as in HDFS and in
    local folders).
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, list[str]]]):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {n: T._parse_datatype_string(s) for n, (s, _) in tables.items()}
        self.keys = {n: k for n, (_, k) in tables.items()}

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def manifests(self) -> list[dict]:
        """One small document a committed version, in order; read by the driver."""
        sc = self.spark.sparkContext
        path = self._path(f"{self.root}/_versions")
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = []
        for entry in files.listStatus(path):
            if entry.getPath().getName().endswith(".json"):
                stream = files.open(entry.getPath())
                found.append(json.loads(sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        return sorted(found, key=lambda r: r["version"])

    def version(self) -> int:
        """The committed version; 0 before the first."""
        return max((r["version"] for r in self.manifests()), default=0)

    def committed(self, batch: str) -> int | None:
        """The version that a batch has become."""
        return next((r["version"] for r in self.manifests() if r["batch"] == batch), None)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default."""
        known = [r for r in self.manifests() if version is None or r["version"] <= version]
        first = max([r["version"] for r in known if r["base"]], default=0)
        paths = [f"{self.root}/{r['folder']}/{table}" for r in known if r["version"] >= first and table in r["tables"]]
        schema, keys = self.schemas[table], self.keys[table]
        if not paths:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            return self.spark.range(0).where("false").select(*nothing)  # known as empty to the optimizer
        stored = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_version", T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(*paths)
        ranges = [r.get("ranges", {}).get(table) for r in known if r["version"] >= first and table in r["tables"]]
        if len(paths) > 1 and not apart(ranges):
            rest = [F.col(f.name) for f in stored.fields if f.name not in keys]
            rows = rows.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select(*keys, "_row.*")
        return rows.where("not _gone").select(*schema.fieldNames())

    def begin(self, batch: str) -> Stage:
        return Stage(self, batch, self.version() + 1)

    def compact(self) -> int:
        """A version that holds whole tables, so that readers need none before it."""
        stage = self.begin(f"compact-{uuid.uuid4().hex}")
        for table in self.schemas:
            stage.put(table, self.read(table))
        return stage.commit(base=True)


class Stage:
    """A version that is being written."""

    def __init__(self, store: VersionedTables, batch: str, version: int):
        self.store, self.batch, self.version, self.tables, self.ranges = store, batch, version, [], {}
        self.folder = f"deltas/{version:09d}-{uuid.uuid4().hex}"

    def put(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Write rows that are put (each key once) and the keys of rows that go; returns the put rows as written."""
        store = self.store
        schema, keys = store.schemas[table], store.keys[table]
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], F.lit(False).alias("_gone"))
        if gone is not None:
            rest = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in keys else F.col(f.name) for f in schema.fields]
            out = out.unionByName(gone.select(*rest, F.lit(True).alias("_gone")))
        path = f"{store.root}/{self.folder}/{table}"
        out.withColumn("_version", F.lit(self.version)).write.mode("error").parquet(path)
        self.tables.append(table)
        written = store.spark.read.parquet(path)
        if isinstance(schema[keys[0]].dataType, T.LongType):
            least, most, nulls = written.agg(F.min(keys[0]), F.max(keys[0]), F.count_if(F.col(keys[0]).isNull())).first()
            if not nulls:
                self.ranges[table] = [least, most]
        return written

    def commit(self, base: bool = False) -> int:
        """Rename the manifest to the version's name; a Conflict if that version exists by now."""
        store = self.store
        row = {"version": self.version, "batch": self.batch, "folder": self.folder, "tables": self.tables, "ranges": self.ranges, "base": base}
        sc = store.spark.sparkContext
        conf, fs = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs
        draft, final = store._path(f"{store.root}/{self.folder}/manifest"), store._path(f"{store.root}/_versions/{self.version:09d}.json")
        files = draft.getFileSystem(conf)
        files.mkdirs(final.getParent())
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        draft, final = files.makeQualified(draft), files.makeQualified(final)
        plain = sc._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, plain)
        except Exception as e:
            if files.exists(final):
                raise Conflict(f"version {self.version} was committed by another writer") from e
            raise
        return self.version
