"""Counts of every distinct value, kept up to date by signed deltas.

A store is a folder with two tables: the record versions it has counted, and
one row per value with its occurrences and records, both partitioned by a hash
bucket of their key. A batch of deliveries is compared with the stored
versions of its buckets; added records give positive deltas, deleted ones
negative deltas, changed ones both. Deltas are summed map-side before they are
shuffled, then merged into the buckets of counts that they concern, so a value
that is in every record costs one row per task, and a small batch rewrites
little. A manifest says which generation holds each bucket; it is written
last, so a batch that dies leaves the old counts whole, and a store opened
again goes on where it was.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellichor.plans.lineage import scratch_dir

RARE_MAX_RECORDS = 2
COMMON_SHARE = 0.05

_CONTENT = T.ArrayType(T.StructType([T.StructField("field_name", T.StringType()), T.StructField("term_value", T.StringType()), T.StructField("n", T.LongType())]))
RECORD_SCHEMA = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("content", _CONTENT)])
COUNT_SCHEMA = T.StructType([T.StructField("field_name", T.StringType()), T.StructField("term_value", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])


def normalize_value(value: str | None) -> str | None:
    """Lower case, NFC, single blanks, trimmed; None where nothing is left."""
    if value is None:
        return None
    v = " ".join(value.split())
    if v.isascii():
        return v.lower() or None
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", v).lower()) or None


def _normalizer(fields: Sequence[str]):
    out = pa.schema(
        [
            ("record_key", pa.string()),
            ("version", pa.int64()),
            ("content", pa.list_(pa.struct([("field_name", pa.string()), ("term_value", pa.string()), ("n", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for b in batches:
            columns = [b.column(f).to_pylist() for f in fields]
            content = []
            for values in zip(*columns, strict=True):
                row = []
                for f, vs in zip(fields, values, strict=True):
                    if not vs:
                        continue
                    c: Counter[str] = Counter()
                    for raw in vs:
                        if raw is None:
                            continue
                        if raw in known:
                            v = known[raw]
                        else:
                            if len(known) > 50_000:
                                known.clear()
                            v = known[raw] = normalize_value(raw)
                        if v:
                            c[v] += 1
                    row += [{"field_name": f, "term_value": v, "n": n} for v, n in c.items()]
                content.append(row)
            yield pa.RecordBatch.from_arrays([b.column("record_key"), b.column("version"), pa.array(content, out.field("content").type)], schema=out)

    return run


def record_versions(df: DataFrame, fields: Sequence[str], key: str = "id", version: str = "seq") -> DataFrame:
    """One row per record: the values of its latest delivery, normalised.

    A null key makes each row a record of its own. Null, empty and blank
    elements count nowhere; a null array is an empty one. Of deliveries with
    the same version the one with the greater content is taken.
    """
    src = df.select(
        F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\u0000"), F.col(version).cast("string"))).alias("record_key"),
        F.col(version).cast("long").alias("version"),
        *[F.col(f).cast("array<string>").alias(f) for f in fields],
    )
    rows = src.mapInArrow(_normalizer(fields), RECORD_SCHEMA)
    return rows.groupBy("record_key").agg(F.max(F.struct("version", "content")).alias("m")).select("record_key", "m.version", "m.content")


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.explode("content").alias("c")).select("c.field_name", "c.term_value", (F.col("c.n") * sign).alias("occurrences"), F.lit(sign).cast("long").alias("records"))


def signed_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Per-value changes between two sets of record versions.

    ``before`` has the stored versions of the records concerned, ``after``
    their new ones; records with the same content on both sides cancel out.
    """
    d = _signed(after, 1)
    if before is not None:
        d = d.unionByName(_signed(before, -1))
    return d.groupBy("field_name", "term_value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("occurrences <> 0 or records <> 0")


def _load(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """The tables of some folders without the bucket that the folders name."""
    return spark.read.schema(schema).parquet(*paths).select(*schema.names)


def _by_bucket(df: DataFrame, buckets: int, *key: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


class TermCountStore:
    """Persistent, partitioned counts below one folder, which may hold a store already.

    ``buckets`` holds for a new store only.
    """

    def __init__(self, spark: SparkSession, fields: Sequence[str], path: str | None = None, buckets: int = 16):
        self.spark, self.fields = spark, tuple(fields)
        self.path = path or scratch_dir(spark, "term-counts")
        self.generation, self.buckets = 0, buckets
        self._held: dict[str, dict[int, int]] = {"records": {}, "counts": {}}
        if path:
            self._open()

    def _open(self) -> None:
        """Finds the last generation whose manifest is complete."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return
        done = [int(f.getPath().getName()[1:]) for f in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if done:
            self.generation = max(done)
            # one row a bucket and table
            for r in self.spark.read.parquet(f"{self.path}/manifest/g{self.generation}").collect():
                self.buckets = r["buckets"]
                if r["bucket"] >= 0:
                    self._held[r["table"]][r["bucket"]] = r["generation"]

    def _read(self, table: str, schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/g{g}/{table}/bucket={k}" for k, g in sorted(self._held[table].items()) if buckets is None or k in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return _load(self.spark, schema, *paths)

    def records(self) -> DataFrame:
        return self._read("records", RECORD_SCHEMA)

    def counts(self) -> DataFrame:
        return self._read("counts", COUNT_SCHEMA)

    def apply(self, delivered: DataFrame | None = None, deleted_keys: DataFrame | None = None, key: str = "id", version: str = "seq") -> TermCountStore:
        """Counts a batch: deliveries (added or changed records) and deletions.

        A delivery older than the stored version of its record is ignored.
        ``deleted_keys`` has one column, the record keys to remove.
        """
        spark, into = self.spark, f"{self.path}/g{self.generation + 1}"
        new = spark.createDataFrame([], RECORD_SCHEMA) if delivered is None else record_versions(delivered, self.fields, key, version)
        touched = self._write(new, f"{into}/fresh" if self.generation else f"{into}/records", "record_key")
        if not self.generation:
            after, before = _load(self.spark, RECORD_SCHEMA, f"{into}/records") if touched else new, None
            deltas = signed_deltas(None, after)
            held = touched
        else:
            fresh = _load(self.spark, RECORD_SCHEMA, f"{into}/fresh") if touched else new
            gone = spark.createDataFrame([], "record_key string") if deleted_keys is None else deleted_keys.select(F.col(deleted_keys.columns[0]).cast("string").alias("record_key")).filter("record_key is not null").distinct()
            held = touched | {r[0] for r in _by_bucket(gone, self.buckets, "record_key").select("bucket").distinct().collect()}
            old = self._read("records", RECORD_SCHEMA, held)
            # one row a record of the buckets concerned: what was stored, and what holds from now on
            both = old.select("record_key", F.struct("version", "content").alias("was")).join(fresh.select("record_key", F.struct("version", "content").alias("came")), "record_key", "full").join(gone.withColumn("gone", F.lit(True)), "record_key", "left")
            newer = F.col("came").isNotNull() & (F.col("was").isNull() | (F.col("came.version") >= F.coalesce("was.version", F.lit(-(2**63)))))
            merged = both.select("record_key", "was", F.when(F.col("gone").isNull(), F.when(newer, F.col("came")).otherwise(F.col("was"))).alias("now"), (newer | F.col("gone").isNotNull()).alias("changed"))
            self._write(merged, f"{into}/merged", "record_key")
            merged = _load(self.spark, merged.schema, f"{into}/merged")
            self._write(merged.filter("now is not null").select("record_key", "now.version", "now.content"), f"{into}/records", "record_key")
            changed = merged.filter("changed")
            before, after = changed.filter("was is not null").select("record_key", "was.version", "was.content"), changed.filter("now is not null").select("record_key", "now.version", "now.content")
            deltas = signed_deltas(before, after)
        terms = self._write(deltas, f"{into}/deltas" if self.generation else f"{into}/counts", "field_name", "term_value")
        if self.generation and terms:
            deltas = _load(self.spark, COUNT_SCHEMA, f"{into}/deltas")
            sums = self._read("counts", COUNT_SCHEMA, terms).unionByName(deltas).groupBy("field_name", "term_value").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("records > 0")
            kept = self._write(sums, f"{into}/counts", "field_name", "term_value")
        else:
            kept = terms
        self.generation += 1
        here = held if self.generation == 1 else self._buckets_of(f"{into}/records")
        for table, concerned, written in (("records", held, here), ("counts", terms, kept)):
            for k in concerned:
                self._held[table].pop(k, None)
            self._held[table].update(dict.fromkeys(written, self.generation))
        rows = [(t, k, g, self.buckets) for t, m in self._held.items() for k, g in m.items()] or [("records", -1, self.generation, self.buckets)]
        spark.createDataFrame(rows, "table string, bucket int, generation int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/g{self.generation}")
        return self

    def _write(self, df: DataFrame, path: str, *key: str) -> set[int]:
        """Writes by bucket; the buckets that have rows."""
        _by_bucket(df, self.buckets, *key).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self._buckets_of(path)

    def _buckets_of(self, path: str) -> set[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}

    def marked(self, rare_max: int = RARE_MAX_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
        """The counts with ``mark``: ``rare``, ``common`` or null."""
        total = self.records().agg(F.count(F.lit(1)).alias("total"))
        mark = F.when(F.col("records") <= rare_max, "rare").when(F.col("records") > F.col("total") * common_share, "common")
        return self.counts().join(F.broadcast(total)).select("field_name", "term_value", "occurrences", "records", mark.alias("mark"))


def term_marks(df: DataFrame, fields: Sequence[str] = ("terms", "citations"), version: str = "seq", deliveries: int = 2, **kw) -> DataFrame:
    """Counts and marks of a whole table, taken into a new store in deliveries by version, as they came.

    Records that come again in a later delivery are changes: what they held
    before is taken off. The result doesn't depend on the number of deliveries.
    """
    store = TermCountStore(df.sparkSession, fields)
    low, high = df.agg(F.min(version), F.max(version)).first()
    if low is None or deliveries < 2:
        return store.apply(df, version=version, **kw).marked()
    # rows without a version come with the first
    at = F.least(F.lit(deliveries - 1), F.coalesce(F.floor((F.col(version) - low) * deliveries / max(1, high - low)), F.lit(0)))
    for k in range(deliveries):
        store.apply(df.filter(at == k), version=version, **kw)
    return store.marked()
