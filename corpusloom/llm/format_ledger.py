"""Problem 7: records that differ only in formatting, counted in an incremental ledger.

Every row gets a canonical key in the JVM: named fields (JSON object, or ``name: value`` parts
between ``|``, ``;`` or line breaks) are taken apart, sorted by name and put together again; case,
white space and punctuation go, letters, marks and digits stay.

The ledger is durable: below one path, each update writes a version ``v=N`` of
``(bucket, key, n, first_id)`` and then a manifest that says which version holds each bucket; opening the path reads the
newest manifest. Versions are bucketed tables (Spark's own buckets of ``key``, also the partition folder). An update
aggregates the batch per key, full-outer-joins it with the matching buckets only, adds counts and keeps the
smallest id as the representative. As the ledger's side is bucketed by the key, only the aggregated batch is shuffled;
buckets that the batch doesn't touch are neither read nor written. The number of buckets is a parameter of a new ledger and
kept in its manifest. One writer at a time: a second one fails when it writes the same version.

Defined cases: null texts and texts without letters and digits have no key and are no records;
equal texts are copies; a repeated field name keeps its values in the order of their text; field names may have any
length; ties between representatives go to the smallest id; an empty batch leaves the ledger as it is; an
update that fails before its manifest is written leaves the ledger as it was.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import heavy_keys, join_on_skewed_key, materialise, scratch

#: Least number of buckets of a new ledger; by default it has as many as a shuffle has tasks.
BUCKETS = 16
_NAME = r"[\p{L}\p{M}_][\p{L}\p{M}\p{N}_ ]*+\s*+:"
_PART = rf"\s*[|;\n]+\s*(?={_NAME})"
_IS_RECORD = rf"(?s)^\s*{_NAME}.*?[|;\n]\s*{_NAME}.*$"
_SCHEMA = "key string, n bigint, first_id bigint, bucket int"


def _bare(c: Column) -> Column:
    """Letters, marks and digits in one case."""
    return F.lower(F.upper(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", "")))


def canonical_text(text: Column) -> Column:
    """What two rows must share to be the same record; null if nothing is left."""
    plain = _bare(text)
    as_map = F.from_json(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), "map<string,string>")
    from_json = F.when(F.size(as_map) > 0, F.transform(F.map_entries(as_map), lambda e: F.struct(_bare(e["key"]).alias("k"), _bare(F.coalesce(e["value"], F.lit(""))).alias("v"))))
    parts = F.split(F.when(text.rlike(_IS_RECORD), text), _PART)
    from_parts = F.transform(parts, lambda p: F.struct(_bare(F.regexp_extract(p, r"(?s)^(.*?):", 1)).alias("k"), _bare(F.regexp_extract(p, r"(?s)^.*?:(.*)$", 1)).alias("v")))
    fields = F.array_sort(F.coalesce(from_json, from_parts))
    joined = F.array_join(F.transform(fields, lambda f: F.concat(f["k"], F.lit("\x1f"), f["v"])), "\x1e")
    return F.when(plain != "", F.coalesce(joined, plain))


def keyed(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """(key, id, more...) of every row that is a record. The key is a 128-bit digest of the canonical text."""
    rows = df.select(F.col(id_col).alias("id"), F.md5(canonical_text(F.col(text_col))).alias("key"), *[c.alias(n) for n, c in more.items()])
    return rows.where("key IS NOT NULL")


class KeyLedger:
    """Bucketed counts of canonical keys below one path, durable across sessions."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        self.version: dict[int, int] = {}  # bucket -> version that holds it
        self.updates = 0
        newest = self._newest()
        if newest:
            self.updates, self.buckets = newest["update"], newest["buckets"]
            self.version = {int(b): v for b, v in newest["versions"].items()}
        else:
            self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _folders(self) -> list[int]:
        """Numbers of the finished manifests."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        have = [s.getPath() for s in fs.listStatus(at)]
        return [int(p.getName().removeprefix("u=")) for p in have if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _newest(self) -> dict | None:
        done = self._folders()
        return json.loads(self.spark.read.text(f"{self.path}/manifest/u={max(done)}").first()[0]) if done else None

    def _table(self, version: int) -> DataFrame:
        """One version as a bucketed table of the session's catalogue; the data lie at the ledger's path."""
        name = f"ledger_{hashlib.md5(f'{self.path}#{version}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            columns = "key STRING, n BIGINT, first_id BIGINT, bucket INT"
            place = f"{self.path}/v={version}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (bucket) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def _read(self, wanted: list[int] | None = None) -> DataFrame | None:
        """The rows of the given buckets (all: None) in their newest versions; other folders aren't read."""
        by: dict[int, list[int]] = {}
        for b, v in self.version.items():
            if wanted is None or b in wanted:
                by.setdefault(v, []).append(b)
        out = None
        for v, bs in sorted(by.items()):
            part = self._table(v).where(F.col("bucket").isin(bs))
            out = part if out is None else out.unionByName(part)
        return out

    def update(self, batch: DataFrame) -> None:
        """Add the rows (key, id) of ``keyed``."""
        sums = batch.groupBy("key").agg(F.count("*").alias("n"), F.min("id").cast("bigint").alias("first_id"))
        new = materialise(sums.withColumn("bucket", F.pmod(F.hash("key"), F.lit(self.buckets)).cast("int")), "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        old = self._read(touched)
        both = new.select("key", "n", "first_id").repartition(self.buckets, "key")
        if old is not None:
            a, b = both.alias("a"), old.select("key", "n", "first_id").alias("b")
            both = a.join(b.hint("merge"), "key", "full_outer").select("key", (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), F.least("a.first_id", "b.first_id").alias("first_id"))
        number = self.updates + 1
        rows = both.withColumn("bucket", F.pmod(F.hash("key"), F.lit(self.buckets)).cast("int"))
        name = f"ledger_{hashlib.md5(f'{self.path}#{number}'.encode()).hexdigest()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows.write.format("parquet").option("path", f"{self.path}/v={number}").partitionBy("bucket").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        version = self.version | {b: number for b in touched}
        manifest = json.dumps({"update": number, "buckets": self.buckets, "versions": version})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/u={number}")
        self.version, self.updates = version, number

    def counts(self) -> DataFrame:
        """(key, n, first_id, bucket): one row per record with its number of copies."""
        held = self._read()
        return self.spark.createDataFrame([], _SCHEMA) if held is None else held


def ledger_of(df: DataFrame, id_col: str, text_col: str, batches: list[Column] | None = None, path: str | None = None) -> tuple[DataFrame, KeyLedger]:
    """Build a ledger from ``df``, delivery by delivery (a row belongs to the first that fits), and give the keyed rows with it. Keys are computed once."""
    number = F.lit(None).cast("int")
    for k, only in reversed(list(enumerate(batches or [F.lit(True)]))):
        number = F.when(only, k).otherwise(number)
    rows = materialise(keyed(df, id_col, text_col, batch=number), "keyed")
    ledger = KeyLedger(df.sparkSession, path)
    for k in range(len(batches or [1])):
        ledger.update(rows.where(F.col("batch") == k))
    return rows, ledger


def copies(df: DataFrame, id_col: str, text_col: str, batches: list[Column] | None = None) -> DataFrame:
    """(first_id, copy_id) of every row that isn't the representative of its record.

    The join back to the rows is on the ledger's key; its counts tell the heavy keys beforehand.
    """
    rows, ledger = ledger_of(df, id_col, text_col, batches)
    many = ledger.counts().where("n > 1").select("key", "n", "first_id")
    out = join_on_skewed_key(rows.select("key", "id"), many.select("key", "first_id"), "key", heavy_keys(ledger.counts(), "key", "n"))
    return out.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
