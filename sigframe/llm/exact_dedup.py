"""Exact de-duplication of texts against a persistent index of digests.

The index is two Parquet tables, both bucketed and sorted by the SHA-256 of a text, with a partition for each batch of documents that was added:
``seen`` counts a batch's rows of each digest, ``index`` has for each digest the row that stays. A batch is summed by digest (so copies are combined
before the shuffle), written to ``seen``, and what a sort-merge anti-join with ``index`` leaves is appended there. Both sides of that join are bucketed
alike, so nothing of the index is shuffled, however large it has grown. A batch that was broken off leaves no mark of its end; it is taken out and added
again. A batch that is in the index already is not added twice.

Within a batch the row with the largest id stays, and what came in an earlier batch stays before what comes later. ``exact_groups`` adds a table in
batches of descending ids, so the largest id of all stays.

Texts are compared as they are, without any change; null counts as the empty text, which is a text like any other. Texts are taken as equal
where their digests are. A null id is smaller than all others. Of rows that agree in id and text exactly one stays. An empty table gives
no rows. Columns other than the id and the text are not read by ``exact_groups`` and come through ``deduplicate`` unchanged; only names ``_digest_...`` are
reserved.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, shared_dir, stored, whole_text

#: Batches that a whole table is added in.
ARRIVALS = 2


def _digest(text_col: str):
    return F.unhex(F.sha2(whole_text(text_col), 256))


class DigestIndex:
    """An index in a folder; it is opened if there is one, else made with so many buckets (as many as shuffles have partitions, if not said)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/about"
        if self._exists(about):
            buckets = spark.read.parquet(about).first()["buckets"]
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(about)
        self.buckets = buckets
        self.seen = self._table("seen", "digest BINARY, n BIGINT, keep_id BIGINT, keep_row BIGINT")
        self.index = self._table("index", "digest BINARY, keep_id BIGINT, keep_row BIGINT")

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        files, where = self._folder(path)
        return files.exists(files.makeQualified(where).suffix("/_SUCCESS"))

    def _table(self, kind: str, columns: str) -> str:
        """The name under which this session's catalog has a table of the folder."""
        name = f"digests_{kind}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'"
        )
        files, where = self._folder(f"{self.path}/{kind}")
        files.mkdirs(where)
        self.spark.catalog.recoverPartitions(name)
        return name

    def _append(self, df: DataFrame, table: str, batch: str) -> None:
        df.createOrReplaceTempView("_digests_of_batch")
        try:
            self.spark.sql(f"INSERT INTO {table} PARTITION (batch = '{batch}') SELECT * FROM _digests_of_batch")
        finally:
            self.spark.catalog.dropTempView("_digests_of_batch")

    def _take_out(self, batch: str) -> None:
        for kind, table in (("seen", self.seen), ("index", self.index)):
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (batch = '{batch}')")
            files, where = self._folder(f"{self.path}/{kind}/batch={batch}")
            files.delete(where, True)
            self.spark.catalog.refreshTable(table)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Adds rows (doc_id, row, digest) under a name of letters, digits, ``_`` and ``-``. ``row`` tells the rows of a batch apart."""
        if not batch.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"not the name of a batch: {batch!r}")
        if self._exists(f"{self.path}/done/{batch}"):
            return
        self._take_out(batch)
        first = F.max(F.struct("doc_id", "row"))
        summed = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            summed = summed.repartition(self.buckets, "digest")
        self._append(summed.select("digest", "n", "first.doc_id", "first.row"), self.seen, batch)
        own = self.spark.table(self.seen).where(F.col("batch") == batch)
        new = own.hint("merge").join(self.spark.table(self.index).select("digest"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", "keep_row"), self.index, batch)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/done/{batch}")

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_row, keep_batch, group_size) of all digests, over all batches; no shuffle."""
        sizes = self.spark.table(self.seen).groupBy("digest").agg(F.sum("n").alias("group_size"))
        kept = self.spark.table(self.index).withColumnRenamed("batch", "keep_batch")
        return kept.hint("merge").join(sizes, "digest")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, row, digest, batch) that were added, with keep_id, group_size and kept.

        Only digests of several rows are joined. Their table is broadcast where it is counted and found small; else it is a plain
        shuffle join of two stored tables, which Spark splits where a digest is hot.
        """
        several = stored(self.groups().where("group_size > 1"), "several")
        of = {c: c for c in ("keep_id", "keep_row", "keep_batch", "group_size")}
        joined = rows.join(few(several).select("digest", *of), "digest", "left")
        single = F.col("group_size").isNull()
        kept = single | ((F.col("keep_row") == F.col("row")) & (F.col("keep_batch") == F.col("batch")))
        return joined.select(
            "doc_id", "row", "digest", "batch",
            F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"),
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = ARRIVALS, path: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row; of equal texts the row with the largest id stays.

    Texts are read once. The rest goes over ids and digests, added to an index (a new one, or that of ``path``) in batches of descending ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = DigestIndex(spark, path or f"{shared_dir(spark)}/digest_index")
    batch = F.lit(f"part{arrivals - 1}")
    if high is not None:
        for k in reversed(range(arrivals - 1)):
            batch = F.when(F.col("doc_id") > high - (high - low + 1) * (k + 1) // arrivals, f"part{k}").otherwise(batch)
    rows = rows.withColumn("batch", batch)
    for k in range(arrivals):
        index.add(rows.where(F.col("batch") == f"part{k}"), f"part{k}")
    return index.labelled(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text is new to the index, one of each, all columns as they are; the index has them afterwards.

    The batch is written once, as it came, for a row's number must stay the same. Adding the same rows again under the same name gives them again.
    """
    at = f"{index.path}/held/{batch}"
    if not index._exists(at):
        held = docs.withColumns({"_digest_text": _digest(text_col), "_digest_row": F.monotonically_increasing_id()})
        held.write.mode("overwrite").parquet(at)
    held = index.spark.read.parquet(at)
    rows = held.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_digest_row").alias("row"), F.col("_digest_text").alias("digest"))
    index.add(rows, batch)
    gone = index.labelled(rows.withColumn("batch", F.lit(batch))).where("NOT kept").select(F.col("row").alias("_digest_row"))
    return held.join(few(stored(gone, "gone")), "_digest_row", "left_anti").select(*docs.columns)
