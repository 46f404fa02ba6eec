"""Keeping an index up to date from streams: micro-batches of changed documents into a bucketed, versioned index.

Documents are stored in buckets by the hash of their id.  A change batch rewrites only the buckets it touches and
commits a manifest that names, for every bucket, the folder that holds it; readers see a whole version or none.
The manifest also holds the stream's last epoch, so a batch that is delivered again is passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import index
from tessera.operators.versions import Store

SCHEMA = "doc_id string, rel_path string, size bigint, hash string, modified_time bigint, content string, words array<string>"


class BucketedIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.store, self.buckets = spark, Store(spark, path), buckets

    def _manifest(self) -> dict:
        names = [n for n in self.store.names("_manifests") if n.endswith(".json")]
        return json.loads(self.store.read(f"_manifests/{names[-1]}")) if names else {"version": 0, "epoch": -1, "folders": {}}

    def version(self) -> int:
        return self._manifest()["version"]

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.store.path}/{f}" for f in sorted(folders)])

    def documents(self) -> DataFrame:
        return self._read(list(self._manifest()["folders"].values()))

    def postings(self) -> DataFrame:
        return index.postings(self.documents())

    def apply(self, changes: DataFrame, epoch: int | None = None) -> int:
        """Upserts (``op`` null or ``upsert``) and deletes (``op`` delete) by doc_id, of which the last ``seq`` holds; the new version."""
        m = self._manifest()
        if epoch is not None and epoch <= m["epoch"]:
            return m["version"]
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        cols = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        last = changes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("seq", F.coalesce("op", F.lit("upsert")).alias("op"), *[c for c in cols if c not in ("doc_id", "words")])).alias("r"))
        last = last.select("doc_id", "r.*").withColumn("_b", bucket).persist()
        try:
            touched = [r[0] for r in last.select("_b").distinct().collect()]  # at most `buckets` numbers
            if touched:
                old = self._read([m["folders"][str(b)] for b in touched if str(b) in m["folders"]])
                new = last.where("op <> 'delete'").withColumn("words", F.coalesce(index.text.words(F.col("content")), F.array().cast("array<string>"))).select(*cols)
                merged = index.delete_documents(old, last).unionByName(new)
                part = f"data/{uuid.uuid4().hex}"
                merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.path}/{part}")
                have = set(self.store.names(part))
                for b in touched:
                    if f"bucket={b}" in have:
                        m["folders"][str(b)] = f"{part}/bucket={b}"
                    else:
                        m["folders"].pop(str(b), None)
        finally:
            last.unpersist()
        m["version"] += 1
        m["epoch"] = m["epoch"] if epoch is None else epoch
        if not self.store.put_new(f"_manifests/{m['version']:012}.json", json.dumps(m)):
            raise FileExistsError("the index was changed by another writer")
        return m["version"]


def index_stream(changes: DataFrame, target: BucketedIndex, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds a streaming table of changes (doc_id, rel_path, size, hash, modified_time, content, op, seq) to the index."""
    writer = changes.writeStream.foreachBatch(lambda batch, epoch: target.apply(batch, epoch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def file_changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of change rows from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
