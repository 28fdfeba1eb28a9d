"""A vector store on files: keyed upserts in versions, with one manifest file as the pointer to the current one.

Rows (chunk_id, version, document_id, embedding, deleted) are dealt to buckets by a hash of chunk_id. An upsert merges its
rows with those of the buckets that it touches and writes these buckets anew, in a folder of the new commit; the others stay
where they are. Then it writes a manifest: which commit's folder holds each bucket. The manifest is one file that appears
by one rename, so a reader sees the store before or after an upsert and never between; files of a commit without a manifest
are never read.

Of two rows of a chunk the one of the higher version wins, whatever order they come in; at equal versions the one that is
deleted, then the one with the greater hash of its content. So the store is the same after the same upserts in any order
and however often each is repeated. A deleted row is kept as a mark, so that an older row that comes late stays deleted.

One writer at a time: two that commit at once would both extend the same manifest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chunk_id string, version long, document_id string, embedding array<float>, deleted boolean"
MANIFEST = "commit long, bucket int, at long"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def manifest(self, commit: int | None = None) -> tuple[int, dict[int, int]]:
        """The latest commit, or the one asked for (0: nothing yet), and the commit whose folder holds each bucket."""
        rows = self._manifests()
        last = commit if commit is not None else rows.agg(F.max("commit")).first()[0] or 0
        return last, {r.bucket: r.at for r in rows.where(F.col("commit") == last).collect()}  # at most one row for each bucket

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(self.buckets)).cast("int")

    def _read(self, where: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/commit={at}/bucket={bucket}" for bucket, at in sorted(where.items())]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/data").parquet(*folders).select(*SCHEMA_COLUMNS)

    def upsert(self, rows: DataFrame) -> int:
        """Merge `rows` (chunk_id, version, document_id, embedding and maybe deleted) and return the commit.

        Rows without a chunk_id have no key and are left out; a null version counts as 0, a null `deleted` as false. Repeated
        rows count once. An empty batch makes no commit.
        """
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False)
        given = rows.where("chunk_id is not null").select(
            F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"),
            F.col("document_id").cast("string").alias("document_id"), F.col("embedding").cast("array<float>").alias("embedding"), deleted.alias("deleted"),
        )
        commit, where = self.manifest()
        touched = sorted(r.bucket for r in given.select(self._bucket().alias("bucket")).distinct().collect())
        if not touched:
            return commit
        old = self._read({b: where[b] for b in touched if b in where})
        merged = latest(given.unionByName(old)).withColumn("bucket", self._bucket())
        new = commit + 1
        # A folder left by a writer that died before its manifest is written over.
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/commit={new}")
        entries = [(new, b, at) for b, at in {**where, **dict.fromkeys(touched, new)}.items()]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return new

    def read(self, commit: int | None = None) -> DataFrame:
        """chunk_id, version, document_id, embedding as of the latest commit, or of an earlier one, without deleted rows."""
        return self._read(self.manifest(commit)[1]).where("not deleted").drop("deleted")

    def delete_document(self, document_id: str, version: int) -> int:
        """Mark all chunks of a document as deleted as of a version; later versions of them live on."""
        own = self.read().where(F.col("document_id") == document_id)
        return self.upsert(own.select("chunk_id", F.lit(version).alias("version"), "document_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit(True).alias("deleted")))


SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def latest(rows: DataFrame) -> DataFrame:
    """One row for each chunk_id: the highest version, then deleted before not, then the greatest hash.

    An aggregate keeps the best row in each task before the shuffle: a chunk written a billion times is no hot key.
    """
    order = F.struct("version", "deleted", F.xxhash64("document_id", "embedding").alias("hash"))
    best = rows.groupBy("chunk_id").agg(F.max_by(F.struct("version", "document_id", "embedding", "deleted"), order).alias("r"))
    return best.select("chunk_id", "r.version", "r.document_id", "r.embedding", "r.deleted")
