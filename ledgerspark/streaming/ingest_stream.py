"""Continuous ingest of uploaded ledger files (re-aim of the upload route).

``readStream`` over a folder of arriving files (binaryFile source) -> SHA-256 of the bytes
-> streaming aggregation keyed by that hash: the state store holds, for each hash ever seen,
when and under which path it came first, so a file is new exactly when its hash came first
in this batch. Duplicates are found by the key's state alone; no batch reads the registry
or the ledger, so its cost depends on its own files only. Of equal files of one batch the
earliest (time, path) is kept.

``foreachBatch`` gets the hashes touched by a batch. The new files, at most
``max_files`` of them, are read by Spark's CSV reader (A4 classification and B1-B3 parsing
on records, with quoted commas and line breaks) and those accepted are added to the ledger
and the registry. Each batch overwrites its own ``batch_id=<n>`` folders, so a batch that
is retried after a lost executor or driver writes the same rows again, not a second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import REGISTRY_SCHEMA, _account_of, csv_records, judge_records, parse_records

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
LEDGER_SCHEMA = "account_id string, txn_date date, description string, amount decimal(18,2)"
MAX_FILES = 1000                # of a micro-batch


def first_seen(files: DataFrame) -> DataFrame:
    """Per content hash (streaming, update mode): ``first`` (batch time, modification time,
    path) of all times, ``last`` batch time and the number of files so far."""
    # the time is one value for a whole batch, kept for its retries
    seen = files.select(F.sha2("content", 256).alias("sha256"), F.current_timestamp().alias("batch_time"),
                        "modificationTime", "path")
    return seen.groupBy("sha256").agg(F.min(F.struct("batch_time", "modificationTime", "path")).alias("first"),
                                      F.max("batch_time").alias("last"), F.count(F.lit(1)).alias("files"))


def ingest_stream(spark: SparkSession, source_dir: str, ledger_path: str, registry_path: str,
                  checkpoint: str, date_format: str = "yyyy-MM-dd", available_now: bool = True,
                  max_files: int = MAX_FILES, max_age: str = "3650d",
                  account_from: str = "file") -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops. Files that are
    not ``.csv``, not UTF-8, empty or unparsable leave no row and no registry entry. A file
    may have been written up to ``max_age`` before the newest: the source passes over older
    ones, and keeps the names of all others in mind."""
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files)
              .option("maxFileAge", max_age).load(source_dir)
              .filter(F.is_valid_utf8(F.col("content").cast("string"))))

    def batch(df: DataFrame, epoch_id: int) -> None:
        sp = df.sparkSession
        new = (df.filter(F.col("first.batch_time") == F.col("last"))
               .select("sha256", "first.path", "first.modificationTime").collect())       # max_files at most
        files = sp.createDataFrame(new, "sha256 string, path string, upload_time timestamp")
        folder = f"batch_id={epoch_id}"
        if new:
            # read the files once; what is kept of them comes from this copy
            copy = f"{checkpoint.rstrip('/')}/records/{folder}"
            csv_records(sp, [r.path for r in new]).write.mode("overwrite").parquet(copy)
            records = sp.read.parquet(copy)
            accepted = judge_records(records).filter(~F.col("broken")).select("path")
            rows = parse_records(records.join(accepted, "path", "left_semi"), date_format, account_from).drop("path")
            files = files.join(accepted, "path", "left_semi")
        else:
            rows = sp.createDataFrame([], LEDGER_SCHEMA)
        rows.write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/{folder}")
        (files.select("sha256", _account_of(F.col("path"), account_from).alias("account_id"),
                      F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "upload_time")
         .to(sp.createDataFrame([], REGISTRY_SCHEMA).schema)
         .write.mode("overwrite").parquet(f"{registry_path.rstrip('/')}/{folder}"))

    writer = (first_seen(stream).writeStream.outputMode("update").foreachBatch(batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
