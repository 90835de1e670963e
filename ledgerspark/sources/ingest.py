"""Ledger files: reading, file registry, dedup, classification, export.

A ledger upload is a CSV file whose name (without ``.csv``) is its account id.
Files of different layouts (column names) are read per layout: a distributed
header probe reads only the first line of every file, the driver groups the
files by distinct header -- bounded by the number of layouts, not files --
and each group goes through Spark's splittable CSV reader, so one huge file
is still read in parallel. Column roles are then found on each layout's
header (B1) and every group is cast into the canonical schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import (
    AMOUNT_KEYWORDS, DATE_KEYWORDS, DESCRIPTION_KEYWORDS, detect_role, parse_date, parse_money,
)

ACCOUNT_FROM_NAME = r"^(.*?)(\.[cC][sS][vV])?$"
CANONICAL = ["account_id", "txn_date", "description", "amount"]


def account_id_of(path_col) -> F.Column:
    """File name without the ``.csv`` extension."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    return F.regexp_extract(name, ACCOUNT_FROM_NAME, 1)


def _plain_path(path_col) -> F.Column:
    """``_metadata.file_path`` is percent-encoded; the plain path, as listed."""
    return F.url_decode(F.replace(path_col, F.lit("+"), F.lit("%2B")))


# ---------------------------------------------------------------------------
# A3 catalog (no content read)
# ---------------------------------------------------------------------------

def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of every file; the binaryFile source
    prunes the content column when it is not selected."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A3: one row per stored ledger, in sub-folders too: account id, file name, time,
    size, rows (records after the header; one with quoted line breaks is one)."""
    files = list_files(spark, path, "*.csv")
    rows = csv_records(spark, path).groupBy("path").agg((F.count(F.lit(1)) - 1).alias("rows"))
    return (files.join(rows, "path", "left")
            .select(account_id_of("path").alias("account_id"),
                    F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                    F.col("modificationTime").alias("upload_time"),
                    F.col("length").alias("size_bytes"),
                    F.coalesce("rows", F.lit(0)).alias("rows")))


# ---------------------------------------------------------------------------
# CSV records
# ---------------------------------------------------------------------------

# A field with the comma before it: quoted (text after the closing quote belongs to it),
# opened by a quote that is never closed, or plain.
CSV_FIELD = r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|"[\s\S]*+|[^,"][^,]*+|(?=,|$))'
CSV_QUOTED = r'^,"([^"]*+(?:""[^"]*+)*+)"([\s\S]*)$'


def csv_records(spark: SparkSession, paths: str | list[str], glob: str = "*.csv") -> DataFrame:
    """(path, pos, fields, open): the records of CSV files of any layout, blank ones left
    out. ``pos`` rises by one from record to record of a file, so its smallest is the
    header's; ``fields`` are the texts, null where empty; ``open`` tells of a quote that
    is never closed. Spark's reader finds the records, a file at a time and as a stream, so
    line breaks in quotes and files of any size are well; each record that has not just one
    field is, for a schema of one column, a corrupt one, whose text it hands out whole."""
    read = (spark.read.schema("one string, raw string").option("columnNameOfCorruptRecord", "raw")
            .option("mode", "PERMISSIVE").option("multiLine", True).option("header", False)
            .option("escape", '"').option("maxColumns", 100_000)
            .option("recursiveFileLookup", True).option("pathGlobFilter", glob))
    raw = read.csv(paths).select(_plain_path(F.col("_metadata.file_path")).alias("path"), "one", "raw")
    raw = (raw.filter(F.coalesce("raw", "one").rlike(r"[^ \t\r\n]"))
           .withColumn("pos", F.monotonically_increasing_id()))
    parts = F.regexp_extract_all(F.concat(F.lit(","), "raw"), F.lit(CSV_FIELD), F.lit(0))

    def value(f):
        quoted = F.concat(F.replace(F.regexp_extract(f, CSV_QUOTED, 1), F.lit('""'), F.lit('"')),
                          F.regexp_extract(f, CSV_QUOTED, 2))
        return F.nullif(F.when(f.startswith(',"'), quoted).otherwise(F.substr(f, F.lit(2))), F.lit(""))

    unclosed = F.exists(parts, lambda f: f.startswith(',"') & ~f.rlike(CSV_QUOTED))
    return raw.select(
        "path", "pos",
        F.when(F.col("raw").isNull(), F.array("one")).otherwise(F.transform(parts, value)).alias("fields"),
        F.when(F.col("raw").isNull(), F.col("one").startswith('"')).otherwise(unclosed).alias("open"))


# ---------------------------------------------------------------------------
# A1 read
# ---------------------------------------------------------------------------

def _first_line(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header probe: read only the first line of each file (any pyarrow
    filesystem: local, HDFS, object stores)."""
    from pyarrow import fs as pafs
    for pdf in paths:
        heads = []
        for p in pdf["path"]:
            if p.startswith("file:"):                      # file:/x, file:///x -> /x
                filesystem, inner = pafs.LocalFileSystem(), "/" + p[len("file:"):].lstrip("/")
            else:
                filesystem, inner = pafs.FileSystem.from_uri(p)
            buf = b""
            with filesystem.open_input_stream(inner) as f:
                while b"\n" not in buf:                   # read on until the header line ends
                    chunk = f.read(1 << 16)
                    if not chunk:
                        break
                    buf += chunk
            heads.append(buf.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace"))
        yield pd.DataFrame({"path": pdf["path"], "header": heads})


def file_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    return list_files(spark, path, glob).select("path").mapInPandas(
        _first_line, "path string, header string")


def _account_of(path_col, account_from: str) -> F.Column:
    if account_from == "partition":                    # .../account_id=<id>/part-*.csv
        return F.regexp_extract(path_col, r"account_id=([^/]+)/", 1)
    return account_id_of(path_col)


def _canonical(df: DataFrame, date_format: str, pick: str, strip_symbols: bool = True,
               account_from: str = "file") -> DataFrame:
    roles = {
        "amount": detect_role(df.columns, AMOUNT_KEYWORDS, pick),
        "date": detect_role(df.columns, DATE_KEYWORDS, pick),
        "description": detect_role(df.columns, DESCRIPTION_KEYWORDS, pick),
    }
    amt = parse_money(F.col(f"`{roles['amount']}`"), strip_symbols) if roles["amount"] \
        else F.lit(None).cast("decimal(18,2)")
    dt = parse_date(F.col(f"`{roles['date']}`"), date_format) if roles["date"] else F.lit(None).cast("date")
    desc = F.col(f"`{roles['description']}`").cast("string") if roles["description"] \
        else F.lit(None).cast("string")
    return df.select(_account_of(_plain_path(F.col("_metadata.file_path")), account_from).alias("account_id"),
                     dt.alias("txn_date"), desc.alias("description"), amt.alias("amount"))


def read_ledgers(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd",
                 pick: str = "first", account_from: str = "file") -> DataFrame:
    """A1: every ``*.csv`` under ``path`` in the canonical schema
    (account_id, txn_date, description, amount). All columns are read as
    strings (no inference); roles come from each layout's header. The account
    id is the file name (``account_from='file'``, one upload per account) or
    the ``account_id=`` folder written by :func:`export_csv`
    (``account_from='partition'``)."""
    heads = file_headers(spark, path).groupBy("header").agg(F.collect_list("path").alias("paths"))
    layouts = heads.collect()                       # one row per distinct header
    parts = [
        _canonical(spark.read.option("header", True).option("mode", "PERMISSIVE")
                   .option("enforceSchema", False).csv(r["paths"]), date_format, pick,
                   account_from=account_from)
        for r in layouts
    ]
    if not parts:
        return spark.createDataFrame([], "account_id string, txn_date date, description string, "
                                         "amount decimal(18,2)")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# A2 / A4 registry, dedup, classification
# ---------------------------------------------------------------------------

REGISTRY_SCHEMA = "sha256 string, account_id string, filename string, upload_time timestamp"


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, filename, account_id, length, modificationTime, content, sha256)."""
    b = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", "true").load(path))
    return b.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
                    account_id_of("path").alias("account_id"), "length", "modificationTime",
                    "content", F.sha2("content", 256).alias("sha256"))


def judge_records(records: DataFrame) -> DataFrame:
    """(path, columns, rows, broken) of each file's :func:`csv_records`. A file is broken
    when a quote is never closed or a record is wider than the header and the first row
    (a wider first row brings row names); shorter records are filled up."""
    first = F.struct("pos", F.size("fields").alias("n"))
    # the header and the first row follow one another, so one has an odd number
    even, odd = (F.min(F.when(F.col("pos") % 2 == k, first)) for k in (0, 1))
    return (records.groupBy("path").agg(even.alias("e"), odd.alias("o"), F.max(F.size("fields")).alias("widest"),
                                        F.bool_or("open").alias("open"), F.count(F.lit(1)).alias("n"))
            .select("path", F.least("e", "o")["n"].alias("columns"), (F.col("n") - 1).alias("rows"),
                    (F.col("open") | (F.col("widest") > F.greatest("e.n", "o.n"))).alias("broken")))


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """A4: every file under ``path`` with status ``accepted`` or the first reason against it
    (not a CSV file, not UTF-8 text, empty file, unparsable CSV), and the rows and columns
    of accepted ones. Names decide case-sensitively, as uploads do. Nothing is held per
    file: bytes are checked line by line, records as Spark's CSV reader streams them.
    Spark's file listing skips zero-byte files, so ``empty file`` is what a listed file
    without a record gets."""
    files = list_files(spark, path)
    utf8 = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
            .select(_plain_path(F.col("_metadata.file_path")).alias("path"), F.is_valid_utf8("value").alias("ok"))
            .groupBy("path").agg(F.bool_and("ok").alias("utf8")))
    found = files.join(utf8, "path", "left").join(judge_records(csv_records(spark, path)), "path", "left")
    filename = F.regexp_extract("path", r"([^/]*)$", 1)
    status = (F.when(~filename.endswith(".csv"), F.lit("not a CSV file"))
               .when(~F.coalesce("utf8", F.lit(True)), F.lit("not UTF-8 text"))
               .when(F.col("columns").isNull(), F.lit("empty file"))
               .when(F.col("broken"), F.lit("unparsable CSV"))
               .otherwise(F.lit("accepted")))
    return found.select(
        "path", filename.alias("filename"), account_id_of("path").alias("account_id"),
        "length", "modificationTime", status.alias("status"),
        F.when(status == "accepted", F.col("rows")).alias("rows"),
        F.when(status == "accepted", F.col("columns")).alias("columns"))


def _role_index(header, keywords) -> F.Column:
    """1-based position of the first header field that contains a keyword (0: none)."""
    hits = F.transform(header, lambda c: F.exists(F.array(*[F.lit(k) for k in keywords]),
                                                  lambda k: F.coalesce(F.instr(F.lower(c), k) > 0, F.lit(False))))
    return F.array_position(hits, True)


def parse_records(records: DataFrame, date_format: str = "yyyy-MM-dd", account_from: str = "file") -> DataFrame:
    """(path, account_id, txn_date, description, amount) of the rows of :func:`csv_records`;
    each file's header, its first record, decides which field holds which role (B1). The
    account is named as in :func:`read_ledgers`."""
    header = records.groupBy("path").agg(F.min(F.struct("pos", "fields")).alias("h"))
    roles = header.select("path", F.col("h.pos").alias("_header"),
                          *[_role_index(F.col("h.fields"), words).alias(f"_{role}") for role, words in
                            (("date", DATE_KEYWORDS), ("description", DESCRIPTION_KEYWORDS), ("amount", AMOUNT_KEYWORDS))])
    rows = records.join(roles, "path").filter(F.col("pos") > F.col("_header"))

    def field(role):
        return F.when(F.col(f"_{role}") > 0, F.get("fields", F.col(f"_{role}").cast("int") - 1))
    return rows.select("path", _account_of(F.col("path"), account_from).alias("account_id"),
                       parse_date(field("date"), date_format).alias("txn_date"),
                       field("description").alias("description"), parse_money(field("amount")).alias("amount"))


def dedup_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """A2: same bytes twice -> keep the earliest (time, path) upload; a hash
    already in the registry returns the existing account id. Partial
    aggregation per hash (no window): a hash uploaded a million times costs
    one partial row per map task."""
    first = (files.groupBy("sha256")
             .agg(F.min(F.struct("modificationTime", "path")).alias("_f"))
             .select("sha256", F.col("_f.path").alias("_first_path")))
    known = registry.select("sha256", F.col("account_id").alias("existing_account_id"))
    j = files.join(first, "sha256").join(known, "sha256", "left")
    dup = F.col("existing_account_id").isNotNull() | (F.col("path") != F.col("_first_path"))
    first_id = F.when(F.col("existing_account_id").isNotNull(), F.col("existing_account_id")) \
                .otherwise(account_id_of(F.col("_first_path")))
    return j.select("path", "filename", "account_id", "sha256", "modificationTime",
                    dup.alias("is_duplicate"),
                    F.when(dup, first_id).alias("duplicate_of"))


def register(new_files: DataFrame) -> DataFrame:
    """Registry rows for accepted, non-duplicate files."""
    return new_files.select("sha256", "account_id", "filename",
                            F.col("modificationTime").alias("upload_time"))


# ---------------------------------------------------------------------------
# A5 / A6
# ---------------------------------------------------------------------------

def remove_account(files: DataFrame, txn: DataFrame, account_id: str) -> tuple[DataFrame, DataFrame]:
    """A5: drop one account from the registry and the ledger."""
    return (files.filter(F.col("account_id") != account_id),
            txn.filter(F.col("account_id") != account_id))


def export_csv(txn: DataFrame, path: str) -> None:
    """Write the transactions back as CSV, one folder per account. No
    shuffle: every task writes its own rows of each account (a hot account
    becomes many files, not one big task)."""
    (txn.withColumn("amount", F.col("amount").cast("string"))
        .write.mode("overwrite").partitionBy("account_id").option("header", True).csv(path))
