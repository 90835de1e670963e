"""CSV files of every kind: classification (A4), records, catalog (A3) and the stream."""
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerspark.sources import ingest as A
from ledgerspark.streaming.ingest_stream import ingest_stream

#: name -> (content, status, rows, columns); statuses, rows and columns as a CSV parser of
#: data frames gives them for whole files
FILES = {
    "good.csv": (b'Date,Description,Amount\n2024-01-01,"A, B",-1\n\n2024-01-02,x,2\n', "accepted", 2, 3),
    "breaks.csv": (b'Date,Description,Amount\r\n2024-01-01,"A\nB ""q"" , c",-1\r\n2024-01-02,x,2\r\n', "accepted", 2, 3),
    "short.csv": (b"Date,Description,Amount\n2024-01-01,A\n2024-01-02,x,2\n", "accepted", 2, 3),
    "long.csv": (b"Date,Description,Amount\n2024-01-01,A,1\n2024-01-02,x,2,3\n", "unparsable CSV", None, None),
    "names.csv": (b"Description,Amount\n2024-01-01,A,1\n2024-01-02,x,2\n", "accepted", 2, 2),
    "open.csv": (b'Date,Description,Amount\n2024-01-01,A,1\n2024-01-02,"x,2\n2024-01-03,y,3\n', "unparsable CSV", None, None),
    "inch.csv": (b'Date,Description,Amount\n2024-01-01,5" pipe,1\n2024-01-02,6" x,2\n', "accepted", 2, 3),
    "blank.csv": (b"\n \n\t\n", "empty file", None, None),
    "one.csv": (b'Amount\n1\n"2\n3"\n', "accepted", 2, 1),
    "tail.csv": (b'Description,Amount\n"x"y,2\n,3\n', "accepted", 2, 2),
    "header.csv": (b"Date,Description,Amount\n", "accepted", 0, 3),
    "latin.csv": ("Date,Description,Amount\n2024-01-01,CAF\xc9,-1\n".encode("latin-1"), "not UTF-8 text", None, None),
    "UPPER.CSV": (b"Date,Description,Amount\n2024-01-01,A,1\n", "not a CSV file", None, None),
    "notes.txt": (b"hello", "not a CSV file", None, None),
    "sub/deep one.csv": (b"Amount,Date,Memo\n$5,2024-01-03,z\n", "accepted", 1, 3),
}


@pytest.fixture
def uploads(tmp_path):
    for name, (content, *_) in FILES.items():
        os.makedirs(os.path.dirname(tmp_path / "up" / name), exist_ok=True)
        (tmp_path / "up" / name).write_bytes(content)
    return str(tmp_path / "up")


def test_classify_every_kind(spark, uploads):
    got = {r.path.split("/up/")[1]: (r.status, r.rows, r.columns) for r in A.classify_files(spark, uploads).collect()}
    assert got == {name: tuple(v[1:]) for name, v in FILES.items()}


def test_classification_equals_the_data_frame_parser(spark, uploads):
    import io

    import pandas as pd
    got = {r.path.split("/up/")[1]: r for r in A.classify_files(spark, uploads).collect()}
    for name, (content, status, *_) in FILES.items():
        if not name.endswith(".csv"):
            continue
        try:
            df = pd.read_csv(io.StringIO(content.decode()))
            assert (got[name].status, got[name].rows, got[name].columns) == ("accepted", len(df), len(df.columns)), name
        except UnicodeDecodeError:
            assert status == "not UTF-8 text"
        except pd.errors.EmptyDataError:
            assert status == "empty file"
        except pd.errors.ParserError:
            assert status == "unparsable CSV"


def test_records_and_rows(spark, uploads):
    recs = A.csv_records(spark, uploads)
    by = {}
    for r in recs.orderBy("pos").collect():
        by.setdefault(r.path.split("/up/")[1], []).append(r.fields)
    assert by["breaks.csv"][1] == ["2024-01-01", 'A\nB "q" , c', "-1"]
    assert by["tail.csv"][1:] == [["xy", "2"], [None, "3"]]
    assert by["inch.csv"][1][1] == '5" pipe' and by["one.csv"] == [["Amount"], ["1"], ["2\n3"]]
    rows = A.parse_records(recs)
    got = {(r.account_id, str(r.txn_date), r.description, str(r.amount)) for r in rows.collect()}
    assert ("breaks", "2024-01-01", 'A\nB "q" , c', "-1.00") in got
    assert ("deep one", "2024-01-03", "z", "5.00") in got and ("short", "2024-01-01", "A", "None") in got
    assert not any(a == "header" for a, *_ in got)


def test_catalog_counts_nested_files(spark, uploads):
    rows = {r.account_id: r.rows for r in A.file_catalog(spark, uploads).collect()}
    assert rows["deep one"] == 1 and rows["breaks"] == 2 and rows["blank"] == 0 and rows["header"] == 0


def run(spark, base, **kw):
    q = ingest_stream(spark, base + "/up", base + "/ledger", base + "/registry", base + "/ckpt", **kw)
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(base + "/ledger"), spark.read.parquet(base + "/registry")


def test_stream_restarts_retries_and_duplicates(spark, uploads, tmp_path):
    base = str(tmp_path)
    ledger, registry = run(spark, base, max_files=4)          # several batches
    want = {n for n, v in FILES.items() if v[1] == "accepted" and "/" not in n}
    assert {r.filename for r in registry.collect()} == want
    assert ledger.count() == sum(FILES[n][2] for n in want)
    assert 'A\nB "q" , c' in {r.description for r in ledger.collect()}
    # the same bytes again, in a later run and twice in one batch: nothing new but one file
    (tmp_path / "up" / "again.csv").write_bytes(FILES["good.csv"][0])
    for k, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / "up" / name).write_bytes(b"Date,Description,Amount\n2024-02-01,new,7\n")
        os.utime(tmp_path / "up" / name, (time.time(), 1_700_000_000 + k))
    ledger, registry = run(spark, base)
    assert ledger.count() == sum(FILES[n][2] for n in want) + 1
    assert {r.filename for r in registry.collect()} == want | {"b.csv"}     # the earlier of the two
    # a batch whose commit was lost runs again and writes the same rows
    before = sorted(map(str, ledger.collect()))
    commits = tmp_path / "ckpt" / "commits"
    last = max((p for p in os.listdir(commits) if p.isdigit()), key=int)
    for p in (last, f".{last}.crc"):
        if os.path.exists(commits / p):
            os.remove(commits / p)
    ledger, registry = run(spark, base)
    assert sorted(map(str, ledger.collect())) == before and registry.count() == len(want) + 1
    # batches need neither the old ledger nor the old registry
    assert registry.select("sha256").distinct().count() == registry.count()
    (tmp_path / "up" / "later.csv").write_bytes(b"Date,Description,Amount\n2024-03-01,late,9\n")
    q = ingest_stream(spark, base + "/up", base + "/ledger2", base + "/registry2", base + "/ckpt")
    q.awaitTermination(240)
    assert [r.description for r in spark.read.parquet(base + "/ledger2").filter(F.col("description").isNotNull()).collect()] == ["late"]
