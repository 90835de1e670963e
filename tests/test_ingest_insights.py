"""File ingest (batch + stream), insight facts and card validation."""

import json
import os

from pyspark.sql import functions as F

from ledgerspark.operators import insights as N
from ledgerspark.sources import ingest as A
from ledgerspark.streaming.ingest_stream import ingest_stream


def write_uploads(folder):
    os.makedirs(folder, exist_ok=True)
    files = {
        "acc1.csv": 'Date,Description,Amount\n2024-01-01,NETFLIX,-15.49\n'
                    '2024-01-05,"AMAZON, INC","$1,234.50"\n2024-02-01,NETFLIX,-15.49\n',
        "acc2.csv": "Transaction Date,Memo,Debit,Credit\n2024-01-03,COFFEE,-4.5,\n2024/01/04,TEA,(5),\n",
        "blank.csv": "\n\n",
        "notes.txt": "hello",
    }
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    with open(os.path.join(folder, "acc3.csv"), "w") as f:          # same bytes as acc1
        f.write(files["acc1.csv"])
    with open(os.path.join(folder, "latin.csv"), "wb") as f:
        f.write("Date,Description,Amount\n2024-01-01,CAF\xe9,-1\n".encode("latin-1"))


def test_read_classify_dedup_export(spark, tmp_path):
    up = str(tmp_path / "uploads")
    write_uploads(up)
    rows = {(r.account_id, str(r.txn_date), r.description, r.amount)
            for r in A.read_ledgers(spark, up).collect()}
    assert ("acc1", "2024-01-05", "AMAZON, INC", 1234.5) in {(a, d, s, float(m) if m is not None else None)
                                                             for a, d, s, m in rows}
    acc2 = {(d, s, m) for a, d, s, m in rows if a == "acc2"}
    assert ("None", "TEA", None) in acc2                     # second date format, "(5)" -> NULL
    files = A.hash_files(spark, up)
    status = {r.filename: r.status for r in A.classify_files(spark, up).collect()}
    assert status["acc1.csv"] == "accepted" and status["notes.txt"] == "not a CSV file"
    assert status["blank.csv"] == "empty file" and status["latin.csv"] == "not UTF-8 text"
    reg = spark.createDataFrame([], A.REGISTRY_SCHEMA)
    d = {r.filename: r for r in A.dedup_files(files, reg).collect()}
    assert d["acc3.csv"].is_duplicate and d["acc3.csv"].duplicate_of == "acc1"
    assert not d["acc1.csv"].is_duplicate
    # a hash already registered keeps its registered id
    reg = A.register(A.dedup_files(files, reg).filter(F.col("filename") == "acc1.csv")
                     .select("sha256", F.lit("old-id").alias("account_id"), "filename", "modificationTime"))
    d2 = {r.filename: r for r in A.dedup_files(files, reg).collect()}
    assert d2["acc1.csv"].is_duplicate and d2["acc1.csv"].duplicate_of == "old-id"
    cat = {r.account_id: r for r in A.file_catalog(spark, up).collect()}
    assert cat["acc1"].rows == 3 and cat["acc2"].rows == 2
    led = A.read_ledgers(spark, up)
    kept_files, kept = A.remove_account(files, led, "acc2")
    assert kept.filter(F.col("account_id") == "acc2").count() == 0
    out = str(tmp_path / "export")
    A.export_csv(kept, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == kept.count()


def test_stream_ingest(spark, tmp_path):
    up = str(tmp_path / "uploads")
    write_uploads(up)
    base = str(tmp_path)
    q = ingest_stream(spark, up, base + "/ledger", base + "/registry", base + "/ckpt")
    q.awaitTermination(180)
    led = spark.read.parquet(base + "/ledger")
    assert sorted(r.account_id for r in led.select("account_id").distinct().collect()) == ["acc1", "acc2"]
    assert led.count() == 5
    with open(os.path.join(up, "acc9.csv"), "w") as f:
        f.write("Date,Description,Amount\n2024-03-01,GYM,-39.99\n")
    with open(os.path.join(up, "acc10.csv"), "w") as f:
        f.write(open(os.path.join(up, "acc1.csv")).read())
    q = ingest_stream(spark, up, base + "/ledger", base + "/registry", base + "/ckpt")
    q.awaitTermination(180)
    led = spark.read.parquet(base + "/ledger")
    assert led.count() == 6 and led.filter(F.col("account_id") == "acc10").count() == 0


def card(**kw):
    c = {"kind": "cashflow", "title": "t", "summary": "s", "impact": 1.5, "period": "Last 30d",
         "metrics": {"a": 1}, "cta": None}
    c.update(kw)
    return c


def test_validate_cards(spark):
    good = json.dumps({"cards": [card(), card(kind="merchant", impact=None)]})
    no_cta = json.dumps({"cards": [{k: v for k, v in card().items() if k != "cta"}]})
    bad = {
        "kind": json.dumps({"cards": [card(kind="weather")]}),
        "title": json.dumps({"cards": [card(title="x" * 121)]}),
        "metrics": json.dumps({"cards": [{k: v for k, v in card().items() if k != "metrics"}]}),
        "extra": json.dumps({"cards": [card()], "note": 1}),
        "notjson": "Here are your cards: ...",
        "impact": json.dumps({"cards": [card(impact="big")]}),
        "titletype": json.dumps({"cards": [card(title=5)]}),
    }
    rows = [("good", good), ("no_cta", no_cta), ("empty", json.dumps({"cards": []}))] + list(bad.items())
    df = spark.createDataFrame(rows, "id string, payload string")
    got = {r.id: (r.valid, len(r.cards)) for r in N.validate_cards(df).collect()}
    assert got["good"] == (True, 2) and got["no_cta"] == (True, 1) and got["empty"] == (True, 0)
    for k in bad:
        assert got[k] == (False, 0), k
    c = N.validate_cards(df).filter(F.col("id") == "good").first().cards[0]
    assert c.kind == "cashflow" and json.loads(c.metrics) == {"a": 1}


def test_insight_facts(spark, ledger):
    rows = [("a", "2024-03-31", "CAFE", -5.0, "Coffee"), ("a", "2024-03-30", "CAFE", -5.0, "Coffee"),
            ("a", "2024-03-30", "PAY", 100.0, "Income"), ("a", "2024-02-20", "BAR", -50.0, "Bars"),
            ("a", "2024-03-10", "BAR", -10.0, "Bars")]
    f = N.insight_facts(ledger(rows)).first()
    assert f.time_range == "Last 30d" and f.income == 100.0 and f.expenses == 20.0
    assert [d.category for d in f.category_deltas] == ["Bars", "Coffee"]     # |delta| 40 > 10
    assert f.top_merchants[0].merchant == "CAFE" and f.subs_summary == []
    flat = N.insight_fact_rows(N.insight_facts(ledger(rows)))
    assert flat.filter(F.col("section") == "category_delta").count() == 2
