"""File names with a blank, a plus or a percent sign name the same account everywhere."""
from ledgerspark.sources import ingest

NAMES = ("my bank", "a+b", "50%20x", "plain")


def test_one_account_name_per_file(spark, tmp_path):
    for name in NAMES:
        (tmp_path / f"{name}.csv").write_text("Date,Description,Amount\n2024-01-01,x,1.00\n2024-01-02,y,2.00\n")
    got = {r.account_id: r.rows for r in ingest.file_catalog(spark, str(tmp_path)).collect()}
    assert got == {name: 2 for name in NAMES}
    assert {r.account_id for r in ingest.read_ledgers(spark, str(tmp_path)).collect()} == set(NAMES)
