from decimal import Decimal

from pyspark.sql import functions as F

from ledgerspark.functions import clean as C
from ledgerspark.functions.numeric import round_cents


def test_parse_money_edge_cases(spark):
    vals = ["$1,234.50", "-$5", "(5)", " 7 ", "", "nan", "inf", None, "1e3", "0", "12.345"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(C.parse_money("v")).collect()]
    assert got == [Decimal("1234.50"), Decimal("-5.00"), None, Decimal("7.00"), None, None, None,
                   None, Decimal("1000.00"), Decimal("0.00"), Decimal("12.35")]


def test_parse_money_without_stripping(spark):
    df = spark.createDataFrame([("$5",), ("-5",)], "v string")
    assert [r[0] for r in df.select(C.parse_money("v", strip_symbols=False)).collect()] == \
        [None, Decimal("-5.00")]


def test_parse_date_single_format(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024/01/05",), ("junk",), (None,)], "v string")
    got = [r[0] for r in df.select(C.parse_date("v")).collect()]
    assert str(got[0]) == "2024-01-05" and got[1:] == [None, None, None]


def test_detect_roles_first_and_last():
    cols = ["Transaction Date", "Post Date", "Description", "Debit", "Credit", "Merchant"]
    first = C.detect_roles(cols, "first")
    last = C.detect_roles(cols, "last")
    assert first == {"amount": "Debit", "date": "Transaction Date", "description": "Description"}
    assert last == {"amount": "Credit", "date": "Post Date", "description": "Merchant"}
    assert C.detect_role(["x", "y"], C.AMOUNT_KEYWORDS) is None


def test_normalize_description(spark):
    cases = {
        "POS 1234 STARBUCKS COFFEE #1234": "STARBUCKS COFFEE",
        "AMAZON.COM PURCHASE 01/02/2024": "AMAZON COM PURCHASE",
        "SHELL GAS STATION - AUSTIN TX": "SHELL GAS STATION AUSTIN",
        "WHOLE FOODS USA": "WHOLE FOODS",
        "MCDONALD'S  #55": "MCDONALD'S",
        # a two-letter state code is removed wherever it stands as a word,
        # even inside a name ('IN', 'ME'); inside a longer word it stays
        "SHOP IN STORE PAY ME": "SHOP STORE PAY",
        "PLAZA LAKE": "PLAZA LAKE",
        None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = [r[0] for r in df.select(C.normalize_description("v")).collect()]
    assert got == list(cases.values())


def test_normalize_merchant_and_category(spark):
    df = spark.createDataFrame([("Disney+  Plus!",), ("  spotify.com ",)], "v string")
    assert [r[0] for r in df.select(C.normalize_merchant("v")).collect()] == ["DISNEY+ PLUS", "SPOTIFYCOM"]
    df = spark.createDataFrame([("Other",), ("Uncategorized",), ("Coffee",)], "v string")
    assert [r[0] for r in df.select(C.normalize_category("v")).collect()] == \
        ["Uncategorized", "Uncategorized", "Coffee"]


def test_exclude_category_forms(spark):
    df = spark.createDataFrame([("Rent",), ("Parents",), ("Groceries",), (None,)], "category string")
    kept_contains = sorted(str(r[0]) for r in C.exclude_category(df, "rent", "contains").collect())
    kept_equals = sorted(str(r[0]) for r in C.exclude_category(df, "rent", "equals").collect())
    assert kept_contains == ["Groceries", "None"]
    assert kept_equals == ["Groceries", "None", "Parents"]


def test_json_safe_and_round_cents(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    r = C.json_safe(df).first()
    assert r.a is None and r.b is None and r.c == 1.5
    df = spark.createDataFrame([(275.655,), (2.675,), (1.005,), (-0.125,), (1234.5678,)], "x double")
    got = [r[0] for r in df.select(round_cents("x")).collect()]
    # binary value rounding like Python's round(): 275.655 is 275.65499... -> .65
    # (F.round would give .66). Known difference: when x*100 itself lands on
    # an exact .5 (2.675*100 == 267.5, -0.125*100 == -12.5) ties go away from
    # zero, where Python rounds the unscaled value (2.67) or to even (-0.12).
    assert got == [275.65, 2.68, 1.0, -0.13, 1234.57]
    assert [r[0] for r in df.select(F.round("x", 2)).collect()][0] == 275.66


def test_json_safe_nested(spark):
    df = spark.sql("""SELECT array(double('NaN'), 1.5D) AS a, named_struct('x', double('Infinity'), 'd', date'2024-01-02') AS s,
                      map('k', array(named_struct('v', double('-Infinity')))) AS m, cast(null AS struct<x: double>) AS n,
                      cast(array() AS array<double>) AS e, 3 AS `odd.name`""")
    r = C.json_safe(df).first()
    assert r.a == [None, 1.5] and r.s.x is None and r.s.d == "2024-01-02"
    assert r.m["k"][0].v is None and r.n is None and r.e == [] and r["odd.name"] == 3


def test_validate_goals(spark):
    goals = spark.createDataFrame(
        [("a", 1000.0, 6), ("a", -1000.0, 6), ("a", 1000.0, -6), ("a", 0.0, 6), ("zz", 1000.0, 6),
         (None, 1000.0, 6)], "account_id string, target_amount double, months int")
    accts = spark.createDataFrame([("a",)], "account_id string")
    got = [r.error for r in C.validate_goals(goals, accts).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        None, "target_amount must be positive", "months must be positive",
        "target_amount must be positive", "account not found", "account_id is required"]))


def test_is_income_null_is_spending(spark):
    df = spark.createDataFrame([("Income",), (None,), ("Coffee",)], "category string")
    assert [r[0] for r in df.select(C.is_income()).collect()] == [True, False, False]
    assert df.select(F.count("*")).first()[0] == 3
