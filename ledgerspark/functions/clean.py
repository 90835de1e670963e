"""Column roles, cleaning and text normalisation (native column expressions).

Every function here returns a ``Column`` or a ``DataFrame`` built from
built-in functions only, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------

# column-role keywords (case-insensitive substring match on column names)
AMOUNT_KEYWORDS = ["amount", "debit", "credit", "value"]
DATE_KEYWORDS = ["date", "time"]
DESCRIPTION_KEYWORDS = ["description", "merchant", "memo", "details"]
SUBSCRIPTION_DESCRIPTION_KEYWORDS = ["description", "merchant", "payee"]

# description normalisation patterns, applied in this order
DESC_TERMINAL_WORDS = r"\b(POS|DBT|CRD|CHK|TRN|ATM|XFER|WITHDRAWAL|DEPOSIT)\b"
DESC_NUMBERS = r"\b#?\d{3,}\b"
DESC_DATES = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
DESC_STATES = (r"( AL| AK| AZ| AR| CA| CO| CT| DC| DE| FL| GA| HI| IA| ID| IL| IN| KS| KY| LA|"
               r" MA| MD| ME| MI| MN| MO| MS| MT| NC| ND| NE| NH| NJ| NM| NV| NY| OH| OK| OR|"
               r" PA| RI| SC| SD| TN| TX| UT| VA| VT| WA| WI| WV)\b")
DESC_COUNTRY = r"\b(USA|US|UNITED STATES)\b"
DESC_KEEP = r"[^A-Z&' ]"
MERCHANT_KEEP = r"[^A-Z0-9&+ ]"

INCOME = "Income"
UNCATEGORIZED = "Uncategorized"


# ---------------------------------------------------------------------------
# B1 column roles
# ---------------------------------------------------------------------------

def detect_role(columns: list[str], keywords: list[str], pick: str = "first") -> str | None:
    """Name of the column whose lower-cased name contains any keyword.

    ``pick='first'`` returns the first matching column, ``'last'`` the last one
    (the two behaviours exist side by side in the reference)."""
    hits = [c for c in columns if any(k in c.lower() for k in keywords)]
    if not hits:
        return None
    return hits[0] if pick == "first" else hits[-1]


def detect_roles(columns: list[str], pick: str = "first",
                 description_keywords: list[str] | None = None) -> dict:
    return {
        "amount": detect_role(columns, AMOUNT_KEYWORDS, pick),
        "date": detect_role(columns, DATE_KEYWORDS, pick),
        "description": detect_role(columns, description_keywords or DESCRIPTION_KEYWORDS, pick),
    }


# ---------------------------------------------------------------------------
# B2 / B3 parsing
# ---------------------------------------------------------------------------

def parse_money(c: Column | str, strip_symbols: bool = True) -> Column:
    """String -> DECIMAL(18,2); ``$`` and ``,`` removed; anything unparsable -> NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    if strip_symbols:
        s = F.regexp_replace(F.regexp_replace(s, r"\$", ""), ",", "")
    return s.try_cast("decimal(18,2)")


def parse_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse with one declared format per file; other formats give NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(F.trim(c.cast("string")), F.lit(fmt)))


# ---------------------------------------------------------------------------
# B4-B8 predicates
# ---------------------------------------------------------------------------

def drop_incomplete(txn: DataFrame, subset=("txn_date", "amount")) -> DataFrame:
    return txn.dropna(subset=list(subset))


def is_income(category: Column | str = "category") -> Column:
    category = F.col(category) if isinstance(category, str) else category
    return F.coalesce(category == F.lit(INCOME), F.lit(False))


def exclude_category(df: DataFrame, word: str = "rent", mode: str = "contains",
                     col: str = "category") -> DataFrame:
    """``contains``: drop categories containing ``word`` in any case (also hits
    'parents'); ``equals``: drop only the exact word in any case."""
    low = F.lower(F.col(col))
    if mode == "contains":
        return df.filter(~F.coalesce(low.contains(word.lower()), F.lit(False)))
    return df.filter(~F.coalesce(low == word.lower(), F.lit(False)))


def confidence_filter(subs: DataFrame, threshold: float = 0.5, col: str = "score") -> DataFrame:
    return subs.filter(F.col(col) >= F.lit(threshold))


def validate_goals(goals: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``error``: NULL for a valid goal, else the reason (first failing rule)."""
    known = accounts.select("account_id").distinct().withColumn("_known", F.lit(True))
    g = goals.join(known, "account_id", "left")
    return g.withColumn(
        "error",
        F.when(F.col("account_id").isNull(), F.lit("account_id is required"))
         .when(F.col("target_amount").isNull() | (F.col("target_amount") <= 0),
               F.lit("target_amount must be positive"))
         .when(F.col("months").isNull() | (F.col("months") <= 0), F.lit("months must be positive"))
         .when(F.col("_known").isNull(), F.lit("account not found"))).drop("_known")


# ---------------------------------------------------------------------------
# C1-C3 text normalisation
# ---------------------------------------------------------------------------

def normalize_description(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(F.coalesce(c.cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, DESC_TERMINAL_WORDS, " ")
    t = F.regexp_replace(t, DESC_NUMBERS, " ")
    t = F.regexp_replace(t, DESC_DATES, " ")
    t = F.regexp_replace(t, DESC_STATES, " ")
    t = F.regexp_replace(t, DESC_COUNTRY, " ")
    t = F.regexp_replace(t, DESC_KEEP, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_merchant(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.upper(c.cast("string")), MERCHANT_KEEP, "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_category(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin("Other", UNCATEGORIZED), F.lit(UNCATEGORIZED)).otherwise(c)


# ---------------------------------------------------------------------------
# A7 JSON-safe output
# ---------------------------------------------------------------------------

def _json_value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)
    if isinstance(t, T.DecimalType):
        return c.cast("double")
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _json_value(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _k, v: _json_value(v, t.valueType))
    if isinstance(t, T.StructType):
        fields = [_json_value(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN/+-Inf -> NULL, dates/timestamps -> ISO strings (microseconds where there are
    any), decimals -> doubles, also inside arrays, structs and map values."""
    return df.select(*[_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
