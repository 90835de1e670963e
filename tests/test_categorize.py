"""TF-IDF k-NN categorisation: probe descriptions and a brute-force check."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import categorize as C

TRAIN = [
    ("STARBUCKS", "Coffee"), ("STARBUCKS COFFEE", "Coffee"), ("PEETS COFFEE", "Coffee"),
    ("DUTCH BROS COFFEE", "Coffee"), ("SHELL GAS STATION", "Gas"), ("CHEVRON GAS", "Gas"),
    ("EXXON MOBIL", "Gas"), ("AMAZON MARKETPLACE", "Shopping"), ("AMAZON COM", "Shopping"),
    ("TARGET STORE", "Shopping"), ("NETFLIX MONTHLY", "Entertainment"), ("AMC THEATRES", "Entertainment"),
    ("RENT PAYMENT", "Rent"), ("APARTMENT RENT", "Rent"), ("SAFEWAY GROCERY", "Grocery"),
    ("WHOLE FOODS MARKET", "Grocery"), ("TRADER JOES", "Grocery"), ("UBER TRIP", "Transport"),
    ("LYFT RIDE", "Transport"), ("VENMO PAYMENT", "P2P"), ("MISC THING", "Other"),
]


@pytest.fixture(scope="module")
def index(spark):
    # several equal rows of each text, as in real labelled data: k neighbours vote, and
    # where fewer share a term, rows of similarity 0 fill up
    train = spark.createDataFrame(TRAIN * 4, "description string, category string")
    return C.fit_tfidf(C.training_table(train))


def test_training_table_normalises_labels(spark):
    train = spark.createDataFrame(TRAIN + [(None, "Gas"), ("X", None)], "description string, category string")
    t = {(r.norm, r.label): r.n for r in C.training_table(train).collect()}
    assert ("MISC THING", "Uncategorized") in t and len(t) == len(TRAIN)
    with pytest.raises(ValueError):
        C.training_table(spark.createDataFrame([("a",)], "text string"))


def test_probe_descriptions(spark, index):
    probes = ["STARBUCKS COFFEE #1234", "AMAZON.COM PURCHASE", "SHELL GAS STATION",
              "NETFLIX MONTHLY SUBSCRIPTION", "RENT PAYMENT", "AT&T", "QWERTY ZXCV", ""]
    df = spark.createDataFrame([(p,) for p in probes], "description string")
    got = {r.description: (r.category, r.confidence) for r in C.predict_category(df, index).collect()}
    assert got["STARBUCKS COFFEE #1234"][0] == "Coffee"
    assert got["AMAZON.COM PURCHASE"][0] == "Shopping"
    # k = 7: the exact match (1.0) and CHEVRON GAS both vote Gas; confidence
    # is their mean similarity
    assert got["SHELL GAS STATION"][0] == "Gas" and 0.5 < got["SHELL GAS STATION"][1] < 1.0
    assert got["NETFLIX MONTHLY SUBSCRIPTION"][0] == "Entertainment"
    assert got["AT&T"] == ("Utilities", 1.0)
    assert got["QWERTY ZXCV"] == ("Uncategorized", 0.0)        # no shared term
    assert got[""] == ("Uncategorized", 0.0)
    # never 'Other': the label is normalised
    assert all(v[0] != "Other" for v in got.values())


def test_categorize_sign_rules(spark, index):
    txn = spark.createDataFrame(
        [("a", None, "STARBUCKS", -4.5), ("a", None, "STARBUCKS", 20.0), ("a", None, "STARBUCKS", None),
         ("a", None, None, -1.0)],
        "account_id string, txn_date date, description string, amount double")
    got = [(r.amount, r.category, r.confidence) for r in C.categorize(txn, index).collect()]
    spend = [g for g in got if g[0] == -4.5][0]
    assert spend[1] == "Coffee" and 0.35 <= spend[2] < 1.0      # STARBUCKS + STARBUCKS COFFEE
    assert (20.0, "Income", 1.0) in got
    assert (None, "Uncategorized", 0.0) in got
    assert (-1.0, "Uncategorized", 0.0) in got                  # NULL description = ''
    none = C.categorize(txn, None).select("category", "confidence").distinct().collect()
    assert [(r.category, r.confidence) for r in none] == [("Uncategorized", 0.0)]
    no_amount = C.categorize(txn, index, has_amount=False).filter(F.col("amount") == 20.0).first()
    assert no_amount.category == "Coffee"


# ---------------------------------------------------------------------------
# brute force: dense tf-idf + cosine + vote on random texts
# ---------------------------------------------------------------------------

def brute(train, queries, k, threshold, stop):
    def terms(s):
        toks = [t for t in re.findall(r"\b\w\w+\b", s.lower()) if t not in stop]
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    docs = [(terms(d), lab) for d, lab in train]
    freq, df = Counter(), Counter()
    for ts, _ in docs:
        freq.update(ts)
        df.update(set(ts))
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in freq}

    def vec(ts):
        c = Counter(t for t in ts if t in idf)
        v = {t: c[t] * idf[t] for t in c}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}
    dv = [(vec(ts), lab, " ".join(d.split())) for (ts, lab), (d, _) in zip(docs, train)]
    out = {}
    for q in queries:
        qv = vec(terms(q))
        sims = [(round(sum(w * v.get(t, 0.0) for t, w in qv.items()), 12), lab, nm) for v, lab, nm in dv]
        sims = sorted(sims, key=lambda s: (-s[0], s[1], s[2]))[:k]
        if not qv:
            out[q] = ("Uncategorized", 0.0)
            continue
        b = {}
        for pos, (s, lab, _) in enumerate(sims):
            e = b.setdefault(lab, [0, 0.0, pos])
            e[0] += 1
            e[1] += s
        lab, (cnt, tot, _) = sorted(b.items(), key=lambda kv: (-kv[1][0], -kv[1][1], kv[1][2]))[0]
        conf = round(tot / cnt, 6)
        out[q] = ("Uncategorized" if conf < threshold else lab, conf)
    return out


def test_knn_matches_brute_force(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "tau", "rho", "zeta"]
    labels = ["Coffee", "Gas", "Rent", "Bars"]
    train = [(" ".join(rnd.sample(words, rnd.randint(1, 4))).upper(), rnd.choice(labels)) for _ in range(60)]
    queries = [" ".join(rnd.sample(words, rnd.randint(1, 3))).upper() for _ in range(25)]
    stop = set(C.english_stop_words())
    exp = brute(train, queries, 5, 0.35, stop)
    tdf = spark.createDataFrame(train, "description string, category string")
    idx = C.fit_tfidf(C.training_table(tdf))
    qdf = spark.createDataFrame([(q,) for q in queries], "description string")
    got = {r.description: (r.category, r.confidence) for r in
           C.score_texts(qdf, idx[0], idx[1], 5, 0.35).collect()}
    for q in queries:
        assert got[q][0] == exp[q][0], q
        assert got[q][1] == pytest.approx(exp[q][1], abs=1e-6), q


def test_index_roundtrip(spark, index, tmp_path):
    C.save_index(index, str(tmp_path / "idx"))
    again = C.load_index(spark, str(tmp_path / "idx"))
    df = spark.createDataFrame([("STARBUCKS COFFEE",), ("UBER TRIP 123",)], "description string")
    a = sorted(map(tuple, C.predict_category(df, index).collect()))
    b = sorted(map(tuple, C.predict_category(df, again).collect()))
    assert a == b
