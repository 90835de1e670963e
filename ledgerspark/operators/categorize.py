"""Transaction categorisation: TF-IDF + cosine k-nearest-neighbours.

The index is a *posting table* ``(norm, label, n, term, w)``: training rows
grouped by (normalised text, label) -- ``n`` duplicates share one vector --
with L2-normalised tf-idf weights; a text without any term has one row with a
null term. Scoring is an exact top-k over this inverted index: the rarest terms
of a query give a first set of documents and with it a bound on the k-th
similarity; terms are then read from the rarest on until those left over, at
their largest weights, cannot reach the bound any more, so the long lists of
common terms are read only for queries that have nothing better. Lists longer
than ``LIST_PART`` are cut into parts, dealt to several tasks. Candidates are
verified on whole vectors; where fewer than k share a term, documents of
similarity 0 fill up the vote. Every query text is scored once: descriptions
are de-duplicated before scoring and the result is joined back to the
transactions.

Tokenisation follows the usual text-vectoriser defaults: lower case, tokens
of two or more word characters, English stop words removed, unigrams and
bigrams of the remaining tokens, vocabulary = the ``max_features`` most
frequent terms (ties: term order), smooth idf ``ln((1+N)/(1+df)) + 1``.
The stop-word list is Spark's built-in English list
(``StopWordsRemover.loadDefaultStopWords('english')``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import INCOME, UNCATEGORIZED, normalize_category, normalize_description
from ..functions.numeric import round_to

# Exact-description overrides (their tokens are all stop or
# one-letter words), default neighbours/thresholds of the two entry points.
EXACT_OVERRIDES = [("AT&T", "Utilities", 1.0)]
CATEGORIZE_K, CATEGORIZE_THRESHOLD = 5, 0.35
PREDICT_K, PREDICT_THRESHOLD = 7, 0.25
MAX_FEATURES = 30000
SIM_DECIMALS = 12          # similarities are compared after rounding (ties)
SLACK = 1e-9               # on bounds, far above the rounding of a sum
LIST_PART = 20_000         # postings of a term that one task takes at a time
TOKEN_PATTERN = r"\b\w\w+\b"


# Spark's built-in English stop words
# (``StopWordsRemover.loadDefaultStopWords("english")``), as a literal so that
# importing needs neither a JVM nor Spark's jars.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH_STOP_WORDS


def terms(norm: Column | str) -> Column:
    """Array of unigrams + bigrams of a normalised text."""
    norm = F.col(norm) if isinstance(norm, str) else norm
    stop = F.array(*[F.lit(w) for w in english_stop_words()])
    toks = F.filter(F.regexp_extract_all(F.lower(norm), F.lit(TOKEN_PATTERN), 0),
                    lambda t: ~F.array_contains(stop, t))
    n = F.size(toks)
    bigrams = F.when(n > 1, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                                       lambda a, b: F.concat(a, F.lit(" "), b))) \
               .otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


# ---------------------------------------------------------------------------
# C4 / C5 training
# ---------------------------------------------------------------------------

def training_table(df: DataFrame) -> DataFrame:
    """C4: labelled descriptions -> (norm, label, n). Requires columns
    ``description`` and ``category``; rows missing either are dropped."""
    missing = {"description", "category"} - set(df.columns)
    if missing:
        raise ValueError("training data must have columns: description, category")
    return (df.dropna(subset=["description", "category"])
              .select(normalize_description("description").alias("norm"),
                      normalize_category(F.col("category").cast("string")).alias("label"))
              .groupBy("norm", "label").agg(F.count(F.lit(1)).alias("n")))


def _term_counts(docs: DataFrame, key: list[str]) -> DataFrame:
    return (docs.select(*key, F.explode(terms("norm")).alias("term"))
                .groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_tfidf(train: DataFrame, max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Returns (vocabulary(term, idf), postings(norm, label, n, term, w)).

    The vocabulary is a global top-``max_features``: ``orderBy().limit()``
    keeps a local top-k per partition and merges only those, so it is bounded
    by ``max_features`` x partitions rows, never the whole term set."""
    tc = _term_counts(train, ["norm", "label", "n"])
    stats = tc.groupBy("term").agg(F.sum(F.col("tf") * F.col("n")).alias("freq"),
                                   F.sum("n").alias("df"))
    vocab = stats.orderBy(F.desc("freq"), F.asc("term")).limit(max_features)
    n_docs = F.coalesce(train.agg(F.sum("n")).scalar(), F.lit(0))      # subquery of the one plan
    vocab = vocab.select("term", (F.log((n_docs + 1).cast("double") / (F.col("df") + 1).cast("double"))
                                  + 1.0).alias("idf"))
    w = (tc.join(vocab, "term")              # no hint: AQE broadcasts it by its measured size
           .withColumn("raw", F.col("tf") * F.col("idf")))
    norm2 = Window.partitionBy("norm", "label")
    postings = w.select("norm", "label", "n", "term",
                        (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(norm2))).alias("w"))
    # texts without a term of the vocabulary can be neighbours too, of similarity 0
    bare = train.join(postings.select("norm", "label").distinct(), ["norm", "label"], "left_anti")
    return vocab, postings.unionByName(bare.select("norm", "label", "n", F.lit(None).cast("string").alias("term"),
                                                   F.lit(None).cast("double").alias("w")))


# ---------------------------------------------------------------------------
# C6-C8 scoring
# ---------------------------------------------------------------------------

def query_vectors(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """L2-normalised tf-idf of distinct normalised query texts (column ``norm``)."""
    tc = _term_counts(queries.select("norm").distinct(), ["norm"])
    w = tc.join(vocab, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    per_q = Window.partitionBy("norm")
    return w.select(F.col("norm").alias("qnorm"), "term",
                    (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(per_q))).alias("wq"))


def _parts(postings: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings with the part of their list, (term, parts) of the long lists). There are
    at most |postings| / LIST_PART long lists."""
    long_lists = stats.filter(F.col("docs") > LIST_PART).select("term", F.ceil(F.col("docs") / LIST_PART).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("norm", "label"), F.col("parts")), F.lit(0)).cast("int")
    return postings.join(long_lists, "term", "left").withColumn("part", part).drop("parts"), long_lists


def _matches(q: DataFrame, parted: DataFrame, long_lists: DataFrame) -> DataFrame:
    """Query terms beside the postings of their lists; a query goes to all parts of one."""
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    return q.join(long_lists, "term", "left").select(*q.columns, each).join(parted, ["term", "part"])


def _reach(q: DataFrame, k: int) -> DataFrame:
    """Query terms from the rarest on, with ``first`` (the terms that give the first set:
    lists of k neighbours together) and ``rest``, the most that this and all later terms
    can add to a similarity."""
    order = Window.partitionBy("qnorm").orderBy("docs", "term")
    before = F.coalesce(F.sum("neighbours").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return q.select("qnorm", "term", "wq", (before < k).alias("first"),
                    F.sum(F.col("wq") * F.col("most")).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))


def knn_candidates(qvec: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The k nearest training documents per query of ``qvec`` by cosine similarity, exact.
    Ties: label asc, then text asc; documents of similarity 0 come last in that order.
    Returns (qnorm, norm, label, n, sim, pos). A query without terms has no rows."""
    doc = ["norm", "label", "n"]
    listed = postings.filter("term is not null")
    stats = listed.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("neighbours"), F.max("w").alias("most"))
    parted, long_lists = _parts(listed, stats)
    q = _reach(qvec.join(stats, "term"), k)
    # what the rarest terms alone add up to is a lower bound of each similarity
    some = (_matches(q.filter("first").select("qnorm", "term", "wq"), parted, long_lists)
            .groupBy("qnorm", *doc).agg(F.sum(F.col("wq") * F.col("w")).alias("low")))
    by_low = Window.partitionBy("qnorm").orderBy(F.desc("low"))
    some = some.withColumn("r", F.row_number().over(by_low)).filter(F.col("r") <= k)
    taken = F.sum("n").over(by_low.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bound = some.withColumn("taken", taken).filter(F.col("taken") >= k).groupBy("qnorm").agg(F.max("low").alias("bound"))
    needed = (q.join(bound, "qnorm", "left").filter(F.col("rest") >= F.coalesce("bound", F.lit(0.0)) - SLACK)
              .select("qnorm", "term"))
    found = _matches(needed, parted, long_lists).select("qnorm", *doc).distinct()
    # whole vectors; both are as long as a text has terms
    vectors = listed.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
    weights = qvec.groupBy("qnorm").agg(F.map_from_entries(F.collect_list(F.struct("term", "wq"))).alias("wq"))
    sim = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["w"] * F.coalesce(F.element_at("wq", t["term"]), F.lit(0.0)))
    near = (found.join(vectors, doc).join(weights, "qnorm")
            .select("qnorm", *doc, round_to(sim, SIM_DECIMALS).alias("sim")).filter("sim > 0"))
    w = Window.partitionBy("qnorm").orderBy(F.desc("sim"), F.asc("label"), F.asc("norm"))
    best = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)      # a document is a neighbour or more
    # the first 2k documents hold k that are not among the nearest
    row = F.struct("label", "norm", "n")
    others = (postings.select(*doc).distinct().orderBy("label", "norm").limit(2 * k)
              .agg(F.array_sort(F.collect_list(row)))).scalar()
    nearest = F.transform(F.array_sort(F.collect_list(F.struct("r", "label", "norm", "n", "sim"))),
                          lambda x: F.struct(x["label"], x["norm"], x["n"], x["sim"]))
    fill = F.transform(F.filter(F.col("others"), lambda o: ~F.exists("near", lambda x: (x["norm"] == o["norm"]) & (x["label"] == o["label"]))),
                       lambda o: F.struct(o["label"], o["norm"], o["n"], F.lit(0.0).alias("sim")))
    return (best.groupBy("qnorm").agg(nearest.alias("near")).withColumn("others", others)
            .select("qnorm", F.posexplode(F.slice(F.concat("near", fill), 1, k)).alias("at", "x"))
            .select("qnorm", "x.norm", "x.label", "x.n", "x.sim", (F.col("at") + 1).alias("pos")))


def knn_vote(cand: DataFrame, k: int, threshold: float) -> DataFrame:
    """Neighbours are taken in order, a grouped document contributing
    min(n, k - taken) of its duplicates. Majority label wins; ties by the sum
    of similarities, then by the nearest first appearance. Confidence = mean
    similarity of the winner's neighbours; below ``threshold`` the label is
    Uncategorized (the confidence is kept). Returns (qnorm, category,
    confidence); queries without rows get none."""
    w = Window.partitionBy("qnorm").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("n").over(w), F.lit(0))
    c = (cand.withColumn("weight", F.least(F.col("n"), F.lit(k) - taken))
             .filter(F.col("weight") > 0))
    votes = c.groupBy("qnorm", "label").agg(
        F.sum("weight").alias("votes"), F.sum(F.col("weight") * F.col("sim")).alias("sim_sum"),
        F.min("pos").alias("first"))
    best = Window.partitionBy("qnorm").orderBy(F.desc("votes"), F.desc("sim_sum"), F.asc("first"))
    win = votes.withColumn("r", F.row_number().over(best)).filter(F.col("r") == 1)
    conf = round_to(F.col("sim_sum") / F.col("votes"), 6)
    return win.select("qnorm",
                      F.when(conf < threshold, F.lit(UNCATEGORIZED)).otherwise(F.col("label"))
                       .alias("category"),
                      conf.alias("confidence"))


def score_texts(texts: DataFrame, vocab: DataFrame, postings: DataFrame, k: int,
                threshold: float) -> DataFrame:
    """C6-C8 for a column ``description`` of raw texts: (description,
    category, confidence) per distinct description. Exact overrides first;
    texts without a known term, all of whose neighbours have similarity 0, are
    Uncategorized with 0.0."""
    d = texts.select("description").distinct().withColumn(
        "norm", normalize_description("description"))
    votes = knn_vote(knn_candidates(query_vectors(d, vocab), postings, k), k, threshold)
    scored = d.join(votes, d.norm == votes.qnorm, "left")
    over_cat = F.lit(None).cast("string")
    over_conf = F.lit(None).cast("double")
    for text, cat, conf in reversed(EXACT_OVERRIDES):
        over_cat = F.when(F.col("description") == text, F.lit(cat)).otherwise(over_cat)
        over_conf = F.when(F.col("description") == text, F.lit(conf)).otherwise(over_conf)
    return scored.select(
        "description",
        F.coalesce(over_cat, F.col("category"), F.lit(UNCATEGORIZED)).alias("category"),
        F.coalesce(over_conf, F.col("confidence"), F.lit(0.0)).alias("confidence"))


# ---------------------------------------------------------------------------
# C9 / C10 entry points
# ---------------------------------------------------------------------------

def categorize(txn: DataFrame, index: tuple[DataFrame, DataFrame] | None,
               k: int = CATEGORIZE_K, threshold: float = CATEGORIZE_THRESHOLD,
               has_amount: bool = True) -> DataFrame:
    """Adds ``category`` and ``confidence`` to a ledger with columns
    (account_id, txn_date, description, amount).

    NULL amount -> Uncategorized 0.0; amount > 0 -> Income 1.0; otherwise the
    k-NN label of the description (NULL description = ''). Without an amount
    column (``has_amount=False``) every row is scored; without an index every
    row is Uncategorized 0.0."""
    base = txn.drop("category", "confidence")
    if index is None:
        return base.withColumn("category", F.lit(UNCATEGORIZED)).withColumn("confidence", F.lit(0.0))
    vocab, postings = index
    desc = F.coalesce(F.col("description").cast("string"), F.lit(""))
    spend = (F.col("amount") <= 0) if has_amount else F.lit(True)
    texts = base.filter(spend).select(desc.alias("description"))
    scores = score_texts(texts, vocab, postings, k, threshold).withColumnRenamed("description", "_d")
    j = base.withColumn("_d", desc).join(scores, "_d", "left")
    if has_amount:
        cat = (F.when(F.col("amount").isNull(), F.lit(UNCATEGORIZED))
                .when(F.col("amount") > 0, F.lit(INCOME)).otherwise(F.col("category")))
        conf = (F.when(F.col("amount").isNull(), F.lit(0.0))
                 .when(F.col("amount") > 0, F.lit(1.0)).otherwise(F.col("confidence")))
    else:
        cat, conf = F.col("category"), F.col("confidence")
    return j.select(*[c for c in base.columns], cat.alias("category"), conf.alias("confidence"))


def predict_category(texts: DataFrame, index: tuple[DataFrame, DataFrame],
                     k: int = PREDICT_K, threshold: float = PREDICT_THRESHOLD) -> DataFrame:
    """(description, category, confidence) for a table of descriptions,
    with the single-prediction defaults (k=7, threshold 0.25)."""
    vocab, postings = index
    return score_texts(texts.select(F.col("description").cast("string")), vocab, postings, k, threshold)


# ---------------------------------------------------------------------------
# A9 persistence of the index
# ---------------------------------------------------------------------------

def save_index(index: tuple[DataFrame, DataFrame], path: str) -> None:
    """Write (vocabulary, postings) as parquet under ``path``."""
    vocab, postings = index
    vocab.write.mode("overwrite").parquet(f"{path.rstrip('/')}/vocabulary")
    postings.write.mode("overwrite").parquet(f"{path.rstrip('/')}/postings")


def load_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(f"{path.rstrip('/')}/vocabulary"),
            spark.read.parquet(f"{path.rstrip('/')}/postings"))
