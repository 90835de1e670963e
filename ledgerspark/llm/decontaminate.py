"""Benchmark decontamination by winnowing (native: DataFrame functions only).

Both sides hash every K-word gram and keep the smallest hash of each run of W
consecutive grams. With K + W - 1 = 13 every shared span of 13 words has a gram
that both sides keep, so joining the kept hashes finds every such span. Each hit
(document position, item position) lies on a diagonal; along it document and item
words are compared outwards, and every run of 13 equal words is an occurrence of
item windows. Items of fewer than 13 words have no full run of grams: all
document grams of just those lengths (at most 12 lengths) are joined instead, and
the whole item must match.

Cost: one pass hashes the documents and explodes only the kept hashes
(about 2/(W+1) per word), joined to the distinct benchmark hashes, broadcast only
when their counted number is small and shuffled otherwise. Only documents with a
kept hash in common are tokenised again. Grams are compared by 64-bit hash, the
words along a diagonal by value, so a hash collision costs time, not results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_BREAK, ascii_lower, let, split_words, staged

WINDOW = 13                     # words, fixed by the contract
K = 5
W = WINDOW - K + 1
BROADCAST_ROWS = 200_000        # of 8-byte hashes; beyond it the join shuffles


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), ALNUM_BREAK)


def _grams(hashes: Column, n: int) -> Column:
    """64-bit hash of every run of ``n`` words, by position."""
    empty = F.expr("cast(array() as array<bigint>)")
    return F.when(F.size(hashes) >= n, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(F.lit(n), *[F.get(hashes, i + j) for j in range(n)]))).otherwise(empty)


def _kept(grams: Column) -> Column:
    """The distinct minima of the runs of W grams."""
    empty = F.expr("cast(array() as array<bigint>)")
    return F.when(F.size(grams) >= W, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(grams) - (W - 1)),
        lambda i: F.array_min(F.slice(grams, i, W))))).otherwise(empty)


def _hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def fingerprints(ws: Column, short: list[int]) -> Column:
    """Kept hashes of a document, and all grams of the short items' lengths."""
    return let(_hashed(ws), lambda h: let(_grams(h, K), lambda g: F.array_distinct(F.concat(
        _kept(g), *[_grams(h, n) for n in short]))))


def index_benchmark(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(items with words, (fp, item, q, n_item) postings, lengths of short items).
    Rows without an id or without words give nothing."""
    it = staged(items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("iw"))
                .filter("item is not null and size(iw) > 0").distinct()
                .withColumn("n_item", F.size("iw")), "items")
    short = sorted(r[0] for r in it.filter(F.col("n_item") < WINDOW).select("n_item").distinct().collect())
    full = it.filter(F.col("n_item") >= WINDOW).select("item", "n_item", let(_hashed(F.col("iw")), lambda h: let(
        _grams(h, K), lambda g: let(_kept(g), lambda kept: F.filter(
            F.transform(g, lambda x, i: F.struct(x.alias("fp"), i.alias("q"))),
            lambda x: F.array_contains(kept, x["fp"]))))).alias("at"))
    post = full.select("item", "n_item", F.explode("at").alias("x")).select("x.fp", "item", "x.q", "n_item")
    for n in short:
        post = post.unionByName(it.filter(F.col("n_item") == n).select(
            let(_hashed(F.col("iw")), lambda h: F.get(_grams(h, n), F.lit(0))).alias("fp"),  # noqa: B023 (used at once)
            "item", F.lit(0).alias("q"), "n_item"))
    return it, staged(post, "postings"), short


def _all_grams(ws: Column, short: list[int]) -> Column:
    at = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("fp"), i.alias("p")))
    return let(_hashed(ws), lambda h: F.concat(*[at(_grams(h, n)) for n in sorted({K, *short})]))


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, start, stop): where windows of an item occur in a document,
    in words. Rows that share a doc_id count as one document."""
    it, post, short = index_benchmark(items)
    d = docs.select(F.col("doc_id").alias("doc"), "text").filter("text is not null")
    fps = post.select("fp").distinct()
    if fps.count() <= BROADCAST_ROWS:
        fps = F.broadcast(fps)
    found = staged(d.select("doc", F.explode(fingerprints(words(F.col("text")), short)).alias("fp"))
                   .join(fps, "fp"), "hits")
    # rows of documents with a hit, tokenised once more
    hit = d.join(found.select("doc").distinct(), d["doc"].eqNullSafe(found["doc"]), "left_semi") \
           .select("doc", words(F.col("text")).alias("ws"))
    grams = hit.select("doc", F.explode(_all_grams(F.col("ws"), short)).alias("g")) \
               .select("doc", F.col("g.fp").alias("fp"), F.col("g.p").alias("p"))
    f = found.select(F.col("doc").alias("fdoc"), F.col("fp").alias("ffp")).distinct()
    diag = (grams.join(f, grams["doc"].eqNullSafe(f["fdoc"]) & (grams["fp"] == f["ffp"]), "left_semi")
            .join(post, "fp").select("doc", "item", "n_item", (F.col("p") - F.col("q")).alias("d")).distinct()
            .groupBy("doc").agg(F.collect_list(F.struct("item", "n_item", "d")).alias("diags"))
            .withColumnRenamed("doc", "ddoc"))
    lo = F.greatest(F.col("x.d"), F.lit(0))
    seg = (hit.join(diag, hit["doc"].eqNullSafe(diag["ddoc"])).select("doc", "ws", F.explode("diags").alias("x"))
           .select("doc", "x.item", F.col("x.d").alias("d"), lo.alias("lo"),
                   F.slice("ws", lo + 1, F.greatest(F.lit(0), F.least(F.size("ws"), F.col("x.d") + F.col("x.n_item")) - lo))
                   .alias("seg")))
    run = F.least(F.lit(WINDOW), F.col("n_item"))
    equal = F.zip_with("seg", F.slice("iw", F.col("lo") - F.col("d") + 1, F.size("seg")), lambda a, b: a == b)
    starts = F.when(F.size("seg") >= run, let(equal, lambda eq: F.filter(
        F.sequence(F.lit(0), F.size(eq) - run),
        lambda i: F.forall(F.slice(eq, i + 1, run), lambda x: x)))).otherwise(F.expr("cast(array() as array<int>)"))
    return (seg.join(it, "item").select("doc", "item", "lo", run.alias("run"), F.explode(starts).alias("i"))
            .select("doc", "item", (F.col("lo") + F.col("i")).alias("start"),
                    (F.col("lo") + F.col("i") + F.col("run")).alias("stop")).distinct())


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any
    occurring window), n_items, items_sha256 (hash of the sorted item ids) and
    contaminated (5 % of the words or more). Null and word-less texts have no
    words and no hits; an empty benchmark finds nothing; further columns of the
    inputs are ignored."""
    occ = staged(occurrences(docs, items), "occurrences")
    by_start = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    cover = (occ.groupBy("doc", "start").agg(F.max("stop").alias("stop"))
             .withColumn("before", F.coalesce(F.max("stop").over(by_start), F.lit(0)))
             .groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before")))
                                 .cast("long").alias("n_hit")))
    # a document's own list, as its digest asks for
    ids = (occ.select("doc", "item").distinct().groupBy("doc")
           .agg(F.array_sort(F.collect_list("item")).alias("items")))
    per_doc = cover.join(ids, cover["doc"].eqNullSafe(ids["doc"])).select(
        cover["doc"].alias("hdoc"), "n_hit", "items")
    d = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return d.join(per_doc, d["doc_id"].eqNullSafe(per_doc["hdoc"]), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is not contaminated."""
    bad = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
