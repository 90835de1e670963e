"""Importance resampling towards a target collection.

Features are runs of words, hashed into buckets. The counts of the buckets over all
documents and over all target texts give one array of integer gains (log ratios); a
document's weight is the mean gain of its features, read from that array. Adding Gumbel
noise, drawn from a hash of the id, turns "the highest scores" into a draw without
replacement by weight.

The cutoff is found by weighted median-of-medians selection. Each round, every partition
gives the median of its remaining keys and their number; the median of these medians,
weighted by the numbers, has at least a quarter of all remaining keys on either side, so
counting the two sides discards a quarter or more. Keys are (score, doc_id, row) and
unique, and the rounds go on until the cutoff is among a handful of keys. Only the
winners are sorted: by range over all tasks, ranked by prefix sums.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, bases, id_type, per_document, staged

BUCKETS = 10_000                # fixed by the contract, as are the next four
RUNS = 1                        # words of the longest feature
SHARE = (10, 100)               # of the eligible documents
LEAST_WORDS = 20
SEED = 2024
HANDFUL = 4096                  # keys among which the cutoff is read off
REMEMBERED = 500_000            # features whose bucket a task remembers at a time

# bytes between words become blanks, A-Z lower case; bytes of other letters stay
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_TABLE = bytes(32 if _BREAK.match(bytes([b])) else b + 32 if chr(b) in UPPER else b for b in range(256))


def reader(buckets: int, runs: int):
    """A function of a text's UTF-8 bytes: (number of words, buckets of its features)."""
    known: dict[bytes, int] = {}

    def read(text: bytes | None):
        ws = (text or b"").translate(_TABLE).split()
        features = list(ws)
        for n in range(2, runs + 1):
            features += [b" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1)]
        if len(known) > REMEMBERED:
            known.clear()
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % buckets
        return len(ws), np.fromiter(map(known.__getitem__, features), np.int64, len(features))
    return read


def _binary(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", F.col("text").cast("binary"))


def counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How many features of all ``texts`` each bucket holds."""
    def run(batches):
        import pyarrow as pa

        read, total = reader(buckets, runs), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(read(text.as_py())[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    per_task = _binary(texts.select("text")).mapInArrow(run, "bucket long, n long")
    for b, n in per_task.groupBy("bucket").agg(F.sum("n")).collect():      # a row per bucket
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) of every bucket."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain; 0 without features."""
    def start():
        read = reader(len(gain), runs)

        def run(ids, texts):
            for i, t in zip(ids, texts):
                n, at = read(t)
                yield i, n, len(at), int(gain[at].sum()) // len(at) if len(at) else 0
        return run
    return per_document(_binary(docs.select("doc_id", "text")), start,
                        f"doc_id {id_type(docs)}, n_words long, n_features long, weight long", each_task=True)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The floored noise of a document; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


KEY = [F.desc, F.asc_nulls_last, F.asc]     # of score, doc_id, row


def _order():
    return [f(c) for f, c in zip(KEY, ("score", "doc_id", "row"))]


def _sort_key(key: tuple):
    score, doc_id, row = key
    return -score, doc_id is None, doc_id if doc_id is not None else 0, row


def upto(key: tuple) -> Column:
    """Whether a row's key is ``key`` or comes before it."""
    score, doc_id, row = key
    if doc_id is None:
        first, same = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
    else:
        first = F.coalesce(F.col("doc_id") < F.lit(doc_id), F.lit(False))
        same = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    # the plain comparison of the score reaches the scan
    return (F.col("score") >= score) & ((F.col("score") > score) | first | (same & (F.col("row") <= row)))


def _medians(rows: DataFrame, pivot: tuple | None) -> list:
    """(side, number, median key) of each partition's rows, for the rows up to the pivot
    (side 0) and those after it (side 1): two rows a task at most."""
    side = F.lit(0) if pivot is None else F.when(upto(pivot), 0).otherwise(1)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held = list(batches)        # three numbers a row
        for s in (0, 1) if held else ():
            table = pa.Table.from_batches(held)
            part = table.filter(pc.equal(table["side"], s)).drop(["side"])
            if part.num_rows:
                order = pc.sort_indices(part, sort_keys=[("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
                mid = part.take(order.slice((part.num_rows - 1) // 2, 1))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.num_rows], pa.int64()),
                                                  *(c.combine_chunks() for c in mid.columns)],
                                                 names=["side", "n", *mid.column_names])

    found = rows.select(side.cast("int").alias("side"), "score", "doc_id", "row").mapInArrow(
        run, f"side int, n long, score long, doc_id {kind}, row long").collect()
    return [(r.side, r.n, (r.score, r.doc_id, r.row)) for r in found]


def _weighted_median(found: list) -> tuple:
    found = sorted(found, key=lambda x: _sort_key(x[2]))
    half, seen = sum(n for _, n, _ in found) / 2, 0
    for _, n, key in found:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(rows: DataFrame, rank: int, handful: int = HANDFUL) -> tuple | None:
    """The key (score, doc_id, row) of the ``rank``-th row in the order score descending,
    doc_id ascending (null last), row ascending; ``row`` is unique. None for rank 0 or
    one beyond the rows."""
    found = _medians(rows, None)
    left = stored = sum(n for _, n, _ in found)
    if not 1 <= rank <= left:
        return None
    while left > handful:
        pivot = _weighted_median(found)
        sides = _medians(rows, pivot)
        before = sum(n for s, n, _ in sides if s == 0)
        keep = 0 if rank <= before else 1
        rows = rows.filter(upto(pivot) if keep == 0 else ~upto(pivot))
        rank -= before * keep
        found = [x for x in sides if x[0] == keep]
        left = sum(n for _, n, _ in found)
        if left < stored / 4:           # so that all rounds together read a few times the first table
            rows, stored = staged(rows.select("score", "doc_id", "row"), "keys"), left
    last = sorted(((r.score, r.doc_id, r.row) for r in rows.select("score", "doc_id", "row").collect()), key=_sort_key)
    return last[rank - 1]


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank from 1 in the order of the keys: sorted by range, then
    numbered by prefix sums over the partitions."""
    at = F.monotonically_increasing_id()            # partition number and place in it
    low = 1 << 33
    s = staged(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("_at", at), "sorted")
    part = F.shiftrightunsigned("_at", 33)
    total = s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    base = F.broadcast(bases(total, "part", "n"))   # a row of two numbers per task
    return s.join(base, part == F.col("part")).select(
        *rows.columns, (F.col("base") + F.col("_at") % low + 1).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, ... of
    the drawn by falling score, ties to the smaller doc_id, null last; else null).

    Of the N rows with ``least_words`` words or more, floor(N * share) are drawn. Rows that
    repeat or share a doc_id are drawn one by one, in any order among themselves. Null,
    empty and word-less texts have weight 0 and are never drawn where ``least_words`` is
    above 0. An empty target leaves only the documents' own shares; empty ``docs`` give no
    rows. Further columns are ignored."""
    gain = gains(counts(docs, buckets, runs), counts(target, buckets, runs))
    scored = staged(weights(docs, gain, runs)
                    .withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
                    .withColumn("row", F.monotonically_increasing_id()), "scored")
    fits = F.col("n_words") >= least_words
    key = cutoff(scored.filter(fits), scored.filter(fits).count() * share[0] // share[1])
    cols = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if key is None:
        return scored.select(*cols, none)
    drawn = fits & upto(key)
    winners = ranked(scored.filter(drawn).select(*cols, "row"))
    return winners.select(*cols, "rank").unionByName(scored.filter(~drawn).select(*cols, none))


def draw(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id was drawn."""
    won = resample(docs, target, **parameters).filter("rank is not null").select(F.col("doc_id").alias("_won")).distinct()
    return docs.join(won, docs["doc_id"].eqNullSafe(won["_won"]), "left_semi")
