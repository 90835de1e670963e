"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed values of the contracts: word and line patterns.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"    # between lower-cased words
SPACE_BREAK = r"[\x20\x09-\x0D]+"                  # between space-separated words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back.
    The copy survives lost executors; each call writes a folder of its own. The folder is
    what ``spark.checkpoint.dir`` names; where that is unset, a local master gets a
    scratch folder and a cluster an error."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body(value)``, also inside other
    lambdas, where a plain column expression would run once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does the same where all text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, breaks: str) -> Column:
    """Non-empty pieces between ``breaks``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


SCAN = 64                       # values of a block of ``running``


def running(values: Column, zero: Column, op) -> Column:
    """For each value the combination (``op``, associative) of all before it, ``zero`` for
    the first. Appending copies the list made so far, so it is done in blocks of ``SCAN``
    values and then over the blocks: 32 copies a value, and n * n / 8192 for n values."""
    none = F.slice(F.array(zero), 1, 0)

    def append(a):
        return F.aggregate(a, F.struct(zero.alias("at"), none.alias("out")), lambda acc, x: F.struct(
            op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    # a short list is a single block
    starts = lambda a: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a)), F.lit(SCAN))
    parts = let(values, lambda a: F.transform(starts(a), lambda i: F.slice(a, i, SCAN)))
    return let(parts, lambda p: F.flatten(F.zip_with(
        p, append(F.transform(p, lambda q: F.aggregate(q, zero, op))),
        lambda q, under: F.transform(append(q), lambda x: op(under, x)))))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches in
    order; offsets are code points, ``end`` exclusive. The pieces between the
    matches and the matches themselves come from the same left-to-right search,
    so their lengths give every offset. ``pattern`` must not match ''."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")

    def spans(pieces):
        at = running(F.transform(pieces, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])),
                     F.lit(0), lambda a, b: a + b)

        def span(x, before):
            start = before + F.char_length(x["gap"])
            return F.struct(start.alias("start"), (start + F.char_length(x["hit"])).alias("end"), x["hit"].alias("hit"))
        return F.zip_with(pieces, at, span)

    def walk(hits):
        return let(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits,
                              lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(empty))


CHUNK = 4096                    # code points


def chunked(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, for ``piece``."""
    return F.when(F.char_length(text) <= CHUNK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a chunked text. ``substring`` of the whole
    text would count its way from the beginning for each piece."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)


def clear_of(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, in their order. One sweep by
    start: the largest end so far and the next start of the others decide."""
    top = F.lit(2 ** 31 - 1)

    def sweep(a):
        other = lambda s, value, none: F.when(s["own"] == 0, value).otherwise(none)
        reach = running(F.transform(a, lambda s: other(s, s["end"], F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
        following = F.reverse(running(F.reverse(F.transform(a, lambda s: other(s, s["start"], top))), top, lambda a, b: F.least(a, b)))
        limits = F.zip_with(reach, following, lambda r, f: F.struct(r.alias("reach"), f.alias("next")))
        clear = F.zip_with(a, limits, lambda s, x: F.when(
            (s["own"] == 1) & (x["reach"] <= s["start"]) & (x["next"] >= s["end"]), s["at"]))
        return F.transform(F.array_sort(F.filter(clear, lambda i: i.isNotNull())), lambda i: F.get(spans, i))

    def tagged(list_, own):
        return F.transform(list_, lambda s, i: F.struct(
            s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), i.alias("at")))
    both = F.array_sort(F.concat(tagged(others, 0), tagged(spans, 1)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(both, sweep)).otherwise(spans)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def bases(totals: DataFrame, part: str, amount: str, block: int = 1024) -> DataFrame:
    """(part, base): the sum of ``amount`` over all smaller parts. ``totals`` has one row
    per part, parts being partition numbers from 0. Blocks of parts are summed first, so
    no task holds more than a block or the list of blocks."""
    t = totals.select(F.col(part).cast("long").alias("part"), F.col(amount).cast("long").alias("amount"),
                      F.floor(F.col(part) / block).alias("block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (t.groupBy("block").agg(F.sum("amount").alias("amount"))
              .select("block", F.sum("amount").over(before(Window.orderBy("block"))).alias("under")))
    inner = F.sum("amount").over(before(Window.partitionBy("block").orderBy("part")))
    return t.select("part", "block", inner.alias("inner")).join(blocks, "block").select(
        F.col("part").alias(part), (F.coalesce("inner", F.lit(0)) + F.coalesce("under", F.lit(0))).alias("base"))


OUT_BYTES = 8 << 20             # of texts and binaries that a Python task holds for Spark


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: 8 MB go to Python at a time, not Spark's 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def per_document(docs: DataFrame, fn, fields: str, inputs: tuple[str, ...] = ("doc_id", "text"),
                 each_task: bool = False) -> DataFrame:
    """Rows that ``fn(*lists of the input columns)`` makes (tuples, as ``fields`` names
    them, in a list or one by one), a few hundred documents at a time. They go back to
    Spark whenever their texts and binaries pass ``OUT_BYTES``. No shuffle. With
    ``each_task``, ``fn()`` is called at the start of each task and returns that function,
    which may keep state from one call to the next."""
    bound_batches(docs.sparkSession)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def record(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow)

    def run(batches):
        make = fn() if each_task else fn
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, size = [], 0
                for row in make(*[part.column(i).to_pylist() for i in range(part.num_columns)]):
                    rows.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if size > OUT_BYTES:
                        yield record(rows)
                        rows, size = [], 0
                if rows:
                    yield record(rows)

    return docs.select(*inputs).mapInArrow(run, schema)


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the held-out
    fifth, chosen by a hash of the id. A document with several labels has the largest, one
    with several rows the smallest text; null labels don't count. The labels are small by
    their bound, so they are broadcast; repeated rows are combined before the shuffle."""
    lab = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max(label).alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
           .withColumnRenamed("doc_id", "_id"))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(lab), F.col("doc_id") == F.col("_id"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
