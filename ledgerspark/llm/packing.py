"""Packing by concatenating and cutting.

Documents are tokenised once and written with their place in their partition: the ids
before them there (first prefix sum, kept by the task itself). The token totals of the
partitions, one row each, are summed again over the partitions; with that base every
document has its global offset, and fixed windows of ``LENGTH`` ids cut the endless row
of ids into sequences. A window that crosses documents or partitions gets one piece of
each, so no id moves: only the last sequence can be short.

Pieces are computed where their document lies, without a shuffle. Whole sequences are put
together the same way (:func:`sequences`): a task joins the pieces that follow one another,
and only the boundary records, the cut-off ends of its run, are grouped by sequence.

Tokenising: this vocabulary drops white space and never joins over it, so a blank ends
every merge. Texts are cut at blanks, each task remembers the ids of the pieces between
them, and plain words of letters go to the vocabulary's model without the patterns that
split signs from letters; a test holds the ids against those of whole texts.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bases, bound_batches, id_type, per_document, staged

LENGTH = 2048                   # ids of a sequence
END = 1                         # the id that ends a document
BEYOND = 0x530                  # first code point of words that take the tokenizer's whole way
REMEMBERED = 700_000            # pieces between blanks that a task remembers at a time (150 MB)


def default_tokenizer() -> str:
    """The vocabulary's file, which every executor must have at this path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, end: int = END):
    """A function of a list of texts: the ids of each, ``end`` last, as little-endian
    unsigned 32-bit numbers. Null texts count as empty."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # Spark gives a task its core
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    # the model reads bytes as letters; ASCII letters stand for themselves
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, BEYOND)}
    last = array("I", [end]).tobytes()
    known: dict[str, bytes] = {}

    def word_ids(word):
        return array("I", [t.id for t in model.tokenize(word if word.isascii() else word.translate(letters))]).tobytes()

    def encode(texts):
        gc.disable()            # nothing here refers to itself, and the collector would walk all of ``known``
        try:
            return ids_of(texts)
        finally:
            gc.enable()

    def ids_of(texts):
        cut = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = set().union(*cut).difference(known)
        plain = {w: n for w in new if w.isalpha() and (n := normal(w))}
        signed = [(w, n, m[1], m[3]) for w in new - plain.keys() if (m := SIGNED.fullmatch(w)) and (n := normal(m[2]))]
        rest = new.difference(plain, (p[0] for p in signed)).union((p[2] for p in signed), (p[3] for p in signed))
        rest = list(rest.difference(known))
        for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        for n in set(plain.values()).union(p[1] for p in signed).difference(known):
            known[n] = word_ids(n)
        for w, n in plain.items():
            known[w] = known[n]
        for w, n, head, tail in signed:
            known[w] = known[head] + known[n] + known[tail]
        return [b"".join(map(known.__getitem__, ws)) + last for ws in cut]
    return encode


#: A word of letters with ASCII signs before or after it; an apostrophe may start a token
#: of letters, "<" a special token.
SIGNED = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:;=-@\[-`{-~]*)")


def normal(word: str) -> str | None:
    """A word of letters as the tokenizer normalises it; None where that may leave
    something else than letters, or is not Latin, Greek or Cyrillic."""
    if word.isascii():
        return word.lower()
    if max(word) >= chr(BEYOND) or "Σ" in word:         # whose lower case depends on its place
        return None
    word = unicodedata.normalize("NFC", word).lower()
    return word if word.isalpha() else None


def tokenise(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, part, before, n, ids): the ids of each row of ``docs`` and how many its
    partition ``part`` has before them."""
    path = tokenizer or default_tokenizer()

    def start():
        from pyspark import TaskContext

        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0

        def run(doc_ids, texts):
            nonlocal before
            for i, ids in zip(doc_ids, encode(texts)):
                yield i, part, before, len(ids) // 4, ids
                before += len(ids) // 4
        return run
    return per_document(docs, start, f"doc_id {id_type(docs)}, part int, before long, n long, ids binary", each_task=True)


def _div(a: Column, b: int) -> Column:
    return ((a - a % b) / b).cast("long")


def _windows(at: Column, n: Column, length: int) -> Column:
    """array<struct<start, length, sequence_id, offset, ids>> of a document's pieces."""
    def piece(w):
        lo, hi = F.greatest(w * length, at), F.least((w + 1) * length, at + n)
        return F.struct((lo - at).alias("start"), (hi - lo).alias("length"), w.alias("sequence_id"),
                        (lo - w * length).alias("offset"),
                        F.substring(F.col("ids"), (4 * (lo - at) + 1).cast("int"), (4 * (hi - lo)).cast("int")).alias("ids"))
    return F.transform(F.sequence(_div(at, length), _div(at + n - 1, length)), piece)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids
    (binary, little-endian 32-bit), doc_tokens, sequence_id and offset (its place there).

    Every row of ``docs`` is a document of its own, also with a repeated or null doc_id.
    Null and empty texts are the end id alone. Sequences are numbered from 0 in the order
    of the partitions of ``docs``, and each but the last is full. No rows give no pieces;
    further columns are ignored."""
    tokens = staged(tokenise(docs, tokenizer), "tokens")
    total = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row of two numbers per task, fewer than the driver keeps of each task itself
    base = F.broadcast(bases(total, "part", "total"))
    at = F.col("base") + F.col("before")
    return (tokens.join(base, "part")
            .select("doc_id", F.col("n").alias("doc_tokens"), F.explode(_windows(at, F.col("n"), length)).alias("x"))
            .select("doc_id", "x.start", "x.length", "x.ids", "doc_tokens", "x.sequence_id", "x.offset"))


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, length, padding, ids): the sequences that ``pieces`` make up, ids
    little-endian and not padded; ``padding`` is 0 where the length is a power of two, else
    what is missing to ``length``. Pieces may come in any order and partitioning: those
    that lie one after the other are joined in place, the rest is grouped by sequence, at
    most ``length`` records each."""
    import pyarrow as pa

    bound_batches(pieces.sparkSession)
    fields = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        """Joins what follows on; gives out what is done when a batch ends."""
        seq, first, ids, size = None, 0, [], 0
        for batch in batches:
            done = []
            for s, o, b in zip(*(c.to_pylist() for c in batch.columns)):
                if s != seq or o != first + size:
                    if ids:
                        done.append((seq, first, b"".join(ids)))
                    seq, first, ids, size = s, o, [], 0
                ids.append(b)
                size += len(b) // 4
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=fields)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((seq, first, b"".join(ids)), fields)], schema=fields)

    runs = staged(pieces.select(F.col("sequence_id").cast("long"), F.col("offset").cast("long"), "ids")
                  .mapInArrow(run, "sequence_id long, offset long, ids binary"), "runs")
    whole = (F.col("offset") == 0) & (F.octet_length("ids") == 4 * length)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b""),
                         lambda acc, x: F.concat(acc, x["ids"]))
    boundary = runs.filter(~whole).groupBy("sequence_id").agg(joined.alias("ids"))
    n = (F.octet_length("ids") / 4).cast("long")
    return runs.filter(whole).select("sequence_id", "ids").unionByName(boundary).select(
        "sequence_id", n.alias("length"),
        F.when(F.bit_count(n) == 1, 0).otherwise(length - n).cast("long").alias("padding"), "ids")


def packed(docs: DataFrame) -> DataFrame:
    """:func:`pack`, with the unsigned CRC-32 of each piece's ids in their place."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                             "doc_tokens", "sequence_id", "offset")
