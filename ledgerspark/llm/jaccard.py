"""N-gram Jaccard join by universe partition and pigeonhole.

A document is its set of 5-word shingles (64-bit hashes). Two documents link when
100 * intersection >= 75 * union; then their sets differ in at most
H = (s + l) * 25 / 175 shingles, s and l being the sizes. Sizes fall into bands that
double; the scheme of a band serves the pairs whose larger set lies in it, so a document
takes part in one or two schemes.

Level 1 (segment subsets). A scheme cuts the hash universe into m segments. At most H of
a document's non-empty segment subsets can differ in a linked document, so the H + 1 + X
smallest subset signatures (a prefix in one global order) of the two share X + 1 or more.
X is the allocation to spare: a signature that is too frequent ("hot": a passage that
many documents share) gets allocation 0, and the guarantee holds for every document with
at most X hot signatures. So a link can be lost only between two documents that both have
more hot signatures than they can spare ("needy").

Level 2 (one-deletion neighbourhoods). Needy documents alone are cut into fewer, larger
segments, each worth two differences: subsets that differ by one shingle meet because
every subset is indexed whole and with each one shingle deleted.

The rest, documents that even so share hot signatures only (dense groups of copies that
are nearly, but not quite, linked), are compared in blocks: their sets are dealt into
tiles of bounded size, and a task counts the intersections of a tile by an inverted index
and returns no more links than join its components.

Buckets hold documents with a signature in common. Each document is first compared with
the smallest of its bucket only, so a large group of near copies costs one comparison
each, not one per pair. Where a bucket's documents still are in different components, the
pairs across components are counted (unless the bucket is hot), and those that share as
many signatures as the guarantee asks for are compared. A document that shares, with all
others together, no more signatures than it can spare has no link, and its rows go no
further. All pairs are verified on the whole sets. Exact copies are joined by a hash of
their words first; only the smallest id emits signatures.

Costs: about half a signature per shingle is shuffled; the rest follows the number of
documents that share signatures. The blocks read a dense group of n documents n / (size
of a block) times, which only matters for very large groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BREAK, ascii_lower, id_type, per_document, split_words, staged
from .components import connected

WORDS, PERCENT = 5, 75
SPARE = 0.2                     # X as a share of the largest H of a scheme
HOT_PAIRS = 50                  # pairs across components that make a bucket hot
BLOCK = 250_000                 # shingles of a block of the rest, about
BROADCAST_ROWS = 300_000        # of small rows (ids); beyond it joins shuffle
COPY_IDS = 2_000_000            # ids of copies that are broadcast; beyond it copies emit signatures as well

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(v: np.ndarray) -> np.ndarray:
    """Sorted distinct values, in a third of the time of ``np.unique``."""
    v = np.sort(v)
    return v[np.append(True, v[1:] != v[:-1])]


def split(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of all runs of five words, or of the whole shorter
    sequence. Different shingles of equal hash would count as one (2^-64 a pair)."""
    import xxhash

    if not ws:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, ws)), ">u8").astype(np.uint64)
    n = min(WORDS, len(ws))
    v = np.full(len(ws) - n + 1, np.uint64(n))
    for k in range(n):
        v = v * _PRIME + h[k:len(h) - n + 1 + k]
    return _distinct(_mix(v))


def most_apart(s: int, most: int) -> int:
    """Differences that a set of s shingles can have with a linked set of up to
    ``most`` shingles."""
    return (s + min(most, s * 100 // PERCENT)) * (100 - PERCENT) // (100 + PERCENT)


def schemes(s: int) -> list[tuple[int, int]]:
    """(band, H) of the one or two schemes of a set of s shingles."""
    band = max(0, (s - 1).bit_length())
    out = [(band, most_apart(s, 1 << band))]
    if s * 100 // PERCENT > 1 << band:
        out.append((band + 1, most_apart(s, 2 << band)))
    return out


def _segments(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, segment, sum of hashes) of the non-empty segment subsets of a sorted set."""
    seg = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    return first, seg[first], np.add.reduceat(h, first)


def _key(content: np.ndarray, seg: np.ndarray, salt: int) -> np.ndarray:
    return _mix(content ^ _mix(seg * _PRIME + np.uint64(salt)))


def subset_keys(h: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """Level 1: (signatures, spare, band) per scheme. spare -1: too few segments."""
    out = []
    for band, apart in schemes(len(h)):
        salt = 4 * band + 1
        spare = int(SPARE * most_apart(1 << band, 1 << band)) + 2
        _, seg, content = _segments(h, 4 * (1 << band) // 10 + 6)
        keys = _key(content, seg, salt)
        take = min(len(keys), apart + 1 + spare)
        if take < len(keys):
            keys = np.partition(keys, take - 1)[:take]
        out.append((keys, max(-1, take - apart - 1), band))
    return out


def neighbourhood_keys(h: np.ndarray, bands: list[int]) -> list[tuple[np.ndarray, int, int]]:
    """Level 2: signatures of all segment subsets whole and with one shingle deleted.
    A subset of one shingle is worth one difference, a larger one two; subsets worth
    more than H in all leave that much shared, else empty subsets are indexed as well."""
    out = []
    for band, apart in schemes(len(h)):
        if band not in bands:
            continue
        m, salt = 3 * (most_apart(1 << band, 1 << band) + 1) // 4 + 2, 4 * band + 2
        first, seg, content = _segments(h, m)
        sizes = np.diff(np.append(first, len(h)))
        member = np.repeat(np.arange(len(seg)), sizes)
        some = sizes[member] > 1
        keys = [_key(content, seg, salt), _key((content[member] - h)[some], seg[member][some], salt)]
        worth = int(np.minimum(sizes, 2).sum())
        if worth <= apart:
            none = np.arange(m, dtype=np.uint64)
            none = none[~np.isin(none, seg[sizes > 1])]           # empty, or empty after a deletion
            keys.append(_key(np.zeros(len(none), np.uint64), none, salt))
        out.append((_distinct(np.concatenate(keys)), max(0, -(-(worth - apart) // 2) - 1), band))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n, words_id): size of the set and hash of the word sequence, null if
    there are no words."""
    def run(ids, texts):
        import xxhash

        out = []
        for i, t in zip(ids, texts):
            ws = split(t)
            out.append((i, len(shingles(ws)), xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None))
        return out
    return per_document(docs, run, f"doc_id {id_type(docs)}, n long, words_id binary")


def _emit(docs: DataFrame, level: int) -> DataFrame:
    """(key, node, info): the signatures of each document; of copies, one in a task.
    Level 2 reads the column ``bands``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"key long, node {id_type(docs)}, info long")
    arrow = to_arrow_schema(schema)
    signatures = {1: lambda h, _: subset_keys(h), 2: neighbourhood_keys}[level]

    def run(batches):
        import xxhash

        seen = set()            # hashes of this task's texts
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            bands = batch.column(2).to_pylist() if level > 1 else [None] * len(ids)
            for at in range(0, len(ids), 256):
                keys, rows, infos = [], [], []
                for r, t in enumerate(texts.slice(at, 256).to_pylist(), at):
                    ws = split(t)
                    mark = (xxhash.xxh3_128_digest(b" ".join(ws)), tuple(bands[r] or ()))
                    if not ws or mark in seen:
                        continue
                    seen.add(mark)
                    h = shingles(ws)
                    for k, spare, band in signatures(h, bands[r]):
                        keys.append(k)
                        rows.append(np.full(len(k), r))
                        infos.append(np.full(len(k), (len(h) << 32) + ((spare + 1) << 6) + band))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                                      ids.take(pa.array(np.concatenate(rows))),
                                                      pa.array(np.concatenate(infos))], schema=arrow)

    cols = ["doc_id", "text"] + ["bands"] * (level > 1)
    return docs.filter("doc_id is not null").select(*cols).mapInArrow(run, schema)


def _size(info: str):
    """info: size of the set, spare + 1 and band in one number."""
    return F.shiftright(info, 32)


def _spare(info: str):
    return F.shiftright(F.col(info).bitwiseAND(0xFFFFFFFF), 6) - 1


def _band(info: str):
    return F.col(info).bitwiseAND(63)


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, node, info, center, cinfo): rows that share a key with another, beside the
    smallest node of the key and its info; rows that can spare nothing stay alone with a
    null center. Each partition is read in order of the key, a batch at a time, so a
    key may have any number of rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = keys.schema["node"].dataType.simpleString()
    schema = StructType.fromDDL(f"key long, node {kind}, info long, center {kind}, cinfo long")
    arrow = to_arrow_schema(schema)

    def rows(table, emit, first, shared):
        pick = pa.array(np.flatnonzero(emit))
        center = pa.array(np.where(shared, first, 0)[emit], mask=~shared[emit])
        return pa.RecordBatch.from_arrays(
            [c.take(pick) for c in table.columns] + [c.take(center) for c in table.columns[1:]], schema=arrow)

    def run(batches):
        head, told = None, False          # first row of the last key, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([x for x in (head, batch) if x is not None]).combine_chunks().to_batches()[0]
            k = table.column(0).to_numpy()
            alone = (table.column(2).to_numpy() & 0xFFFFFFFF) < 64      # spare of -1
            start = np.append(True, k[1:] != k[:-1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
            shared = ~start | np.append(k[1:] == k[:-1], False)
            shared[0] |= told
            emit = shared | alone
            if head is not None and told:
                emit[0] = False
            last = int(first[-1])
            told_now = bool(shared[last])
            if not told_now:
                emit[last] = False                                      # its key may go on in the next batch
            if emit.any():
                yield rows(table, emit, first, shared)
            head, told = table.slice(last, 1), told_now
        if head is not None and not told and (head.column(2)[0].as_py() & 0xFFFFFFFF) < 64:
            one = np.array([True])
            yield rows(head, one, np.array([0]), ~one)

    sorted_ = keys.repartition("key").sortWithinPartitions("key", "node")
    return staged(sorted_.mapInArrow(run, schema), "buckets")


def _small(df: DataFrame) -> DataFrame:
    """Hint a broadcast where the counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_link(a: str, b: str):
    return 100 * F.least(_size(a), _size(b)) >= PERCENT * F.greatest(_size(a), _size(b))


def verify(docs: DataFrame, pairs: DataFrame, doubtful: bool = False) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose whole sets link. The set of b travels to a,
    once for each pair; a may be the same in any number of pairs. Of ``doubtful`` pairs the
    upper halves of the hashes are compared first: these can only agree more often."""
    if doubtful:
        return _compare(docs, _compare(docs, pairs, np.uint32), np.uint64)
    return _compare(docs, pairs, np.uint64)


def _compare(docs: DataFrame, pairs: DataFrame, kept: type) -> DataFrame:
    def blob(text):
        h = shingles(split(text))
        return (h if kept is np.uint64 else (h >> np.uint64(32)).astype(kept)).tobytes()

    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    n = pairs.count()
    if not n:
        return pairs
    few = F.broadcast if n <= BROADCAST_ROWS else _small        # no more documents than pairs
    d = docs.select("doc_id", "text")
    own = few(pairs.groupBy("b").agg(F.collect_list("a").alias("with_a")))   # centers of b's own signatures
    kind = id_type(docs)

    def sets(ids, texts, others):           # a document's set once for each partner, never all at once
        for i, t, o in zip(ids, texts, others):
            own_set = blob(t)
            for a in o:
                yield a, i, own_set
    side_b = per_document(d.join(own, F.col("doc_id") == F.col("b")), sets, f"a {kind}, b {kind}, set_b binary", ("doc_id", "text", "with_a"))
    centers = few(pairs.select(F.col("a").alias("c")).distinct())
    side_a = per_document(d.join(centers, F.col("doc_id") == F.col("c"), "left_semi"),
                          lambda ids, texts: ((i, blob(t)) for i, t in zip(ids, texts)),
                          f"c {kind}, set_a binary")

    def linked(a, b, set_a, set_b):
        out = []
        for i, j, x, y in zip(a, b, set_a, set_b):
            x, y = np.frombuffer(x, kept), np.frombuffer(y, kept)
            if not len(x) or not len(y):
                continue
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            k = int((y[at] == x).sum())
            if 100 * k >= PERCENT * (len(x) + len(y) - k):
                out.append((i, j))
        return out
    both = side_b.join(side_a, F.col("a") == F.col("c"))
    return staged(per_document(both, linked, f"a {kind}, b {kind}", ("a", "b", "set_a", "set_b")).distinct(), "links")


def _with_comp(rows: DataFrame, comps: DataFrame, **names: str) -> DataFrame:
    """``rows`` and, as each name, the component of the node in the column given for it."""
    c = _small(comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp")))
    for name, node in names.items():
        rows = (rows.join(c, F.col(node) == F.col("_node"), "left")
                .withColumn(name, F.coalesce("_comp", node)).drop("_node", "_comp"))
    return rows


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) after further links (a, b). Only components that these
    join are searched, each as one node: what hangs together already is not gone through
    again."""
    ends = _with_comp(links, comps, x="a", y="b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    up = staged(connected(ends), "merged").select(F.col("node").alias("_old"), F.col("comp").alias("_new"))
    if up.isEmpty():
        return comps
    moved = comps.join(_small(up), F.col("comp") == F.col("_old"), "left").select("node", F.coalesce("_new", "comp").alias("comp"))
    fresh = up.join(comps, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_new").alias("comp"))
    return staged(moved.unionByName(fresh), "comps")


def _live(rows: DataFrame, n) -> DataFrame:
    """(node): documents whose rows, ``n`` in all, are more signatures than they can spare
    in one of their schemes. Linked documents share more than that, whichever of them
    is asked: with a smaller prefix than its scheme's, a set has all its signatures in it."""
    return staged(rows.groupBy("node", "info").agg(n.alias("n")).filter(F.col("n") > _spare("info")).select("node").distinct(), "live")


def _work_off(docs: DataFrame, buckets: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(components after the links among the documents of the buckets, rows of the hot
    buckets, which were left out)."""
    shared = buckets.filter("center is not null")
    stars = staged(shared.groupBy("node", "info", "center", "cinfo").agg(F.count(F.lit(1)).alias("k")), "stars")
    live = _live(stars, F.sum("k"))
    stars = stars.filter("node <> center")
    # a count that shows a likely link; stars that don't reach it stay open
    likely = stars.filter(_may_link("info", "cinfo") & (2 * F.col("k") > F.least(_spare("info"), _spare("cinfo"))))
    comps = _merged(comps, verify(docs, likely.select(F.col("center").alias("a"), F.col("node").alias("b"))))
    apart = stars.join(_small(live), "node", "left_semi").select("node", "center").distinct()
    apart = _with_comp(apart, comps, x="node", y="center")
    apart = staged(apart.filter("x <> y").select("node", "center"), "apart")
    if apart.isEmpty():
        return comps, None
    keys = staged(shared.join(_small(apart), ["node", "center"], "left_semi").select("key").distinct(), "open")
    rows = shared.join(_small(live), "node", "left_semi").select("key", "node", "info").join(_small(keys), "key", "left_semi")
    rows = staged(_with_comp(rows, comps, comp="node"), "open-rows")
    rows = rows.join(_small(_live(rows, F.count(F.lit(1)))), "node", "left_semi")
    per_key = (rows.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("n_comp"))
               .groupBy("key").agg(F.sum("n_comp").alias("n_all"), F.sum(F.col("n_comp") * F.col("n_comp")).alias("n_own")))
    hot = (F.col("n_all") * F.col("n_all") - F.col("n_own")) / 2 > HOT_PAIRS
    hot_keys = _small(staged(per_key.filter(hot).select("key"), "hot-keys"))
    hot_rows = staged(rows.join(hot_keys, "key", "left_semi").select("key", "node", "info"), "hot-rows")
    cold = rows.join(hot_keys, "key", "left_anti")
    p, q = cold.alias("p"), cold.alias("q")
    pairs = (p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.comp") != F.col("q.comp"))
                    & _may_link("p.info", "q.info"))
             .groupBy(F.col("p.node").alias("a"), F.col("q.node").alias("b"), _band("p.info").alias("band"))
             .agg(F.count(F.lit(1)).alias("k"), F.max(F.least(_spare("p.info"), _spare("q.info"))).alias("spare")))
    # the hot signatures that the two share count as well; each document's own are few, and
    # travel as 32 bits: those that become equal (merged) count as shared
    own_hot = staged(hot_rows.groupBy("node", _band("info").alias("band")).agg(
        F.collect_set(F.hash("key")).alias("keys"), F.count(F.lit(1)).alias("rows"))
        .select("node", "band", "keys", (F.col("rows") - F.size("keys")).alias("merged")), "hot")
    for end in ("a", "b"):
        pairs = pairs.join(own_hot.select(F.col("node").alias(end), "band", F.col("keys").alias(f"hot_{end}"),
                                          *[F.col("merged")] * (end == "a")), [end, "band"], "left")
    k_hot = F.coalesce(F.size(F.array_intersect("hot_a", "hot_b")) + F.col("merged"), F.lit(0))
    pairs = pairs.filter(F.col("k") + F.greatest(F.lit(0), k_hot) > F.col("spare"))
    return _merged(comps, verify(docs, pairs.select("a", "b"), doubtful=True)), hot_rows


def _needy(buckets: DataFrame, hot_rows: DataFrame | None) -> DataFrame:
    """(node, bands): documents whose guarantee the hot signatures use up, and those that
    have none (at level 2 all have)."""
    needy = buckets.filter(_spare("info") < 0).select("node", _band("info").alias("band"))
    if hot_rows is not None:
        needy = needy.unionByName(hot_rows.groupBy("node", _band("info").alias("band"))
                                  .agg(F.count(F.lit(1)).alias("k"), F.max(_spare("info")).alias("spare"))
                                  .filter("k > spare").select("node", "band"))
    return staged(needy.distinct().groupBy("node").agg(F.sort_array(F.collect_list("band")).alias("bands")), "needy")


def _tile_links(rows):
    """Links of one tile, as a pandas frame (i, j, block, node, comp, set): the pairs of a
    block i document and a block j document (of all, where the blocks are one)."""
    import pandas as pd

    up: dict = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    same = rows["i"].iloc[0] == rows["j"].iloc[0]
    left = rows[rows["block"] == rows["i"]]
    right = rows[rows["block"] == rows["j"]]
    sets = [np.frombuffer(b, np.uint64) for b in right["set"]]
    sizes = np.array([len(x) for x in sets])
    if not len(left) or not len(right):
        return pd.DataFrame({"a": left["node"][:0], "b": left["node"][:0]})
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    nodes, comps = right["node"].tolist(), right["comp"].tolist()
    a, b = [], []
    for at, (node, comp, blob) in enumerate(zip(left["node"], left["comp"], left["set"])):
        x = np.frombuffer(blob, np.uint64)
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        k = np.bincount(hits, minlength=len(sets))
        for r in np.flatnonzero(100 * k >= PERCENT * (len(x) + sizes - k)):
            if (not same or r > at) and find(comp) != find(comps[r]):
                up[find(comp)] = find(comps[r])
                a.append(node)
                b.append(nodes[r])
    return pd.DataFrame({"a": a, "b": b}, dtype=rows["node"].dtype)


def _rest(docs: DataFrame, hot_rows: DataFrame, needy: DataFrame, comps: DataFrame) -> DataFrame:
    """Links among the needy documents, by groups of those that are joined by hot
    signatures, in tiles of two blocks."""
    kind = id_type(docs)
    hot_rows = hot_rows.join(_small(needy.select("node")), "node", "left_semi").select("key", "node")
    center = hot_rows.groupBy("key").agg(F.min("node").alias("center"))
    group = connected(hot_rows.join(center, "key").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct())
    group = staged(group.select("node", F.col("comp").alias("group")), "groups")
    sets = per_document(docs.select("doc_id", "text").join(_small(group), F.col("doc_id") == F.col("node")),
                        lambda ids, texts, groups: ((g, i, len(h), h.tobytes()) for i, t, g in zip(ids, texts, groups) if len(h := shingles(split(t)))),
                        f"group {kind}, node {kind}, n long, set binary", ("doc_id", "text", "group"))
    sets = staged(sets, "rest")
    blocks = sets.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("group", "_group")
    sets = _with_comp(sets, comps, comp="node")
    dealt = (sets.join(_small(staged(blocks, "blocks")), F.col("group") == F.col("_group"))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "set"))
    return staged(dealt.groupBy("group", "i", "j").applyInPandas(_tile_links, f"a {kind}, b {kind}"), "rest-links")


def classes(docs: DataFrame, copies: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """(node, comp): the components by the edges ``copies`` (a, b) and all verified links.
    The ids ``joined`` (a) hang on a copy of all their words, which stands for them."""
    comps, now = staged(connected(copies), "comps"), docs
    if joined is not None and joined.count() <= COPY_IDS:
        now = docs.join(F.broadcast(joined), F.col("doc_id") == F.col("a"), "left_anti")
    for level in (1, 2):
        buckets = _buckets(_emit(now, level))
        comps, hot_rows = _work_off(docs, buckets, comps)
        needy = _needy(buckets, hot_rows)
        if needy.isEmpty():
            return comps
        now = docs.select("doc_id", "text").join(_small(needy), F.col("doc_id") == F.col("node"))
    return _merged(comps, _rest(docs, hot_rows, needy, comps))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, its own included). Null, empty and blank texts have no
    shingles and link with nothing; a null doc_id stays null. Rows that share a doc_id
    are one document. Further columns are ignored."""
    docs = docs.select("doc_id", "text")
    m = staged(measure(docs), "sets")
    full = m.filter("n > 0 and doc_id is not null")
    reps = full.groupBy("words_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    copies = staged(full.join(reps, "words_id").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    # an id with another row may have other words there
    again = m.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("a"))
    joined = staged(copies.select("a").join(again, "a", "left_anti"), "joined")
    comps = classes(docs, copies, joined)
    return m.join(comps, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest of their component, once
    each: of rows that share that doc_id and the words, any one stays. Rows with a null
    doc_id are compared with each other for equal words only; those without words all stay."""
    gone = staged(near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    # only rows of repeated ids are compared
    ids = staged(left.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    same = left["doc_id"].eqNullSafe(ids["_id"])
    words = F.array_join(split_words(ascii_lower(F.col("text")), SPACE_BREAK), " ")
    again = left.join(ids, same, "left_semi").withColumn("__words", words)
    compared = F.col("doc_id").isNotNull() | (F.col("__words") != "")
    return (left.join(ids, same, "left_anti").unionByName(again.filter(~compared).drop("__words"))
            .unionByName(again.filter(compared).dropDuplicates(["doc_id", "__words"]).drop("__words")))
