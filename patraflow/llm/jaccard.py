"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles of `k` words. Documents with one set form a class; the rest works on
classes. Exact steps, each of which keeps every link:

1. Of all shingle hashes a fixed share above 1 - similarity is counted over classes. A class that holds more than
   (1 - similarity) * size shingles found in no other class can't link, and goes.
2. A size band fixes the largest symmetric difference d of two linked sets and a number of blocks above d. Each shingle flips one bit of
   the parity sketch of its block. The sketches' Hamming distance is at most the symmetric difference, so at most d blocks differ and
   linked sets agree in a block whose sketch isn't zero if one of them has more than d such blocks. Where a sketch has no more, its
   smallest shingles (a prefix that linked sets must share) join as well, for partners that have no more either.
3. Every class meets one class, the pivot: of the smallest classes of its keys the one that most classes meet. A class that isn't linked to
   its pivot meets the NEXT smallest classes with which it shares the most keys. Verified pairs give components. Keys that still hold several components pair classes of different components, but only where the symmetric difference can
   be small enough: with a common pivot P, |A d B| >= u(A) + u(B) + ||P - A| - |P - B||, u being the shingles that no other such class has.
   The bound is met by an equi-join on its buckets, so pairs that it rules out are never made; the classes of a large pivot are dealt to
   as many tasks as they need.
4. Within the joins pairs are pruned by the Hamming distance of short dense sketches; what is left is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._bitmap import bitmap, may_contain
from ._store import drop, release, save
from .components import components

#: Sixteenths of the hash space that step 1 counts; above 0.2.
SHARE = 5
#: 64-bit words of the dense sketch.
DENSE = 8
#: Classes of one pivot that go to one task, and rows of one class.
DEALT, ROWS = 256, 1024
#: Further classes that a class meets if it isn't linked to its pivot; pairs beyond are found in step 3's last part.
NEXT = 8
U = np.uint64


def _sets(batch, text, k):
    for rows, data, at in X.groups(batch, text):
        data = X.lower(data)
        starts, ends, first = X.words(data, at)
        row, h = X.distinct(*X.shingles(X.word_hashes(data, starts, ends), first, k))
        yield rows, row, h, np.searchsorted(row, np.arange(len(at)))


def _sums(v, edge):
    total = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v, dtype=v.dtype)])
    return total[edge[1:]] - total[edge[:-1]]


def _digests(h, edge):
    return [_sums(X.mix(h ^ U(s)), edge).view(np.int64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _base(id_col, text, k):
    def run(batches):
        for batch in batches:
            for rows, _, h, edge in _sets(batch, text, k):
                d1, d2 = _digests(h, edge)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(np.diff(edge)), pa.array(d1), pa.array(d2)], ["doc_id", "n", "d1", "d2"])

    return run


def _counted(text, k):
    def run(batches):
        for batch in batches:
            for _, row, h, edge in _sets(batch, text, k):
                d1 = _digests(h, edge)[0]
                keep = (h >> U(60)) < U(SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(d1[row[keep]])], ["h", "d1"])

    return run


def bands(largest: int) -> np.ndarray:
    """First sizes of the bands: sets of similarity 0.8 or more are in one band or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 5 // 4 + 1)
    return np.array(edges)


def block_keys(h: np.ndarray, band: int, high: int) -> np.ndarray:
    """Join keys of one set (sorted distinct hashes) in a band whose largest smaller set has `high` shingles."""
    d = high // 4
    if not d:
        return np.zeros(0, U)
    m = 5 * (d + 1) // 4 + 4
    salt = U(band * 0x9E3779B97F4A7C15 % 2**64)
    x = X.mix(h ^ salt)
    block = (x % U(m)).astype(np.int64)
    flips = X.mix(x // U(m))
    order = np.argsort(block, kind="stable")
    block, flips = block[order], flips[order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sketch = np.bitwise_xor.reduceat(flips, at)
    some = sketch != 0
    keys = X.mix(sketch[some] ^ X.mix(block[at][some].astype(U) + salt))
    if len(keys) > d:
        return keys
    return np.concatenate([keys, X.mix(h[: len(h) // 5 + 1] ^ X.mix(np.array([(band * 0x9E3779B97F4A7C15 + 0xABCDEF) % 2**64], U)))])


def _sketched(text, k):
    def run(batches):
        for batch in batches:
            want = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3)]
            for rows, _, h, edge in _sets(batch, text, k):
                d1, d2 = _digests(h, edge)
                out = []
                for i in np.flatnonzero((d1 == want[0][rows]) & (d2 == want[1][rows])):
                    own = h[edge[i] : edge[i + 1]]
                    bits = np.bincount((own >> U(3)).astype(np.int64) % (64 * DENSE), minlength=64 * DENSE) & 1
                    out.append((batch.column(0)[rows.start + int(i)].as_py(), len(own), np.packbits(bits.astype(np.uint8)).view(np.int64), own.view(np.int64)))
                if out:
                    ids, n, dense, sets = zip(*out, strict=True)
                    lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32), pa.array(np.concatenate(x))) for x in (dense, sets)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["rep", "n", "dense", "hashes"])

    return run


def set_keys(h: np.ndarray) -> np.ndarray:
    """Join keys of one set in its own band and the one below."""
    edges = bands(len(h))
    b = int(np.searchsorted(edges, len(h), side="right")) - 1
    return np.concatenate([block_keys(h, x, int(edges[x + 1]) - 1) for x in (b, b - 1) if x >= 0])


def _keyed(batches):
    for batch in batches:
        edge, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False).view(U)
        for i in range(0, batch.num_rows, 256):
            keys = [set_keys(flat[edge[j] : edge[j + 1]]) for j in range(i, min(i + 256, batch.num_rows))]
            ids = batch.column(0)[i : i + 256].take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(keys).view(np.int64))], ["rep", "key"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    side = {s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("dense").alias(f"d{s}"), F.col("hashes").alias(f"h{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    apart = F.aggregate(F.zip_with("da", "db", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.where(9 * apart <= F.col("na") + F.col("nb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.select("a", "b", "na", "nb", shared.alias("i")).where("100 * i >= 80 * (na + nb - i)").select("a", "b")


def _pivoted(live: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each class with its pivot: rep, n, p, lost (shingles of the pivot that it lacks), linked. A pivot's set goes to as many tasks as its
    classes need. Also votes (low, rep, v: the keys of rep whose smallest class is low), and the stored tables that this reads."""
    votes = save(live.where("low < rep").groupBy("low", "rep").agg(F.count("*").alias("v")), "votes")
    fame = save(votes.groupBy("low").agg(F.count("*").alias("fame")), "fame")  # stored, so that the join can split a popular class
    best = votes.join(fame, "low").groupBy("rep").agg(F.max(F.struct("fame", (-F.col("low")).alias("m"))).alias("x")).select("rep", (-F.col("x.m")).alias("p"))
    best = save(best, "pivots")
    copies = best.groupBy("p").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("copies"))
    pivots = sets.join(copies, F.col("rep") == F.col("p")).select("p", "copies", F.col("n").alias("np"), F.col("hashes").alias("hp"), F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"))
    members = sets.select("rep", "n", "hashes").join(best, "rep").join(copies, "p").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int")).drop("copies")
    i = F.size(F.array_intersect("hashes", "hp"))
    met = members.join(pivots.drop("copies"), ["p", "salt"]).select("rep", "n", "p", "np", i.alias("i"))
    met = met.select("rep", "n", "p", (F.col("np") - F.col("i")).alias("lost"), F.expr("100 * i >= 80 * (n + np - i)").alias("linked"))
    alone = sets.select("rep", "n").join(best.select("rep"), "rep", "left_anti").select("rep", "n", F.col("rep").alias("p"), F.lit(0).cast("long").alias("lost"), F.lit(False).alias("linked"))
    return met.unionByName(alone), votes, [votes, fame, best]


def _cross(reps: DataFrame, shared: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes of different components that the bounds leave, and the stored table that they come from. reps: rep, label, n,
    p, lost, of the classes in keys with several components; shared: key, rep of these keys."""
    hashes = sets.join(reps.select("rep"), "rep").select("rep", F.explode("hashes").alias("h"))
    own = hashes.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other").groupBy("rep").agg(F.count("*").alias("u"))
    size = reps.groupBy("p", "label").agg(F.count("*").alias("k")).groupBy("p").agg(F.max(F.struct("k", "label")).alias("x"), F.ceil(F.sum("k") / ROWS).cast("int").alias("copies")).select("p", F.col("x.label").alias("top"), "copies")
    rows = reps.join(own, "rep", "left").na.fill(0, ["u"]).join(size, "p").join(sets.select("rep", "dense"), "rep")
    # nine times the bounds, in whole numbers: a pair needs low(a) <= high(b) and low(b) <= high(a)
    rows = rows.withColumns({"low": F.expr("9 * (u + lost) - n"), "high": F.expr("9 * (lost - u) + n")})
    bucket = lambda c: F.floor(F.col(c) * 4 / F.col("n")).cast("int")
    rows = save(rows.withColumns({"from": bucket("low"), "to": F.greatest(F.lit(-40), F.least(F.lit(40), bucket("high")))}), "open")
    # sizes of linked sets differ by a quarter at most, so buckets in units of n / 4 are compared after widening by that ratio
    widened = F.when(F.col("from") >= 0, F.floor(F.col("from") * 0.79)).otherwise(F.floor(F.col("from") * 1.26) - 2).cast("int")
    most = rows.groupBy("p").agg(F.max("to").alias("most"))
    least = F.least(F.greatest(widened, F.lit(-40)), F.lit(40))
    query = rows.where("label <> top").join(most, "p").where(least <= F.col("most")).withColumn("bucket", F.explode(F.sequence(least, F.col("most"))))
    query = query.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = rows.withColumn("bucket", F.col("to")).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("copies")).cast("int"))
    cols = ["rep", "label", "n", "p", "u", "low", "high", "top", "bucket", "salt", "dense"]
    # the Hamming distance of the dense sketches prunes within the joins
    near = " and 9 * (" + " + ".join(f"bit_count(q_dense[{j}] ^ i_dense[{j}])" for j in range(DENSE)) + ") <= q_n + i_n"
    side = lambda x, t: x.select(*[F.col(c).alias(f"{t}_{c}") for c in cols])
    q, i = side(query, "q"), side(dealt, "i")
    fits = F.expr("q_label <> i_label and q_low <= i_high and i_low <= q_high and (i_label = i_top or struct(q_low, q_rep) > struct(i_low, i_rep))" + near)
    same = q.join(i, (F.col("q_p") == F.col("i_p")) & (F.col("q_bucket") == F.col("i_bucket")) & (F.col("q_salt") == F.col("i_salt")) & fits)
    # different pivots: by key, from the classes whose pivot is not the key's most frequent one
    keyed = shared.join(rows.select("rep", "label", "n", "p", "u", "dense"), "rep")
    most = keyed.groupBy("key", "p").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "p")).alias("x"), F.count("*").alias("ps")).where("ps > 1").select("key", F.col("x.p").alias("top"))
    keyed = keyed.join(most, "key")
    q2, i2 = (x.select("key", *[F.col(c).alias(f"{t}_{c}") for c in ["rep", "label", "n", "p", "u", "top", "dense"]]) for x, t in ((keyed.where("p <> top"), "q"), (keyed, "i")))
    differ = q2.join(i2, "key").where("q_p <> i_p and q_label <> i_label and 9 * (q_u + i_u) <= q_n + i_n and (i_p = i_top or q_rep < i_rep)" + near)
    pairs = same.select("q_rep", "i_rep").unionByName(differ.select("q_rep", "i_rep")).select(F.least("q_rep", "i_rep").alias("a"), F.greatest("q_rep", "i_rep").alias("b"))
    return pairs.distinct(), rows


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links of similarity >= 0.8).

    A null, empty or blank text has an empty set, links with nothing and is its own component. Repeated rows stay. Further columns of
    docs are not read. Ids must be integers; a row with a null id keeps a null id and gets its component's smallest id that is known.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = save(docs.mapInArrow(_base("doc_id", "text", k), "doc_id long, n long, d1 long, d2 long"), "sets")
    classes = base.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows"))
    counted = docs.mapInArrow(_counted("text", k), "h long, d1 long").groupBy("h").agg(F.min("d1").alias("d1"), F.max("d1").alias("other"))
    alone = counted.where("d1 = other").groupBy("d1").agg(F.count("*").alias("alone"))
    left = save(classes.where("rep is not null").join(alone, "d1", "left").where("5 * coalesce(alone, 0) <= n").select("rep", "d1", "d2"), "left")
    release(spark)
    chosen = may_contain(docs, "doc_id", bitmap(left, "rep")).join(left.withColumnRenamed("rep", "doc_id"), "doc_id")
    sets = chosen.select("doc_id", "text", "d1", "d2").mapInArrow(_sketched("text", k), "rep long, n long, dense array<long>, hashes array<long>")
    if base.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        sets = sets.dropDuplicates(["rep"])  # rows that repeat an id
    sets = save(sets, "sketches")
    drop(left)
    keys = sets.select("rep", "hashes").mapInArrow(_keyed, "rep long, key long")
    ends = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    live = save(keys.join(ends, "key"), "keys")
    release(spark)
    met, votes, stored = _pivoted(live, sets)
    met = save(met, "met")
    order = Window.partitionBy("rep").orderBy(F.col("v").desc(), "low")
    left = votes.join(met.where("not linked").select("rep", "p"), "rep").where("low <> p").withColumn("k", F.row_number().over(order))
    further = save(_verified(left.where(F.col("k") <= NEXT).select(F.col("low").alias("a"), F.col("rep").alias("b")), sets), "further")
    drop(*stored)
    links = met.where("linked").select(F.col("p").alias("a"), F.col("rep").alias("b")).unionByName(further)
    labels = components(links)
    named = live.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("g")).where("l < g").select("key")
    shared = save(live.select("key", "rep").join(mixed, "key").distinct(), "mixed")
    drop(live)
    reps = save(shared.select("rep").distinct().join(met.drop("linked"), "rep").join(labels, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("label", "rep").alias("label"), "n", "p", "lost"), "reps")
    pairs, open_ = _cross(reps, shared, sets)
    more = save(_verified(pairs, sets), "links")
    drop(shared, reps, open_, sets)
    if more.limit(1).count():
        # one edge for two components that meet, however many of their classes do
        named = lambda side: labels.select(F.col("node").alias(f"node_{side}"), F.col("label").alias(f"label_{side}"))
        ends = more.join(named("a"), F.col("a") == F.col("node_a"), "left").join(named("b"), F.col("b") == F.col("node_b"), "left")
        ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
        labels = components(links.unionByName(ends))
    drop(met, more, further)
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("label", "rep").alias("component_id"))
    # rows of a class go to as many tasks as they need; classes of a thousandth of the rows or more are a thousand at most
    large = save(classes.where(F.col("rows") >= max(ROWS, base.count() // 1000)).select("d1", "d2", F.ceil(F.col("rows") / ROWS).cast("int").alias("copies")), "large")
    salted = lambda df: df.join(F.broadcast(large), ["d1", "d2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    named = salted(named).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    rows = salted(base.where("n > 0")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    out = rows.join(named, ["d1", "d2", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
