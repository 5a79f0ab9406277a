"""Near-duplicates: MinHash bands, sequential Bayesian pruning (BayesLSH), exact verification.

1. One pass over the texts: distinct five-word shingles, a 128-bit digest of the set, 126 min-hashes.
   Documents with equal sets form a class; all further work is on classes. A class is named by its
   smallest id, or by a number above all ids where another class has that name.
2. Classes that share one of 21 bands (six values each) are candidates. A bucket compares its members
   with one of them only, so a bucket of any size makes one pair a member; which one it is follows one
   of five random orders, by band, so that a large group meets several.
3. A pair's signatures are compared 21 values at a time. With m of n equal, similarity has the
   posterior Beta(m + 1, n - m + 1); the pair is dropped once P(similarity >= threshold) is below
   ``miss``. What survives is verified on the full sets.
4. Connected components of the links. In buckets whose members are still in several components, the
   members outside the compared one's component meet all others, in blocks of about a thousand rows a
   side. Rows with a partner in another component whose signature passes step 3 are looked at again
   together with their full sets: their pairs are verified in the block, which skips pairs that its own
   links have joined meanwhile. So a bucket is compared in full wherever a link could still join two
   components, and no list of all its pairs is ever made.

Bands miss a pair at similarity 0.85 with probability 5e-5 (0.8: 2e-3); ``miss`` adds 1e-5 a batch.

Edge cases: null, empty and blank texts have no shingles and link with nothing. A null id links with
nothing, has a null component and is kept; ids are cast to long, so one that is no number becomes null.
Rows that share an id are one document: their links unite, and they stay or go together. Of a component the
smallest id stays, so there are no ties. Texts of any length are taken whole, a batch of rows at a time. An
empty table gives an empty result. Extra columns are carried by near_dedup, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, packed, ship
from .wordhash import U64, hash_words, mix, shingles

K, BANDS, ROWS, ORDERS = 5, 21, 6, 5
N_HASH = BANDS * ROWS
BATCH = 21
BLOCK = 1000
BROADCAST_IDS = 1_000_000
CHUNK = 1 << 15
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, N_HASH, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, N_HASH, dtype=np.uint64)
SIGN_SCHEMA = "id long, n int, k1 long, k2 long, sig binary"
SET_SCHEMA = "id long, k1 long, k2 long, set binary"


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; fewer than five words are one shingle."""
    if not len(h):
        return h
    if len(h) < K:
        return shingles(h, len(h)) ^ U64(len(h))
    return np.unique(shingles(h, K))


def _signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each of the min-hashes, one row for each set; sets are not empty."""
    out = np.empty((len(starts), N_HASH), "<u2")
    edges = np.append(starts, len(flat))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + CHUNK, "right")) - 1)
        part, at = flat[edges[a] : edges[b]], edges[a:b] - edges[a]
        tmp = np.empty_like(part)
        with np.errstate(over="ignore"):
            for j in range(N_HASH):
                np.multiply(part, _A[j], out=tmp)
                np.add(tmp, _B[j], out=tmp)
                out[a:b, j] = (np.minimum.reduceat(tmp, at) >> U64(4)).astype("<u2")
        a = b
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers; 0 for empty sets."""
    n = np.array([len(s) for s in sets], np.int64)
    has = np.flatnonzero(n)
    k1, k2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
    if len(has):
        flat = np.concatenate([sets[i] for i in has])
        starts = np.cumsum(n[has]) - n[has]
        with np.errstate(over="ignore"):
            k1[has] = np.add.reduceat(mix(flat), starts)
            k2[has] = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), starts)
    return k1.view(np.int64), k2.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, first = hash_words(batch.column(1), True)
        sets = [shingle_set(h[a:b]) for a, b in zip(first[:-1], first[1:])]
        n = np.array([len(s) for s in sets], np.int64)
        has = np.flatnonzero(n)
        k1, k2 = _digests(sets)
        sigs: list[bytes | None] = [None] * len(n)
        if len(has):
            flat = np.concatenate([sets[i] for i in has])
            starts = np.cumsum(n[has]) - n[has]
            for i, row in zip(has, _signatures(flat, starts)):
                sigs[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n.astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(sigs, pa.binary())], ["id", "n", "k1", "k2", "sig"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, first = hash_words(batch.column(1), True)
        sets = [shingle_set(h[a:b]) for a, b in zip(first[:-1], first[1:])]
        k1, k2 = _digests(sets)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "k1", "k2", "set"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<u2").reshape(-1, N_HASH)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _matrix(batch.column(2)).reshape(-1, BANDS, ROWS).astype(U64)
        with np.errstate(over="ignore"):
            key = np.zeros(rows.shape[:2], U64) + np.arange(1, BANDS + 1, dtype=U64)
            for i in range(ROWS):
                key = mix(key * U64(0x9E3779B97F4A7C13) + rows[:, :, i])
        node = np.repeat(batch.column(0).to_numpy(), BANDS)
        with np.errstate(over="ignore"):
            turn = mix(node.view(U64) + np.tile(np.arange(BANDS, dtype=U64) % U64(ORDERS), batch.num_rows) * U64(0xD6E8FEB86659FD93)).view(np.int64)
        columns = [key.ravel().view(np.int64), node, np.repeat(batch.column(1).to_numpy(), BANDS), turn]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bh", "node", "n", "turn"])


def p_at_least(m: int, n: int, t: float) -> float:
    """P(similarity >= t) after m equal of n min-hashes, from a uniform prior."""
    return sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))


def bounds(t: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, least number equal for which the pair goes on)."""
    return [(n, next(m for m in range(n + 1) if p_at_least(m, n, t) >= miss)) for n in range(BATCH, N_HASH + 1, BATCH)]


def _surviving(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows that pass every bound, and their equal values."""
    left, same, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in limits:
        same = same + (a[left, before:n] == b[left, before:n]).sum(1)
        ok = same >= least
        left, same, before = left[ok], same[ok], n
    return left, same


def _prune(limits: list[tuple[int, int]]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep, _ = _surviving(_matrix(batch.column(2)), _matrix(batch.column(3)), limits)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return prune


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(keys[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _partners(i: int, members: np.ndarray, part: np.ndarray, n: np.ndarray, sig: np.ndarray, limits: list[tuple[int, int]], percent: int) -> np.ndarray:
    """Members in another component than row i that it may link with, by size and signature."""
    to = members[(part[members] != part[i]) & (100 * np.minimum(n[members], n[i]) >= percent * np.maximum(n[members], n[i]))]
    keep, _ = _surviving(np.broadcast_to(sig[i], (len(to), N_HASH)), sig[to], limits)
    return to[keep]


BLOCK_SCHEMA = "bh long, c int, d int, kind int, node long, n int, comp long"


def _open_rows(limits: list[tuple[int, int]], percent: int):
    """Rows of a block (kind 1: outside the main component, kind 0: any member) with a possible partner."""

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, 3):
            kind, part, n = (block.column(c).to_numpy() for c in ("kind", "comp", "n"))
            sig = _matrix(block.column("sig").combine_chunks())
            members, used = np.flatnonzero(kind == 0), np.zeros(len(kind), bool)
            for i in np.flatnonzero(kind == 1):
                found = _partners(i, members, part, n, sig, limits, percent)
                used[found] = True
                used[i] |= len(found) > 0
            for batch in block.drop_columns(["sig"]).filter(pa.array(used)).to_batches():
                yield batch

    return open_rows


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _join_blocks(limits: list[tuple[int, int]], percent: int):
    """Verified links between components of a block; those that its own links have joined are skipped."""

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, 3):
            kind, node, part, n = (block.column(c).to_numpy() for c in ("kind", "node", "comp", "n"))
            part, sig = part.copy(), _matrix(block.column("sig").combine_chunks())
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in block.column("set")]
            members, links = np.flatnonzero(kind == 0), []
            for i in np.flatnonzero(kind == 1):
                for j in _partners(i, members, part, n, sig, limits, percent):
                    if part[i] != part[j] and _similar(sets[i], sets[j], percent):
                        links.append((node[i], node[j]))
                        part[part == part[j]] = part[i]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return join_blocks


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one = None, None
        for batch in batches:
            a, b = [], []
            for x, salt, kind, node, raw in zip(*(batch.column(i) for i in range(5))):
                x, salt, own = x.as_py(), salt.as_py(), np.frombuffer(raw.as_buffer(), "<u8")
                if kind.as_py() == 0:
                    key, one = (x, salt), own
                elif key == (x, salt):
                    if _similar(one, own, percent):
                        a.append(x)
                        b.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. A set travels once for each pair it ends and once for every 256 it starts."""
    salts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / 256)).cast("int").alias("salt"))
    ones = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("kind"), "node", "set")
    others = salted.join(sets, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("kind"), "node", "set")
    rows = ones.unionByName(others)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(_verify(percent), "a long, b long").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp): every node of an edge (a, b) with the smallest node it reaches.

    Alternating large-star and small-star steps; each is a grouped minimum and a join, and every round
    is written to the shared folder. No step gathers a node's neighbours in one row.
    """
    table = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        table = materialize(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges"
        )
        now = tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"connected components: the edges still change after {rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined on id with a table of distinct ids, which is broadcast only if it is known to be small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _number(classes: DataFrame) -> DataFrame:
    """(k1, k2, node): numbers above all ids for classes whose smallest id is that of another class, too."""
    first = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2")).alias("f")).where("c > 1")
    other = classes.select("rep", "k1", "k2").join(first, "rep").where(F.struct("k1", "k2") != F.col("f"))
    other = materialize(other.select("k1", "k2", F.monotonically_increasing_id().alias("m")), "names")
    at, sizes = classes.agg(F.max("top")).first()[0] + 1, other.groupBy(F.shiftright("m", 33).alias("p")).count().collect()
    start = []
    for p, c in sizes:
        start.append((p, at - (p << 33)))
        at += c
    if at > 1 << 63:
        raise ValueError("ids leave no numbers above them for documents that share an id")
    numbers = classes.sparkSession.createDataFrame(start, "p long, start long")
    return other.join(F.broadcast(numbers), F.shiftright("m", 33) == F.col("p")).select("k1", "k2", (F.col("m") + F.col("start")).alias("node"))


def near_groups(docs: DataFrame, threshold: int = 80, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_shingles, component). threshold: least similarity, in percent."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    signed = materialize(rows.mapInArrow(_sign, SIGN_SCHEMA), "signed")
    valid = signed.where("n > 0 and id is not null")
    classes = materialize(
        valid.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("top"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("node", F.col("rep")), "classes"
    )
    # ids with several texts unite their classes
    several = valid.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2") for f in (F.min, F.max)]).where("min_k1 <> max_k1 or min_k2 <> max_k2")
    several = materialize(several.select("id"), "several")
    shared, united = not several.isEmpty(), None
    if shared:
        classes = materialize(classes.join(_number(classes).withColumnRenamed("node", "other"), ["k1", "k2"], "left").withColumn("node", F.coalesce("other", "node")).drop("other"), "classes")
        owned = materialize(_with_ids(valid.select("id", "k1", "k2"), several, "left_semi").distinct().join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node"), "owned")
        united = owned.join(owned.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a <> b")
    sigs = classes.select("node", "n", "sig")
    bands = classes.select("node", "n", "sig").mapInArrow(_bands, "bh long, node long, n int, turn long")
    buckets = bands.groupBy("bh").agg(F.min(F.struct("turn", "node", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    member = materialize(bands.join(buckets, "bh").select("bh", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), "m"), "members")

    t, limits = threshold / 100, bounds(threshold / 100, miss)
    near = F.expr(f"100 * least(n, pivot_n) >= {threshold} * greatest(n, pivot_n)")
    star = member.where("node <> pivot").where(near).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    sa, sb = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    pairs = materialize(star.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_prune(limits), "a long, b long").distinct(), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        found = nodes.select("node").distinct()
        if not shared:
            ids = materialize(found.withColumnRenamed("node", "id"), "ids")
            return materialize(_with_ids(rows, ids, "left_semi").mapInArrow(_sets, SET_SCHEMA).select(F.col("id").alias("node"), "set"), "sets")
        named = materialize(found.join(classes.select("node", F.col("rep").alias("id"), "k1", "k2"), "node"), "ids")
        sets = _with_ids(rows, named.select("id").distinct(), "left_semi").mapInArrow(_sets, SET_SCHEMA)
        return materialize(sets.join(named, ["id", "k1", "k2"]).select("node", "set").dropDuplicates(["node"]), "sets")

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    links = materialize(verified(pairs, sets_of(ends), threshold), "links")
    comps = materialize(connected_components(links.unionByName(united) if shared else links), "components")

    known = member.join(comps, "node", "left").select("bh", "node", "n", "pivot", F.coalesce("comp", "node").alias("comp"))
    mixed = known.groupBy("bh").agg(
        F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("comp"))).alias("main")
    ).where("m > 2 and lo <> hi")
    told = known.join(mixed.select("bh", "m", "main"), "bh")
    outside = told.where("comp <> main").groupBy("bh").agg(F.count(F.lit(1)).alias("s"))
    told = told.join(outside, "bh").select("bh", "node", "n", "comp", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("C"), F.ceil(F.col("s") / BLOCK).cast("int").alias("D"))
    told = told.join(sigs.select("node", "sig"), "node")
    cut = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    any_member = told.select("bh", cut("C").alias("c"), F.explode(F.sequence(F.lit(0), F.col("D") - 1)).alias("d"), F.lit(0).alias("kind"), "node", "n", "comp", "sig")
    outsiders = told.where("comp <> main").select("bh", F.explode(F.sequence(F.lit(0), F.col("C") - 1)).alias("c"), cut("D").alias("d"), F.lit(1).alias("kind"), "node", "n", "comp", "sig")
    blocks = any_member.unionByName(outsiders).repartition(parts, "bh", "c", "d").sortWithinPartitions("bh", "c", "d", "kind")
    open_rows = materialize(blocks.mapInArrow(_open_rows(limits, threshold), BLOCK_SCHEMA), "open-rows")
    if not open_rows.isEmpty():
        full = sets_of(open_rows.select("node")).join(sigs.select("node", "sig"), "node")
        again = open_rows.join(full, "node").select("bh", "c", "d", "kind", "node", "n", "comp", "sig", "set")
        again = again.repartition(parts, "bh", "c", "d").sortWithinPartitions("bh", "c", "d", "kind")
        extra = materialize(again.mapInArrow(_join_blocks(limits, threshold), "a long, b long").distinct(), "links")
        if not extra.isEmpty():
            comps = materialize(connected_components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(extra)), "components")
    by_class = classes.join(comps, "node", "left").select("k1", "k2", F.coalesce("comp", "node").alias("component"))
    linked = valid.select("id", "n", "k1", "k2").join(by_class, ["k1", "k2"]).select("id", F.col("n").cast("long").alias("n_shingles"), "component")
    alone = signed.where("n = 0 or id is null").select("id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def near_dedup(docs: DataFrame, threshold: int = 80, id_col: str = "doc_id", **cols: str) -> DataFrame:
    """The documents that are the smallest id of their component, all columns unchanged."""
    groups = near_groups(docs, threshold, id_col=id_col, **cols)
    losers = materialize(groups.where("id <> component").select("id").distinct(), "losers")
    side = F.broadcast(losers) if losers.count() <= BROADCAST_IDS else losers
    return docs.select(packed(docs), F.col(f"`{id_col}`").cast("long").alias("id")).join(side, "id", "left_anti").select("__row.*")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id, kept; links at a similarity of 0.85."""
    return near_groups(documents(spark, sf_dir).select("doc_id", "text"), 85).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
