"""A lexical index: postings with block bounds and partial statistics, kept by source, and pruned top-k search.

An index is four tables. Their statistics are sums, so those of several sources, or of a scope, are added up:
a source that changes replaces its own part only, and a search in some sources reads only these. Bounds are nearly as many
as postings, so they are not kept: a search makes those of its own tokens from the postings.

    postings  (scope, block, chunk_id, token, tf, dl)
    terms     (scope, token, df)
    bounds    (scope, block, token, tf, dl, n): the greatest tf, the least dl and the number of a block's postings
    sizes     (scope, n, total): chunks and tokens
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stemming
from .shared import escaped, read_or_empty, remove_path, written

# Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are sums of whole numbers of this unit, so that they do not depend on the order of addition.
UNIT = 1e-12
#: Blocks of chunks for which bounds are kept. Chunks of like length share one, as scores depend on the length.
BLOCKS = 80
#: Share of the threshold up to which tokens are left out. Beyond it, most chunks would need a second look.
LEFT_OUT = 0.5
#: Postings of the asked tokens up to which all are scored at once: that takes less than finding out which matter.
DIRECT = 50_000_000
#: Beyond that, the share of them that a pruned search may score, or look up, before all are scored instead.
PAYS = 0.125
#: Rows of asked tokens that are sent to the postings, rather than postings to them.
SENT = 500_000
#: Tokens that a task counts at a time, so that its memory does not follow the length of a batch's texts.
COUNTED = 1 << 18


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose last column holds COUNTED tokens at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy())
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COUNTED, "right")))
        yield batch.slice(a, b - a)
        a = b


def _count_tokens(n_keys: int):
    """Rows (keys, chunk_id, tokens) to a row a distinct token of each chunk; a chunk without tokens has one with a
    null token. One row of each chunk is its first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            tokens = batch.column(n_keys + 1)
            if tokens.null_count:
                tokens = pc.fill_null(tokens, pa.scalar([], tokens.type))
            dl = pc.list_value_length(tokens).to_numpy()
            codes = tokens.flatten().dictionary_encode()
            n = max(1, len(codes.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + codes.indices.to_numpy(), return_counts=True)
            chunk, token = pair // n, pair % n
            empty = np.flatnonzero(dl == 0)
            rows = np.concatenate([chunk, empty])
            first = np.concatenate([np.append(True, chunk[1:] != chunk[:-1])[: len(chunk)], np.ones(len(empty), bool)])
            words = pa.chunked_array([codes.dictionary.take(pa.array(token)), pa.nulls(len(empty), codes.dictionary.type)]).combine_chunks()
            at = pa.array(rows)
            counts = pa.array(np.concatenate([tf, np.zeros(len(empty), np.int64)]).astype(np.int64))
            carried = [batch.column(i).take(at) for i in range(n_keys + 1)]
            yield pa.RecordBatch.from_arrays([*carried, words.cast(pa.string()), counts, pa.array(dl[rows].astype(np.int32)), pa.array(first)], [*batch.schema.names[: n_keys + 1], "token", "tf", "dl", "first"])

    return count


def _counted(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Postings are counted where the chunks are: nothing is shuffled."""
    rows = chunks.select(*keys, "chunk_id", "tokens")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_count_tokens(len(keys)), f"{kinds}, token string, tf long, dl int, first boolean")


def _stemmed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by index form: the distinct tokens are stemmed as one table and joined back."""
    counted = written(counted, "surface")
    named = counted.where("token is not null").join(stemming.index_forms(counted), "token").groupBy(*keys, "chunk_id", F.col("form").alias("token"))
    named = named.agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.max("first").alias("first"))
    return named.unionByName(counted.where("token is null").select(*named.columns))


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    bounds: DataFrame
    sizes: DataFrame
    scope: list[str] = field(default_factory=list)

    def weights(self, tokens: DataFrame) -> DataFrame:
        """(scope, token, df, avgdl, idf) of the given tokens. A negative idf becomes a quarter of the mean
        over all tokens of the scope."""
        s = self.scope
        size = self.sizes.select(*s, "n", (F.col("total") / F.col("n")).alias("avgdl"))
        # scopes may be many: the join's side is Spark's choice by size; without a scope it is one row
        joined = self.terms.join(size, s) if s else self.terms.crossJoin(F.broadcast(size))
        raw = joined.select(*s, "token", "df", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        # decimal: some 700,000 tokens of this size exceed the sum of a long
        total = F.sum(F.round(F.col("raw") / UNIT).cast("long").cast("decimal(19,0)")).cast("double")
        mean = raw.groupBy(*s).agg((total * UNIT / F.count(F.lit(1))).alias("mean"))
        wanted = raw.join(tokens.select("token").distinct(), "token", "left_semi")
        both = wanted.join(mean, s) if s else wanted.crossJoin(F.broadcast(mean))
        return both.select(*s, "token", "df", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(scope, qid, token, times, df, avgdl, idf) of the tokens of queries (qid, tokens)."""
        one = queries.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))
        return one.join(self.weights(one), "token")


def _units(tf: str = "tf", dl: str = "dl") -> Column:
    """A posting's part in the score of a query, in units."""
    t, d = F.col(tf), F.col(dl)
    part = F.col("idf") * t * (K1 + 1) / (t + K1 * (1 - B + B * d / F.col("avgdl")))
    return F.round(part * F.col("times") / UNIT).cast("long")


def _postings(counted: DataFrame, keys: list[str]) -> DataFrame:
    block = F.least(F.lit(BLOCKS - 1), F.floor(F.log2("dl") * 4)).cast("int").alias("block")
    return counted.where("token is not null").select(*keys, block, "chunk_id", "token", "tf", "dl")


def _bounds(posts: DataFrame, keys: list[str]) -> DataFrame:
    return posts.groupBy(*keys, "block", "token").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count(F.lit(1)).alias("n"))


def _tables(counted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    posts = _postings(counted, keys)
    terms = posts.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    sizes = counted.where("first").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dl").cast("long")).alias("total"))
    return posts, terms, sizes


def index_of(chunks: DataFrame, scope: list[str] | None = None, stem: bool = False) -> Index:
    """An index for one run, of (scope, chunk_id, tokens). stem: tokens are surface forms, to be stemmed."""
    scope = scope or []
    counted = _counted(chunks, scope)
    counted = written(_stemmed(counted, scope) if stem else counted, "postings")
    posts, terms, sizes = _tables(counted, scope)
    return Index(posts, written(terms, "terms"), _bounds(posts, scope), written(sizes, "sizes"), scope)


def _sent(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is short, so that postings need not be shuffled to meet it."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(scope, qid, chunk_id, score) of all chunks that share a token with the query."""
    return _all_scores(index, written(index.asked(queries), "asked"))


def _all_scores(index: Index, asked: DataFrame) -> DataFrame:
    s = index.scope
    parts = index.postings.join(_sent(asked), [*s, "token"]).select(*s, "qid", "chunk_id", _units().alias("units"))
    return parts.groupBy(*s, "qid", "chunk_id").agg((F.sum("units").cast("double") * UNIT).alias("score"))


def coverage(index: Index, queries: DataFrame, key: DataFrame | None = None):
    """A function that adds a column coverage to rows (qid, chunk_id, ...): the share of a query's distinct tokens
    among a chunk's key tokens. key: (chunk_id, token) of key tokens; all tokens of the chunks without it."""
    asked = queries.select("qid", F.explode(F.array_distinct("tokens")).alias("token"))
    size = queries.select("qid", F.size(F.array_distinct("tokens")).alias("n_asked"))
    held = index.postings.select("chunk_id", "token") if key is None else key

    def add(rows: DataFrame) -> DataFrame:
        found = rows.select("qid", "chunk_id").join(asked, "qid").join(held, ["chunk_id", "token"]).groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("n_held"))
        share = F.when(F.col("n_asked") > 0, F.coalesce("n_held", F.lit(0)) / F.col("n_asked")).otherwise(F.lit(0.0))
        return rows.join(found, ["qid", "chunk_id"], "left").join(size, "qid", "left").withColumn("coverage", F.coalesce(share, F.lit(0.0))).drop("n_held", "n_asked")

    return add


@dataclass
class Pruned:
    """Top rows of a pruned search, and how many postings it scored: (qid, all, scored)."""

    top: DataFrame
    work: DataFrame


def top(index: Index, queries: DataFrame, k: int, digits: int = 9) -> Pruned:
    """The k best chunks of each query (and scope) by rounded score, then id, without scoring all postings.

    Few postings are scored at once (DIRECT), and so are many if the steps below would not leave out most of them (PAYS). Else:

    1. The rarest tokens of a query give seeds. The seeds' full scores give a threshold that its k-th best reaches.
    2. In each block of chunks, tokens whose bounds there add up to less than the threshold cannot bring a chunk
       among the k best by themselves. Only the postings of the other tokens are scored for all its chunks.
       What saves most postings for its bound is left out first.
    3. A chunk stays if its score so far and the bounds of the tokens left out in its block reach the threshold. The
       rest of the score is looked up for these chunks alone, unless that asks for too many pairs of chunk and token.
    """
    s = index.scope
    q = [*s, "qid"]
    slack = round(10.0**-digits / UNIT) + 1000
    weight = ["times", "avgdl", "idf"]
    asked = written(index.asked(queries), "asked")
    best = F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("score"), "chunk_id"))

    def all_scored() -> Pruned:
        found = _all_scores(index, asked).withColumn("score", F.round("score", digits)).withColumn("rank", best)
        work = asked.groupBy(*q).agg(F.sum("df").alias("all"), F.sum("df").alias("scored"))
        return Pruned(found.where(F.col("rank") <= k), work)

    everything = asked.agg(F.sum("df")).first()[0] or 0
    if everything <= DIRECT:
        return all_scored()
    tokens = written(asked.select(*s, "token").distinct(), "tokens")
    own = index.postings.join(_sent(tokens), [*s, "token"], "left_semi")
    at_most = F.greatest(_units() + 1 + F.col("times"), F.lit(0).cast("long"))
    bounds = _bounds(own, s).join(_sent(asked), [*s, "token"])
    terms = written(bounds.select(*q, "block", "token", "n", *weight, at_most.alias("most")), "bounds")

    def looked_up(chunks: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
        """The scores of chunks by tokens wanted. Only the postings of these chunks are shuffled."""
        few = _sent(written(chunks.select(*s, "chunk_id").distinct(), "chunks"))
        part = own.select(*s, "token", "chunk_id", "tf", "dl").join(few, [*s, "chunk_id"], "left_semi")
        part = part.join(chunks.join(wanted, on), [*s, "token", "chunk_id"])
        return part.groupBy(*q, "chunk_id").agg(F.sum(_units()).alias("more"), F.count(F.lit(1)).alias("n"))

    rarest = Window.partitionBy(*q).orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    first = asked.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < 32 * k)
    first = written(first, "first")
    seeds = index.postings.join(_sent(first), [*s, "token"]).groupBy(*q, "chunk_id").agg(F.sum(_units()).alias("units"))
    seeds = seeds.withColumn("at", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("units"), "chunk_id"))).where(F.col("at") <= 2 * k)
    full = looked_up(written(seeds.select(*q, "chunk_id"), "seeds"), asked.select(*q, "token", *weight), q)
    full = full.withColumn("at", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("more"))))
    least = written(full.where(F.col("at") == k).select(*q, (F.col("more") - slack).alias("least")), "least")

    cheapest = Window.partitionBy(*q, "block").orderBy(F.col("most") / F.col("n"), "token").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.join(least, q, "left").withColumn("essential", F.coalesce(F.sum("most").over(cheapest) >= LEFT_OUT * F.col("least"), F.lit(True)))
    terms = written(terms, "essential")
    if (terms.where("essential").agg(F.sum("n")).first()[0] or 0) > PAYS * everything:
        return all_scored()
    left_out = terms.where("not essential")
    # blocks travel as a list a token, so that the rows sent to the postings are no more than those asked
    lists = terms.where("essential").groupBy(*q, "token", *weight).agg(F.collect_set("block").alias("blocks"))
    part = own.join(_sent(written(lists, "lists")), [*s, "token"]).where(F.array_contains("blocks", F.col("block")))
    units = part.select(*q, "chunk_id", "block", _units().alias("units")).groupBy(*q, "chunk_id", "block").agg(F.sum("units").alias("units"))
    rest = left_out.groupBy(*q, "block").agg(F.sum("most").alias("rest"), F.first("least").alias("least"), F.count(F.lit(1)).alias("looks"))
    kept = units.join(rest, [*q, "block"], "left").where(F.col("rest").isNull() | (F.col("units") + F.col("rest") >= F.col("least")))
    kept = written(kept.select(*q, "chunk_id", "block", "units", "looks"), "kept")
    if (kept.agg(F.sum("looks")).first()[0] or 0) > PAYS * everything:
        return all_scored()
    more = written(looked_up(kept.select(*q, "chunk_id", "block"), left_out.select(*q, "block", "token", *weight), [*q, "block"]), "more")
    total = kept.join(more, [*q, "chunk_id"], "left").select(*q, "chunk_id", F.round((F.col("units") + F.coalesce("more", F.lit(0))).cast("double") * UNIT, digits).alias("score"))
    work = terms.groupBy(*q).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("essential"), F.col("n")).otherwise(F.lit(0))).alias("scored"))
    for extra in (first.groupBy(*q).agg(F.sum("df").alias("x")), more.groupBy(*q).agg(F.sum("n").alias("x"))):
        work = work.join(extra, q, "left").select(*q, "all", (F.col("scored") + F.coalesce("x", F.lit(0))).alias("scored"))
    return Pruned(total.withColumn("rank", best).where(F.col("rank") <= k), work)


#: The parts of a kept index and their columns besides source. Postings are kept as they were counted: a chunk without
#: tokens has a row with a null token, and one row of each chunk is its first.
PARTS = {
    "postings": "chunk_id long, token string, tf long, dl int, first boolean",
    "terms": "token string, df long",
    "sizes": "n long, total long, state long",
}


class LexicalStore:
    """An index of a chunk store, kept by source under a path. A source whose files in the store are not the
    ones that were indexed is indexed anew at the next refresh; the others are not touched.

    The sizes of a source are written last and removed first, and only sources that have them are read, so an
    index that was not written to its end is never used.
    """

    def __init__(self, spark: SparkSession, path: str, stem: bool = True):
        self.spark, self.path, self.stem = spark, path.rstrip("/"), stem

    def _read(self, part: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/{part}", f"{PARTS[part]}, source string")

    def update(self, chunks: DataFrame, states: DataFrame | None = None) -> None:
        """Replace the part of every source in ``chunks`` (source, chunk_id, tokens), which are surface forms if the
        index is one of stems. states: (source, state) of the files that they come from."""
        counted = _counted(chunks, ["source"])
        names = [r[0] for r in chunks.select("source").distinct().collect()]  # a row a source, as the catalogue has
        for source in names:
            self.remove(source)
        self._write("postings", _stemmed(counted, ["source"]) if self.stem else counted)
        # read back by source, which takes no second copy; few of a source's tokens are in more than one file
        _, terms, sizes = _tables(self._read("postings").where(F.col("source").isin(names)), ["source"])
        self._write("terms", terms)
        state = F.lit(None).cast("long").alias("state")
        self._write("sizes", sizes.join(states, "source", "left") if states is not None else sizes.select("*", state))

    def _write(self, part: str, df: DataFrame) -> None:
        names = [c.split()[0] for c in PARTS[part].split(", ")]
        dealt = df.select(*names, "source").hint("rebalance", "source")  # few files a source; a large source is split
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.path}/{part}")

    def remove(self, source: str) -> None:
        for part in ("sizes", "postings", "terms"):
            remove_path(self.spark, f"{self.path}/{part}/source={escaped(self.spark, source)}")

    def refresh(self, store, tokens=stemming.surface_tokens) -> list[str]:
        """Bring the index up to a chunk store's state; the sources that were indexed or removed."""
        files = store.read().select("source", F.col("_metadata.file_path").alias("file")).distinct()
        now = files.groupBy("source").agg(F.sum(F.call_function("shiftright", F.xxhash64("file"), F.lit(24))).alias("state"))
        known = self._read("sizes").select("source", F.col("state").alias("known"))
        changed = written(now.join(known, "source", "full").where("not (state <=> known)"), "changed")
        names = sorted((r["source"], r["state"]) for r in changed.collect())
        for source in (n for n, state in names if state is None):
            self.remove(source)
        if any(state is not None for _, state in names):
            fresh = store.read().join(changed.where("state is not null").select("source"), "source", "left_semi")
            self.update(fresh.select("source", "chunk_id", tokens(F.col("content")).alias("tokens")), changed.select("source", "state"))
        return [n for n, _ in names]

    def open(self, sources: list[str] | None = None, scoped: bool = False) -> Index:
        """The index over some sources (all, if None), with their statistics. scoped: each source by itself."""
        pick = (lambda df: df) if sources is None else (lambda df: df.where(F.col("source").isin(sources)))
        sizes = pick(self._read("sizes"))
        part = lambda name: pick(self._read(name)).join(sizes.select("source"), "source", "left_semi")
        keys = ["source"] if scoped else []
        posts = _postings(part("postings"), keys)
        if scoped:
            return Index(posts, part("terms"), _bounds(posts, keys), sizes.drop("state"), keys)
        terms = part("terms").groupBy("token").agg(F.sum("df").alias("df"))
        return Index(posts, terms, _bounds(posts, keys), sizes.agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
