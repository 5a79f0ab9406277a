"""Interpolated modified Kneser-Ney bigram model: counted in Spark, scored from memory-mapped arrays.

Counting: tasks turn texts into word hashes, sum unigrams and bigrams of about half a million tokens at a
time and send them, as sorted arrays, to shards of the hash space. A shard merges what it gets and
writes its bigrams as sorted hash arrays to the shared folder. Continuation counts are dealt again by
the second word, which gives the unigram arrays. Discounts come from sums over shards. Scoring maps
the arrays that a block of texts needs; sorted look-ups keep the pages they touch few.

Words are told apart by 64-bit hashes (48 bits for the second word of a bigram).

Edge cases: null, empty and blank texts are one end token. A null id has no remainder and is trained
on. Without training texts every token is unknown and has probability 1. Rows are scored one by one,
so repeated rows get the same score. A text is never cut; long ones are scored in slices. Ids are cast to
long, so one that is no number becomes null. Other columns are not carried, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, new_path, ship
from .sharedfiles import map_arrays, write_arrays
from .wordhash import U64, hash_words

END, BEGIN = U64(0x6A09E667F3BCC909), U64(0xBB67AE8584CAA73B)
SLICE = 1 << 19
SHARD_BYTES = 8 << 20


def _tokens(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, text number) of a column of texts: words and one end each."""
    h, first = hash_words(column, lower)
    n = np.diff(first) + 1
    ends = np.cumsum(n) - 1
    tok = np.empty(len(h) + len(n), U64)
    is_end = np.zeros(len(tok), bool)
    is_end[ends] = True
    tok[is_end] = END
    tok[~is_end] = h
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[ends - n + 1] = BEGIN
    return ctx, tok, np.repeat(np.arange(len(n)), n)


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _six(h: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return (h >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 or more follow as 64-bit values."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes() + counts[big].astype("<i8").tobytes()


def _unsmall(raw: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    c = raw[:n].astype(np.int64)
    big = np.flatnonzero(c == 255)
    end = n + 8 * len(big)
    c[big] = np.frombuffer(raw[n:end].tobytes(), "<i8")
    return c, end


def _count_blobs(ctx: np.ndarray, tok: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """By shard: the words with their counts, the contexts with their numbers of successors, the successors."""
    vocab, ids = np.unique(np.concatenate([ctx, tok]), return_inverse=True)
    n = len(ctx)
    uni = np.bincount(ids[n:], minlength=len(vocab))
    pairs = np.sort((ids[:n].astype(U64) << U64(32)) | ids[n:].astype(U64))
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times = np.diff(np.append(new, n))
    pairs = pairs[new]
    v, w = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
    for s, a, b in _slices(_shard(vocab, bits)):  # the shards that occur, not all there are
        p, q = np.searchsorted(v, (a, b))
        words = np.flatnonzero(uni[a:b]) + a
        out = [np.array([len(words)], "<i8").tobytes(), vocab[words].astype("<u8").tobytes(), _small(uni[words])]
        heads = np.flatnonzero(np.concatenate([[True], v[p + 1 : q] != v[p : q - 1]])) if q > p else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, q - p))
        out += [np.array([len(heads), q - p], "<i8").tobytes(), vocab[v[p:q][heads]].astype("<u8").tobytes(), _small(sizes), _six(vocab[w[p:q]]), _small(times[p:q])]
        yield s, b"".join(out)


def _read_blob(blob: bytes):
    raw = np.frombuffer(blob, np.uint8)
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    at = 8
    words = np.frombuffer(blob, "<u8", n, at)
    at += 8 * n
    uni, used = _unsmall(raw[at:], n)
    at += used
    heads, m = np.frombuffer(blob, "<i8", 2, at)
    at += 16
    v = np.frombuffer(blob, "<u8", heads, at)
    at += 8 * heads
    sizes, used = _unsmall(raw[at:], heads)
    at += used
    w = _unsix(raw[at : at + 6 * m])
    at += 6 * m
    return words, uni, np.repeat(v, sizes), w, _unsmall(raw[at:], m)[0]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def _ones_to_fours(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


COUNT_SCHEMA = "shard int, blob binary"
STATS_SCHEMA = "types long, n1 long, n2 long, n3 long, n4 long, tokens long, vocabulary long"


def _counter(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, tok, held = [], [], 0

        def flush():
            rows = list(_count_blobs(np.concatenate(ctx), np.concatenate(tok), bits))
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["shard", "blob"])

        for batch in batches:
            c, t, _ = _tokens(batch.column(0))
            for i in range(0, len(t), SLICE):
                ctx.append(c[i : i + SLICE])
                tok.append(t[i : i + SLICE])
                held += len(tok[-1])
                if held >= SLICE:
                    yield from flush()
                    ctx, tok, held = [], [], 0
        if held:
            yield from flush()

    return count


def _bigram_shard(folder: str, bits: int):
    def reduce(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        parts = [_read_blob(b.as_py()) for b in table.column("blob")]
        words, uni = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        v, w, c = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        del parts
        order = np.lexsort((w, v))
        v, w, c = v[order], w[order], c[order]
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
        c = np.add.reduceat(c, new) if len(new) else c
        v, w = v[new], w[new]
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        sums = lambda x: (np.add.reduceat(x.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64))
        big = c >= 65535
        write_arrays(
            f"{folder}/bigrams-{shard:06d}", ctx=v[heads], start=np.append(heads, len(v)).astype("<u4"), total=sums(c), ones=sums(c == 1).astype("<u4"), twos=sums(c == 2).astype("<u4"),
            high=(w >> U64(16)).astype("<u4"), low=(w & U64(0xFFFF)).astype("<u2"), count=np.where(big, 65535, c).astype("<u2"), big_at=np.flatnonzero(big), big=c[big],
        )
        # what the second words get: in how many contexts of this shard each stands
        seen, times = np.unique(w, return_counts=True)
        rows = [(s, np.array([0, b - a], "<i8").tobytes() + _six(seen[a:b] << U64(16)) + _small(times[a:b])) for s, a, b in _slices(_shard(seen << U64(16), bits))]
        rows.append((shard, np.array([1, len(words)], "<i8").tobytes() + words.astype("<u8").tobytes() + _small(uni)))
        stats = [len(c), *_ones_to_fours(c), int(uni.sum()), len(words)]
        k = len(rows)
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())} | {f.split()[0]: pa.array([x] + [0] * (k - 1), pa.int64()) for f, x in zip(STATS_SCHEMA.split(", "), stats)})

    return reduce


def _unigram_shard(folder: str):
    def reduce(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, uni, seen, times = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for b in table.column("blob"):
            blob = b.as_py()
            kind, n = np.frombuffer(blob, "<i8", 2)
            raw = np.frombuffer(blob, np.uint8)
            if kind:
                words.append(np.frombuffer(blob, "<u8", n, 16))
                uni.append(_unsmall(raw[16 + 8 * n :], n)[0])
            else:
                seen.append(_unsix(raw[16 : 16 + 6 * n]))
                times.append(_unsmall(raw[16 + 6 * n :], n)[0])
        words, uni = _summed(np.concatenate(words), np.concatenate(uni))
        seen, times = _summed(np.concatenate(seen), np.concatenate(times))
        at = np.minimum(np.searchsorted(seen, words >> U64(16)), max(len(seen) - 1, 0))
        cont = np.where(seen[at] == words >> U64(16), times[at], 0) if len(seen) else np.zeros(len(words), np.int64)
        write_arrays(f"{folder}/unigrams-{shard:06d}", word=words, count=uni, cont=cont)
        stats = [int(cont.sum()), *_ones_to_fours(cont), int(uni.sum()), len(words)]
        return pa.table({f.split()[0]: pa.array([x], pa.int64()) for f, x in zip(STATS_SCHEMA.split(", "), stats)})

    return reduce


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; where counts of counts are too few, half of each count."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Count a corpus and write its model. Returns what scoring needs: folder, shard bits, sums, discounts."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(f"`{text_col}`").alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(0, (size // SHARD_BYTES).bit_length())
    folder = new_path(spark, "lm")
    sums = [F.sum(f.split()[0]).alias(f.split()[0]) for f in STATS_SCHEMA.split(", ")]
    blobs = texts.mapInArrow(_counter(bits), COUNT_SCHEMA)
    first = materialize(blobs.groupBy("shard").applyInArrow(_bigram_shard(folder, bits), f"{COUNT_SCHEMA}, {STATS_SCHEMA}"), "lm-cont")
    two = first.agg(*sums).first().asDict()
    one = first.select("shard", "blob").groupBy("shard").applyInArrow(_unigram_shard(folder), STATS_SCHEMA).agg(*sums).first().asDict()
    one, two = ({k: v or 0 for k, v in d.items()} for d in (one, two))
    ns = ("n1", "n2", "n3", "n4")
    return {
        "folder": folder, "bits": bits, "tokens": one["tokens"], "vocabulary": one["vocabulary"], "types": one["types"],
        "d2": discounts(*(two[k] for k in ns)), "d1": discounts(*(one[k] for k in ns)),
        "n_cont": [one["n1"], one["n2"], one["vocabulary"]],
    }


class Model:
    """The mapped arrays of a model, opened shard by shard as they are needed."""

    def __init__(self, spec: dict):
        self.spec, self.uni, self.bi = spec, {}, {}
        d1, d2, d3 = spec["d1"]
        n1, n2, v = spec["n_cont"]
        # types whose continuation count is 0 get no mass of their own
        self.floor = (d1 * n1 + d2 * n2 + d3 * max(0, v - n1 - n2)) / max(spec["types"], 1) / (spec["vocabulary"] + 1) if spec["types"] else 1.0

    def _open(self, kind: str, shard: int) -> dict | None:
        cache = self.uni if kind == "unigrams" else self.bi
        if shard not in cache:
            if len(cache) >= 4096:
                cache.clear()
            cache[shard] = map_arrays(f"{self.spec['folder']}/{kind}-{shard:06d}")
        return cache[shard]

    def unigrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and continuation counts of sorted distinct words."""
        count, cont = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for s, a, b in _slices(_shard(words, self.spec["bits"])):
            m = self._open("unigrams", s)
            if m is None or not len(m["word"]):
                continue
            at = np.minimum(np.searchsorted(m["word"], words[a:b]), len(m["word"]) - 1)
            hit = m["word"][at] == words[a:b]
            count[a:b], cont[a:b] = np.where(hit, m["count"][at], 0), np.where(hit, m["cont"][at], 0)
        return count, cont

    def p_cont(self, cont: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.spec["d1"]])[np.minimum(cont, 3)]
        return np.maximum(cont - d, 0) / max(self.spec["types"], 1) + self.floor

    def bigrams(self, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P(w | v) of distinct pairs sorted by v; low is P(w) of the order below."""
        out = low.copy()
        d = np.array([0.0, *self.spec["d2"]])
        for s, a, b in _slices(_shard(v, self.spec["bits"])):
            m = self._open("bigrams", s)
            if m is None or not len(m["ctx"]):
                continue
            at = np.minimum(np.searchsorted(m["ctx"], v[a:b]), len(m["ctx"]) - 1)
            known = np.flatnonzero(m["ctx"][at] == v[a:b])
            at, goal = at[known], w[a:b][known] >> U64(16)
            lo, end = m["start"][at].astype(np.int64), m["start"][at + 1].astype(np.int64)
            hi = end.copy()
            high, lowbits = m["high"], m["low"]
            go = np.flatnonzero(lo < hi)
            while len(go):
                mid = (lo[go] + hi[go]) >> 1
                less = ((high[mid].astype(U64) << U64(16)) | lowbits[mid]) < goal[go]
                lo[go] = np.where(less, mid + 1, lo[go])
                hi[go] = np.where(less, hi[go], mid)
                go = go[lo[go] < hi[go]]
            inside = np.minimum(lo, len(high) - 1)
            hit = (lo < end) & (((high[inside].astype(U64) << U64(16)) | lowbits[inside]) == goal)
            c = np.where(hit, m["count"][inside], 0).astype(np.int64)
            for k in np.flatnonzero(c == 65535):
                c[k] = m["big"][np.searchsorted(m["big_at"], inside[k])]
            n1, n2 = m["ones"][at].astype(np.int64), m["twos"][at].astype(np.int64)
            n3 = (m["start"][at + 1].astype(np.int64) - m["start"][at]) - n1 - n2
            back = d[1] * n1 + d[2] * n2 + d[3] * n3
            out[a + known] = (np.maximum(c - d[np.minimum(c, 3)], 0) + back * low[a + known]) / m["total"][at]
        return out


def _slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(shard):
        heads = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
        yield from ((int(shard[a]), int(a), int(b)) for a, b in zip(heads[:-1], heads[1:]))


SCORE_SCHEMA = "id long, n_tokens long, n_known long, base_score double, score double"


def _scorer(spec: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(spec)
        total = spec["tokens"] + spec["vocabulary"] + 1
        for batch in batches:
            n = batch.num_rows
            known, base, got, size = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            ctx, tok, text = _tokens(batch.column(1))
            for i in range(0, len(tok), SLICE):
                c, t, doc = ctx[i : i + SLICE], tok[i : i + SLICE], text[i : i + SLICE]
                vocab, ids = np.unique(np.concatenate([c, t]), return_inverse=True)
                count, cont = model.unigrams(vocab)
                v, w = ids[: len(c)].astype(U64), ids[len(c) :]
                pairs, back = np.unique((v << U64(32)) | w.astype(U64), return_inverse=True)
                pv, pw = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
                p = model.bigrams(vocab[pv], vocab[pw], model.p_cont(cont)[pw])
                a, b = doc[0], doc[-1] + 1
                at, k = doc - a, b - a
                size[a:b] += np.bincount(at, minlength=k)
                known[a:b] += np.bincount(at, weights=count[w] > 0, minlength=k).astype(np.int64)
                base[a:b] += np.bincount(at, weights=np.log10((count[w] + 1) / total), minlength=k)
                got[a:b] += np.bincount(at, weights=np.log10(p)[back], minlength=k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(known), pa.array(base), pa.array(got)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score (log10 probabilities)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(_scorer(model), SCORE_SCHEMA)


def perplexity(scores: DataFrame) -> DataFrame:
    """scores with each text's perplexity."""
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.where(~held_out("doc_id", 7, 2)))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
