"""Repeated passages by FM-indexes over shards of the corpus.

A window is ``width`` consecutive words of one document. A word goes if a window that covers it also
starts earlier: in a document with a smaller id, or earlier in the same one.

1. Every window has an anchor, the least hash among its six-word runs, so equal windows have equal
   anchors. One pass collects anchors; those that occur twice are written as sorted arrays, by shard of
   the hash space, with a mark on the very frequent ones.
2. A second pass cuts out the stretches of text whose windows have a repeated anchor and deals them by
   anchor; windows with a very frequent anchor are dealt one by one, by both their ends. Of stretches
   with equal words a task sends the earliest on and settles the others itself.
3. A shard joins its stretches, in document order, to one text and builds its FM-index: suffix array,
   Burrows-Wheeler transform, wavelet matrix over bit vectors with block counts. Backward search runs
   for all stretches at once, from the right, as long as the matched part also starts earlier (a range
   minimum over the suffix array); a match of at least ``width`` words is an interval to remove.
4. Intervals are dealt by document, written as sorted arrays and applied in a last pass over the texts.

No document meets another's shard unless they share an anchor, so work grows with the corpus and with
what repeats in it. Words are told apart by 48-bit hashes within a shard.

Edge cases: null, empty, blank and short texts have no window and lose nothing. A null id sorts last.
Rows that share an id count as one document; equal starts in equal rows do not remove each other. An
empty table gives an empty result. Texts of any length are taken in slices and never cut: a window never
spans two texts. Ids are cast to long, so one that is no number becomes null. Extra columns are carried by
remove_repeats, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, packed, ship
from .sharedfiles import map_arrays, write_arrays
from .wordhash import U64, hash_words, mix, shingles

WIDTH, GRAM = 20, 6
SLICE = 1 << 19
SHARD_BYTES = 16 << 20
SHARD_WORDS = 400_000
HOT = 4096
LAST = np.iinfo(np.int64).max
BLOB_SCHEMA = "shard int, blob binary"


def _runs(h: np.ndarray, first: np.ndarray, width: int):
    """(anchor, first window, last window, anchor's place) of runs of windows with one anchor at one place."""
    span = width - GRAM + 1
    if len(h) < width:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(0, U64)
    g = shingles(h, GRAM)
    at, size = np.arange(len(g)), 1
    while size < span:  # leftmost place of the least value among ``size`` values, by doubling
        step = min(size, span - size)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        size += step
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[: len(at)] == text[width - 1 : width - 1 + len(at)]
    change = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | (text[1 : len(at)] != text[: len(at) - 1])])
    heads = np.flatnonzero(change)
    ends = np.append(heads[1:], len(at)) - 1
    ok = valid[heads]
    return g[at[heads[ok]]], heads[ok], ends[ok], g


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word hashes of a batch's texts, some texts at a time: (hashes, first words, number of the first text)."""
    h, first = hash_words(batch.column(0))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE, "right")) - 1)
        yield h[first[a] : first[b]], first[a : b + 1] - first[a], a
        a = b


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of the runs of a sorted array: the shards that occur, not all there are."""
    if len(shard):
        heads = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
        yield from ((int(shard[a]), int(a), int(b)) for a, b in zip(heads[:-1], heads[1:]))


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


def _anchors(width: int, bits: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            yield _rows([(s, values[a:b].tobytes() + np.minimum(times[a:b], HOT).astype("<u2").tobytes()) for s, a, b in _slices(_shard(values, bits))])

        for batch in batches:
            for h, first, _ in _parts(batch):
                held.append(_runs(h, first, width)[0])
                size += len(held[-1])
                if size > SLICE:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return anchors


def _repeated(folder: str):
    def repeated(table: pa.Table) -> pa.Table:
        values, times = [], []
        for b in table.column("blob"):
            raw = b.as_py()
            n = len(raw) // 10
            values.append(np.frombuffer(raw, "<u8", n))
            times.append(np.frombuffer(raw, "<u2", n, 8 * n).astype(np.int64))
        values, times = np.concatenate(values), np.concatenate(times)
        order = np.argsort(values)
        values, times = values[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sums = np.add.reduceat(times, heads)
        twice = sums > 1
        write_arrays(f"{folder}/anchors-{table.column('shard')[0].as_py():06d}", value=values[heads][twice], hot=(sums[twice] >= HOT).astype(np.uint8))
        return pa.table({"runs": pa.array([int(sums[twice].sum())], pa.int64())})

    return repeated


class _Mapped:
    """Arrays of shards, mapped when they are first needed."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.open = folder, kind, {}

    def __getitem__(self, shard: int) -> dict | None:
        if shard not in self.open:
            if len(self.open) >= 4096:
                self.open.clear()
            self.open[shard] = map_arrays(f"{self.folder}/{self.kind}-{shard:06d}")
        return self.open[shard]


def _look_up(values: np.ndarray, anchors: _Mapped, bits: int) -> np.ndarray:
    """0: occurs once, 1: is repeated, 2: very frequent."""
    out = np.zeros(len(values), np.uint8)
    order = np.argsort(values)
    v = values[order]
    for s, a, b in _slices(_shard(v, bits)):
        m = anchors[s]
        if m is not None and len(m["value"]):
            part = v[a:b]
            at = np.minimum(np.searchsorted(m["value"], part), len(m["value"]) - 1)
            out[order[a:b]] = np.where(m["value"][at] == part, 1 + m["hot"][at], 0)
    return out


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _interval_blob(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    return b"".join(x.astype(t).tobytes() for x, t in ((key, "<u8"), (a, "<i8"), (b, "<i8")))


def _deal_intervals(key: np.ndarray, a: np.ndarray, b: np.ndarray, n_shards: int) -> list[tuple[int, bytes]]:
    to = (key % U64(n_shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return [(s, _interval_blob(*(x[order[i:j]] for x in (key, a, b)))) for s, i, j in _slices(to[order])]


def _stretches(folder: str, width: int, bits: int, n_shards: int):
    """Stretches go to shards 0 .. n_shards - 1; intervals settled here to n_shards and above."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _Mapped(folder, "anchors")
        for batch in batches:
            ids, keys = batch.column(1), batch.column(2).to_numpy().view(U64)
            ids = ids.fill_null(LAST).to_numpy()
            for h, first, base in _parts(batch):
                value, lo, hi, g = _runs(h, first, width)
                if not len(value):
                    continue
                kind = _look_up(value, anchors, bits)
                plain, hot = kind == 1, kind == 2
                # windows with a very frequent anchor, one by one
                one = _flat(lo[hot], hi[hot] - lo[hot] + 1)
                start = np.concatenate([lo[plain], one])
                size = np.concatenate([hi[plain] - lo[plain] + width, np.full(len(one), width)])
                with np.errstate(over="ignore"):
                    to = np.concatenate([mix(value[plain]), mix(g[one] * U64(3) + g[one + width - GRAM])])
                if not len(start):
                    continue
                shard = (to % U64(n_shards)).astype(np.int64)
                text = np.searchsorted(first, start, "right") - 1
                at = start - first[text]
                doc, key = ids[base + text], keys[base + text]
                # equal stretches: the earliest is sent, later ones are settled
                edges = np.cumsum(size) - size
                with np.errstate(over="ignore"):
                    content = mix(np.add.reduceat(mix(h[_flat(start, size)] + (np.arange(size.sum()) - np.repeat(edges, size)).astype(U64) * U64(0x9E3779B97F4A7C13)), edges) + size.astype(U64))
                order = np.lexsort((at, doc, content, shard))
                head = np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (shard[order][1:] != shard[order][:-1])])
                lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                later = (doc[order] != doc[lead]) | (at[order] != at[lead])
                gone, sent = order[later], order[~later]
                if len(gone):
                    yield _rows([(n_shards + s, blob) for s, blob in _deal_intervals(key[gone], at[gone], at[gone] + size[gone], n_shards)])
                rows = []
                for s, from_, to_ in _slices(shard[sent]):
                    i = sent[from_:to_]
                    head_bytes = b"".join(x[i].astype(t).tobytes() for x, t in ((doc, "<i8"), (key, "<u8"), (at, "<i8"), (size, "<u1")))
                    rows.append((s, np.array([len(i)], "<i8").tobytes() + head_bytes + _six(h[_flat(start[i], size[i])])))
                for i in range(0, len(rows), 512):
                    yield _rows(rows[i : i + 512])

    return stretches


class BitVector:
    """Packed bits with the number of ones before every 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))


class FMIndex:
    """Full-text index of a sequence of symbols 0 .. sigma - 1, where 0 ends a stretch.

    Stretch ends count as different symbols, in order, so that suffixes never tie.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray):
        """order: rank in document order of every place; equal ranks are the same place."""
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends) - 1
        rank[ends] = np.arange(len(ends))
        done, size = False, 1
        while not done:
            fold = 3 if rank.max(initial=0) < 1 << 20 else 2
            shift = 21 if fold == 3 else 32
            key = np.zeros(n, U64)
            for k in range(fold):
                moved = np.zeros(n, np.int64)
                moved[: max(0, n - k * size)] = rank[k * size :] + 1 if fold == 3 or k else rank + 1
                key = (key << U64(shift)) | moved.astype(U64)
            sa = np.argsort(key)
            step = np.concatenate([[0], (key[sa][1:] != key[sa][:-1]).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(step)
            size *= fold
            done = int(step.sum()) == n - 1
        bwt = text[sa - 1]
        self.n, self.sigma = n, int(text.max(initial=0)) + 1
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.bits = []
        symbols = np.arange(self.sigma)
        for level in reversed(range(self.levels)):
            bit = ((bwt >> level) & 1).astype(bool)
            self.bits.append(BitVector(bit))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.origin = self._down(symbols, np.zeros(self.sigma, np.int64))
        # range minimum of the document order over rows
        self.least = [order[sa].astype(np.int32)]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            prev = self.least[-1]
            self.least.append(np.minimum(prev[:-half], prev[half:]))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, v in zip(reversed(range(self.levels)), self.bits):
            one = v.rank(i)
            i = np.where((c >> level) & 1, v.zeros + one, i - one)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of c + pattern, from the rows of the patterns."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        k = len(c)
        base = self.first_row[c] - self.origin[c]
        return base + both[:k], base + both[k:]

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least document order among rows lo .. hi - 1 (lo < hi)."""
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.least[k][lo[i]], self.least[k][hi[i] - (1 << int(k))])
        return out


def earlier_matches(text: np.ndarray, order: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first word, end) of the maximal parts of stretches, at least ``width`` long, that also
    start earlier. Backward search for all stretches at once."""
    index = FMIndex(text, order)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who = np.arange(len(start))
    end = size - 1  # last word of the pattern, within the stretch
    place = end.copy()  # word to match next
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), index.n, np.int64)
    while len(who):
        at = start[who] + place
        new_lo, new_hi = index.extend(text[at], lo, hi)
        ok = new_lo < new_hi
        ok[ok] = index.earliest(new_lo[ok], new_hi[ok]) < order[at[ok]]
        lo, hi = new_lo, new_hi
        place = np.where(ok, place - 1, place)
        stop = ~ok | (place < 0)
        length = end - place
        hit = stop & (length >= width)
        if hit.any():
            found.append((who[hit], place[hit] + 1, end[hit] + 1))
        # after a match only windows that begin at its left neighbour or before are open; after none, those that end earlier
        end = np.where(stop, np.where(hit, place + width - 1, end - 1), end)
        over = stop & ((end < width - 1) | (place < 0))
        fresh = stop & ~over
        place = np.where(fresh, end, place)
        lo, hi = np.where(fresh, 0, lo), np.where(fresh, index.n, hi)
        go = ~over
        who, end, place, lo, hi = who[go], end[go], place[go], lo[go], hi[go]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _search(width: int, n_shards: int):
    def search(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard >= n_shards:
            return pa.table({"shard": pa.array([shard - n_shards] * table.num_rows, pa.int32()), "blob": table.column("blob")})
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in table.column("blob"):
            raw = b.as_py()
            n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
            for k, t in enumerate(("<i8", "<u8", "<i8", "<u1")):
                cols[k].append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            six = np.frombuffer(raw, np.uint8, len(raw) - at, at).reshape(-1, 6)
            wide = np.zeros((len(six), 8), np.uint8)
            wide[:, :6] = six
            cols[4].append(wide.view("<u8").ravel())
        doc, key, at, size = (np.concatenate(c) for c in cols[:4])
        size = size.astype(np.int64)
        words = np.concatenate(cols[4])
        edges = np.cumsum(size) - size
        # document order, and equal stretches once
        with np.errstate(over="ignore"):
            content = mix(np.add.reduceat(mix(words + (np.arange(len(words)) - np.repeat(edges, size)).astype(U64) * U64(0x9E3779B97F4A7C13)), edges) + size.astype(U64))
        same = np.lexsort((at, doc, content))
        head = np.concatenate([[True], content[same][1:] != content[same][:-1]])
        lead = same[np.maximum.accumulate(np.where(head, np.arange(len(same)), 0))]
        later = (doc[same] != doc[lead]) | (at[same] != at[lead])
        gone = same[later]
        out = [(key[gone], at[gone], at[gone] + size[gone])]
        rest = np.sort(same[~later])
        rest = rest[np.lexsort((at[rest], doc[rest]))]
        n, length = len(rest), size[rest]
        begin = np.cumsum(length + 1) - (length + 1)
        text = np.zeros(int((length + 1).sum()), np.int64)
        vocab, ids = np.unique(words[_flat(edges[rest], length)], return_inverse=True)
        text[_flat(begin, length)] = ids + 1
        fresh = np.concatenate([[True], (doc[rest][1:] != doc[rest][:-1]) | (at[rest][1:] != at[rest][:-1])])
        base = begin[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
        order = np.repeat(base - begin, length + 1) + np.arange(len(text))
        who, a, b = earlier_matches(text, order, begin, length, width)
        i = rest[who]
        out.append((key[i], at[i] + a, at[i] + b))
        rows = _deal_intervals(*(np.concatenate(x) for x in zip(*out)), n_shards)
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return search


def _file_intervals(folder: str):
    def file_intervals(table: pa.Table) -> pa.Table:
        parts = []
        for b in table.column("blob"):
            raw = b.as_py()
            n = len(raw) // 24
            parts.append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<i8", n, 16 * n)))
        key, a, b = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, a, b = key[order], a[order], b[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        write_arrays(f"{folder}/intervals-{table.column('shard')[0].as_py():06d}", key=key[heads], first=np.append(heads, len(key)), a=a, b=b)
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    return file_intervals


def _removed(keys: np.ndarray, intervals: _Mapped, n_shards: int) -> list[list[tuple[int, int]]]:
    """Merged intervals of each document."""
    out: list[list[tuple[int, int]]] = []
    for key in keys:
        m = intervals[int(key % U64(n_shards))]
        found: list[tuple[int, int]] = []
        if m is not None:
            i = int(np.searchsorted(m["key"], key))
            if i < len(m["key"]) and m["key"][i] == key:
                s, e = int(m["first"][i]), int(m["first"][i + 1])
                for a, b in sorted(zip(m["a"][s:e].tolist(), m["b"][s:e].tolist())):
                    if found and a <= found[-1][1]:
                        found[-1] = (found[-1][0], max(found[-1][1], b))
                    else:
                        found.append((a, b))
        out.append(found)
    return out


def _apply(folder: str, n_shards: int, texts_too: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = _Mapped(folder, "intervals")
        for batch in batches:
            texts = batch.column(0)
            n_words, n_removed, digests, kept, spans = [], [], [], [], []
            for text, gone in zip(texts, _removed(batch.column(1).to_numpy().view(U64), intervals, n_shards)):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del words[a:b]
                left = b" ".join(words)
                digests.append(sha256(left).hexdigest())
                if texts_too:
                    kept.append(left)
                    spans.append([{"start": a, "end": b} for a, b in gone])
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            if texts_too:
                made += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = [*batch.schema.names[2:], "n_words", "n_removed", "kept_sha256", *["kept_text", "spans"] * texts_too]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names)

    return apply


def _key(ident: Column, text: Column) -> Column:
    return F.xxhash64(ident, F.coalesce(text, F.lit("")))


def find_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Search a corpus and write the intervals to remove. Returns what remove_repeats needs."""
    spark = docs.sparkSession
    ship(spark)
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(text.alias("t"), ident.alias("id"), _key(ident, text).alias("key"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = max(0, (size // SHARD_BYTES).bit_length())
    folder = new_path(spark, "repeats")
    runs = rows.select("t").mapInArrow(_anchors(width, bits), BLOB_SCHEMA).groupBy("shard").applyInArrow(_repeated(folder), "runs long").agg(F.sum("runs")).first()[0] or 0
    n_shards = max(1, int(runs * (width + 8) // SHARD_WORDS))
    cut = rows.mapInArrow(_stretches(folder, width, bits, n_shards), BLOB_SCHEMA)
    found = cut.groupBy("shard").applyInArrow(_search(width, n_shards), BLOB_SCHEMA)
    found.groupBy("shard").applyInArrow(_file_intervals(folder), "n long").agg(F.sum("n")).first()
    return {"folder": folder, "n_shards": n_shards}


def remove_repeats(docs: DataFrame, found: dict, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, texts: bool = True) -> DataFrame:
    """(__row, n_words, n_removed, kept_sha256[, kept_text, spans]): kept words joined by one space, and
    the removed ranges of words. __row holds the given columns (all, if None); without texts the digest of
    the kept words stands for them."""
    ship(docs.sparkSession)
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    carried = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    rows = docs.select(text.alias("t"), _key(ident, text).alias("key"), packed(carried))
    row_type = carried.schema.simpleString()
    return rows.mapInArrow(
        _apply(found["folder"], found["n_shards"], texts), f"__row {row_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<start:long,end:long>>" * texts
    )


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_words, n_removed, kept_sha256."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs, find_repeats(docs), columns=["doc_id"], texts=False).select(F.col("__row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
