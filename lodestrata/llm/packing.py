"""Best-fit packing of tokenised documents into sequences by linear grouping.

Pieces of at most ``capacity`` tokens are counted by length. On that histogram, which has at most
``capacity`` rows whatever the corpus size, the driver solves the packing: large lengths are dealt, in
order, into groups of equal cardinality and rounded up to each group's largest; column generation
finds the configurations of those few sizes that need the fewest sequences; actual lengths take the places
of the rounded ones, the last one in a sequence so that it uses up what the rounding left free; what is
left over and all small lengths go, longest first, to the sequence with the least sufficient room. The result is a list of segments (length, ranks, first
sequence, offset), and each piece finds its place by its length and its rank among equal lengths.

Edge cases: a null or empty text is one piece of one token, the end id. Rows that repeat are packed as
often as they stand. Texts of any length are tokenised whole and cut into full pieces. An empty table
gives an empty result. A null id is kept as null.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, ship

CAPACITY = 2048
PIECE_SCHEMA = "id long, piece int, start long, length int, ids_crc32 long"


class _Cache(dict):
    """A bounded cache in two generations; misses are computed."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Token ids of texts, word by word, for a tokenizer that never joins two words.

    Words of characters below U+0250 are normalised and split here and given to the BPE model; all
    others, and those that may hold a special token, go through the whole tokenizer.
    """

    #: Words whose lower case stays below U+02B0.
    SAFE = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]+")
    #: The tokenizer's own parts of a word, with letters and digits as they are below U+02B0.
    LETTER, DIGIT = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{LETTER}{DIGIT}]+")

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}
        self.words = _Cache(self._word, limit)
        self.pieces = _Cache(self._part, limit)

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])

    def _word(self, word: str) -> bytes:
        if "<|" not in word and self.SAFE.fullmatch(word):
            pieces, low = self.pieces, word.lower()
            if low.isalpha():
                return pieces[low]
            if low[-1] in ".,;:!?" and low[:-1].isalpha():
                return pieces[low[:-1]] + pieces[low[-1]]
            return b"".join([pieces[p] for p in self.PARTS.findall(low)])
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit values."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for Python only
            return self._whole(text)
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for a worker process, whose tasks share its cache."""
    return WordTokenizer(path)


def _tokenize(path: str, capacity: int, end: bytes, with_ids: bool):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        step = 4 * capacity
        for batch in batches:
            rows = [[] for _ in names]
            held = 0
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = tok.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for column, x in zip(rows, (ident, k, at // 4, len(part) // 4, crc32(part), part)):
                        column.append(x)
                    held += len(part)
                if with_ids and held > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
                    rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return tokenize


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every text's ids and the end id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(_tokenize(path, capacity, np.array([end_id], "<u4").tobytes(), with_ids), PIECE_SCHEMA + ", ids binary" * with_ids)


def _price(value: np.ndarray, sizes: np.ndarray, capacity: int, most: int):
    """Knapsack of at most ``most`` items: the best value by room, and a function that gives the items."""
    items = np.flatnonzero(value > 1e-12)
    room = np.arange(capacity + 1) - sizes[items][:, None]
    fits = room >= 0
    room = np.where(fits, room, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most if len(items) else 0):
        cand = np.where(fits, best[room] + value[items][:, None], -1.0)
        which = cand.argmax(0)
        new = np.take_along_axis(cand, which[None], 0)[0]
        better = new > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, items[which], -1))
        best = np.where(better, new, best)

    def configuration(c: int) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for pick in reversed(picks):
            if pick[c] >= 0:
                out[pick[c]] += 1
                c -= sizes[pick[c]]
        return out

    return best, configuration


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear program by column generation, rounded down.

    A pricing knapsack puts the best configuration with each size into a pool, which is priced first. It
    stops when no configuration is worth more than 1 + ``gap`` sequences (then the value is within that
    share of the optimum); after ``rounds`` pivots it takes what it has.
    """
    n = len(sizes)
    most = int(capacity // sizes.min())
    basis, cost = np.diag((capacity // sizes).astype(float)), np.ones(n)
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    pool = np.zeros((0, n))
    for turn in range(1, rounds + 1):
        if turn % 200 == 0:  # against rounding errors
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        dual = cost @ inverse
        worth = pool @ dual
        if dual.min() < -1e-9:  # covering a size more often than asked costs nothing
            column, price = np.zeros(n), 0.0
            column[int(dual.argmin())] = -1
        elif len(worth) and worth.max() > 1 + 1e-6:
            column, price = pool[int(worth.argmax())], 1.0
        else:
            best, configuration = _price(dual, sizes, capacity, most)
            if best[capacity] <= 1 + gap:
                break
            found = {tuple(configuration(capacity))}
            for g in np.flatnonzero(best[capacity - sizes] + dual > 1 + gap):
                with_g = configuration(capacity - sizes[g])
                with_g[g] += 1
                found.add(tuple(with_g))
            pool = np.vstack([pool[-4000:], np.array(sorted(found), float)])
            column, price = pool[int((pool @ dual).argmax())], 1.0
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.full(n, np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / d[ok]
        leave = int(ratio.argmin())
        basis[:, leave], cost[leave] = column, price
        row = inverse[leave] / d[leave]
        inverse = inverse - np.outer(d, row)
        inverse[leave] = row
        x = x - ratio[leave] * d
        x[leave] = ratio[leave]
    x = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    return [(basis[:, i].astype(np.int64), int(x[i])) for i in range(n) if x[i] > 0 and cost[i] > 0]


class _Packing:
    """Pieces counted by length, their segments, and the room that sequences have left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: n for k, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.rank: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences
        self.n_seq = 0

    def put(self, length: int, n: int, seq: int, offset: int) -> None:
        self.segments.append((length, self.rank[length], n, seq, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def longest(self, limit: int, least: int, used: Counter) -> Iterator[int]:
        """Lengths from limit down to least of which a piece is left besides the used ones."""
        for i in range(bisect.bisect_right(self.lengths, limit) - 1, -1, -1):
            if self.lengths[i] < least:
                return
            if self.left[self.lengths[i]] > used[self.lengths[i]]:
                yield self.lengths[i]

    def fill(self, tops: list[int], lows: list[int], least: int, tried: int = 64) -> tuple[int, Counter] | None:
        """(room left, lengths) for one sequence of a configuration: groups with lengths from lows to tops.

        The longest piece of every group, but the last two: of the pieces of one group, and whatever
        large length then fits best, those two that leave the least room. A group that has run out gives
        its place to the next shorter length.
        """
        used, free = Counter(), self.capacity
        for top in tops[:-2]:
            length = next(self.longest(top, least, used), 0)
            if not length:
                return None
            used[length] += 1
            free -= length
        if len(tops) == 1:
            length = next(self.longest(free, least, used), 0)
            return (free - length, Counter([length])) if length else None
        best = None
        for length in itertools.islice(self.longest(tops[-2], least, used), tried):
            if best and (length < lows[-2] or not best[0]):
                break
            last = next(self.longest(free - length, least, used + Counter([length])), 0)
            if last and (best is None or free - length - last < best[0]):
                best = free - length - last, used + Counter([length, last])
        return best

    def place(self, need: Counter, times: int) -> int:
        """Up to so many sequences of these lengths; how many."""
        k, offset = min([times, *(self.left[x] // n for x, n in need.items())]), 0
        for length in sorted(need.elements(), reverse=True):
            self.put(length, k, self.n_seq, offset)
            offset += length
        if offset < self.capacity:
            self.room[self.capacity - offset].append((self.n_seq, k))
        self.n_seq += k
        return k

    def best_fit(self) -> None:
        """All pieces that are left, longest first, to the sequences with the least sufficient room."""
        levels = sorted(self.room)
        for length in reversed(self.lengths[:]):
            n = self.left[length]
            while n:
                i = bisect.bisect_left(levels, length)
                if i == len(levels):
                    k = -(-n // (self.capacity // length))
                    self.room[self.capacity].append((self.n_seq, k))
                    bisect.insort(levels, self.capacity)
                    self.n_seq += k
                    continue
                free = levels[i]
                seq, k = self.room[free].pop()
                take = min(n, k)
                self.put(length, take, seq, self.capacity - free)
                if take < k:
                    self.room[free].append((seq + take, k - take))
                if not self.room[free]:
                    levels.pop(i)
                if free > length:
                    if not self.room[free - length]:
                        bisect.insort(levels, free - length)
                    self.room[free - length].append((seq, take))
                n -= take


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48, small: float = 1 / 8, slack: int = 8, tell: dict | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, how many, first sequence, offset), and the number of sequences.

    A segment puts as many pieces of one length into consecutive sequences, one each, at one offset. A
    configuration is used as long as actual pieces leave at most ``slack`` tokens free; pieces that are left
    go the way of the small ones. tell receives the number of large pieces and how many of them the
    configurations placed.
    """
    state = _Packing(counts, capacity)
    least = int(capacity * small) + 1
    large = [k for k in reversed(state.lengths) if k >= least]
    ends = np.cumsum([state.left[k] for k in large])
    by_configuration = 0
    if large:
        # groups of equal cardinality, longest first; a length that fills several is one group
        firsts = np.arange(0, ends[-1], -(-ends[-1] // groups))
        tops, at = np.unique(-np.array(large)[np.searchsorted(ends, firsts, "right")], return_inverse=True)
        tops, demand = -tops, np.bincount(at, np.diff(np.append(firsts, ends[-1])))
        lows = np.append(tops[1:] + 1, least)
        for pattern, times in sorted(configurations(tops, demand, capacity), key=lambda c: (-c[1], tuple(c[0]))):
            slots = np.repeat(np.arange(len(tops)), pattern)
            while times:
                found = state.fill(tops[slots].tolist(), lows[slots].tolist(), least)
                if found is None or found[0] > slack:
                    break
                k = state.place(found[1], times)
                times -= k
                by_configuration += k * found[1].total()
    if tell is not None:
        tell.update(large=int(ends[-1]) if large else 0, by_configuration=by_configuration)
    state.best_fit()
    return state.segments, state.n_seq


def _place(starts: np.ndarray, first_seq: np.ndarray, offsets: np.ndarray, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            key = (cols["length"].to_numpy().astype(np.int64) << 44) | cols["rank"].to_numpy()
            i = np.searchsorted(starts, key, "right") - 1
            cols["sequence_id"] = pa.array(first_seq[i] + (key - starts[i]))
            cols["offset"] = pa.array(offsets[i])
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return place


def assign(table: DataFrame, capacity: int = CAPACITY, per_block: int = 1000) -> DataFrame:
    """Pieces (a written table) with sequence_id and offset. Full pieces are a sequence each; the
    others are ranked among those of equal length within hashed blocks, so that no length is one task."""
    hist = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # at most capacity rows
    full = hist.pop(capacity, 0)
    segments, n_seq = plan(hist, capacity)
    segments.sort()
    starts = np.array([(s[0] << 44) | s[1] for s in segments], np.int64)
    first_seq, offsets = np.array([s[3] for s in segments], np.int64), np.array([s[4] for s in segments], np.int64)
    table = table.select("*", F.monotonically_increasing_id().alias("rid"))
    names = [c for c in table.columns if c != "rid"] + ["sequence_id", "offset"]
    whole = table.where(F.col("length") == capacity).select(*names[:-2], (F.lit(n_seq) + F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not hist:
        return whole
    blocks = table.sparkSession.createDataFrame([(k, max(1, n // per_block)) for k, n in hist.items()], "length int, blocks long")
    rest = table.where(F.col("length") < capacity).join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).drop("blocks")
    sums = rest.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("rid")
    ranked = rest.join(before, ["length", "block"]).select(*names[:-2], (F.col("before") + F.row_number().over(order) - 1).cast("long").alias("rank"))
    schema = ", ".join(f"{c} {t}" for c, t in ranked.drop("rank").dtypes) + ", sequence_id long, offset long"
    return whole.unionByName(ranked.mapInArrow(_place(starts, first_seq, offsets, names), schema))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, **cols: str) -> DataFrame:
    """All pieces of the documents with their places: id, piece, start, length, ids_crc32, sequence_id, offset.

    with_ids adds the ids themselves, as little-endian 32-bit values.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return assign(materialize(pieces(docs, path, capacity, with_ids=with_ids, **cols), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids), from pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
