"""Passages of benchmarks in training documents, by FM-indexes over shards of the documents.

1. Every item becomes windows of ``width`` consecutive words (one shorter window, if it has fewer). Equal windows
   are searched once. They are written to files in the shared folder, in blocks of bounded size.
2. A task cuts its documents into shards of at most SHARD words (a longer document goes into several, which
   overlap by a window) and builds a shard's FM-index over all its words: suffix array, Burrows-Wheeler
   transform, wavelet matrix of rank bit vectors, and positions of every RATE-th word of a document.
3. All windows of a block are searched backwards at once, a word a step; those whose range of rows empties drop
   out. Rows of what is left are followed through the index to the next known position, some rows at a
   time. Their ranges of words are merged by a running sum over the shard.

Documents are not shuffled; a lost task reads its documents again. Work grows with documents and blocks of
windows, memory with neither. Words are told apart by 64-bit hashes.

Edge cases: null, empty and wordless texts have no words and no hits; items without words are never found. A null
item id counts as ''. Items that share an id are one item with the windows of all. Rows that repeat are judged
alike. Overlapping and adjacent hits are one span. Empty tables give an empty result, or one without hits.
Texts of any length are read whole. Extra columns are carried by decontaminate, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, new_path, packed, ship
from .sharedfiles import map_arrays, write_arrays
from .substring import BitVector
from .wordhash import U64, buffers, hash_words

WIDTH = 10
SHARD = 1 << 19
RATE = 16
#: Windows of a block, and rows that are followed through the index together.
BLOCK, ROWS = 1 << 16, 1 << 18
#: Word bytes: digits, letters of ASCII in lower case, every byte of other characters.
TABLE = np.full(256, 32, np.uint8)
TABLE[48:58] = np.arange(48, 58)
TABLE[97:123] = np.arange(97, 123)
TABLE[65:91] = np.arange(97, 123)
TABLE[128:] = np.arange(128, 256)


def _words(column: pa.Array, spans: bool = False):
    """(hashes, first word of each text); with spans also the bytes of the texts, starts and ends of words."""
    data, at = buffers(column)
    plain = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(TABLE[data]))
    found = hash_words(plain, spans=spans)
    return (*found[:2], data, *found[3:]) if spans else found


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. Symbol 0 ends a text; ends count as different symbols, in their order.

    Each round sorts by twice as many symbols, and only what is still tied. Sort keys carry the place in
    their lowest bits, so that a plain sort does.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + (len(ends) - 1)
    rank[ends] = np.arange(len(ends))
    bits = max(1, int(n).bit_length())
    packs = 2 * max(bits, int(rank.max(initial=0) + 1).bit_length()) + bits <= 64

    def ordered(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, whether a row differs from the one before it)."""
        wide = max(bits, int(minor.max(initial=0)).bit_length())
        key = (major.astype(U64) << U64(wide)) | minor.astype(U64)
        if packs:
            key = np.sort((key << U64(bits)) | np.arange(len(key), dtype=U64))
            order = (key & U64((1 << bits) - 1)).astype(np.int64)
            key >>= U64(bits)
        else:
            order = np.argsort(key)
            key = key[order]
        return order, np.concatenate([[True], key[1:] != key[:-1]])

    sa, head = ordered(rank, np.append(rank[1:] + 1, 0))
    rows = np.arange(n)
    rank[sa] = np.maximum.accumulate(np.where(head, rows, 0))
    open_ = ~(head & np.append(head[1:], True))
    rows, size = rows[open_], 2
    while len(rows):
        places = sa[rows]
        order, head = ordered(rank[places], rank[np.minimum(places + size, n - 1)])
        places = places[order]
        sa[rows] = places
        rank[places] = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        rows = rows[~(head & np.append(head[1:], True))]
        size *= 2
    return sa


class FMIndex:
    """Compressed index of texts over 64-bit words: backward search, and places of what is found."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        """first: the first word of each text, and one more at the end."""
        import pandas as pd

        codes, vocabulary = pd.factorize(words)
        order = np.argsort(vocabulary)
        self.vocabulary = vocabulary[order]
        back = np.empty(len(order), np.uint32)
        back[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        n_texts = len(first) - 1
        text = np.repeat(np.arange(n_texts), np.diff(first))
        symbols = np.zeros(len(words) + n_texts, np.uint32)
        symbols[np.arange(len(words)) + text] = back[codes]
        self.start = first[:-1] + np.arange(n_texts)  # where each text begins, with the ends of those before it
        self.n = len(symbols)
        sa = suffix_array(symbols)
        place = np.arange(self.n) - np.repeat(self.start, np.diff(np.append(self.start, self.n)))
        known = place % RATE == 0
        self.known = BitVector(known[sa])
        self.place = sa.compress(known[sa]).astype(np.int32)
        bwt = symbols[sa - 1]
        sigma = len(order) + 1
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels = max(1, (sigma - 1).bit_length())
        self.bits = []
        for level in reversed(range(self.levels)):
            if level in (7, 15):  # the bits above are done with
                bwt = bwt.astype(np.uint8 if level == 7 else np.uint16)
            bit = (bwt & bwt.dtype.type(1 << level)) != 0
            self.bits.append(BitVector(bit))
            bwt = np.concatenate([bwt.compress(~bit), bwt.compress(bit)])
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, v in zip(reversed(range(self.levels)), self.bits):
            one = v.rank(i)
            i = np.where((c >> level) & 1, v.zeros + one, i - one)
        return i

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbol c followed by what the rows lo .. hi - 1 begin with."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first_row[c] - self.origin[c]
        return base + both[: len(c)], base + both[len(c) :]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, end) of the windows that occur; a window's words stand at the right of its row."""
        width = windows.shape[1]
        at = np.minimum(np.searchsorted(self.vocabulary, windows), len(self.vocabulary) - 1) if len(self.vocabulary) else np.zeros_like(windows, np.int64)
        symbol = np.where(self.vocabulary[at] == windows, at + 1, 0) if len(self.vocabulary) else np.zeros_like(at)
        who = np.flatnonzero(((symbol > 0) | (np.arange(width) < width - lengths[:, None])).all(axis=1))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n)
        for k in range(width):
            here = lengths[who] > k
            lo[here], hi[here] = self.extend(symbol[who[here], width - 1 - k], lo[here], hi[here])
            alive = lo < hi
            who, lo, hi = who[alive], lo[alive], hi[alive]
        return who, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of rows, by steps back to a known one: a text's first word is known, so none leaves its text."""
        out, todo, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(todo):
            word, bit = row >> 6, (row & 63).astype(U64)
            there = (self.known.words[word] >> bit) & U64(1) == 1
            out[todo[there]] = self.place[self.known.rank(row[there])] + steps
            row, todo = row[~there], todo[~there]
            i, c = row, np.zeros(len(row), np.int64)
            for v in self.bits:  # the symbol before, and how often it came before this row
                one = v.rank(i)
                bit = (v.words[i >> 6] >> (i & 63).astype(U64)) & U64(1) == 1
                c = (c << 1) | bit
                i = np.where(bit, v.zeros + one, i - one)
            row = self.first_row[c] + i - self.origin[c]
            steps += 1
        return out


def _windows(width: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = _words(batch.column(0))
            sizes = np.diff(first)
            out, item = [], []
            for a, n, i in zip(first[:-1].tolist(), sizes.tolist(), batch.column(1).to_pylist()):
                found = {h[k : k + width].tobytes() for k in range(a, a + n - width + 1)} if n >= width else {h[a : a + n].tobytes()} if n else set()
                out += found
                item += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(item, pa.string())], ["words", "item"])

    return windows


def _write_block(folder: str, width: int):
    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by([("words", "ascending"), ("item", "ascending")])
        words = table.column("words").to_pylist()
        firsts = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
        grid = np.zeros((len(firsts), width), U64)
        for row, i in enumerate(firsts):
            w = np.frombuffer(words[i], U64)
            grid[row, width - len(w) :] = w
        text, at = buffers(table.column("item"))
        lengths = np.array([len(words[i]) // 8 for i in firsts], np.int64)
        write_arrays(f"{folder}/windows-{table.column('block')[0].as_py()}", words=grid.ravel(), lengths=lengths, first=np.array([*firsts, len(words)]), text=text, at=at)
        return pa.table({"n": pa.array([len(firsts)], pa.int64())})

    return write


def write_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> dict:
    """Write the items' windows to the shared folder, in blocks. Returns what decontaminate needs."""
    spark = items.sparkSession
    ship(spark)
    folder = new_path(spark, "windows")
    rows = items.select(F.col(f"`{text_col}`").alias("t"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"))
    found = materialize(rows.mapInArrow(_windows(width), "words binary, item string").distinct(), "windows")
    blocks = max(1, -(-found.count() // BLOCK))
    made = found.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_write_block(folder, width), "n long")
    made.agg(F.sum("n")).first()
    return {"folder": folder, "blocks": blocks, "width": width}


def _shards(first: np.ndarray, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first word, end) of at most SHARD words; parts of a text overlap."""
    held, size = [], 0
    for text, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        while a < b:
            end = min(b, a + SHARD)
            if held and size + end - a > SHARD:
                yield held
                held, size = [], 0
            held.append((text, a, end))
            size += end - a
            if end == b:
                break
            a = end - overlap
    if held:
        yield held


class _Found:
    """What a batch's words hit: cover holds +1 where a hit begins and -1 where it ends; pairs of text and item."""

    def __init__(self, n_words: int):
        self.cover, self.pairs = np.zeros(n_words + 1, np.int32), set()


def _search_shard(h: np.ndarray, parts: list[tuple[int, int, int]], phrases: dict, found: _Found) -> None:
    texts, starts, ends = (np.array(x) for x in zip(*parts))
    first = np.concatenate([[0], np.cumsum(ends - starts)])
    index = FMIndex(np.concatenate([h[a:b] for _, a, b in parts]), first)
    for block in range(phrases["blocks"]):
        m = map_arrays(f"{phrases['folder']}/windows-{block}")
        if m is None:
            continue
        lengths = m["lengths"]
        who, lo, hi = index.search(m["words"].reshape(-1, phrases["width"]), lengths)
        total = np.cumsum(hi - lo)
        names: dict[int, list[str]] = {}
        for a in range(0, int(total[-1]) if len(total) else 0, ROWS):  # rows of all windows, some at a time
            row = np.arange(a, min(a + ROWS, int(total[-1])))
            k = np.searchsorted(total, row, "right")
            place = index.locate(row - (total[k] - (hi - lo)[k]) + lo[k])
            part = np.searchsorted(index.start, place, "right") - 1
            word = place - index.start[part] + starts[part]
            np.add.at(found.cover, word, 1)
            np.add.at(found.cover, word + lengths[who[k]], -1)
            for pair in np.unique(texts[part] * len(lengths) + who[k]).tolist():
                text, window = divmod(pair, len(lengths))
                if window not in names:
                    i, j = int(m["first"][window]), int(m["first"][window + 1])
                    text_at = m["at"][i : j + 1].tolist()
                    names[window] = [bytes(m["text"][x:y]).decode() for x, y in zip(text_at[:-1], text_at[1:])]
                found.pairs.update((text, item) for item in names[window])


def _hits(phrases: dict, texts_too: bool):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first, *where = _words(batch.column(0), texts_too)
            found = _Found(len(h))
            for parts in _shards(first, phrases["width"] - 1):
                _search_shard(h, parts, phrases, found)
            hit = np.cumsum(found.cover[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(hit)])
            n_hit = upto[first[1:]] - upto[first[:-1]]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for text, item in sorted(found.pairs):
                items[text].append(item)
            cols = [pa.array(np.diff(first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))]
            if texts_too:
                spans, kept = [], []
                data, starts, ends = where
                at = buffers(batch.column(0))[1]
                for i in range(batch.num_rows):
                    a, b = int(first[i]), int(first[i + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
                    pairs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                    spans.append([{"start": x, "end": y} for x, y in pairs])
                    left, text = int(at[i]), []
                    for x, y in pairs:
                        text.append(data[left : starts[a + x]].tobytes())
                        left = int(ends[a + y - 1])
                    kept.append(b"".join([*text, data[left : at[i + 1]].tobytes()]).decode())
                cols += [pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["n_words", "n_hit", "items", *["kept_text", "spans"] * texts_too]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])

    return hits


def decontaminate(docs: DataFrame, phrases: dict, text_col: str = "text", columns: list[str] | None = None, texts: bool = True) -> DataFrame:
    """(__row, n_words, n_hit, items[, kept_text, spans]): items whose windows occur, sorted; the text without
    the hit words, and their ranges. __row holds the given columns (all, if None)."""
    ship(docs.sparkSession)
    carried = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    rows = docs.select(F.col(f"`{text_col}`").alias("t"), packed(carried))
    more = ", kept_text string, spans array<struct<start:long,end:long>>" * texts
    return rows.mapInArrow(_hits(phrases, texts), f"__row {carried.schema.simpleString()}, n_words long, n_hit long, items array<string>{more}")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document against all windows of ``benchmark``."""
    phrases = write_windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), phrases, columns=["doc_id"], texts=False)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("__row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p), s AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT DISTINCT s.r, s.i, p.k, item FROM s CROSS JOIN k JOIN p ON p.k = k.k AND array_to_string(w[i:i + k.k - 1], ' ') = p.x WHERE s.i + k.k - 1 <= len(w)),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY 1),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""
