"""How the sources of each language differ in their words.

1. Exact document frequencies: a task encodes the terms of some texts at a time as a dictionary, counts each
   (text, term) once and hands on sums by language and term. Terms in enough documents are kept; they are
   written, by language and in blocks of bounded size, to files in the shared folder.
2. A second pass counts occurrences with an Aho-Corasick automaton a block of kept terms. Terms carry a
   delimiter on both sides, and texts have one delimiter between terms, so a term is never found inside
   another one. Texts of one language and source are searched as one. More kept terms than a worker holds are
   not searched block after block: the terms of the texts are dealt to their blocks, so that every term meets
   one automaton and a task builds few of them.
3. The counts are sparse postings (language, source, term, n). Shares are exact whole numbers. A pair's value
   is summed over terms that both sources have (by blocks of terms), terms that one of them has (by the
   number of terms with an equal share), and the terms that neither has (one product), so that absent terms
   are never listed.

A worker holds automata of at most CACHED terms and counts of bounded size; every sum is partial before it is
shuffled. The pairs that come out are as many as the contract asks for, all ordered pairs of a language's
sources; joins by language are salted, since one language may hold most rows.

Edge cases: null text, language and source count as ''. A text without terms still makes its group known. A
language without kept terms has pairs with value 0 and no terms. Repeated rows, and rows that share an id, are
documents like others. Equal values are ranked by item in the order of UTF-8 bytes. An empty table gives an
empty result. Texts of any length are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import sha256
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, new_path, ship
from .sharedfiles import map_arrays, write_arrays
from .wordhash import buffers

MIN_DOCS, TOP = 10, 10
PIECE = 4 << 20
BLOCK_TERMS, CACHED = 200_000, 400_000
BLOCK_POSTINGS = 200_000
HELD_COUNTS = 8 << 20
#: Bytes of terms that a task of one block reads.
DEALT = 32 << 20
SALT = 16
SCALE = 1_000_000_000
#: Term bytes: letters of ASCII, in lower case, and every byte of other characters.
TABLE = np.full(256, 32, np.uint8)
TABLE[97:123] = np.arange(97, 123)
TABLE[65:91] = np.arange(97, 123)
TABLE[128:] = np.arange(128, 256)


def _plain(column: pa.Array) -> pa.Array:
    """Texts with a space for every character that belongs to no term."""
    data, at = buffers(column)
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(TABLE[data]))


def _pieces(texts: pa.Array, groups: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """(group, its texts), some texts at a time."""
    size = pc.binary_length(texts).to_numpy()
    order = np.argsort(groups, kind="stable")
    total = np.cumsum(size[order])
    a = 0
    while a < len(order):
        b = int(np.searchsorted(total, total[a] + PIECE, "right"))
        b = max(a + 1, min(b, int(np.searchsorted(groups[order], groups[order[a]], "right"))))
        yield int(groups[order[a]]), texts.take(pa.array(order[a:b]))
        a = b


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(1).dictionary_encode()
        for group, texts in _pieces(_plain(batch.column(0)), lang.indices.to_numpy()):
            parts = pc.split_pattern(texts, " ")
            terms = parts.values.dictionary_encode()
            n = len(terms.dictionary)
            if not n:
                continue
            text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            pair = np.sort(text * n + terms.indices.to_numpy())
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
            counts = np.bincount(pair % n, minlength=n)
            real = pc.not_equal(terms.dictionary, "")
            yield pa.RecordBatch.from_arrays([pa.array([lang.dictionary[group].as_py()] * n).filter(real), terms.dictionary.cast(pa.string()).filter(real), pa.array(counts).filter(real)], ["lang", "term", "df"])


def _file(folder: str, lang: str, block: int) -> str:
    return f"{folder}/terms-{sha256(lang.encode()).hexdigest()[:32]}-{block}"


def _write_terms(folder: str):
    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by([("df", "descending"), ("term", "ascending")])  # a node's children are tried in the order in which they came
        data, at = buffers(table.column("term").drop_null())
        lang, block, blocks = (table.column(c)[0].as_py() for c in ("lang", "block", "blocks"))
        write_arrays(_file(folder, lang, block), text=data, at=at, blocks=np.array([blocks]))
        return pa.table({"lang": [lang], "n": pa.array([len(at) - 1], pa.int64())})

    return write


class _Automata:
    """Automata of kept terms by language and block; those used last are held, up to CACHED terms."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, OrderedDict()

    def blocks(self, lang: str) -> int:
        first = self.get(lang, 0)
        return first[2] if first else 0

    def get(self, lang: str, block: int):
        """(automaton, terms, number of blocks), or None for a language without kept terms."""
        import ahocorasick

        key = lang, block
        if key not in self.held:
            found = map_arrays(_file(self.folder, lang, block))
            if found is None:
                self.held[key] = None
            else:
                text, at = bytes(found["text"]), found["at"].tolist()
                terms = [text[a:b].decode() for a, b in zip(at[:-1], at[1:])]
                automaton = ahocorasick.Automaton()
                for i, term in enumerate(terms):
                    automaton.add_word(f" {term} ", i)
                automaton.make_automaton()
                self.held[key] = automaton, terms, int(found["blocks"][0])
            while len(self.held) > 1 and sum(len(x[1]) if x else 1 for x in self.held.values()) > CACHED:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, str, pa.Array]]:
    """(language, source, texts) of rows (text, lang, source), some texts at a time."""
    codes = [batch.column(i).dictionary_encode() for i in (1, 2)]
    n_sources = max(1, len(codes[1].dictionary))
    group = codes[0].indices.to_numpy().astype(np.int64) * n_sources + codes[1].indices.to_numpy()
    names = [c.dictionary.to_pylist() for c in codes]
    for g, texts in _pieces(_plain(batch.column(0)), group):
        yield names[0][g // n_sources], names[1][g % n_sources], texts


def _dealt(folder: str):
    """Rows (text, lang, source) to (text, lang, source, block): the terms of some texts, one text a block of terms."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for lang, source, texts in _grouped(batch):
                if lang not in known:
                    found = map_arrays(_file(folder, lang, 0))
                    known[lang] = int(found["blocks"][0]) if found else 0
                n = known[lang]
                if not n:
                    continue
                terms = pc.split_pattern(texts, " ").values
                terms = terms.filter(pc.not_equal(terms, ""))
                codes = terms.dictionary_encode()
                of = np.array([crc32(t) % n for t in codes.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)[codes.indices.to_numpy()]
                at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), terms.take(pa.array(np.argsort(of, kind="stable"))))
                out = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([out, pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32))], ["text", "lang", "source", "block"])

    return dealt


def _occurrences(folder: str):
    """Rows (text, lang, source), or (text, lang, source, block) by language and block, to (lang, source, term, n)."""

    def searched(batches: Iterator[pa.RecordBatch], automata: _Automata) -> Iterator[tuple[str, str, int, str]]:
        for batch in batches:
            if batch.num_columns > 3:
                for i in range(batch.num_rows):
                    text, lang, source, block = (c[i].as_py() for c in batch.columns)
                    yield lang, source, block, f" {text} "
            else:
                for lang, source, texts in _grouped(batch):
                    joined = f" {' '.join(texts.to_pylist())} "
                    for block in range(automata.blocks(lang)):
                        yield lang, source, block, joined

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata(folder)
        counts: dict[tuple[str, str, int], tuple[list[str], np.ndarray]] = {}
        held = 0

        def flush():
            for (lang, source, _), (terms, n) in counts.items():
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array([terms[i] for i in found.tolist()], pa.string()), pa.array(n[found])], ["lang", "source", "term", "n"])

        for lang, source, block, text in searched(batches, automata):
            automaton, terms, _ = automata.get(lang, block)
            if not terms:  # a block to which no term was dealt
                continue
            key = lang, source, block
            if key not in counts:
                if held + len(terms) > HELD_COUNTS:
                    yield from flush()
                    counts.clear()
                    held = 0
                counts[key] = terms, np.zeros(len(terms), np.int64)
                held += len(terms)
            counts[key][1][:] += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(terms))
        yield from flush()

    return occurrences


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared_terms(table: pa.Table) -> pa.Table:
    """What terms that both sources have add to their pair, over what the sums for one and none have counted."""
    names = pc.unique(table.column("source")).sort()
    s = pc.index_in(table.column("source"), names).to_numpy()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.zeros(0, np.int64)
    order = np.lexsort((s, term))
    s, term = s[order].astype(np.int64), term[order]
    p, none = (table.column(c).to_numpy()[order] for c in ("p", "none"))
    n = len(names)
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = 1
    while True:  # rows of one term lie side by side: compare each with the one that lies ``step`` further on
        a = np.flatnonzero(term[:-step] == term[step:]) if step < len(term) else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + step
        value = _difference(p[a], p[b]) - _difference(p[a], none[b]) - _difference(none[a], p[b]) + _difference(none[a], none[b])
        keys, at = np.unique(np.concatenate([keys, s[a] * n + s[b]]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([values, value]))
        values = sums
        step += 1
    lang = pa.array([table.column("lang")[0].as_py()] * len(keys) * 2, pa.string())
    one, other = names.take(pa.array(keys // n)), names.take(pa.array(keys % n))
    return pa.table([lang, pa.chunked_array([one, other]), pa.chunked_array([other, one]), pa.array(np.tile(values, 2))], ["lang", "source", "item", "value"])


def _by_block(rows: DataFrame, folder: str) -> DataFrame:
    """Terms dealt to their blocks: a task reads a few blocks of a few languages, one after the other."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT))
    salt = F.pmod(F.xxhash64("text"), F.lit(max(SALT, n // 16)))
    dealt = rows.mapInArrow(_dealt(folder), "text string, lang string, source string, block int")
    return dealt.repartition(n, "lang", "block", salt).sortWithinPartitions("lang", "block")


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact for any long; total is n + 2 * v."""
    return F.expr(f"1 + (cast({count} + 2 as decimal(20,0)) * {SCALE}BD) div cast({total} as decimal(20,0))")


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' compares a source with every other one of its
    language, part 'term' names the ``top`` terms that set it apart from the language."""
    spark = docs.sparkSession
    ship(spark)
    folder = new_path(spark, "divergence")
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    df = rows.select("text", "lang").mapInArrow(_frequencies, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))
    kept = materialize(df.where(F.col("df") >= min_docs), "terms")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    blocks = F.ceil(F.col("v") / BLOCK_TERMS).cast("int")
    # a language's row meets its terms: many terms a key, so the side with one row a language is salted
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    named = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).join(vocabulary.select("lang", blocks.alias("blocks"), salt), ["lang", "salt"])
    named = named.select("lang", "term", "df", "blocks", F.pmod(F.crc32(F.col("term").cast("binary")), F.col("blocks").cast("long")).cast("int").alias("block"))
    every = vocabulary.select("lang", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("df"), blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    named = named.unionByName(every)  # a block without terms has its file, too
    named.groupBy("lang", "block").applyInArrow(_write_terms(folder), "lang string, n long").agg(F.sum("n")).first()
    found = _by_block(rows, folder) if kept.count() > CACHED else rows
    found = found.mapInArrow(_occurrences(folder), "lang string, source string, term string, n long")
    counts = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "counts")

    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "k", "v")]).withColumn("total", F.expr("n + 2 * v"))
    groups = groups.withColumn("none", F.when(F.col("v") > 0, share("0L", "nullif(total, 0)")))
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg((F.sum("n") + 2 * F.max("v")).alias("lang_total"))
    sums = F.sum("n").over(Window.partitionBy("lang", "term"))  # a row a source
    postings = counts.withColumn("lang_n", sums).join(groups.join(langs, "lang").select("lang", "source", "total", "none", "lang_total"), ["lang", "source"])
    postings = materialize(postings.select("lang", "source", "term", "none", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q")), "postings")

    marked = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # pairs: no common term at all, then terms of one source, then terms of both
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"), F.col("k").alias("other_k"), salt)
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).join(other, ["lang", "salt"]).where("source <> item")
    neither = salted(groups, "source").select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("k") - F.col("other_k")) * distance("none", "other")).otherwise(F.lit(0).cast("long")).alias("value"))
    equal = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    one = salted(equal, "source", "p").select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair"), (F.col("times") * distance("p", "other")).alias("value"))
    n_blocks = max(64, -(-postings.count() // BLOCK_POSTINGS))
    both = postings.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n_blocks))).groupBy("lang", "block").applyInArrow(_shared_terms, "lang string, source string, item string, value long")
    pairs = neither.unionByName(one.select("lang", "pair.source", "pair.item", "value")).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    return marked.unionByName(pairs).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all pairs of sources and the first ten terms of each, by language."""
    return source_divergence(documents(spark, sf_dir).select("text", "lang", "source"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 10), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang) AS lang_total, v
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::BIGINT AS q FROM full_c),
w AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
terms AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM w),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM terms WHERE rank <= 10
UNION ALL SELECT lang, source, 'pair', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INTEGER FROM pairs"""
