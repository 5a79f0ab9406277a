"""Language identification by a linear-chain conditional random field over words.

Every word has a label. Its features are prefixes and suffixes, character n-grams, the word itself and
membership in a lexicon of each language, hashed into one table of weights; transitions between labels
are learned with them. Training takes a bounded sample of labelled documents, cuts it into stretches
and joins stretches of different languages, so that switches occur. Prediction runs forward-backward
over the whole text, however long: blocks of words are reduced to transfer matrices at once, a short
loop passes over the blocks, and the blocks are filled in again at once. The language of a text is the
one with the largest sum of word marginals, weighted by letters.

Bounds of the training sample: ``per_lang`` distinct texts of each language, ``per_doc`` words of each.

Edge cases: a null text and one without a letter are ``und`` with score 0 and no spans. Without labelled
documents every text is ``und``. A null id counts as training; ids are cast to long, so one that is no
number becomes null. Rows are predicted one by one, so repeated rows agree; ties go to the language first
in code point order. Texts of any length are labelled whole. Extra columns are neither read nor carried,
so their names do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ship, words
from .wordhash import U64, hash_words, mix

TABLE = 1 << 16
SPAN = 128
BLOCK = 32
SLICE = 1 << 18
CACHE = 300_000
UND = "und"


def word_features(batch: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) pairs: n-grams of up to three characters with word ends, prefixes
    and suffixes of two to four, the word, and its lexicon."""
    if not batch:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = [w.lower().replace("\n", " ") for w in batch]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
    sep = codes == 10
    edges = np.flatnonzero(sep)
    begin, end = edges[:-1] + 1, edges[1:]
    size = end - begin
    owner = np.cumsum(sep) - 1
    idx, feat = [], []

    def add(who: np.ndarray, h: np.ndarray, kind: int) -> None:
        idx.append(who)
        feat.append((mix(h * U64(64) + U64(kind)) & U64(TABLE - 1)).astype(np.int64))

    with np.errstate(over="ignore"):
        base = U64(0x9E3779B97F4A7C13)
        inner = np.flatnonzero(~sep)
        add(owner[inner], codes[inner], 1)
        two = codes[:-1] * base + codes[1:]
        at = np.flatnonzero(~(sep[:-1] & sep[1:]))
        add(np.minimum(owner[at], len(batch) - 1), two[at], 2)
        at = np.flatnonzero(~sep[1:-1])
        add(owner[at + 1], two[at] * base + codes[at + 2], 3)
        for n in (2, 3, 4):
            i = np.flatnonzero(size >= n)
            head, tail = np.zeros(len(i), U64), np.zeros(len(i), U64)
            for k in range(n):
                head = head * base + codes[begin[i] + k]
                tail = tail * base + codes[end[i] - n + k]
            add(i, head, 10 + n)
            add(i, tail, 20 + n)
        place = (np.arange(len(codes)) - edges[owner]).astype(U64)
        whole = np.add.reduceat(np.where(sep, U64(0), mix(codes) * mix(place)), edges[:-1])
        add(np.arange(len(batch)), whole, 30)
    i = np.array([k for k, w in enumerate(low) if w in lexicon], np.int64)
    if len(i):
        add(i, np.array([lexicon[low[k]] for k in i], U64), 31)
    return np.concatenate(idx), np.concatenate(feat)


def _emissions(n: int, idx: np.ndarray, feat: np.ndarray, weights: np.ndarray) -> np.ndarray:
    count = np.maximum(np.bincount(idx, minlength=n), 1)
    return np.stack([np.bincount(idx, weights[feat, j], n) / np.sqrt(count) for j in range(weights.shape[1])], 1)


def _chain(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals and summed pair marginals of sequences of one length (sequences, words, labels)."""
    psi = np.exp(emit - emit.max(2, keepdims=True))
    t = np.exp(trans)
    s, n, k = emit.shape
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    a = np.full((s, k), 1 / k)
    for i in range(n):
        a = (a @ t) * psi[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = a
    for i in range(n - 2, -1, -1):
        b = (beta[:, i + 1] * psi[:, i + 1]) @ t.T
        beta[:, i] = b / b.sum(1, keepdims=True)
    node = alpha * beta
    node /= node.sum(2, keepdims=True)
    left, right = alpha[:, :-1].reshape(-1, k), (beta * psi)[:, 1:].reshape(-1, k)
    norm = np.einsum("ni,ij,nj->n", left, t, right)
    pair = t * (left.T @ (right / norm[:, None]))
    return node, pair


def train(sample: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-6, seed: int = 7) -> dict:
    """Fit a model on (language, words) pairs."""
    langs = sorted({lang for lang, ws in sample if ws})
    if not langs:
        return {"langs": [], "weights": np.zeros((TABLE, 0), np.float32), "trans": np.zeros((0, 0)), "lexicon": {}}
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    # lexicons: frequent words of which four fifths stand in one language
    by_lang = {x: Counter() for x in langs}
    for lang, ws in sample:
        by_lang[lang].update(w.lower() for w in ws)
    total = Counter()
    for c in by_lang.values():
        total.update(c)
    lexicon = {w: number[x] for x, c in by_lang.items() for w, n in c.most_common(500) if n >= 3 and 5 * n >= 4 * total[w]}
    # stretches of one to 48 words, in random order, so that languages alternate
    stretches = []
    for lang, ws in sample:
        i = 0
        while i < len(ws):
            n = int(rng.integers(1, 49))
            stretches.append((number[lang], ws[i : i + n]))
            i += n
    rng.shuffle(stretches)
    labels = np.array([y for y, ws in stretches for _ in ws])
    tokens = [w for _, ws in stretches for w in ws]
    pad = -len(tokens) % SPAN
    labels, tokens = np.append(labels, labels[:pad] if len(labels) >= pad else np.resize(labels, pad)), tokens + (tokens * (pad // len(tokens) + 1))[:pad]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    ids = np.array([vocab[w] for w in tokens])
    idx, feat = word_features(list(vocab), lexicon)
    k, n = len(langs), len(vocab)
    scale = 1 / np.sqrt(np.maximum(np.bincount(idx, minlength=n), 1))
    # every language has the same weight, whatever its share of the sample
    share = (len(labels) / k / np.maximum(np.bincount(labels, minlength=k), 1))[labels]
    weights, trans = np.zeros((TABLE, k)), np.where(np.eye(k, dtype=bool), 2.0, 0.0)
    gw, gt = np.full((TABLE, k), 1e-8), np.full((k, k), 1e-8)
    y = np.eye(k)[labels]
    seen = np.zeros((k, k))
    rows = labels.reshape(-1, SPAN)
    np.add.at(seen, (rows[:, :-1].ravel(), rows[:, 1:].ravel()), 1)
    for _ in range(rounds):
        emit = _emissions(n, idx, feat, weights)[ids].reshape(-1, SPAN, k)
        node, pair = _chain(emit, trans)
        miss = (y - node.reshape(-1, k)) * share[:, None]
        by_word = np.stack([np.bincount(ids, miss[:, j], n) for j in range(k)], 1) * scale[:, None]
        grad = np.stack([np.bincount(feat, by_word[idx, j], TABLE) for j in range(k)], 1) / len(labels) - decay * weights
        gw += grad**2
        weights += rate * grad / np.sqrt(gw)
        grad = (seen - pair) / len(labels)
        gt += grad**2
        trans += 0.1 * grad / np.sqrt(gt)
    return {"langs": langs, "weights": weights.astype(np.float32), "trans": trans, "lexicon": lexicon}


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label marginals of all words of texts whose words start at first[i]; exact for any length."""
    n, k = emit.shape
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros((n, k))
    block_first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(size)), size)
    within = np.arange(n) - first[text]
    row, col = block_first[text] + within // BLOCK, within % BLOCK
    psi = np.ones((BLOCK, total, k))
    psi[col, row] = np.exp(emit - emit.max(1, keepdims=True))
    live = np.zeros((BLOCK, total), bool)
    live[col, row] = True
    t = np.exp(trans - trans.max())
    move = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for i in range(BLOCK):
        on = live[i]
        step = (move[on] @ t) * psi[i, on][:, None, :]
        move[on] = step / step.sum((1, 2), keepdims=True)
    ahead, behind = np.empty((total, k)), np.empty((total, k))
    order = np.argsort(-blocks, kind="stable")
    a = np.full((len(size), k), 1 / k)
    b = np.full((len(size), k), 1 / k)
    most = int(blocks.max())
    for i in range(most):
        who = order[: np.searchsorted(-blocks[order], -i, "left")]  # texts with more than i blocks
        at = block_first[who] + i
        ahead[at] = a[who]
        x = np.einsum("ni,nij->nj", a[who], move[at])
        a[who] = x / x.sum(1, keepdims=True)
        at = block_first[who] + blocks[who] - 1 - i
        behind[at] = b[who]
        x = np.einsum("nij,nj->ni", move[at], b[who])
        b[who] = x / x.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, total, k))
    x = ahead
    for i in range(BLOCK):
        y = (x @ t) * psi[i]
        x = np.where(live[i][:, None], y / y.sum(1, keepdims=True), x)
        alpha[i] = x
    x = behind
    for i in reversed(range(BLOCK)):
        alpha[i] *= x
        y = (x * psi[i]) @ t.T
        x = np.where(live[i][:, None], y / y.sum(1, keepdims=True), x)
    out = alpha[col, row]
    return out / out.sum(1, keepdims=True)


class Tagger:
    """A model with a bounded cache of the words' emission scores."""

    def __init__(self, model: dict):
        self.model, self.k = model, len(model["langs"])
        self._reset()

    def _reset(self) -> None:
        self.keys, self.emit, self.letters = np.zeros(0, U64), np.zeros((0, self.k)), np.zeros(0)

    def look_up(self, keys: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and letters of distinct sorted keys; text_of gives the words of new ones."""
        if len(self.keys) > CACHE:
            self._reset()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            fresh = text_of(new)
            emit = _emissions(len(new), *word_features(fresh, self.model["lexicon"]), self.model["weights"])
            letters = np.array([sum(map(str.isalpha, w)) for w in fresh], float)
            put = np.searchsorted(self.keys, keys[new])
            self.keys, self.emit, self.letters = np.insert(self.keys, put, keys[new]), np.insert(self.emit, put, emit, 0), np.insert(self.letters, put, letters)
            at = np.searchsorted(self.keys, keys)
        return self.emit[at], self.letters[at]

    def texts(self, column) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(best label or -1, its share of the letters) of every text, and its spans: number of them by text,
        first words, ends, labels, mean probabilities."""
        h, first, data, s, e = hash_words(column, spans=True)
        best, score = np.full(len(column), -1), np.zeros(len(column))
        spans = [np.zeros(len(column), np.int64), [], [], [], []]
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE, "right")) - 1)
            lo, hi = first[a], first[b]
            keys, one, back = np.unique(h[lo:hi], return_index=True, return_inverse=True)
            word = lambda new, one=one, lo=lo: [bytes(data[s[lo + one[i]] : e[lo + one[i]]]).decode("utf-8", "replace") for i in new]
            emit, letters = self.look_up(keys, word)
            own = first[a : b + 1] - lo
            node = marginals(emit[back], own, self.model["trans"])
            text = np.repeat(np.arange(b - a), np.diff(own))
            label = node.argmax(1)
            weight = letters[back]
            votes = np.stack([np.bincount(text, node[:, j] * weight, b - a) for j in range(self.k)], 1)
            total = votes.sum(1)
            has = total > 0
            best[a:b][has] = votes[has].argmax(1)
            score[a:b][has] = votes[has].max(1) / total[has]
            if len(label):
                heads = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])]))
                size = np.diff(np.append(heads, len(label)))
                sure = np.add.reduceat(node.max(1), heads) / size
                ok = has[text[heads]]
                spans[0][a:b] = np.bincount(text[heads[ok]], minlength=b - a)
                for k, x in enumerate((heads - own[text[heads]], heads - own[text[heads]] + size, label[heads], sure), 1):
                    spans[k].append(x[ok])
            a = b
        return best, np.minimum(score, 1.0), [spans[0], *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in spans[1:])]


SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())])


def _predict(model: dict):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        names = np.array([*model["langs"], UND], object)
        for batch in batches:
            n = batch.num_rows
            best, score, (count, start, end, label, sure) = tagger.texts(batch.column(1)) if model["langs"] else (np.full(n, -1), np.zeros(n), [np.zeros(n, np.int64)] + [np.zeros(0, np.int64)] * 4)
            runs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names[label.astype(np.int64)], pa.string()), pa.array(sure, pa.float64())], fields=list(SPAN_TYPE))
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), spans], ["id", "lang_pred", "score", "spans"])

    return predict


def sample(labelled: DataFrame, per_lang: int = 250, per_doc: int = 200, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[str]]]:
    """The per_lang distinct texts of each language with the least hashes, and of each at most per_doc
    consecutive words from a hashed place.

    Counts bound the hashes first, so that a few times per_lang hashes a language are ranked, whatever the
    corpus size; then the hash of the last one that counts picks the texts where they are read, and copies
    are one before they are dealt. Languages are few: the model has a column of weights for each.
    """
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"), F.col(f"`{text_col}`").alias("t"))
    known = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not known:
        return []
    spark = labelled.sparkSession
    limits = spark.createDataFrame([(r[0], min((4 * per_lang << 64) // max(r[1], 1) - 2**63, 2**63 - 1)) for r in known], "lang string, most long")
    few = rows.select("lang", "h").join(F.broadcast(limits), "lang").where("h <= most").select("lang", "h").distinct()
    ranked = few.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rn") <= per_lang)
    last = spark.createDataFrame([tuple(r) for r in ranked.groupBy("lang").agg(F.max("h")).collect()], "lang string, last long")
    top = rows.join(F.broadcast(last), "lang").where("h <= last")
    w = words(F.col("t"))
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size(w) - (per_doc - 1))) + 1
    cut = top.groupBy("lang", "h").agg(F.first(F.slice(w, start.cast("int"), per_doc)).alias("w"))
    return sorted((r[0], r[2]) for r in cut.select("lang", "h", "w").collect())


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, lang_pred, score, spans). spans are the stretches of words with one label:
    first word, end (exclusive), language, mean probability; a text that is ``und`` has none."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(_predict(model), "id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string,probability:double>>")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    model = train(sample(docs.where(~held("doc_id"))))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "lang_pred", "score")
