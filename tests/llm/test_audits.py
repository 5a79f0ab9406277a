"""Source divergence, decontamination and filter audit against brute force, on small tables with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, divergence, filter_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD12 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
# columns whose names clash with those that the operators make
SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, term string, digest string, bits string, part string, item string, t string, __row string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    vocab = [f"{c}{d}" for c in "abcdefgh" for d in ("a", "É", "ş", "本", "zz", "Q")] + ["x1y", "#", "%"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    texts = [None, "", " \t\n", "1 2 3", "A", "one", say(1500), "UPPER CASE " * 120]
    texts += [say(int(rng.integers(1, 300))) for _ in range(60)]
    texts += [texts[10]] * 3 + ["same text"] * 40 + [texts[9] + ".", say(3) * 200]
    out = []
    for k, t in enumerate(texts):
        ident = None if k in (20, 70) else (k if k != 30 else 29)
        out.append((ident, t, [None, "en", "de", "en"][k % 4], None if k % 7 == 0 else ["", "s1", "s2", "ß"][k % 4 if k < 90 else 1], 1, 2, "x", "y", "z", "q", "r", "s", "u"))
    out += [(500, "alone in its language", "xx", "s", 1, 2, "x", "y", "z", "q", "r", "s", "u"), (501, "quite alone", "xx", "t", 1, 2, "x", "y", "z", "q", "r", "s", "u")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def divergence_by_hand(rows, min_docs):
    texts = [(r[2] or "", r[3] or "", TERM.findall(lower(r[1]))) for r in rows]
    out = set()
    for lang in {x[0] for x in texts}:
        own = [(s, t) for g, s, t in texts if g == lang]
        df = Counter(w for _, t in own for w in set(t))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for s, t in own:
            counts[s].update(w for w in t if df[w] >= min_docs)
        counts[None] = sum((c for c in list(counts.values())), Counter())
        p = {}
        for s, c in counts.items():
            total = sum(c.values()) + 2 * len(kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        sources = [s for s in counts if s is not None]
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], p[None][w]), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, found, cut in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:cut]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("min_docs", [1, 4, 10])
def test_divergence(docs, rows, none, monkeypatch, min_docs):
    monkeypatch.setattr(divergence, "PIECE", 1 << 10)
    got = divergence.source_divergence(docs, min_docs)
    assert {tuple(r) for r in got.collect()} == divergence_by_hand(rows, min_docs)
    assert got.columns == divergence.source_divergence(none).columns


@pytest.mark.parametrize("min_docs", [1, 2])
def test_more_terms_than_a_worker_holds(docs, rows, monkeypatch, min_docs):
    """Terms are dealt to their blocks instead of searching every text for each block."""
    for name, value in (("BLOCK_TERMS", 3), ("CACHED", 0), ("HELD_COUNTS", 10), ("PIECE", 1 << 10)):
        monkeypatch.setattr(divergence, name, value)
    dealt = divergence._by_block
    asked = []
    monkeypatch.setattr(divergence, "_by_block", lambda *a: asked.append(1) or dealt(*a))
    assert {tuple(r) for r in divergence.source_divergence(docs, min_docs).collect()} == divergence_by_hand(rows, min_docs)
    assert asked


def test_divergence_of_nothing(none):
    assert divergence.source_divergence(none).count() == 0


def test_vocabulary_in_blocks(docs, rows, monkeypatch):
    """A vocabulary of several automata, few of which are held, and counts that are handed on early."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    assert {tuple(r) for r in divergence.source_divergence(docs, 2).collect()} == divergence_by_hand(rows, 2)


def test_shares_are_exact(spark):
    n, total = 3 * 10**14 + 7, 9 * 10**15 + 1
    got = spark.createDataFrame([(n, total)], "n long, total long").select(divergence.share("n", "total")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // total


ITEMS = "item_id long, text string, words string, item string"


def hits_by_hand(texts, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD12.findall(lower(t))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[k : k + width])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w = WORD12.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                who = windows.get(tuple(w[k : k + n]))
                if who:
                    found |= who
                    hit[k : k + n] = [True] * n
        out.append((len(w), sum(hit), ",".join(sorted(found, key=str.encode)), hit))
    return out


def contaminated(rows):
    rng = np.random.default_rng(3)
    items = [(None, "null id has eleven words in all, as everybody can count now"), (1, None), (2, ""), (3, "!?"), (4, "UPPER case"), (4, "and again, the same item"), (5, rows[6][1][:400]), (50, "A1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"), (6, "ça où là"), (7, "c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13"), (8, "upper CASE")]
    more = [t for _, t in items if t] + ["a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13", "x a1 b2 c3 d4 e5 f6 g7 h8 i9 j10", "a1 b2 c3 d4 e5 f6 g7 h8 i9", "ÇA où là", "ça OÙ là ça où là", "upper\x00case"]
    made = [(600 + i, f"{' '.join(map(str, rng.integers(0, 9, 5)))} {t} -- {t[:30]} end") for i, t in enumerate(more * 3)]
    return items, made


@pytest.mark.parametrize("shard", [1 << 19, 64])
def test_decontamination(spark, rows, docs, none, monkeypatch, tmp_path, shard):
    items, made = contaminated(rows)
    phrases = decontamination.write_windows(spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS))
    texts = [r[1] for r in rows] + [t for _, t in made]
    expected = hits_by_hand(texts, items)
    if shard == 64:  # in this process, so that the limits hold: long texts in overlapping parts, rows and windows in blocks
        monkeypatch.setattr(decontamination, "SHARD", 64)
        monkeypatch.setattr(decontamination, "ROWS", 5)
        import pyarrow as pa

        out = next(iter(decontamination._hits(phrases, True)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])]))))
        got = [(n, k, ",".join(i), [(s["start"], s["end"]) for s in spans], kept) for n, k, i, kept, spans in zip(*(c.to_pylist() for c in out.columns))]
    else:
        table = docs.select("doc_id", "text", "t", "__row").unionByName(spark.createDataFrame([(*r, "s", "u") for r in made], "doc_id long, text string, t string, __row string"))
        found = decontamination.decontaminate(table, phrases).collect()
        by_text = {r["__row"]["text"]: (r.n_words, r.n_hit, ",".join(r["items"]), [(s.start, s.end) for s in r.spans], r.kept_text) for r in found}
        assert len(found) == len(texts) and {r["__row"]["__row"] for r in found} == {"u"}
        got = [by_text[t] for t in texts]
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert any(e[1] for e in expected[:len(rows)]) and sum(e[1] > 0 for e in expected) > 20
    for text, (_, _, _, spans, kept), (_, _, _, hit) in zip(texts, got, expected):
        covered = [False] * len(hit)
        for a, b in spans:
            covered[a:b] = [True] * (b - a)
        assert covered == hit and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert WORD12.findall(lower(kept)) == [w for w, h in zip(WORD12.findall(lower(text)), hit) if not h] or any(hit)
        if not any(hit):
            assert kept == (text or "")
    assert decontamination.decontaminate(none, phrases).count() == 0


def test_nothing_to_find(spark, docs):
    phrases = decontamination.write_windows(spark.createDataFrame([], ITEMS))
    assert decontamination.decontaminate(docs, phrases, columns=["doc_id"], texts=False).where("n_hit > 0").count() == 0


def test_spans_of_kept_text(spark):
    phrases = decontamination.write_windows(spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    got = decontamination.decontaminate(spark.createDataFrame([("Aé, (B-c) d. B C b c!",)], "text string"), phrases).first()
    assert got.kept_text == "Aé, () d. !" and [tuple(s) for s in got.spans] == [(1, 3), (4, 8)]


@pytest.mark.parametrize(("n", "vocabulary", "seed"), [(0, 1, 0), (1, 1, 1), (300, 2, 2), (2000, 3, 3), (3000, 500, 4)])
def test_fm_index(n, vocabulary, seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(1, vocabulary + 1, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C13)
    first = np.unique(np.concatenate([[0], rng.integers(0, n + 1, 8), [n]])) if n else np.array([0, 0])
    words[n // 2 : n // 2 + n // 4] = words[: n // 4]  # a long repeat
    symbols = np.zeros(0, np.uint32)
    for a, b in zip(first[:-1], first[1:]):
        symbols = np.concatenate([symbols, np.unique(words, return_inverse=True)[1][a:b] + 1, [0]])
    ends = np.cumsum(symbols == 0)
    key = [(int(s), int(e) if s == 0 else 0) for s, e in zip(symbols, ends)]
    assert decontamination.suffix_array(symbols.astype(np.uint32)).tolist() == sorted(range(len(key)), key=lambda i: key[i:])
    index = decontamination.FMIndex(words, first)
    windows, lengths = np.zeros((40, 6), np.uint64), rng.integers(1, 7, 40)
    for i in range(40):
        at = int(rng.integers(0, max(1, n - 6)))
        taken = words[at : at + lengths[i]] if i % 4 else rng.integers(1, 9, lengths[i]).astype(np.uint64)
        lengths[i] = max(1, len(taken))
        windows[i, 6 - lengths[i] :] = taken if len(taken) else np.uint64(5)
    who, lo, hi = index.search(windows, lengths)
    got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(who, lo, hi)}
    for i in range(40):
        there = [int(first[t] + t + k) for t in range(len(first) - 1) for k in range(first[t + 1] - first[t] - lengths[i] + 1) if (words[first[t] + k : first[t] + k + lengths[i]] == windows[i, 6 - lengths[i] :]).all()]
        assert got.get(i, []) == sorted(there)


def audit_by_hand(rows, labels):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in range(2))
    facts = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and t in least and least[t] < r[0]}
        facts.append((r[3] or "", {k for k, v in fails.items() if v}, r[0] in good, r[0] in toxic))
    out = set()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        got, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for i, k in enumerate(order):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                shapley[k] += len(gone)
                failing = sum(k in f[1] for f in own)
                got.append((part, "".join(order), i + 1, len(left), len(gone), failing - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), k))
        out |= {(*g[:-1], shapley[g[-1]]) for g in got}
    return out


LABELS = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 120, 2)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, 1), (9, 1, None), (9999, 1, 1)]


@pytest.mark.parametrize(("block", "heavy"), [(1 << 16, 4096), (17, 4)])
def test_filter_audit(spark, docs, rows, none, monkeypatch, block, heavy):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    monkeypatch.setattr(filter_audit, "HEAVY", heavy)
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, digest string")
    run = lambda d, m: filter_audit.audit(d, m, filter_audit.standard_filters(F.col("text")), "E")
    got = [tuple(r) for r in run(docs, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, LABELS)
    assert run(none, labels).count() == 0
    assert {tuple(r) for r in run(docs, labels.limit(0)).collect()} == audit_by_hand(rows, [])


def test_bitsets_of_many_parts():
    """Parts in blocks fill whole words, and counts are handed on before they grow."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    part, bits = rng.integers(0, 5000, 20000), rng.integers(0, 16, 20000)
    total = Counter()
    for b in filter_audit._count(2)(pa.RecordBatch.from_arrays([pa.array(map(str, part[i : i + 3000])), pa.array(bits[i : i + 3000].astype(np.int32))], ["part", "bits"]) for i in range(0, 20000, 3000)):
        for name, prefix, k, *n in zip(*(c.to_pylist() for c in b.columns)):
            for what, x in zip(filter_audit.COUNTS, n):
                total[name, prefix, k, what] += x
    for name in map(str, range(0, 5000, 250)):
        own = bits[part == int(name)]
        for prefix, k in ((0, 0), (0, 1), (1, 1), (2, 0)):
            left = own[(own & prefix) == 0]
            gone = left[(left >> k & 1) == 1]
            assert [total[name, prefix, k, c] for c in filter_audit.COUNTS] == [len(left), len(gone), (gone >> 2 & 1).sum(), (gone >> 3 & 1).sum()]


def test_digest_of_no_items(spark):
    assert decontamination.op12_decontamination(spark, "/root/testdata/sf0.001").where("n_items = 0").first().items_sha256 == hashlib.sha256(b"").hexdigest()
