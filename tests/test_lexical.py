"""Stems, the lexical index, pruned search and rank fusion, against plain Python on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import stemming, text
from lodestrata.operators import fusion, lexical
from lodestrata.plans.engine import Engine
from lodestrata.sources.providers import hash_embedder
from lodestrata.sources.store import ChunkStore


def fold(w):
    return w.translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO))


@pytest.mark.parametrize(
    "word, expected",
    [
        ("çocuğum", "çocuk"), ("çocuğu", "çocuk"), ("hekimi", "hek"), ("uzmanı", "uzma"), ("deneyim", "de"), ("deniz", "de"), ("damla", "da"), ("data", "da"), ("akın", "ak"),
        ("evlerindeki", "ev"), ("kitaplarımızdan", "kitap"), ("babasının", "baba"), ("ağacın", "ağaç"), ("şehirde", "şehir"), ("arkadaşlarımla", "arkadaş"), ("yapmıştı", "yapmış"), ("kalemler", "kalem"),
        ("iş", "iş"), ("ön", "ön"), ("soyad", "soyad"), ("david", "davidi"), ("uzmani", "uzmani"), ("", ""), ("g4", "g4"), ("xyz", "xyz"),
    ],
)
def test_stems(word, expected):
    assert stemming.stem(word) == expected


def tokens(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.tokens for r in stemming.search_tokens(rows, "t").orderBy("i").collect()]


def test_tokens_of_questions(spark):
    """Content words stay apart from function words with the same stem; function words and question suffixes go."""
    words = ["deneyim", "damla", "deniz", "iş", "ön", "data"]
    for word, got in zip(words, tokens(spark, *words)):
        assert got == [fold(word)]
    assert all(not t for t in tokens(spark, "ve", "bu", "için", "de", "da", "ne", "nedir", "nelerdir", "mıdır", "içindeki", "", None))
    got = tokens(spark, "Damla Akın hangi şehirde hizmet veriyor?", "KBB muayenesi ve deneyim", "G4.1 dilbilgisinde VT kümesinin elemanları nelerdir?", "dişçisi arıyorum", "disci", "goz DOKTORUNA iyi", "İstanbul Çocuğum")
    assert "damla" in got[0] and got[1][-1] == "deneyim" and got[1][:3] == ["kulak", "bur", "bogaz"] and "g4.1" in got[2]
    assert got[3] == got[4] == ["dis", "hek"] and got[5] == ["goz", "hek"] and got[6] == ["istanbul", "cocuk"]


def score_by_hand(chunks, queries):
    n = len(chunks)
    df = Counter(t for ts in chunks.values() for t in set(ts))
    avgdl = sum(map(len, chunks.values())) / n
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = {}
    for q, qt in queries.items():
        for c, ts in chunks.items():
            tf = Counter(ts)
            if any(t in tf for t in qt):
                out[q, c] = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avgdl)) for t in qt if t in tf)
    return out


def corpus(seed, n, vocabulary, length):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return {i * 7 - 50: rng.choices(words, weights, k=rng.randrange(0, length)) for i in range(n)}, rng, words, weights


def ranked(scores, k):
    out = {}
    for (q, c), s in scores.items():
        out.setdefault(q, []).append((-round(s, 9), c))
    return {q: [(c, round(-s, 6)) for s, c in sorted(v)[:k]] for q, v in out.items()}


@pytest.mark.parametrize(("seed", "n", "vocabulary", "direct"), [(1, 400, 300, 0), (1, 400, 300, 10**9), (2, 60, 8, 0), (3, 5, 3, 0)])
def test_pruned_search(spark, monkeypatch, seed, n, vocabulary, direct):
    monkeypatch.setattr(lexical, "DIRECT", direct)
    chunks, rng, words, weights = corpus(seed, n, vocabulary, 60)
    some = [c for c in chunks.values() if len(c) > 3]
    queries = {q: rng.choice(some)[: rng.randrange(1, 12)] + rng.choices(words, weights, k=3) for q in range(12)} | {90: ["unknown"], 91: [], 92: ["w0"], 93: ["w0", "w0", "w1"]}
    table = spark.createDataFrame(list(chunks.items()), "chunk_id long, tokens array<string>")
    asked = spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>")
    expected = score_by_hand(chunks, queries)
    index = lexical.index_of(table)
    full = {(r.qid, r.chunk_id): r.score for r in lexical.scores(index, asked).collect()}
    assert full == pytest.approx(expected, abs=1e-9)
    found = lexical.top(index, asked, 5)
    got = {}
    for r in found.top.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, round(r.score, 6)))
    assert got == ranked(expected, 5)
    work = found.work.agg(F.sum("all").alias("a"), F.sum("scored").alias("s")).first()
    assert work.s <= 2 * work.a


def test_few_postings_are_scored(spark, monkeypatch):
    """Passages that stand in a corpus with frequent words: less than a fifth of the postings is scored."""
    monkeypatch.setattr(lexical, "DIRECT", 0)
    chunks, rng, words, weights = corpus(4, 3000, 4000, 120)
    some = [c for c in chunks.values() if len(c) > 60]
    queries = {q: rng.choice(some)[10:50] for q in range(20)}
    index = lexical.index_of(spark.createDataFrame(list(chunks.items()), "chunk_id long, tokens array<string>"))
    found = lexical.top(index, spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>"), 1)
    got = {r.qid: (r.chunk_id, round(r.score, 6)) for r in found.top.collect()}
    assert got == {q: v[0] for q, v in ranked(score_by_hand(chunks, queries), 1).items()}
    work = found.work.agg((F.sum("scored") / F.sum("all")).alias("share")).first()
    assert work.share < 0.2


@pytest.mark.parametrize("direct", [0, 10**9])
def test_scopes(spark, monkeypatch, direct):
    monkeypatch.setattr(lexical, "DIRECT", direct)
    chunks, rng, words, weights = corpus(5, 120, 40, 30)
    rows = [(f"s{c % 3}", c, t) for c, t in chunks.items()]
    queries = {q: rng.choices(words, weights, k=5) for q in range(4)}
    index = lexical.index_of(spark.createDataFrame(rows, "lang string, chunk_id long, tokens array<string>"), ["lang"])
    asked = spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>")
    got = {}
    for r in lexical.top(index, asked, 3).top.orderBy("rank").collect():
        got.setdefault((r.lang, r.qid), []).append((r.chunk_id, round(r.score, 6)))
    for lang in ("s0", "s1", "s2"):
        own = ranked(score_by_hand({c: t for s, c, t in rows if s == lang}, queries), 3)
        assert {q: v for (s, q), v in got.items() if s == lang} == own


def test_index_of_nothing(spark):
    index = lexical.index_of(spark.createDataFrame([], "chunk_id long, tokens array<string>"))
    asked = spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>")
    assert lexical.top(index, asked, 3).top.count() == 0 and lexical.scores(index, asked).count() == 0


def test_kept_index_follows_the_store(spark, tmp_path):
    """A changed source replaces its part only; scores equal those of an index made anew."""
    store, kept = ChunkStore(spark, str(tmp_path / "s")), lexical.LexicalStore(spark, str(tmp_path / "i"))
    schema = "source string, seq int, content string, page_info string"
    put = lambda *rows: store.upsert(spark.createDataFrame([(s, i, t, "p") for s, i, t in rows], schema))
    put(("data/a=1.txt", 0, "uçaklar ve gemiler"), ("data/a=1.txt", 1, ""), ("data/b.txt", 0, "elmalar armutlar elma"), ("data/c.txt", 0, "kitaplar, defterler ve gemi"))
    asked = stemming.search_tokens(spark.createDataFrame([(1, "gemi ve elma"), (2, "kitapları")], "qid long, question string"), "question")

    def same():
        chunks = store.read().select("chunk_id", stemming.surface_tokens(F.col("content")).alias("tokens"))
        got, made = kept.open(), lexical.index_of(chunks, stem=True)
        for a, b in ((lexical.scores(got, asked), lexical.scores(made, asked)), (lexical.top(got, asked, 2).top, lexical.top(made, asked, 2).top), (got.terms, made.terms), (got.sizes, made.sizes)):
            assert sorted(a.select(*b.columns).collect()) == sorted(b.collect())

    assert kept.refresh(store) == ["data/a=1.txt", "data/b.txt", "data/c.txt"]
    same()
    assert kept.refresh(store) == []
    files = lambda: {p for p in (tmp_path / "i").rglob("*.parquet")}
    before = files()
    put(("data/b.txt", 0, "erikler"), ("data/b.txt", 1, "gemiler gemi"))
    assert kept.refresh(store) == ["data/b.txt"]
    same()
    assert {p.parent.name for p in before ^ files()} == {"source=data%2Fb.txt"}
    store.delete("data/c.txt")
    assert kept.refresh(store) == ["data/c.txt"]
    same()
    own = lexical.scores(kept.open(["data/b.txt"]), asked).collect()
    chunks = store.read().where("source = 'data/b.txt'").select("chunk_id", stemming.surface_tokens(F.col("content")).alias("tokens"))
    assert sorted(own) == sorted(lexical.scores(lexical.index_of(chunks, stem=True), asked).collect())
    by_source = lexical.scores(kept.open(scoped=True), asked).where("source = 'data/b.txt'")
    assert sorted(by_source.select("qid", "chunk_id", "score").collect()) == sorted(own)
    assert kept.open([]).sizes.where("n > 0").count() == 0


def test_half_written_source_is_not_read(spark, tmp_path):
    kept = lexical.LexicalStore(spark, str(tmp_path / "i"))
    kept.update(spark.createDataFrame([("a", 1, ["x"]), ("b", 2, ["y"])], "source string, chunk_id long, tokens array<string>"))
    lexical.remove_path(spark, f"{kept.path}/sizes/source=a")
    assert [r.token for r in kept.open().postings.collect()] == ["y"] and kept.open().sizes.first().n == 1


def fused_by_hand(chunks, questions, words, cover, k):
    out = {}
    for q in questions:
        norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        dense = {c: round(sum(a * b for a, b in zip(q.vector, e)) / norm(q.vector) / norm(e), 9) for c, e, _, _ in chunks if e is not None}
        lex = {c: s for (i, c), s in words.items() if i == q.qid and s > 0}
        dr = {c: i for i, c in enumerate(sorted(dense, key=lambda c: (-dense[c], c)))}
        br = {c: i for i, c in enumerate(sorted(lex, key=lambda c: (-lex[c], c)))}
        peak = max(lex.values(), default=0)
        rows = []
        for c, _, s, m in chunks:
            if c in dr or c in br:
                rrf = round(((1 / (60 + dr[c]) if c in dr else 0) + (1 / (60 + br[c]) if c in br else 0)) / (2 / 60), 12)
                boost = (0.08 * lex[c] / peak * cover[q.qid, c] if c in lex and cover else 0) + (0.35 if q.meta and m else 0) + (0.5 if q.hint and s and q.hint in s else 0)
                rows.append((-round(rrf + boost, 9), c, dr.get(c), br.get(c)))
        out[q.qid] = [(c, d, b, round(-s, 6)) for s, c, d, b in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("boosts", [False, True])
def test_fusion_by_counting(spark, boosts):
    rng = random.Random(6)
    chunks = []
    for c in range(900):
        e = [rng.choice([-1.0, 0.0, 1.0, rng.uniform(-1, 1)]) for _ in range(4)] if c % 9 else None
        chunks.append((c * 3 - 200, e, [f"data/s{c % 5}.json", None][c % 11 == 0], c % 40 == 0))
    chunks[50] = (chunks[50][0], [0.0] * 4, chunks[50][2], False)
    questions = [fusion.Question(q, [rng.uniform(-1, 1) for _ in range(4)], boosts and q % 2 == 0, "s3" if boosts and q % 3 == 0 else None) for q in range(7)] + [fusion.Question(99, [0.0] * 4)]
    words = {(q.qid, c): round(rng.choice([0.5, rng.uniform(-0.2, 3)]), 9) for q in questions[:-2] for c, *_ in chunks if rng.random() < 0.4}
    cover = {(q.qid, c): (c % 4) / 3 for q in questions for c, *_ in chunks}
    coverage = (lambda rows: rows.withColumn("coverage", (F.pmod("chunk_id", F.lit(4)) / 3))) if boosts else None
    table = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>, source string, meta boolean").repartition(5)
    rounded = [(c, [float(x) for x in e] if e else None, s, m) for c, e, s, m in (tuple(r) for r in table.collect())]
    lexical_scores = spark.createDataFrame([(q, c, s) for (q, c), s in words.items()], "qid long, chunk_id long, score double").repartition(3)
    found = fusion.fuse(table, lexical_scores, questions, 6, coverage).collect()
    assert len(found) < 0.6 * len(questions) * len(chunks)
    expected = fused_by_hand(rounded, questions, words, cover if boosts else None, 6)
    for q in questions:
        best = sorted((r for r in found if r.qid == q.qid), key=lambda r: (-r.score, r.chunk_id))[:6]
        assert [(r.chunk_id, r.dense_rank, r.bm25_rank, round(r.score, 6)) for r in best] == expected[q.qid]


def test_fusion_lengthens_its_lists(spark):
    """A group of which most chunks are far behind in both ranks still gives its best ones."""
    chunks = [(c, [1.0, c / 5000], "hinted" if c >= 700 else "x", False) for c in range(800)]
    questions = [fusion.Question(1, [1.0, 0.0], False, "hinted")]
    got = fusion.fuse(spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, source string, meta boolean"), spark.createDataFrame([], "qid long, chunk_id long, score double"), questions, 90)
    best = [r.chunk_id for r in got.orderBy(F.desc("score"), "chunk_id").limit(90).collect()]
    assert best == list(range(700, 790))


def test_engine_ranks_by_stems(spark, tmp_path):
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "s")), hash_embedder(8))
    rows = [("data/a.txt", 0, "çocuklar için bir uzman", "p"), ("data/b.txt", 0, "uçaklar ve gemide", "p"), ("data/c.txt", 0, "masalar", "p"), ("data/d.txt", 0, "kalemler", "p")]
    engine.store.upsert(spark.createDataFrame(rows, "source string, seq int, content string, page_info string"))
    q = spark.createDataFrame([(1, "çocuğum"), (2, "gemide nerede")], "qid long, question string")
    assert {r.qid: r.source for r in engine.retrieve(q).where("rank = 1").collect()} == {1: "data/a.txt", 2: "data/b.txt"}
    engine.store.upsert(spark.createDataFrame([("data/b.txt", 0, "trenler", "p"), ("data/e.txt", 0, "gemide", "p")], "source string, seq int, content string, page_info string"))
    assert engine.retrieve(q).where("qid = 2 and rank = 1").first().source == "data/e.txt"
    assert engine.retrieve(q.limit(0)).count() == 0


def test_stem_counts_by_hand(spark):
    """The query over whole documents, against a walk over each text."""
    import re

    import pyarrow.parquet as pq

    from lodestrata.catalogue import stem_counts

    stop = {fold(w) for w in text.STOPWORDS}
    rules = [("goz doktoru", "göz hekimi"), ("cocuk doktoru", "çocuk sağlığı uzmanı"), ("disci", "diş hekimi"), ("kbb", "kulak burun boğaz"), ("cildiye", "dermatoloji")]
    counts, holders = Counter(), Counter()
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        low = (t or "").replace("İ", "i").replace("I", "ı").lower()
        words = [w for w in re.findall(r"\w+", low) + re.findall(r"[^\W\d_]+\d+(?:\.\d+)+", low) if fold(w) not in stop]
        forms, i = [], 0
        while i < len(words):
            for key, canonical in rules:
                k = key.split()
                window = [fold(w) for w in words[i : i + len(k)]]
                if len(window) == len(k) and window[:-1] == k[:-1] and window[-1].startswith(k[-1]):
                    forms += [fold(stemming.stem(w)) for w in canonical.split()]
                    i += len(k)
                    break
            else:
                s = fold(stemming.stem(words[i]))
                forms.append(fold(words[i]) if s in stemming.STOP_STEMS else s)
                i += 1
        counts.update(forms)
        holders.update(set(forms))
    got = {r.form: (r.n, r.n_documents) for r in stem_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {f: (n, holders[f]) for f, n in counts.items()}


def test_many_tokens_have_a_mean(spark):
    """Weights of a million rare tokens in a large corpus, whose sum in units exceeds a long."""
    n = 1_000_000
    terms = spark.range(n).select(F.concat(F.lit("w"), "id").alias("token"), F.lit(1).cast("long").alias("df"))
    terms = terms.unionByName(spark.createDataFrame([("often", 900_000)], "token string, df long"))
    sizes = spark.createDataFrame([(n, 10 * n)], "n long, total long")
    got = {r.token: r.idf for r in lexical.Index(None, terms, None, sizes).weights(spark.createDataFrame([("w7",), ("often",)], "token string")).collect()}
    rare, often = (math.log(n - d + 0.5) - math.log(d + 0.5) for d in (1, 900_000))
    assert got == pytest.approx({"w7": rare, "often": 0.25 * (n * rare + often) / (n + 1)})


def test_tokens_are_counted_a_few_at_a_time(monkeypatch):
    """What a task counts at once is bounded by tokens, not by rows; the rows are those of one pass."""
    chunks = {1: ["a", "b", "a"], 2: [], 3: None, 4: ["b"] * 9, 5: ["c", "a"], 6: ["d"]}
    batch = lexical.pa.RecordBatch.from_arrays([lexical.pa.array(list(chunks)), lexical.pa.array(list(chunks.values()))], ["chunk_id", "tokens"])
    rows = lambda batches: sorted(str(r) for b in batches for r in b.drop_columns(["first"]).to_pylist())
    whole = rows(lexical._count_tokens(0)(iter([batch])))
    monkeypatch.setattr(lexical, "COUNTED", 3)
    parts = list(lexical._count_tokens(0)(iter([batch])))
    assert len(parts) == 3 and rows(parts) == whole
    assert sorted(r["chunk_id"] for b in parts for r in b.to_pylist() if r["first"]) == list(chunks)


@pytest.mark.parametrize(("pays", "scope"), [(0.0, False), (10.0**9, False), (0.0, True), (10.0**9, True)])
def test_search_that_pruning_does_not_help(spark, monkeypatch, pays, scope):
    """Above DIRECT too, all postings are scored if pruning would score or look up many of them; results are the same."""
    monkeypatch.setattr(lexical, "DIRECT", 0)
    monkeypatch.setattr(lexical, "PAYS", pays)
    monkeypatch.setattr(lexical, "SENT", 3 if scope else lexical.SENT)
    chunks, rng, words, weights = corpus(7, 300, 200, 60)
    rows = [(f"s{c % 3}" if scope else "s0", c, t) for c, t in chunks.items()]
    queries = {q: rng.choice([t for t in chunks.values() if len(t) > 9])[:9] for q in range(6)}
    index = lexical.index_of(spark.createDataFrame(rows, "lang string, chunk_id long, tokens array<string>"), ["lang"])
    found = lexical.top(index, spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>"), 3)
    got = {}
    for r in found.top.orderBy("rank").collect():
        got.setdefault((r.lang, r.qid), []).append((r.chunk_id, round(r.score, 6)))
    for lang in {s for s, _, _ in rows}:
        own = ranked(score_by_hand({c: t for s, c, t in rows if s == lang}, queries), 3)
        assert {q: v for (s, q), v in got.items() if s == lang} == own
    work = found.work.agg(F.sum("all").alias("a"), F.sum("scored").alias("s")).first()
    assert work.s == work.a if pays == 0 else work.s != work.a


def test_kept_index_holds_no_second_copy(spark, tmp_path, monkeypatch):
    """An update writes each posting once and keeps no bounds; a source that loses its tokens loses their counts."""
    kept = lexical.LexicalStore(spark, str(tmp_path / "i"), stem=False)
    copies = []
    real = lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name: copies.append(name) or real(df, name))
    put = lambda *rows: kept.update(spark.createDataFrame(list(rows), "source string, chunk_id long, tokens array<string>"))
    put(("a", 1, ["x", "y", "x"]), ("a", 2, None), ("b", 3, ["y"]))
    assert copies == [] and {p.name for p in (tmp_path / "i").iterdir()} == {"postings", "terms", "sizes"}
    index = kept.open(scoped=True)
    assert sorted(map(tuple, index.sizes.select("source", "n", "total").collect())) == [("a", 2, 3), ("b", 1, 1)]
    assert sorted(map(tuple, index.postings.select("chunk_id", "token", "tf", "dl").collect())) == [(1, "x", 2, 3), (1, "y", 1, 3), (3, "y", 1, 1)]
    put(("b", 4, []))
    assert sorted(map(tuple, kept.open().terms.collect())) == [("x", 1), ("y", 1)]
    assert sorted(map(tuple, kept.open(scoped=True).sizes.select("source", "n", "total").collect())) == [("a", 2, 3), ("b", 1, 0)]
