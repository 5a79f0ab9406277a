import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import aggregates, chunking, evaluation, search, spans
from lodestrata.plans import algebra, routing, rules
from lodestrata.plans.engine import Engine
from lodestrata.sources import json_tree, readers
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.providers import hash_embedder, overlap_scorer
from lodestrata.sources.store import ChunkStore
from lodestrata.streaming.ingest import ingest_stream


def test_paragraph_merge(spark):
    files = spark.createDataFrame([("a", "\n\n".join("x" * n for n in (300, 300, 600))), ("b", "\n\n".join("x" * n for n in (600, 100))), ("c", "short"), ("d", "")], "source string, value string")
    got = [(r["source"], r["page_info"]) for r in chunking.text_chunks(files).orderBy("source", "seq").collect()]
    assert got == [("a", "paragraf 1-2"), ("a", "paragraf 3"), ("b", "paragraf 1-2"), ("c", "paragraf 1")]


def test_continued_pages(spark):
    rows = [("p", 18, "9.9 t\n", False), ("p", 19, "9.9 t\n", False), ("p", 22, "1.2 a\n", True), ("p", 23, "1.2 b\n", True), ("p", 30, "1.2 c\n", True), ("p", 31, "1.2 d\n", True)]
    got = [r["page_info"] for r in chunking.continued_pages(spark.createDataFrame(rows, "source string, page int, text string, recognised boolean")).orderBy("first").collect()]
    assert got == ["sayfa 18", "sayfa 19", "sayfa 22-23", "sayfa 30-31"]


def test_signed_sum_and_guard(spark):
    df = spark.createDataFrame([("ACC-123", "credit", 100.0), ("ACC-123", "debit", 40.0), ("ACC-123", "credit", 60.0), ("ACC-123", "debit", 120.0)], "account string, type string, amount double")
    assert aggregates.signed_sum(df, F.col("amount"), F.col("type") == "credit").first()[0] == 0.0
    assert aggregates.sign_columns(df) == [("type", "credit", "debit")]
    assert aggregates.guarded(df, F.col("account") == "ACC-124", F.sum("amount")).first()["status"] == "empty"
    assert aggregates.guarded(df, F.col("account") == "ACC-123", F.lit(0) * F.count("amount")).first()["status"] == "ok"


def test_chart(spark):
    counts = spark.createDataFrame([("İstanbul", 250), ("Ankara", 120), ("İzmir", 95), ("Bursa", 60), ("Antalya", 45)], "value string, n long")
    r = aggregates.chart(counts).first()
    assert (r["total"], r["top"], r["highest"]) == (570, "İstanbul", 250)
    assert aggregates.chart(counts.limit(1)).count() == 0


def test_bm25_by_hand(spark):
    import math

    texts = {1: "a b a", 2: "b c", 3: "c c d", 4: "e"}
    chunks = spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "chunk_id long, tokens array<string>")
    queries = spark.createDataFrame([(0, ["a", "c", "c"])], "qid long, tokens array<string>")
    got = {r["chunk_id"]: r["score"] for r in search.bm25(chunks, queries).collect()}
    n, avg = 4, 9 / 4
    df = {t: sum(t in v.split() for v in texts.values()) for t in "abcde"}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    for k, v in texts.items():
        ws = v.split()
        want = sum(idf[t] * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for t in ("a", "c", "c"))
        assert got.get(k, 0.0) == pytest.approx(want)


def test_dense_slot(spark):
    pool = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, chunk_id long, rank int")
    dense = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.1), (0, 3, 0.3), (0, 4, 0.4)], "qid long, chunk_id long, score double")
    for n, want in ((1, [1, 2, 4]), (3, [1, 2, 4, 3])):
        assert [r["chunk_id"] for r in search.with_dense_slot(pool, dense, n).orderBy("rank").collect()] == want


def test_rerank(spark):
    pairs = spark.createDataFrame([(0, 1, "a b", "a"), (0, 2, "a b", "a b"), (0, 3, "a b", "c")], "qid long, chunk_id long, query string, content string")
    assert [r["chunk_id"] for r in search.rerank(pairs, overlap_scorer, 2).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize(
    "question, target",
    [
        ("Veri setinde kaç farklı sektör bulunmaktadır?", "rule_engine"),
        ("Bu bilgi doğrudan belirtilmiş mi?", "meta_query"),
        ("fieldGuide bölümü ne işe yarar?", "semantic_rag"),
        ("Veri setinde ortalama bakiye nedir?", "code_interpreter"),
        ("FFT'nin hesaplama karmaşıklığı en çok nedir?", "semantic_rag"),
        ("Fourier grafiği nasıl çizilir?", "semantic_rag"),
        ("", "semantic_rag"),
    ],
)
def test_routes(spark, question, target):
    q = spark.createDataFrame([(1, question)], "qid long, question string")
    assert routing.route(q, ["account_id", "balance", "city"]).first()["target"] == target


def test_selected_table_is_a_signal(spark):
    q = spark.createDataFrame([(1, "Deneyim yılları histogramı")], "qid long, question string")
    assert routing.route(q, ["experience"], F.lit(True)).first()["target"] == "code_interpreter"
    assert routing.route(q, ["city"]).first()["target"] == "semantic_rag"


def test_schema_columns():
    assert routing.schema_columns({"a": {"x": 1, "y": 2}, "b": {"y": 1, "z": 3}}) == ["x", "y", "z"]
    assert routing.schema_columns(["x", "y"]) == ["x", "y"] and routing.schema_columns(None) == []


def test_dataset_scores(spark):
    q = spark.createDataFrame([(1, "havaalanlari airports listesi"), (2, "hello")], "qid long, question string")
    cols = spark.createDataFrame([("airports.json", "code"), ("people.json", "city")], "dataset string, column string")
    vocab = spark.createDataFrame([("people.json", "city", "ankara")], "dataset string, column string, value string")
    sizes = spark.createDataFrame([("airports.json", 30), ("people.json", 728)], "dataset string, n_rows long")
    best = {r["qid"]: (r["dataset"], r["reason"]) for r in routing.score_datasets(q, cols, vocab, sizes).where("rank = 1").collect()}
    assert best[1] == ("airports.json", "best_score") and best[2] == ("people.json", "fallback_no_signal")


@pytest.fixture(scope="module")
def people(spark):
    rows = [("individual", "Saglik", "Doktor", "Ankara", 5, ["tr", "en"], True), ("business", "Egitim", "Ogretmen", "Izmir", 9, ["tr"], False), ("individual", "Saglik", "Hemsire", "Ankara", 2, [], True)]
    return spark.createDataFrame(rows, "profileType string, sector string, occupation string, city string, years int, languages array<string>, autoApprove boolean")


@pytest.mark.parametrize(
    "question, operation, values",
    [
        ("autoApprove oranı nedir", "ratio_autoapprove", {"pct": 33.3}),
        ("Minimum ve maksimum deneyim", "min_max_experience", {"low": 2, "high": 9}),
        ("Ortalama deneyim", "mean_experience", {"mean": 5.33}),
        ("Saglik sektöründe kaç kişi var", "filtered_count_sector", {"n": 2}),
        ("profil tipi dağılımı", "value_counts_profiletype", {"individual": 2, "business": 1}),
        ("diller neler", "explode_languages", {"tr": 2, "en": 1}),
        ("kaç farklı şehir var", "nunique_city_topn", {"n_distinct": 2, "Ankara": 2, "Izmir": 1}),
        ("kaç farklı meslek var", "nunique_occupation", {"n_distinct": 3}),
        ("kaç profil var", "total_count", {"n": 3}),
    ],
)
def test_rules(people, question, operation, values):
    rows = rules.execute(question, people).collect()
    assert {r["operation"] for r in rows} == {operation}
    assert {r["name"]: r["value"] for r in rows} == pytest.approx(values)


def test_rules_without_match(people):
    assert rules.execute("hava nasıl", people) is None


def test_sector_among_many(spark):
    many = spark.range(1200).select(F.concat(F.lit("dal"), F.lpad("id", 4, "0")).alias("sector"))
    df = many.unionByName(spark.createDataFrame([("Sağlık",), ("Beslenme ve Sağlıklı Yaşam",), ("Beslenme ve Sağlıklı Yaşam",), (None,)], "sector string")).repartition(4)
    # each of the values is known, and the longer name displaces the one within it
    assert rules.execute("Beslenme ve Sağlıklı Yaşam sektöründe kaç kişi var", df).first()["value"] == 2
    for i in range(0, 1200, 97):
        assert rules.execute(f"dal{i:04} sektöründe kaç kişi var", df).first()["value"] == 1


def test_cut_answers_are_marked(spark, tmp_path):
    df = spark.range(1500).select(F.concat(F.lit("t"), "id").alias("profileType"), F.when(F.col("id") >= 1400, 1).alias("late"))
    group = [{"step": "group", "keys": ["profileType"], "aggs": {"n": ["count", "profileType"]}}]
    out = algebra.run_plan(df, group)
    assert (len(out["rows"]), out["n_rows"], out["truncated"]) == (1000, 1500, True)
    out = algebra.run_plan(df, group, limit=1500)
    assert (len(out["rows"]), out["n_rows"], out["truncated"]) == (1500, 1500, False)
    # values beyond the rows that come are values, too
    assert algebra.run_plan(df.coalesce(1), [{"step": "select", "columns": ["late"]}])["status"] == "ok"
    for table, label, n in ((df, "truncated", 1500), (df.where("late = 1"), "exact", 100)):
        got = Engine(spark, None, None, Catalog(spark, {"t.json": table})).answer_table("profil tipi dağılımı çıkarılabilir mi")
        assert (got["label"], got["n_rows"], got["truncated"]) == (label, n, n > 1000)
    got = Engine(spark, None, None, Catalog(spark, {"t.json": df}), write_plan=lambda prompt: group).answer_table("t.json hesapla")
    assert (got["label"], len(got["rows"]), got["n_rows"]) == ("truncated", 1000, 1500)


def test_stored_statistics(people):
    roles = rules.Roles(statistics={"profileCount": 728, "sectorDistribution": {"A": 3, "B": 5}})
    assert rules.execute("sektor dagilimi 5 profil", people, roles).first()["name"] == "B"


def test_algebra(people):
    out = algebra.run_plan(people, [{"step": "filter", "where": {"col": "city", "op": "==", "value": "Erzurum"}}, {"step": "group", "aggs": {"n": ["count", "city"]}}])
    assert out["status"] == "empty" and out["rows"] == [{"n": 0}]
    out = algebra.run_plan(people, [{"step": "filter", "where": {"and": [{"col": "years", "op": ">", "value": 3}, {"not": {"col": "city", "op": "isnull"}}]}}, {"step": "group", "keys": ["city"], "aggs": {"m": ["mean", "years"]}}, {"step": "sort", "by": ["-m"], "limit": 1}])
    assert out["status"] == "ok" and out["rows"] == [{"city": "Izmir", "m": 9.0}]
    assert "no column" in algebra.run_plan(people, [{"step": "select", "columns": ["nope"]}])["error"]
    assert "unknown step" in algebra.run_plan(people, [{"step": "exec", "code": "1"}])["error"]


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"name": "x", "tags": ["p", null]}, {"name": "y", "note": " "}], "stats": {"n": 2}, "title": "T"}', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    got = {r["page_info"]: r["content"] for r in readers.read_json_chunks(spark, str(tmp_path)).collect()}
    assert set(got) == {"$.items[0]", "$.items[1]", "$.stats", "$.metadata"} and got["$.items[0]"] == "name: x\ntags[0]: p\nname: x\ntags[0]: p"
    assert sorted(r["page_info"] for r in readers.read_jsonl_chunks(spark, str(tmp_path)).collect()) == ["satır 1", "satır 4"]
    table, meta = readers.read_table(spark, str(tmp_path / "a.json"))
    assert table.count() == 2 and meta["stats"] == {"n": 2}


def test_json_leaves(spark):
    """What a walk over the parsed texts finds."""
    texts = ['{"b": [1, {"x": null, "y": true}, [], "s"], "a": {"c": "t", "d": {}}}', "[]", "7", '"word"', "", None, "{", '[[1, [2.5]], [{"k.l": "ü"}]]', '{"a": 1, "a": 2}', "null", '{"e": ""}']

    def walk(v, path="$"):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in walk(y, f"{path}.{k}")]
        if isinstance(v, list):
            return [x for i, y in enumerate(v) for x in walk(y, f"{path}[{i}]")]
        return [(path, str(v).lower() if isinstance(v, bool) else str(v))] if v is not None else []

    expected = []
    for i, t in enumerate(texts):
        if t and t not in ("{", '{"a": 1, "a": 2}'):
            expected += [(i, *x) for x in walk(json.loads(t))]
    df = spark.createDataFrame(list(enumerate(texts)), "`a b` int, value string")
    got = json_tree.json_leaves(df)
    assert sorted((r[0], r.path, r.leaf) for r in got.collect()) == sorted(expected)
    assert {r.kind for r in got.collect()} >= {"BIGINT", "BOOLEAN", "STRING"}
    assert json_tree.json_leaves(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="path"):
        json_tree.json_leaves(df.withColumnRenamed("a b", "path"))


def test_tables_of_json_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(' [{"a": {"b": 1}}, {"a": null}]', encoding="utf-8")
    (tmp_path / "o.json").write_text('{"x": [{"p": 1}, {"p": 2}, {"p": 3}], "y": [{"q": 1}], "m": {"n": null, "k": "ü"}, "s": [1, 2]}', encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"x": [', encoding="utf-8")
    (tmp_path / "none.json").write_text('{"m": 3}', encoding="utf-8")
    table, meta = readers.read_table(spark, str(tmp_path / "l.json"))
    assert [r["a.b"] for r in table.collect()] == [1, None] and meta == {}
    table, meta = readers.read_table(spark, str(tmp_path / "o.json"))
    assert [r.p for r in table.collect()] == [1, 2, 3] and meta == {"y": [{"q": 1}], "m": {"n": None, "k": "ü"}, "s": [1, 2]}
    with pytest.raises(ValueError, match="not JSON"):
        readers.read_table(spark, str(tmp_path / "bad.json"))
    table, meta = readers.read_table(spark, str(tmp_path / "none.json"))
    assert table.count() == 0 and meta == {"m": 3}


def test_docx_reader(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("one", "two", "", "three"))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    got = [(r["content"], r["page_info"]) for r in readers.read_docx_chunks(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("one\ntwo", "bölüm 1"), ("three", "bölüm 2")]


def test_store_and_stream(spark, tmp_path):
    folder, store = tmp_path / "in", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "x.txt").write_text("hello world", encoding="utf-8")
    assert store.read().count() == 0
    for _ in range(2):
        ingest_stream(spark, str(folder), store, str(tmp_path / "cp"), embed=hash_embedder(4)).awaitTermination()
    assert [(r["source"], r["n"]) for r in store.sources().collect()] == [("data/x.txt", 1)]
    (folder / "y.txt").write_text("more", encoding="utf-8")
    ingest_stream(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination()
    chunks = readers.read_txt_chunks(spark, str(folder))
    assert store.missing(chunks).count() == 0
    store.upsert(chunks.where("source = 'data/x.txt'"))
    assert store.read().count() == 2 and store.delete("data/x.txt") == 1 and store.read().count() == 1


def test_evaluation(spark):
    answers = spark.createDataFrame(
        [(1, "Ankara", False, ["data/a.txt"], "a.txt", "evet"), (2, "bilgi yok", True, [], "-", "hayır"), (3, "HATA: x", False, [], "a.txt", "evet"), (4, "bilmiyorum", True, ["b"], "a.txt", "evet")],
        "id long, answer string, refused boolean, found array<string>, expected_source string, flag string",
    )
    truth = spark.createDataFrame([(1, ["ankara", "istanbul"], []), (4, ["izmir"], [])], "id long, refs array<string>, keywords array<string>")
    scored = evaluation.score_answers(answers, truth)
    assert {r["id"]: (r["outcome"], r["f1"], r["em"], r["hit_rank"]) for r in scored.collect()} == {1: ("TP", 1.0, True, 1), 2: ("TN", 0.0, False, 0), 4: ("FN", 0.0, False, 0)}
    c = evaluation.confusion(scored).first()
    assert (c["tp"], c["tn"], c["fp"], c["fn"]) == (1, 1, 0, 1)
    with pytest.raises(ValueError, match="a.json, b.json"):
        evaluation.unique_truth([("a.json", truth), ("b.json", truth)])
    streak = spark.createDataFrame([("s", i, f) for i, f in enumerate([False, True, True, True, False])], "set_name string, pos int, failed boolean")
    assert evaluation.error_streaks(streak).first()["first_pos"] == 1
    old = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, chunk_id long, rank int")
    new = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid long, chunk_id long, rank int")
    r = evaluation.rank_changes(old, new).first()
    assert (r["same_set"], r["entered"], r["gone"]) == (False, [3], [1])


def test_truth_and_judging(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "id long, question string")
    old = spark.createDataFrame([(1, "a", ["x"], []), (2, "other", ["y"], [])], "id long, question string, refs array<string>, keywords array<string>")
    assert {r["id"]: r["refs"] for r in evaluation.truth_skeleton(q, old).collect()} == {1: ["x"], 2: []}
    t = spark.createDataFrame([("s", False, ["x"]), ("s", True, []), ("s", False, [])], "set_name string, negative boolean, refs array<string>")
    assert {r["set_name"]: (r["total"], r["negatives"], r["filled"], r["needed"], r["pct"]) for r in evaluation.fill_status(t).collect()} == {"s": (3, 1, 1, 2, 50.0), "all": (3, 1, 1, 2, 50.0)}
    s = spark.createDataFrame([('so: {"a": 7, "b": "x", "c": 2.6}',)], "t string").select(evaluation.judge_scores(F.col("t"), ["a", "b", "c"]).alias("s")).first()["s"]
    assert (s["a"], s["b"], s["c"]) == (5, None, 3)
    ranking = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid long, chunk_id long, rank int")
    target, confuser = (spark.createDataFrame([(0, k)], "qid long, chunk_id long") for k in (2, 1))
    assert tuple(evaluation.ranks_of_targets(ranking, target, confuser).first()) == (0, 2, 1)


def test_column_roles(spark):
    df = spark.createDataFrame([("x", 41.0, 29.0, 5), ("y", 38.0, 27.0, 6)], "city string, geo_lat double, geo_lon double, total int")
    assert aggregates.coordinate_pair(df) == ("geo_lat", "geo_lon") and aggregates.amount_column(df) == "total"
    assert aggregates.coordinate_pair(df.drop("geo_lat")) is None
    assert [r["value"] for r in aggregates.first_values(df, "city", "total", 1).collect()] == ["x"]


def test_ranking_tokens(spark):
    from lodestrata.functions import text

    df = spark.createDataFrame([("Ankara'da iyi bir dişçi arıyorum",)], "t string")
    assert df.select(text.content_tokens(F.col("t")).alias("y")).first()[0] == ["ankara", "dis", "hekimi"]
    assert df.select(text.candidate_word(F.lit("12")).alias("a"), text.candidate_word(F.lit("için")).alias("b"), text.candidate_word(F.lit("deniz")).alias("c")).first()[0:3] == (False, False, True)


def test_patterns_of_questions(spark, monkeypatch):
    """Every pattern that a nested comparison finds, in one pass or several; words of columns start a word."""
    import re

    texts = ["the customer name of ankara", "rename x", "", None, "city_name in izmir, ankarali", "aa aaa"]
    patterns = [("d1", "column", "name", True), ("d1", "value", "ankara", False), ("d2", "value", "ankara", False), ("d2", "column", "city", True), ("d2", "value", "a", False), ("d2", "value", "aa", False), ("d3", "file", "custom", False), ("d3", "value", "(x", False), ("d3", "value", "", False)]
    expected = {(i, d, k, p) for i, t in enumerate(texts) for d, k, p, s in patterns if t and p and (re.search(rf"(?<!\w){re.escape(p)}", t) if s else p in t)}
    q = spark.createDataFrame(list(enumerate(texts)), "qid int, norm string")
    for size in (50_000, 2):
        monkeypatch.setattr(routing, "PATTERNS", size)
        got = routing.matches(q, spark.createDataFrame(patterns, "dataset string, kind string, text string, starts boolean")).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_outermost_spans(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.randrange(0, 9), i) for i, s in enumerate(rng.choices(range(40), k=150))] + [("a", None, 3, 900), ("a", 3, None, 901), ("c", 1, 2, 902), ("c", 1, 2, 903)]
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    inside = {r[3] for r in whole if any(o[0] == r[0] and o[1] <= r[1] and r[2] <= o[2] and o[2] - o[1] > r[2] - r[1] for o in whole)}
    got = spans.outermost(spark.createDataFrame(rows, "k string, start int, end int, i int"), ["k"]).collect()
    assert sorted(r.i for r in got) == sorted(r[3] for r in rows if r[3] not in inside)


def test_confusable_names(spark):
    names = ["Damla Akın", "Deniz  akın", "Ada Çelik", "ada çelik", "Tek", "Bir Tek", None, " ", "Yalnız"]
    got = spans.confusable(spark.createDataFrame([(n,) for n in names], "name string"), F.col("name")).collect()
    assert {r.name: r.confusable for r in got} == {"Damla Akın": True, "Deniz  akın": True, "Ada Çelik": False, "ada çelik": False, "Tek": True, "Bir Tek": True, None: False, " ": False, "Yalnız": False}


class InOneTask:
    """Stands for a table of vectors that one task reads in one batch."""

    def __init__(self, ids, vectors):
        self.batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    def select(self, *_):
        return self

    where = select

    def mapInArrow(self, task, _):
        return list(task(iter([self.batch])))


def test_vectors_are_compared_by_tiles():
    """Similarities that a task holds do not grow with the queries; what earlier rows beat is not handed on."""
    rng = np.random.default_rng(3)
    vectors, queries = rng.normal(size=(5000, 8)).astype(np.float32), rng.normal(size=(600, 8))
    asked, table = [(i, v.tolist()) for i, v in enumerate(queries)], InOneTask(range(5000), vectors.tolist())
    out = search.cosine_scores(table, asked)
    assert sum(b.num_rows for b in out) == 3_000_000 and max(b.num_rows for b in out) <= search.QUERY_TILE * search.CHUNK_TILE
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(queries) @ unit(vectors.astype(float)).T
    out = pa.Table.from_batches(search.cosine_scores(table, asked, 3)).to_pandas()
    assert len(out) < 600 * 3 * 3
    got = out.sort_values(["qid", "score"], ascending=[True, False]).groupby("qid")["chunk_id"].apply(lambda x: x.tolist()[:3])
    assert got.tolist() == np.argsort(-sims, axis=1)[:, :3].tolist()


def test_scores_that_round_alike_are_ties():
    near = [[1.0, 0.0], [1.0, 1e-5], [-1.0, 0.0]]
    out = search.cosine_scores(InOneTask([7, 9, 11], near), [(1, [1.0, 1e-5])], 1)
    assert {c for b in out for c in b.column("chunk_id").to_pylist()} == {7, 9}
