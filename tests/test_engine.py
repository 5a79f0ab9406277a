import json

import pytest

from lodestrata.plans.engine import Engine
from lodestrata.sources import sinks
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.providers import hash_embedder, overlap_scorer
from lodestrata.sources.store import ChunkStore


def test_ingest_and_retrieve(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("kediler ve köpekler hakkında bir metin", encoding="utf-8")
    (folder / "b.txt").write_text("uçaklar ve havaalanları hakkında başka bir metin", encoding="utf-8")
    (folder / "c.json").write_text(json.dumps({"items": [{"city": "Ankara"}, {"city": "İzmir"}]}), encoding="utf-8")
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "store")), hash_embedder(16))
    for _ in range(2):
        assert {r["source"]: r["n"] for r in engine.ingest(str(folder)).collect()} == {"data/a.txt": 1, "data/b.txt": 1, "data/c.json": 2}
    q = spark.createDataFrame([(1, "uçaklar nedir"), (2, "Ankara")], "qid long, question string")
    best = {r["qid"]: r["content"] for r in engine.retrieve(q).where("rank = 1").collect()}
    assert best[1].startswith("uçaklar") and "Ankara" in best[2]
    assert {r["source"] for r in engine.retrieve(q, source="A.txt").collect()} == {"data/a.txt"}
    assert engine.retrieve(q, source="none.txt").count() == 0
    engine.score_pairs = overlap_scorer
    assert engine.retrieve(q, dense_slot=1).where("qid = 1 and rank = 1").first()["source"] == "data/b.txt"


def test_gates_of_retrieval(spark, tmp_path):
    """Questions about a data set lift its chunks and those that describe it; vectors have to fit."""
    data = {"people": [{"name": "ada", "city": "Ankara"}, {"name": "can", "city": "Izmir"}], "statistics": {"sectorCount": 7}}
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "people.json").write_text(json.dumps(data), encoding="utf-8")
    (folder / "z.txt").write_text("kediler ve köpekler hakkında bir metin", encoding="utf-8")
    catalog = Catalog.load(spark, [str(folder / "people.json")])
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "store")), hash_embedder(16), catalog)
    engine.ingest(str(folder))
    q = spark.createDataFrame([(1, "people.json veri setinde hangi alanlar var, metadata nedir?"), (2, "kediler hakkında")], "qid long, question string")
    rows = engine.retrieve(q, final=8, parts=True).collect()
    meta = {r["qid"]: r["meta"] for r in engine._gates(q, None).collect()}
    assert not meta[2] and all(r["meta_boost"] == 0 and r["hint_boost"] == 0 for r in rows if r["qid"] == 2)
    assert all((r["meta_boost"] > 0) == (meta[1] and r["page_info"].startswith("$.statistics")) for r in rows if r["qid"] == 1)
    forced = engine.retrieve(q, final=8, parts=True, meta=True).collect()
    assert all((r["meta_boost"] > 0) == r["page_info"].startswith("$.statistics") for r in forced)
    engine.embed = hash_embedder(8)
    with pytest.raises(ValueError, match="8 values"):
        engine.retrieve(q)


def test_chunks_without_vectors_are_found(spark, tmp_path):
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "s")), hash_embedder(8))
    engine.store.upsert(spark.createDataFrame([("data/a.txt", 0, "uçak ve gemi", "p"), ("data/b.txt", 0, "elma ve armut", "p"), ("data/c.txt", 0, "masa", "p"), ("data/d.txt", 0, "kalem", "p")], "source string, seq int, content string, page_info string"))
    q = spark.createDataFrame([(1, "armut")], "qid long, question string")
    assert [r["source"] for r in engine.retrieve(q).collect()] == ["data/b.txt"]


def test_answers_over_tables(spark, tmp_path):
    (tmp_path / "people.json").write_text(json.dumps({"people": [{"name": "a", "location": {"city": "Ankara"}, "years": 3}, {"name": "b", "location": {"city": "Izmir"}, "years": 5}], "statistics": {"sectorCount": 7}}), encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    catalog = Catalog.load(spark, [str(tmp_path / "people.json"), str(tmp_path / "bad.json")])
    assert catalog.schemas()["people.json"]["location.city"] == "string"
    steps = [{"step": "filter", "where": {"col": "location.city", "op": "==", "value": "Erzurum"}}, {"step": "group", "aggs": {"n": ["count", "name"]}}]
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "s")), hash_embedder(4), catalog, write_plan=lambda prompt: steps)
    assert engine.answer_table("Veri setinde kaç farklı sektör bulunmaktadır?")["rows"] == [{"operation": "meta_sector_count", "name": "n", "value": 7.0}]
    assert engine.answer_table("people.json Erzurum kaç kişi?")["label"] == "empty"
    assert Engine(spark, engine.store, hash_embedder(4)).answer_table("x")["reason"] == "no_datasets_loaded"


def test_sinks(spark, tmp_path):
    rows = sinks.union_rows([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("ş",)], "b string")])
    sinks.write_csv(rows, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    sinks.write_summary(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
