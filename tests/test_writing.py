"""Plans by an injected writer: prompts within their budget, corrections, objections, temperature."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import algebra, rules, writing
from lodestrata.plans.engine import Engine
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.providers import hash_embedder
from lodestrata.sources.store import ChunkStore

GOOD = [{"step": "group", "aggs": {"years": ["sum", "years"]}}]
BAD = [{"step": "group", "aggs": {"years": ["sum", "absent"]}}]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Saglik", 5), ("Egitim", 9), ("Saglik", 3)], "sector string, years int")


class Writer:
    def __init__(self, *plans):
        self.plans, self.prompts, self.temperatures = list(plans), [], []

    def bind(self, temperature):
        self.temperatures.append(temperature)
        return self

    def __call__(self, prompt):
        self.prompts.append(prompt)
        plan = self.plans.pop(0)
        if isinstance(plan, Exception):
            raise plan
        return plan


def run(people, writer, verdict=None, **options):
    def check(prompt):
        if isinstance(verdict, Exception):
            raise verdict
        return verdict

    return writing.answer(writer, people, "Toplam deneyim yili nedir?", check if verdict is not None else None, **options)


def test_a_broken_checker_changes_nothing(people):
    broken, fine = (run(people, Writer(GOOD), v) for v in (RuntimeError("Error code: 500"), "TAMAM"))
    assert broken["validation"] == "failed" and broken["validation_error"].startswith("RuntimeError: Error code: 500")
    assert fine["validation"] == "ok" and fine["validation_error"] is None
    assert all(broken[k] == fine[k] for k in ("rows", "plan", "attempts", "status")) and fine["rows"] == [{"years": 17}]


def test_an_objection_goes_back_to_the_writer(people):
    better = [{"step": "filter", "where": {"col": "sector", "op": "==", "value": "Saglik"}}, *GOOD]
    writer, verdicts = Writer(GOOD, better), iter(["SORUN: filtre eksik", "TAMAM"])
    out = writing.answer(writer, people, "?", lambda prompt: next(verdicts))
    assert out["rows"] == [{"years": 8}] and out["attempts"] == 2 and out["validation"] == "ok" and "filtre eksik" in writer.prompts[1]


def test_only_the_objected_answer_is_left(people):
    out = run(people, Writer(GOOD, GOOD, BAD), "SORUN: filtre eksik")
    assert out["validation"] == "objection" and out["objection"] == "filtre eksik" and out["attempts"] == 1 and out["rows"] == [{"years": 17}]


def test_the_last_attempt_is_not_checked(people):
    assert {k: v for k, v in run(people, Writer(BAD, BAD, GOOD), "TAMAM").items() if k in ("attempts", "validation")} == {"attempts": 3, "validation": "not_run"}
    assert run(people, Writer(GOOD))["validation"] == "not_run"


@pytest.mark.parametrize(("verdict", "expected"), [("SORUN: x", "x"), ("sorun: yanlış", "yanlış"), ("TAMAM", None), ("Bence SORUN: x", None), ("SORUN:", None), ("", None), ("SORUN: " + "y" * 400, "y" * 300)])
def test_only_a_marked_verdict_objects(verdict, expected):
    assert writing.objection(verdict) == expected


def test_repeats_are_named_and_warmed(people):
    writer = Writer(json.dumps(BAD), json.dumps(BAD, indent=1), "no plan")
    out = run(people, writer)
    assert out["status"] == "failed" and out["attempts"] == 3 and not out["service_failure"] and "JSON" in out["error"]
    assert writer.temperatures == pytest.approx([0.4, 0.6])
    assert "DIFFERENT" not in writer.prompts[1]
    assert "DIFFERENT" in writer.prompts[2]
    assert "no column 'absent'" in writer.prompts[1] and writer.prompts[2].count("--- Attempt") == 2


def test_a_broken_writer_ends_the_loop(people):
    out = run(people, Writer(GOOD, ConnectionError("x")), "SORUN: a")
    assert out["validation"] == "objection"
    out = run(people, Writer(ConnectionError("gone")))
    assert out["service_failure"] and "gone" in out["error"]


def fixed(limit=10**6):
    return len(writing.correction_prompt("q", "d", [], limit=limit))


def test_history_that_fits_is_whole():
    out = writing.correction_prompt("q", "d", [("x = 1", "KeyError: a"), ("y = 2", "NameError: b")])
    assert "--- Attempt 1 ---\nPlan:\nx = 1\nERROR: KeyError: a\n\n--- Attempt 2 ---\nPlan:\ny = 2\nERROR: NameError: b\n" in out and "kirpildi" not in out


@pytest.mark.parametrize("room", [150, 300, 600, 800, 2000])
def test_long_history_stays_within_the_limit(room):
    limit = fixed() + room
    out = writing.correction_prompt("q", "d", [("old" * 800, "OldError"), ("START" + "c" * 2322, "ValueError: " + "e" * 40)], limit=limit)
    assert len(out) <= limit and "ValueError" in out and "kirpildi" in out and out.endswith("Plan:")
    assert ("START" in out) == (room > 250) and "OldError" not in out
    long_error = writing.correction_prompt("q", "d", [("x", "E" * 5000)])
    assert "E" * 401 not in long_error and "E" * 400 in long_error


def test_a_limit_below_the_fixed_part():
    assert writing.correction_prompt("q", "d", [("x", "Error")], limit=10).endswith("Plan:")


def test_description(spark, people):
    out = writing.describe(people)
    assert "Rows: 3" in out and "years (int)" in out and "All values of sector: Egitim, Saglik" in out
    assert "All values" not in writing.describe(spark.range(3))


def test_one_run_a_plan(spark, people):
    """A filter's emptiness is told by the run itself: the rows are read once."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table = people.repartition(2).mapInArrow(watch, people.schema)
    where = lambda c, v: {"step": "filter", "where": {"col": c, "op": "==", "value": v}}
    out = algebra.run_plan(table, [where("sector", "Saglik"), where("years", 4), {"step": "group", "keys": ["sector"], "aggs": {"n": ["count", "years"]}}])
    assert out["empty_filter"] == [1] and out["status"] == "empty" and out["rows"] == [] and seen.value == 3
    out = algebra.run_plan(table, [where("sector", "Saglik"), where("years", 3), {"step": "group", "aggs": {"n": ["sum", "years"]}}])
    assert out["empty_filter"] == [] and out["rows"] == [{"n": 3}] and out["status"] == "ok" and seen.value == 6
    out = algebra.run_plan(people.where(F.lit(False)), [where("sector", "x"), {"step": "group", "aggs": {"n": ["sum", "years"]}}])
    assert out["empty_filter"] == [0] and out["status"] == "empty"
    out = algebra.run_plan(spark.range(5000), [{"step": "filter", "where": {"col": "id", "op": ">=", "value": 0}}], limit=10)
    assert out["empty_filter"] == [] and len(out["rows"]) == 10 and out["n_rows"] == 5000 and out["truncated"]
    zero = algebra.run_plan(people, [where("sector", "Saglik"), {"step": "with", "name": "z", "expr": 0}, {"step": "group", "aggs": {"n": ["sum", "z"]}}])
    assert zero["status"] == "ok" and zero["rows"] == [{"n": 0}]


@pytest.mark.parametrize(("question", "value"), [("autoApprove oranı nedir", 33.3), ("autoApprove aktif olanların oranı", 66.7), ("autoApproveRequests true yüzdesi", 66.7), ("autoApprove false oranı", 33.3), ("autoApprove inaktif oranı", 33.3)])
def test_flag_rule(spark, question, value):
    table = spark.createDataFrame([(True,), (False,), (True,)], "autoApproveRequests boolean")
    assert rules.execute(question, table).first()["value"] == value


def test_answer_over_a_table(spark, tmp_path, people):
    engine = Engine(spark, ChunkStore(spark, str(tmp_path / "s")), hash_embedder(4), Catalog(spark, {"people.json": people}), write_plan=Writer(BAD, GOOD), check=lambda prompt: "Bu doğru görünüyor")
    out = engine.answer_table("people.json toplam yıl?", "people.json")
    assert out["label"] == "exact" and out["rows"] == [{"years": 17}] and out["attempts"] == 2 and out["validation"] == "ok"
    engine.write_plan, engine.check = Writer(GOOD, BAD, BAD), lambda prompt: "SORUN: yanlış"
    assert engine.answer_table("people.json toplam yıl?", "people.json")["label"] == "unverified"
