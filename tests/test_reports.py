from pyspark.sql import functions as F

from lodestrata.operators import reports


def test_error_kinds(spark):
    rows = [("x Error code: 500 - y", "Error code: 500", True), ("Embedding olusturulamadi: z", "Embedding olusturulamadi", False), ("", "bilinmeyen hata", False), ("CUDA error (1)", "CUDA error", True), ("a" * 60, "a" * 40, False)]
    df = spark.createDataFrame(rows, "m string, kind string, memory boolean")
    for r in df.select("*", reports.error_kind(F.col("m")).alias("k"), reports.is_memory_error(F.col("m")).alias("x")).collect():
        assert (r["k"], r["x"]) == (r["kind"], r["memory"])


def test_name_cases(spark):
    df = spark.createDataFrame([(t, c) for t in (True, False) for c in (True, False)], "t boolean, c boolean")
    assert [r[0] for r in df.select(reports.name_case(F.col("t"), F.col("c"))).collect()] == reports.NAME_CASES


def test_rates(spark):
    c = spark.createDataFrame([("a", 3, 1), ("b", 0, 0)], "s string, tn int, fp int")
    got = {r["s"]: (r["negative_right"], r["negative_wrong"]) for r in reports.negative_rates(c).collect()}
    assert got == {"a": ("%75.0 (3/4)", "%25.0 (1/4)"), "b": ("Ölçülmedi (n=0)",) * 2}
    r = spark.createDataFrame([(True, 0), (False, 2), (False, 0), (False, 1)], "negative boolean, hit_rank int")
    assert reports.retrieval_accuracy(r).first() == (75.0, 4) and reports.retrieval_accuracy(r.limit(0)).first() == (0.0, 0)


def test_means(spark):
    rows = [("a", True, 0.5, 0.9), ("a", True, 1.0, None), ("a", False, 0.0, None), ("b", False, 0.0, None)]
    df = spark.createDataFrame(rows, "c string, referenced boolean, f1 double, sem double")
    got = {r["c"]: tuple(r)[1:] for r in reports.category_means(df, "c", ["f1"], "sem").collect()}
    assert got == {"a": (3, 2, 75.0, 90.0, 1), "b": (1, 0, 0.0, 0.0, 0)}
    values = spark.createDataFrame([(True, 33.34), (True, 33.36), (True, None), (False, 99.0)], "referenced boolean, x double")
    assert reports.overall_means(values, ["x"]).first() == (33.35, 3)


def test_breakdowns(spark):
    df = spark.createDataFrame([("r", "Kolay", "a.txt", "data/a.txt"), ("r", "Kolay", "-", "x"), ("s", "Zor", "b", "c"), ("s", "Zor", None, "c")], "route string, difficulty string, expected string, top string")
    assert {tuple(r) for r in reports.route_counts(df).collect()} == {("r", 2), ("s", 2)}
    assert {tuple(r) for r in reports.difficulty_report(df).collect()} == {("Kolay", 2, 1, 1), ("Zor", 2, 1, 0)}
    judged = spark.createDataFrame([("FN", 1), ("TP", 4), ("TN", 5), (None, None)], "outcome string, score int")
    assert reports.means_without_fn(judged, ["score"]).first() == ("score", 4.5)
    files = spark.createDataFrame([(True, 3, 1.5), (False, 9, 0.5)], "ok boolean, chunks int, seconds double")
    assert reports.upload_report(files).first() == (1, 1, 3, 2.0) and reports.upload_report(files.limit(0)).first() == (0, 0, 0, 0.0)


def test_joins_of_sets(spark):
    scored = spark.createDataFrame([("s", 1, "TP"), ("t", 1, "FN")], "set string, id int, outcome string")
    judged, asked = spark.createDataFrame([("s", 1, 5)], "set string, id int, score int"), spark.createDataFrame([("t", 1, "q")], "set string, id int, question string")
    assert {tuple(r) for r in reports.with_judgements(scored, judged, asked).collect()} == {("s", 1, "TP", 5, None), ("t", 1, "FN", None, "q")}
    sets = spark.createDataFrame([("s",), ("u",)], "set string")
    assert [r[0] for r in reports.missing_sets(sets, scored).collect()] == ["u"]
