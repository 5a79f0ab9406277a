import pytest
from pyspark.sql import functions as F

from lodestrata.functions import metrics, numeric, text
from lodestrata.operators import evaluation
from lodestrata.sources import readers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_normalizers(spark):
    assert one(spark, "İSTANBUL IŞIK Çağ", text.normalize) == "istanbul isik cag"
    assert one(spark, "Kâğıt ÂLÎ", text.route_form) == "kagit ali"
    assert one(spark, "ŞÖYLE â î", text.fold_plain) == "soyle a i"
    assert one(spark, None, text.normalize) is None


def test_identifier_tokens(spark):
    t = one(spark, "G4.1 bölümü 3.200 kişi", text.tokens)
    assert "g4.1" in t and "3.200" not in t and {"3", "200"} <= set(t)


@pytest.mark.parametrize("q, token, want", [("toplam oran nedir", "oran", True), ("koran", "oran", False), ("oranlar", "oran", True), ("minler", "min", True), ("minimumlar", "min", False), ("%5", "%", True), ("ila", "il", False), ("il", "il", True)])
def test_contains_token(spark, q, token, want):
    assert one(spark, q, lambda c: text.contains_token(c, token)) is want


def test_word_start(spark):
    assert one(spark, "kac sehir var", lambda c: text.word_start(c, "sehir")) is True
    assert one(spark, "xsehir", lambda c: text.word_start(c, "sehir")) is False


def test_truncation(spark):
    assert one(spark, "aa bb cc dd", lambda c: text.truncate(c, 9, "…")) == "aa bb cc…"
    assert one(spark, "short", lambda c: text.truncate(c, 9)) == "short"
    assert one(spark, "x" * 20, lambda c: text.truncate(c, 9, "…")) == "x" * 9 + "…"


def test_field_helpers(spark):
    assert one(spark, "city: Ankara\nbio: " + "x" * 80 + "\nplain", text.key_tokens) == ["ankara"]
    assert one(spark, "a\nb\na\nb\nc", text.unrepeat) == "a\nb\nc"
    assert one(spark, "1.2.3 Title\nmore", text.section_number) == "1.2.3"
    assert one(spark, "Title", text.section_number) is None
    assert one(spark, "accountID2Name", text.column_words) == ["account", "ID", "2", "Name"]
    assert one(spark, "a.txt (0.5); b.txt; a.txt", text.sources) == ["a.txt", "b.txt"]
    assert one(spark, "wait 5m47.76s", text.retry_seconds) == pytest.approx(347.76)
    assert one(spark, "none", text.retry_seconds) is None
    assert one(spark, "x = 1  # note\ny", text.code_form) == "x = 1 y"
    assert one(spark, "so\n```python\nx = 1\n```", text.unfence) == "x = 1"
    d = one(spark, "Türkçe: 728 profil; İngilizce: 1.210 profil", text.distribution)
    assert [(r["name"], r["value"]) for r in d] == [("Türkçe", 728.0), ("profil; İngilizce".split("; ")[1], 1210.0)]


def test_numbers(spark):
    r = spark.range(1).select(
        numeric.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), numeric.percent_change(F.lit(0.0), F.lit(5.0)).alias("none"),
        numeric.percent(F.lit(1), F.lit(0)).alias("zero"), numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("cos"),
    ).first()
    assert r["half"] == pytest.approx(6371.0 * 3.141592653589793) and r["none"] is None and r["zero"] == 0.0 and r["cos"] == 0.0


def test_metrics(spark):
    df = spark.createDataFrame([("Cevap 42 Ankara", "ankara"), ("", "ankara"), ("a b c", "a x c")], "p string, r string")
    rows = df.select(
        metrics.exact_match(F.col("p"), F.col("r")).alias("em"), metrics.soft_match(F.col("p"), F.col("r")).alias("soft"),
        metrics.token_f1(metrics.answer_tokens(F.col("p")), metrics.answer_tokens(F.col("r")))["f1"].alias("f1"), metrics.rouge_l(metrics.answer_tokens(F.col("p")), F.array(metrics.answer_tokens(F.col("r")))).alias("rl"),
    ).collect()
    assert [r["em"] for r in rows] == [True, False, False]
    assert [r["soft"] for r in rows] == [True, False, False]
    assert rows[0]["f1"] == pytest.approx(0.5) and rows[1]["f1"] == 0.0
    assert rows[2]["rl"] == pytest.approx(2 / 3)
    hit = spark.range(1).select(metrics.first_hit(F.array(F.lit("q"), F.lit("q"), F.lit("data/a.txt")), F.lit("a.txt"))).first()[0]
    assert hit == 2


def test_roots_of_json_values():
    assert readers.roots({"a": 1, "b": {"c": 2}}) == [("$", {"a": 1, "b": {"c": 2}})]
    assert readers.roots({"a": [{"x": 1}], "b": 2}) == [("$", {"a": [{"x": 1}], "b": 2})]
    assert readers.roots(7) == [("$", 7)] and readers.roots([1, 2]) == [("$[0]", 1), ("$[1]", 2)]
    data = {"name": "n", "rows": [{"x": 1}, {"x": 2}, {"x": 3}], "guide": {"g": 1}, "tags": [1, 2]}
    want = [("$.rows[0]", {"x": 1}), ("$.rows[1]", {"x": 2}), ("$.rows[2]", {"x": 3}), ("$.guide", {"g": 1}), ("$.tags", [1, 2]), ("$.metadata", {"name": "n"})]
    assert readers.roots(data) == want


def test_leaves_of_json_values():
    value = {"a": [True, None, " x ", {"b": 0}], "c": "", "d": False, "e": 1.5}
    assert list(readers.flatten(value)) == [("$.a[0]", "True"), ("$.a[2]", "x"), ("$.a[3].b", "0"), ("$.d", "False"), ("$.e", "1.5")]
    assert list(readers.flatten(None)) == [] and list(readers.flatten("x", "$.y")) == [("$.y", "x")]


def test_negative_flags_and_first_hit(spark):
    rows = [("Hayır", 1), ("hayir", 1), ("NO", 1), ("h", 0), ("Evet", 0), ("", 0), (None, 0)]
    df = spark.createDataFrame([("a.txt", f, w) for f, w in rows], "source string, flag string, want int")
    none = F.array().cast("array<string>")
    assert all(bool(r["got"]) == bool(r["want"]) for r in df.select("want", evaluation.is_negative(F.col("source"), F.col("flag"), none).alias("got")).collect())
    hit = spark.createDataFrame([("",), (None,), ("b.txt",), ("z",)], "e string").select(metrics.first_hit(F.array(F.lit("a.txt"), F.lit("b.txt")), F.col("e")).alias("h")).collect()
    assert [r["h"] for r in hit] == [0, 0, 2, 0]


def test_lcs_equals_the_table():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
        assert metrics.lcs(a, b) == row[-1]


def test_several_references(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [["x"], ["a", "c"], []]), (["a"], []), ([], [["a"]]), (None, [["a"]]), (["a"], None)], "p array<string>, r array<array<string>>")
    assert [round(r[0], 6) for r in df.select(metrics.rouge_l(F.col("p"), F.col("r"))).collect()] == [0.8, 0.0, 0.0, 0.0, 0.0]


def test_semantic_similarity(spark):
    rows = [([1.0, 0.0], [[0.0, 1.0], [1.0, 1.0]]), ([1.0, 0.0], [[-1.0, 0.0]]), ([0.0, 0.0], [[1.0, 0.0]]), ([1.0, 0.0], [[0.0, 0.0]]), ([1.0, 0.0], []), (None, [[1.0]]), ([1.0, 0.0], [[1.0], None, [2.0, 0.0]]), ([1.0], None)]
    df = spark.createDataFrame(rows, "p array<double>, r array<array<double>>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(metrics.semantic_similarity(F.col("p"), F.col("r"))).collect()] == [0.707107, 0.0, None, None, None, None, 1.0, None]
