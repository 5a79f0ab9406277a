"""Reading order of pages whose layout is known."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import pages

SCHEMA = "page int, x0 double, x1 double, top double, size double, text string, width double, images int"


def text_of(spark, glyphs, width=600.0, images=0):
    """glyphs: (x0, top, text[, size]); a glyph is as wide as five points a character."""
    rows = [(1, float(x), float(x) + 5 * len(t), float(y), float(s[0]) if s else 10.0, t, width, images) for x, y, t, *s in glyphs]
    got = pages.page_texts(spark.createDataFrame(rows, SCHEMA), ["page"]).collect()
    return got[0].text if got else None


def columns(n=5, beside=None):
    beside = n if beside is None else beside
    left = [(50, 100 + 20 * i, f"left{i}") for i in range(n)]
    right = [(350, 100 + 20 * (i + n - beside), f"right{i}") for i in range(n)]
    return left + right


def straight(n=5):
    return "\n".join(f"left{i} right{i}" for i in range(n))


def in_order(n=5):
    return "\n".join([f"left{i}" for i in range(n)] + [f"right{i}" for i in range(n)])


def test_columns_and_sections(spark):
    assert text_of(spark, columns()) == in_order()
    title = [(50, 60, "x" * 90)]
    assert text_of(spark, title + columns(12)) == "x" * 90 + "\n" + in_order(12)
    between = [(50, 330, "y" * 90)] + [(x, 350 + 20 * i, f"{side}{i}b") for x, side in ((50, "l"), (350, "r")) for i in range(6)]
    assert text_of(spark, columns(11) + between) == in_order(11) + "\n" + "y" * 90 + "\n" + "\n".join([f"l{i}b" for i in range(6)] + [f"r{i}b" for i in range(6)])


@pytest.mark.parametrize(
    "glyphs, images, expected",
    [
        (columns(), 1, straight()),
        (columns() + [(50, 300, "")], 0, straight() + "\n"),
        (columns(2), 0, straight(2)),
        (columns(5, 1), 0, "left0\nleft1\nleft2\nleft3\nleft4 right0\nright1\nright2\nright3\nright4"),
        (columns() + [(50, 60, "x" * 90)], 0, "x" * 90 + "\n" + straight()),
    ],
    ids=["images", "symbols", "few rows", "not side by side", "crossing rows"],
)
def test_gates(spark, glyphs, images, expected):
    assert text_of(spark, glyphs, images=images) == expected


def test_a_narrow_gap_is_no_column(spark):
    near = [(50, 100 + 20 * i, "a" * 49) for i in range(6)] + [(300, 100 + 20 * i, "b" * 9) for i in range(6)]
    assert text_of(spark, near) == "\n".join(["a" * 49 + " " + "b" * 9] * 6)


def test_small_glyphs_go_back_to_their_line(spark):
    body = [(50, 100, "V"), (64, 100, "="), (74, 100, "{S}"), (50, 120, "P"), (62, 120, "ends")]
    assert text_of(spark, [*body, (55, 104, "N", 6)]) == "VN = {S}\nP ends"
    assert text_of(spark, [*body, (55, 99.5, "2", 6)]) == "V2 = {S}\nP ends"
    assert text_of(spark, [*body, (55, 160, "far", 6)]) == "V = {S}\nP ends\nfar"


def test_pages_are_apart(spark):
    rows = [(p, 50.0, 60.0, 100.0, 10.0, t, 600.0, None) for p, t in ((1, "a"), (2, "b"), (3, None), (4, " "))]
    got = pages.page_texts(spark.createDataFrame(rows, SCHEMA), ["page"])
    assert {r.page: r.text for r in got.collect()} == {1: "a", 2: "b"}
    assert pages.page_texts(spark.createDataFrame(rows, SCHEMA).where(F.lit(False)), ["page"]).count() == 0


def test_a_page_is_one_row(spark, monkeypatch):
    """Glyphs are brought together once, without a window or a row a split; slices of few glyphs change nothing."""
    rows = [(p, 50.0 + 300 * s, 80.0 + 300 * s, 100.0 + 20 * i, 10.0, f"{'lr'[s]}{i}", 600.0, 0) for p in range(7) for s in (0, 1) for i in range(p)]
    got = pages.page_texts(spark.createDataFrame(rows, SCHEMA), ["page"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
    in_columns = {p: "\n".join([f"{s}{i}" for s in "lr" for i in range(p)] if p > 2 else [f"l{i} r{i}" for i in range(p)]) for p in range(1, 7)}
    assert {r.page: r.text for r in got.collect()} == in_columns
    arrays = spark.createDataFrame(rows, SCHEMA).groupBy("page").agg(F.collect_list(pages.glyph(*[F.col(c) for c in ("x0", "x1", "top", "size", "text", "width", "images")])).alias("glyphs"))
    monkeypatch.setattr(pages, "GLYPHS", 5)
    table = pages.pa.Table.from_batches(pages._texts(arrays.toArrow().to_batches()))
    assert dict(zip(table["page"].to_pylist(), table["text"].to_pylist())) == in_columns
