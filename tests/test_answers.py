import pytest
from pyspark.sql import functions as F

from lodestrata.functions import answers


def run(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("y")).first()[0]


@pytest.mark.parametrize(
    "answer, question, want",
    [
        ("Bu bilgi dokümanlarda bulunamadı.", "Bakiye nedir?", True),
        ("Doğrudan bulunamadı, ancak muhtemelen ACC-124 hesabının bakiyesi 3.200 USD'dir.", "Bakiye nedir?", False),
        ("Verilen metinde herhangi bir bilgi bulunmadığından cevap yoktur.", "Kim?", True),
        ("ACC-124 hesabına dair bilgi bulunamadı.", "ACC-124 bakiyesi nedir?", True),
        ("Ankara'da 120 profil var.", "Kaç profil var?", False),
        ("∫ f(x) bilgi bulunamadı", "?", False),
        ("", "?", False),
        (None, "?", False),
    ],
)
def test_refusals(spark, answer, question, want):
    assert run(spark, answers.is_refusal, answer, question) is want


def test_refusal_without_question(spark):
    assert run(spark, answers.is_refusal, "Bu bilgi dokümanlarda bulunamadı.") is True
    assert run(spark, answers.is_refusal, "Bulunamadı ama hesap toplam bakiyesi büyük bir artış gösterdi.") is False


def test_claims(spark):
    assert run(spark, answers.new_claims, "G4.5.1 bulunamadı.", "G_4.5.1 nedir?") == []
    assert run(spark, answers.new_claims, "bilgi bulunamadı, belki Hawaii 77", "Nerede?") == ["77", "Hawaii"]


def test_trim(spark):
    assert run(spark, answers.trim_refusals, "Cevap 42 olur. Bu bilgi dokümanlarda bulunamadı.") == "Cevap 42 olur."
    assert run(spark, answers.trim_refusals, "Bu bilgi dokümanlarda bulunamadı.") == "Bu bilgi dokümanlarda bulunamadı."


def test_currency(spark):
    assert run(spark, answers.fix_currency, "Bakiye 1 TL'dir.", "currency: USD") == "Bakiye 1 USD'dir."
    assert run(spark, answers.fix_currency, "Bakiye 1 TL.", "none") == "Bakiye 1."
    assert run(spark, answers.fix_currency, "Bakiye 1 TL.", "USD EUR") == "Bakiye 1 TL."


def test_grounding(spark):
    assert run(spark, answers.grounded, "Toplam 570, pay 78,1, uydurma 9999", "İstanbul 250, diğer 320") == [9999.0]
    assert answers.numbers("1.234 ve 2,5") == [1234.0, 2.5]


def test_query_cut(spark):
    text = "\n".join([f"filler line {i}" for i in range(60)] + ["searchKeywords: dentist"])
    out = run(spark, lambda t, q: answers.query_cut(t, q, 400), text, "dentist searchKeywords")
    assert len(out) <= 400 and "dentist" in out and out.startswith("filler line 0")
    assert run(spark, lambda t, q: answers.query_cut(t, q, 400), "short", "x") == "short"
