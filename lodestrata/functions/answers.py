"""Checks and repairs of written answers: refusals, new claims, currencies, grounding, query-aware cuts."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_form, fold_plain

# Phrases, frame words and patterns of refusals, in folded form.
MARKERS = [
    "dokumanlarda bulunamadi", "bilgi dokumanlarda", "bulunamadi", "bulunmamaktadir", "bulunmuyor",
    "yer almamaktadir", "yer almiyor", "gecmemektedir", "belirtilmemistir", "mevcut degildir",
]
FRAME_WORDS = [
    "bu", "bir", "bilgi", "bilgiler", "bilgisi", "veri", "veriler", "konu", "konuya", "konuda", "konusunda", "dair",
    "iliskin", "ait", "hakkinda", "baglamda", "baglam", "dokuman", "dokumanda", "dokumanlarda", "dokumanlar", "belge",
    "belgede", "metin", "metinde", "herhangi", "soruyla", "soruya", "sorunun", "ilgili", "verilen", "mevcut", "net",
    "dogrudan", "acikca", "ve", "ile", "icin", "da", "de", "ise", "olarak", "cevabi", "cevap", "yoktur", "yok",
    "degildir", "ancak", "fakat", "maalesef", "uzgunum", "saglanan", "sunulan", "icerisinde", "icinde", "uzerinde",
    "kaynaklarda", "kaynak", "setinde", "seti", "dosyada", "dosyasinda",
]
PREDICATE = r"bulun(a)?ma[dmyzs]\w*|bulunamad\w*|bulunmuyor|yer alma[dmyzs]\w*|belirtilme[dmyzs]\w*|gecme[dmyzs]\w*|mevcut degil\w*|\byok(tur)?\b"
ABOUT = r"\bbilgi\w*|dokuman\w*|belge\w*|baglam\w*|metin\w*|kaynak\w*|ders not\w*"
MATH = r"[∫∞∑∏√±≤≥≠∈∩∪δωπ]|\\int|\\infty|\\omega"
RESIDUAL_WORDS = 3
CURRENCIES = ["USD", "EUR", "GBP", "TRY", "JPY", "CHF", "CAD", "AUD"]
CURRENCY_WORDS = [r"(?<!\w)[Tt][Ll](?=$|[^\wçğıöşü])", r"(?<!\w)₺", r"(?<!\w)(?:Türk\s+)?[Ll]iras[ıi](?!\w)", r"(?<!\w)[Ll]ira(?!\w)", r"(?<!\w)[Dd]olar(?!\w)", r"(?<!\d)\s?\$(?!\w)"]
PURE_WORDS, CONTRAST = 12, r"\b(ancak|fakat|ama|lakin|yalnizca|bununla birlikte|ne var ki|buna ragmen|yine de|dolayisiyla)\b"


def folded(text: Column) -> Column:
    return fold_plain(answer_form(text))


def refusal_frame(text: Column) -> Column:
    """Whether a sentence denies (a negative predicate) and says of what (information, documents ...)."""
    sentences = F.split(fold_plain(text), "(?<=[.!?])\\s+|\\n+")
    return F.exists(sentences, lambda s: s.rlike(PREDICATE) & s.rlike(ABOUT))


def residual(text: Column) -> Column:
    """Words that are left of an answer without the phrases and frame words of refusals."""
    out = folded(text)
    for m in MARKERS:
        out = F.replace(out, F.lit(m), F.lit(" "))
    kept = F.split(F.regexp_replace(out, PREDICATE, " "), " +")
    return F.filter(kept, lambda w: (w != "") & ~w.isin(FRAME_WORDS) & w.rlike("[\\p{L}\\p{N}]"))


def _question_words(question: Column) -> Column:
    q = folded(question)
    return F.array_distinct(F.concat(F.split(q, " +"), F.split(q, "[ /_-]+")))


def new_claims(text: Column, question: Column) -> Column:
    """Numbers, codes and names of an answer that its question does not have."""
    asked = _question_words(question)
    whole = F.regexp_replace(folded(question), "[^0-9a-z]", "")
    code = lambda w: F.regexp_replace(fold_plain(w), "[^0-9a-z]", "")
    spans = F.filter(F.regexp_extract_all(text, F.lit("([\\p{L}][\\p{L}\\p{N}_.]*\\d[\\p{L}\\p{N}_.]*)"), 1), lambda s: (F.length(code(s)) >= 2) & F.contains(whole, code(s)))
    echoed = F.split(folded(F.array_join(spans, " ")), " +")
    numbers = F.filter(residual(text), lambda w: w.rlike("\\d") & ~F.array_contains(asked, w) & ~F.array_contains(echoed, w))
    # a capital inside a sentence starts a name
    names = F.regexp_extract_all(text, F.lit("(?<=[\\p{L}\\p{N},;%)\"'] )([A-ZÇĞİÖŞÜ][\\p{L}\\p{N}_]+)"), 1)
    names = F.filter(names, lambda w: ~F.array_contains(asked, fold_plain(w)) & ~F.array_contains(echoed, fold_plain(w)) & ~fold_plain(w).isin(FRAME_WORDS))
    return F.concat(numbers, names)


def is_refusal(text: Column, question: Column | None = None) -> Column:
    """Whether an answer says that there is no answer, and nothing else: with its question it makes no new
    claim, without it fewer than three words are left. Null and blank answers are no refusal."""
    norm = folded(text)
    marked = F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(norm, m))
    nothing = F.size(residual(text)) < RESIDUAL_WORDS if question is None else F.size(new_claims(text, question)) == 0
    return F.coalesce((F.trim(text) != "") & (marked | refusal_frame(text)) & ~text.rlike(MATH) & nothing, F.lit(False))


def pure_refusal(sentence: Column) -> Column:
    """Whether a sentence is a refusal only: short, without a contrast, with less than two words of content before it."""
    f = fold_plain(sentence)
    before = F.filter(F.split(F.regexp_replace(F.regexp_extract(f, "^(.*?)bulunamadi", 1), "[^a-z0-9 ]", " "), " +"), lambda w: (w != "") & ~w.isin(FRAME_WORDS))
    words = F.size(F.regexp_extract_all(f, F.lit("([a-z0-9_]+)"), 1))
    return F.coalesce(f.rlike("bulunamadi") & f.rlike("dokuman|belge|baglam|metin") & ~f.rlike(CONTRAST) & (words <= PURE_WORDS) & (F.size(before) < 2) & ~sentence.rlike(MATH + "|\\^|="), F.lit(False))


def trim_refusals(text: Column) -> Column:
    """Without trailing pure refusals after sentences with content; an answer of refusals alone stays."""
    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: F.trim(s) != "")
    kept = F.filter(sentences, lambda s: ~pure_refusal(s))
    return F.when((F.size(kept) > 0) & (F.size(kept) < F.size(sentences)), F.array_join(kept, " ")).otherwise(text)


def fix_currency(answer: Column, context: Column) -> Column:
    """Currency words that the context lacks become its only currency code, or go if it names none; with
    several codes in the context the answer stays."""
    codes = F.filter(F.array(*[F.lit(c) for c in CURRENCIES]), lambda c: F.array_contains(F.split(F.upper(F.coalesce(context, F.lit(""))), "[^A-Z]+"), c))
    code = F.get(codes, F.lit(0))
    out = answer
    for p in CURRENCY_WORDS:
        known = F.coalesce(context, F.lit("")).rlike(f"(?U){p}")
        out = F.when(known, out).otherwise(F.regexp_replace(out, F.lit(f"(?U)\\s*{p}"), F.when(code.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), code))))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "\\s+(?='(?:dir|dır|dur|dür|tir|tır|tur|tür)\\b)", ""), "\\s+([.,;:!?])", "$1"), "\\s{2,}", " "))
    return F.when(F.size(codes) > 1, answer).otherwise(tidy)


def numbers(text: str) -> list[float]:
    """Numbers of a text; dots and commas between groups of three digits separate thousands."""
    out = []
    for raw in re.findall(r"(?<![\w.,])\d+(?:[.,]\d+)*", text or ""):
        plain = re.sub(r"[.,](?=\d{3}(?:\D|$))", "", raw)
        out.append(float(plain.replace(",", ".")) if plain.replace(",", ".").count(".") <= 1 else float(re.sub(r"[.,]", "", raw)))
    return out


def grounded(answer: Column, context: Column) -> Column:
    """Numbers of an answer that the context neither has nor yields as a sum, difference, share or change of
    two of its numbers (tolerance: half a unit or one percent)."""

    @F.pandas_udf("array<double>")
    def missing(a: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> list[float]:
            have = list(dict.fromkeys(numbers(y)))
            derived = list(have)
            for p, q in itertools.combinations(have, 2):
                derived += [p + q, abs(p - q)]
                derived += [100 * p / q, 100 * (p - q) / q] if q else []
                derived += [100 * q / p, 100 * (q - p) / p] if p else []
            return [n for n in numbers(x) if not any(abs(n - d) <= max(0.5, 0.01 * abs(d)) for d in derived)]

        return pd.Series([one(x, y) for x, y in zip(a, c)])

    return missing(answer, context)


def query_cut(text: Column, query: Column, limit: int = 1500, marker: str = " […]") -> Column:
    """A long text cut by lines: those that share a word with the query first, then from the top, in their
    order; without such lines, at the limit."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, queries: pd.Series) -> pd.Series:
        def one(t: str | None, q: str | None) -> str | None:
            if t is None or len(t) <= limit:
                return t
            terms = {w for w in re.findall(r"\w+", (q or "").lower()) if len(w) > 1 and not w.isdigit()}
            lines = t.split("\n")
            hits = [i for i, line in enumerate(lines) if terms & set(re.findall(r"\w+", line.lower()))]
            keep, room = set(), limit - len(marker)
            for i in hits:
                if len(lines[i]) + 1 <= room:
                    keep.add(i)
                    room -= len(lines[i]) + 1
            if not keep or len(lines) < 2:
                return t[: limit - len(marker)].rsplit(" ", 1)[0] + marker
            for i in (i for i in range(len(lines)) if i not in keep):
                if len(lines[i]) + 1 > room:
                    break
                keep.add(i)
                room -= len(lines[i]) + 1
            return "\n".join(lines[i] for i in sorted(keep)) + marker

        return pd.Series([one(t, q) for t, q in zip(texts, queries)])

    return cut(text, query)
