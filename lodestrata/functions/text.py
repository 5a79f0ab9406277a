"""Text functions as column expressions.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Turkish letters and what they fold to.
FOLD_FROM, FOLD_TO = "çğıöşü", "cgiosu"
WORD = "[\\p{L}\\p{N}_]+"
DOTTED = "[\\p{L}]+\\d+(?:\\.\\d+)+"
# Lengths that tell field values apart, and text budgets.
KEY_MAX, CONTEXT_MAX, NARRATIVE_CUT = 60, 400, 350
CHUNK_CHARS, CONTEXT_CHARS = 1500, 6000


def tr_lower(c: Column) -> Column:
    """Turkish lower case: İ to i, I to ı, the rest as usual."""
    return F.lower(F.translate(c, "İI", "iı"))


def fold(c: Column) -> Column:
    """Accents of the Turkish alphabet dropped (after lower case)."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize(c: Column) -> Column:
    """Lower case and fold: the form in which rules and vocabularies compare."""
    return fold(tr_lower(c))


def strip_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks (Arrow; there is no built-in)."""
    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))

    return strip(c)


def route_form(c: Column) -> Column:
    """The form in which questions are routed: normalize, then marks dropped."""
    return strip_marks(normalize(c))


def fold_plain(c: Column) -> Column:
    """Plain lower case with nine folded letters: the form for refusal patterns."""
    return F.translate(F.lower(c), "ıüöşğçâîû", "iuosgcaiu")


def tokens(c: Column) -> Column:
    """Words in order, then whole dotted identifiers such as g4.1."""
    low = tr_lower(c)
    return F.concat(F.regexp_extract_all(low, F.lit(f"({WORD})"), 1), F.regexp_extract_all(low, F.lit(f"({DOTTED})"), 1))


def plain_words(c: Column) -> Column:
    """Words in order, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def answer_form(c: Column) -> Column:
    """Turkish lower case, punctuation as space, white space squeezed: the form that metrics compare."""
    return F.trim(F.regexp_replace(F.regexp_replace(tr_lower(c), "[^\\p{L}\\p{N}\\s+\\-*/=<>%]", " "), "\\s+", " "))


def word_start(c: Column, *patterns: str) -> Column:
    """Whether any pattern stands at the start of a word of a normalized text."""
    return c.rlike("(?<![a-z0-9])(?:" + "|".join(patterns) + ")")


def contains_token(c: Column, token: str) -> Column:
    """A token as a word; longer ones may have a suffix: up to three letters from length 3, any from 5.
    A token without word characters is a plain substring."""
    import re

    if not re.search(r"\w", token):
        return c.contains(token)
    tail = "" if len(token) <= 2 else "\\w{0,3}" if len(token) <= 4 else "\\w*"
    return c.rlike(f"(?U)(?<!\\w){re.escape(token)}{tail}(?!\\w)")


def field_band(value: Column) -> Column:
    """KEY, CONTEXT or NARRATIVE, by the length of a field's value."""
    n = F.length(value)
    return F.when(n <= KEY_MAX, "KEY").when(n <= CONTEXT_MAX, "CONTEXT").otherwise("NARRATIVE")


def narrative(value: Column) -> Column:
    """Long values cut at the last space before the limit, with an ellipsis."""
    cut = F.regexp_replace(F.substring(value, 1, NARRATIVE_CUT), " [^ ]*$", "")
    return F.when(F.length(value) > CONTEXT_MAX, F.concat(cut, F.lit("…"))).otherwise(value)


def truncate(text: Column, limit: int = CHUNK_CHARS, marker: str = " […]") -> Column:
    """Cut at the last space if that lies beyond 60 % of the limit, else at the limit; then a marker."""
    head = F.substring(text, 1, limit)
    at = F.length(head) - F.coalesce(F.nullif(F.instr(F.reverse(head), " "), F.lit(0)), F.lit(limit + 1))
    cut = F.when(at > int(limit * 0.6), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(cut), F.lit(marker))).otherwise(text)


def key_values(text: Column) -> Column:
    """The values of short ``field: value`` lines, joined by line ends."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(": "))
    values = F.filter(F.transform(lines, lambda x: F.trim(F.get(F.split(x, ": ", 2), F.lit(1)))), lambda v: F.length(v).between(1, KEY_MAX))
    return F.array_join(values, "\n")


def key_tokens(text: Column) -> Column:
    """Distinct tokens of the values of short ``field: value`` lines."""
    return F.array_distinct(tokens(key_values(text)))


def unrepeat(text: Column) -> Column:
    """Without a leading block of two or more lines that stands twice in a row: the longest such block."""
    lines = F.split(text, "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    sizes = F.when(half >= 2, F.filter(F.sequence(F.lit(2), half), lambda k: F.slice(lines, 1, k) == F.slice(lines, k + 1, k)))
    k = F.coalesce(F.array_max(sizes), F.lit(0))
    return F.when(k > 0, F.array_join(F.slice(lines, k + 1, F.size(lines)), "\n")).otherwise(text)


def section_number(text: Column) -> Column:
    """The dotted section number at the start of a text's first line; null if there is none."""
    return F.nullif(F.regexp_extract(F.get(F.split(text, "\n"), F.lit(0)), "^\\s*-?(\\d+(?:\\.\\d+)+)\\.?\\s", 1), F.lit(""))


def column_words(name: Column) -> Column:
    """Parts of a column name: camel case, acronyms, digits."""
    return F.regexp_extract_all(name, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\\d+)"), 1)


def sources(found: Column) -> Column:
    """Distinct source names of a list joined by semicolons, without closing parentheses."""
    parts = F.transform(F.split(found, ";"), lambda x: F.trim(F.regexp_replace(x, "\\s*\\([^()]*\\)\\s*$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of keywords that the text holds, both normalized; null without keywords."""
    folded = normalize(text)
    hits = F.size(F.filter(keywords, lambda k: F.contains(folded, normalize(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords))


def retry_seconds(text: Column) -> Column:
    """Seconds of a waiting time such as 5m47.76s; null if there is none."""
    part = lambda unit: F.try_to_number(F.nullif(F.regexp_extract(text, f"(\\d+(?:\\.\\d+)?){unit}", 1), F.lit("")), F.lit("999999999.999999")).cast("double")
    total = F.coalesce(part("h(?![a-z])"), F.lit(0.0)) * 3600 + F.coalesce(part("m(?![a-z])"), F.lit(0.0)) * 60 + F.coalesce(part("s"), F.lit(0.0))
    return F.when(text.rlike("\\d+(\\.\\d+)?[hms]"), total)


def code_form(code: Column) -> Column:
    """Code without comments and with squeezed white space, to tell repeats."""
    return F.trim(F.regexp_replace(F.regexp_replace(code, "(?m)#.*$", ""), "\\s+", " "))


def unfence(text: Column) -> Column:
    """The content of the first code fence; the trimmed text if there is none."""
    inner = F.regexp_extract(text, "(?s)```(?:[a-zA-Z]*\\n)?(.*?)```", 1)
    return F.btrim(F.when(inner != "", inner).otherwise(text), F.lit(" \n\t\r"))


def distribution(text: Column) -> Column:
    """(name, value) pairs of prose such as ``Name: 1.234`` or ``Name (12)``; null below two pairs."""
    pattern = "([\\p{L}][\\p{L} .&/-]*?)\\s*(?::|\\()\\s*(\\d{1,3}(?:\\.\\d{3})+|\\d+)(?:,\\d+)?"
    names, values = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.trim(n).alias("name"), F.translate(v, ".", "").cast("double").alias("value")))
    return F.when(F.size(pairs) >= 2, pairs)


def keep_script(text: Column, share: float = 0.4) -> Column:
    """Each line up to its first run of foreign letters (neither Latin nor Greek); a line that would lose
    more than the given share stays whole."""
    cut = lambda line: F.regexp_replace(line, "[\\p{L}&&[^\\p{IsLatin}\\p{IsGreek}]].*$", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.length(cut(x)) >= share * F.length(x), F.rtrim(cut(x))).otherwise(x))
    return F.array_join(lines, "\n")


# Function words and query phrases that ranking leaves out, and synonyms.
STOPWORDS = [
    "acaba", "ama", "ancak", "bana", "bazı", "belki", "ben", "beni", "benim", "bir", "biraz", "biz", "bize", "bu",
    "buna", "bunu", "bunun", "da", "daha", "de", "değil", "diye", "en", "gibi", "hem", "her", "için", "ile", "ise",
    "kadar", "ki", "mi", "mı", "mu", "mü", "ne", "neden", "nasıl", "o", "ona", "onu", "onun", "olan", "olarak",
    "sen", "siz", "şu", "ve", "veya", "ya", "yani", "çok", "iyi", "var", "arıyorum", "istiyorum", "lazım", "bul",
    "bulur", "öner", "önerir", "musun", "misin", "müsün", "mısın", "nedir", "nelerdir", "neler", "neyi", "nasıldır",
    "kadardır", "midir", "mıdır", "mudur", "müdür", "içinde", "içindeki", "bazında", "önce", "vardı", "biri",
    "birinde", "birini", "birden",
]
SYNONYMS = {
    "dişçi": "diş hekimi",
    "göz doktoru": "göz hekimi",
    "çocuk doktoru": "çocuk sağlığı uzmanı",
    "kbb": "kulak burun boğaz",
    "cildiye": "dermatoloji",
}


def with_synonyms(low: Column) -> Column:
    """A lower-case text with each known term as its canonical one; the last word may carry a suffix.
    Longer terms come first."""
    out = low
    for term in sorted(SYNONYMS, key=len, reverse=True):
        out = F.regexp_replace(out, f"(?U)(?<!\\w){term}\\w*", SYNONYMS[term])
    return out


def content_tokens(c: Column, stem=None) -> Column:
    """Tokens for ranking: synonyms replaced, function words left out by their surface form, then folded.
    stem: an injected function of a column to a column for single tokens; a stem that would be a function
    word is not used."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(w.translate(str.maketrans(FOLD_FROM, FOLD_TO)) for w in STOPWORDS)])
    kept = F.filter(tokens(with_synonyms(tr_lower(c))), lambda t: ~F.array_contains(stop, fold(t)))
    if stem is None:
        return F.transform(kept, fold)
    return F.transform(kept, lambda t: F.when(F.array_contains(stop, fold(stem(t))), fold(t)).otherwise(fold(stem(t))))


def candidate_word(word: Column) -> Column:
    """Not a number, at least two characters, not a function word."""
    stop = F.array(*[F.lit(w.translate(str.maketrans(FOLD_FROM, FOLD_TO))) for w in STOPWORDS])
    return ~word.rlike("^\\d+$") & (F.length(word) >= 2) & ~F.array_contains(stop, normalize(word))


def related_words(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one word starts the other, or both share a start of the given length."""
    return a.startswith(b) | b.startswith(a) | ((F.length(a) >= least) & (F.substring(a, 1, least) == F.substring(b, 1, least)))


def score_band(score: Column) -> Column:
    """A score held to [0, 1] as high (from 0.66), middle (from 0.33) or low."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(s >= 0.66, "high").when(s >= 0.33, "middle").otherwise("low")


def set_name(path: Column) -> Column:
    """The name of a file without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def meaningful(question: Column) -> Column:
    """At least two word characters."""
    return F.length(F.regexp_replace(question, "(?U)[^\\w]", "")) >= 2
