"""Turkish stems: suffixes stripped from the right, under vowel harmony and buffer letters.

The rules are those of the published Turkish suffix grammar of the Snowball project: nominal verb suffixes first,
then noun suffixes, then the last consonant. A word of one syllable is its own stem. Words are stemmed once,
as a table of distinct tokens that is joined back, not once an occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Vowels, those that may precede a suffix's vowel, last consonants and what they become.
VOWELS, CLOSE = "aeıioöuü", "ıiuü"
HARMONY = {"a": "aıou", "e": "eiöü", "ı": "aı", "i": "ei", "o": "ou", "ö": "öü", "u": "ou", "ü": "öü"}
HARDENED = {"b": "p", "c": "ç", "d": "t", "ğ": "k"}
WHOLE = ("ad", "soyad")


def _forms(*patterns: str) -> tuple[str, ...]:
    """Endings of patterns in which A stands for a or e and U for a close vowel, the longest first."""
    out = []
    for p in patterns:
        fits = ["ae"[i] if "A" in p else "" for i in range(2)] if "A" in p else list(CLOSE) if "U" in p else [""]
        out += [p.replace("A", v).replace("U", v) for v in fits]
    return tuple(sorted(out, key=len, reverse=True))


# Suffixes as (endings, whether they follow vowel harmony, buffer letter before them).
SUFFIXES: dict[str, tuple[tuple[str, ...], bool, str]] = {
    "possessive": (_forms("mUz", "nUz", "m", "n"), False, "U"),
    "sU": (_forms("U"), True, "s"),
    "lArI": (("leri", "ları"), False, ""),
    "yU": (_forms("U"), True, "y"),
    "nU": (_forms("nU"), True, ""),
    "nUn": (_forms("Un"), True, "n"),
    "yA": (_forms("A"), True, "y"),
    "nA": (_forms("nA"), True, ""),
    "DA": (_forms("dA", "tA"), True, ""),
    "ndA": (_forms("ndA"), True, ""),
    "DAn": (_forms("dAn", "tAn"), True, ""),
    "ndAn": (_forms("ndAn"), True, ""),
    "ylA": (_forms("lA"), True, "y"),
    "ki": (("ki",), False, ""),
    "ncA": (_forms("cA"), True, "n"),
    "yUm": (_forms("Um"), True, "y"),
    "sUn": (_forms("sUn"), True, ""),
    "yUz": (_forms("Uz"), True, "y"),
    "sUnUz": (_forms("sUnUz"), False, ""),
    "lAr": (_forms("lAr"), True, ""),
    "nUz": (_forms("nUz"), True, ""),
    "DUr": (_forms("tUr", "dUr"), True, ""),
    "cAsInA": (("casına", "cesine"), False, ""),
    "yDU": (_forms("tUm", "dUm", "tUn", "dUn", "tUk", "dUk", "tU", "dU"), True, "y"),
    "ysA": (_forms("sAm", "sAn", "sAk", "sA"), False, "y"),
    "ymUş": (_forms("mUş"), True, "y"),
    "yken": (("ken",), False, "y"),
}


class _Word:
    """A word, a cursor that moves to the left over suffixes, and the place where the open part ends."""

    def __init__(self, word: str):
        self.word, self.at, self.end = word, len(word), len(word)

    def harmonic(self) -> bool:
        head = self.word[: self.at]
        last = max((i for i, c in enumerate(head) if c in VOWELS), default=-1)
        return last >= 0 and any(c in HARMONY[head[last]] for c in head[:last])

    def buffered(self, at: int, letter: str) -> int:
        """The cursor before an optional buffer letter; -1 where neither form fits."""
        is_buffer = (lambda c: c in CLOSE) if letter == "U" else (lambda c: c == letter)
        wanted = (lambda c: c not in VOWELS) if letter == "U" else (lambda c: c in VOWELS)
        if at >= 2 and wanted(self.word[at - 2]):
            return at - 1 if is_buffer(self.word[at - 1]) else at
        return -1

    def over(self, *names: str) -> bool:
        """Move over the first of the suffixes that stands before the cursor."""
        for name in names:
            endings, harmony, letter = SUFFIXES[name]
            if harmony and not self.harmonic():
                continue
            found = next((e for e in endings if self.word.endswith(e, 0, self.at)), None)
            if found is None:
                continue
            at = self.at - len(found)
            if letter:
                at = self.buffered(at, letter)
            if at >= 0:
                self.at = at
                return True
        return False

    def open(self) -> bool:
        self.end = self.at
        return True

    def drop(self) -> bool:
        """Delete what lies between the cursor and the end of the open part."""
        self.word = self.word[: self.at] + self.word[self.end :]
        self.end = self.at
        return True

    def first_of(self, *ways: Callable[[], bool]) -> bool:
        """The first way that goes through; the cursor of one that does not is put back, its deletions stay."""
        right = len(self.word) - self.at
        for way in ways:
            if way():
                return True
            self.at = len(self.word) - right
        return False

    def perhaps(self, way: Callable[[], bool]) -> bool:
        self.first_of(way)
        return True

    def strip(self, *names: str) -> bool:
        return self.open() and self.over(*names) and self.drop()

    # rules

    def before_plural(self) -> bool:
        """A plural before what is gone, and a chain before it."""
        return self.perhaps(lambda: self.strip("lAr") and self.chain())

    def owned(self) -> bool:
        return self.strip("possessive", "sU") and self.before_plural()

    def chain(self) -> bool:
        """Suffix chains that end with -ki."""

        def place() -> bool:
            plural = lambda: self.over("lAr") and self.drop() and self.perhaps(self.chain)
            own = lambda: self.over("possessive") and self.drop() and self.before_plural()
            return self.over("DA") and self.drop() and self.perhaps(lambda: self.open() and self.first_of(plural, own))

        def genitive() -> bool:
            group = lambda: self.over("lArI") and self.drop()
            return self.over("nUn") and self.drop() and self.perhaps(lambda: self.open() and self.first_of(group, self.owned, self.chain))

        return self.open() and self.over("ki") and self.first_of(place, genitive, lambda: self.over("ndA") and self.inner())

    def inner(self) -> bool:
        """What may stand before a place that is still open."""
        group = lambda: self.over("lArI") and self.drop()
        own = lambda: self.over("sU") and self.drop() and self.before_plural()
        return self.first_of(group, own, self.chain)

    def verb(self) -> bool:
        """Nominal verb suffixes; whether noun suffixes may follow."""
        follow = True
        person = lambda *names: self.over(*names) or True

        def plural() -> bool:
            nonlocal follow
            if not (self.over("lAr") and self.drop() and self.perhaps(lambda: self.open() and self.over("DUr", "yDU", "ysA", "ymUş"))):
                return False
            follow = False
            return True

        persons = ("sUnUz", "lAr", "yUm", "sUn", "yUz")
        told = lambda: self.open() and self.over("ymUş")
        ways = [
            lambda: self.over("ymUş", "yDU", "ysA", "yken"),
            lambda: self.over("cAsInA") and person(*persons) and self.over("ymUş"),
            plural,
            lambda: self.over("nUz") and self.over("yDU", "ysA"),
            lambda: self.over("sUnUz", "yUz", "sUn", "yUm") and self.drop() and self.perhaps(told),
            lambda: self.over("DUr") and self.drop() and self.perhaps(lambda: self.open() and person(*persons) and self.over("ymUş")),
        ]
        self.open()
        if self.first_of(*ways):
            self.drop()
        return follow

    def noun(self) -> None:
        strip, over, perhaps, first_of = self.strip, self.over, self.perhaps, self.first_of

        def ablative() -> bool:
            own = lambda: over("possessive") and self.drop() and self.before_plural()
            plural = lambda: over("lAr") and self.drop() and perhaps(self.chain)
            return strip("DAn") and perhaps(lambda: self.open() and first_of(own, plural, self.chain))

        def case() -> bool:
            own = lambda: over("possessive") and self.drop() and perhaps(lambda: self.open() and over("lAr"))
            rest = lambda: self.open() and first_of(own, lambda: over("lAr")) and self.drop() and self.open() and self.chain()
            return strip("DA", "yU", "yA") and perhaps(rest)

        plural_chain = lambda: strip("lAr") and self.chain()
        first_of(
            lambda: strip("lAr") and perhaps(self.chain),
            lambda: strip("ncA") and perhaps(lambda: first_of(lambda: strip("lArI"), self.owned, plural_chain)),
            lambda: self.open() and over("ndA", "nA") and self.inner(),
            lambda: self.open() and over("ndAn", "nU") and first_of(lambda: over("sU") and self.drop() and self.before_plural(), lambda: over("lArI")),
            ablative,
            lambda: strip("nUn", "ylA") and perhaps(lambda: first_of(plural_chain, self.owned, self.chain)),
            lambda: strip("lArI"),
            self.chain,
            case,
            self.owned,
        )


def stem(word: str) -> str:
    """The stem of a lower-case word with its Turkish letters."""
    if sum(c in VOWELS for c in word) < 2:
        return word
    w = _Word(word)
    follow = w.verb()
    w.at = len(w.word)
    if follow:
        w.noun()
    out = w.word
    if out in WHOLE or not out:
        return out
    last = next((c for c in reversed(out) if c in VOWELS), None)
    if out[-1] in "dg" and last:
        return out + next(u for u, group in zip("ıiuü", ("aı", "ei", "ou", "öü")) if last in group)
    return out[:-1] + HARDENED.get(out[-1], out[-1])


_FOLD = str.maketrans(text.FOLD_FROM, text.FOLD_TO)
#: Stems of function words: another word with such a stem is represented by its surface.
STOP_STEMS = {stem(w).translate(_FOLD) for w in text.STOPWORDS}
#: Marks a token that is a stem already.
DONE = "\x01"


def index_form(token: str) -> str:
    """The form in which a token is indexed and searched."""
    if token.startswith(DONE):
        return token[1:]
    out = stem(token).translate(_FOLD)
    return token.translate(_FOLD) if out in STOP_STEMS else out


def index_forms(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, form) of the distinct non-null tokens of a table."""
    @F.pandas_udf("string")
    def form(t: pd.Series) -> pd.Series:
        return t.map(index_form)

    return tokens.select(F.col(token).alias("token")).where("token is not null").distinct().select("token", form("token").alias("form"))


def _composed(c: Column) -> Column:
    """Turkish letters that are written as a letter and a combining mark, as one letter."""
    marks = {"\u0307": ("Ii", "İi"), "\u0327": ("CcSs", "ÇçŞş"), "\u0306": ("Gg", "Ğğ"), "\u0308": ("OoUu", "ÖöÜü")}
    out = c
    for mark, (plain, whole) in marks.items():
        for x, y in zip(plain, whole):
            out = F.replace(out, F.lit(x + mark), F.lit(y))
    return F.when(c.rlike("[" + "".join(marks) + "]"), out).otherwise(c)


def _synonyms(joined: Column) -> Column:
    """Tokens, joined by spaces, with each known term as the stems of its canonical one. A term is matched
    with and without accents, and its last word may carry a suffix; terms of more words come first."""
    out = joined
    for term in sorted(text.SYNONYMS, key=lambda t: -len(t.split())):
        pattern = " ".join("".join(f"[{c}{text.FOLD_FROM[text.FOLD_TO.index(c)]}]" if c in text.FOLD_TO else c for c in w) for w in term.translate(_FOLD).split())
        canonical = " ".join(DONE + stem(w).translate(_FOLD) for w in text.SYNONYMS[term].split())
        out = F.regexp_replace(out, f"(?<![^ ]){pattern}[^ ]*", canonical)
    return out


def surface_tokens(c: Column) -> Column:
    """Tokens in order, before stemming: lower case, function words left out by their folded surface, known
    terms as their canonical ones. Null counts as empty."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(w.translate(_FOLD) for w in text.STOPWORDS)])
    kept = F.filter(text.tokens(_composed(F.coalesce(c, F.lit("")))), lambda t: ~F.array_contains(stop, text.fold(t)))
    return F.filter(F.split(_synonyms(F.array_join(kept, " ")), " "), lambda t: t != "")


def search_tokens(rows: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    """rows with an array of index forms of a text column: for questions and other short tables, whose distinct
    tokens are stemmed as one table and looked up as a map of at most that many entries a row."""
    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return s.map(lambda ts: [known.get(t) or known.setdefault(t, index_form(t)) for t in ts])

    return rows.withColumn(out, forms(surface_tokens(F.col(column))))
