"""Rules that answer fixed kinds of questions, as (trigger, plan) pairs over columns bound by role.

The first rule whose trigger holds and whose role the table has gives the plan. Each result has the
columns operation, name, value; the operation codes are stable.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates
from . import signals
from .routing import plain


@dataclass
class Roles:
    """Columns of a table by what they mean; None where it has none."""

    flag: str | None = None
    years: str | None = None
    sector: str | None = None
    kind: str | None = None
    modes: str | None = None
    languages: str | None = None
    city: str | None = None
    occupation: str | None = None
    statistics: dict = field(default_factory=dict)


def bind(df: DataFrame) -> Roles:
    """Roles by column name, first match in column order."""
    def find(*parts: str) -> str | None:
        return next((c for c in df.columns if any(p in c.lower() for p in parts)), None)

    return Roles(
        flag=find("autoapprove"), years=find("experience.years", "experience", "year"), sector=find("sector", "industry", "kategori", "category"), kind=find("profiletype", "type"),
        modes=find("servicemode"), languages=find("language"), city=find("city"), occupation=find("occupation"),
    )


def _start(q: str, *words: str) -> bool:
    return re.search("(?<![a-z0-9])(?:" + "|".join(words) + ")", q) is not None


def _rows(df: DataFrame, operation: str, name, value) -> DataFrame:
    return df.select(F.lit(operation).alias("operation"), name.cast("string").alias("name"), value.cast("double").alias("value"))


def _scalar(df: DataFrame, operation: str, **aggs) -> DataFrame:
    one = df.agg(*[a.cast("double").alias(n) for n, a in aggs.items()])
    return one.select(F.lit(operation).alias("operation"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in aggs])))


def _counts(df: DataFrame, operation: str, column: str, explode: bool = False) -> DataFrame:
    out = aggregates.exploded_counts(df, column) if explode else aggregates.value_counts(df, column)
    return _rows(out, operation, F.col("value"), F.col("n"))


def top_n(q: str) -> int:
    """The number that a question asks for; 5 for 'the most', else 3."""
    m = re.search(r"(?:ilk|top)\s*(\d+)|en cok\D*(\d+)", q)
    return int(next(g for g in m.groups() if g)) if m else 5 if "en cok" in q else 3


def mentioned(q: str, values: list[str]) -> list[str]:
    """Values that a question names, without those inside a longer one that it names."""
    spans = [(m.start(), m.end(), v) for v in values if v for m in re.finditer(re.escape(plain(v)), q)]
    kept = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and (o[1] - o[0]) > (s[1] - s[0]) for o in spans)]
    return list(dict.fromkeys(v for _, _, v in kept))


def _flag(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    if not r.flag or "autoapprove" not in q:
        return None
    yes = F.col(f"`{r.flag}`") == F.lit(_start(q, "true", "otomatik", "aktif", "evet"))
    if re.search("oran[ıi]|yuzde|%", q):
        return _scalar(df, "ratio_autoapprove", pct=F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.round(100.0 * F.count_if(yes) / F.count(F.lit(1)), 1)))
    return _scalar(df, "filtered_count_autoapprove", n=F.count_if(yes))


def _years(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    if not r.years or not re.search("deneyim|experience|year", q):
        return None
    c = F.col(f"`{r.years}`")
    if re.search("minimum.*maksimum|min.*max|en (az|dusuk).*en (fazla|cok|yuksek)", q):
        return _scalar(df, "min_max_experience", low=F.min(c).cast("int"), high=F.max(c).cast("int"))
    if "ortalama" in q:
        return _scalar(df, "mean_experience", mean=F.round(F.avg(c), 2))
    return None


def _sector(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    if not r.sector or not _start(q, "sektor", "alan", "kategori") or _start(q, *signals.SECTOR_COMPLEX) or re.search(r"(?<![a-z0-9])\d+\s*dk(?![a-z0-9])", q):
        return None
    sector = F.col(f"`{r.sector}`")
    values = df.select(sector).where(F.lit(q).contains(text.normalize(sector))).distinct().collect()  # parts of the question
    named = mentioned(q, [x[0] for x in values])
    if len(named) != 1:
        return None
    return _scalar(df, "filtered_count_sector", n=F.count_if(sector == named[0]))


def _lists(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    if r.kind and re.search("profiletype|profil tipi|profil turu", q):
        return _counts(df, "value_counts_profiletype", r.kind)
    if r.modes and re.search("servicemode|hizmet mod|yerinde hizmet", q):
        return _counts(df, "explode_servicemodes", r.modes, True)
    if r.languages and (_start(q, "language") or re.search(r"\b(dil|diller)\b", q)):
        return _counts(df, "explode_languages", r.languages, True)
    return None


def _distinct(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    if not (_start(q, "sehir", "city", "iller", "kac farkli", "farkli") or " il " in q):
        return None
    for words, column, code in ((("sehir", "city", "iller"), r.city, "nunique_city_topn"), (("sektor", "sector"), r.sector, "nunique_sector"), (("meslek", "occupation"), r.occupation, "nunique_occupation")):
        if column and (_start(q, *words) or (code == "nunique_city_topn" and " il " in q)):
            if code == "nunique_city_topn":
                top = aggregates.distinct_and_top(df, column, top_n(q))
                total = _scalar(df, code, n_distinct=F.count_distinct(F.col(f"`{column}`")))
                return total.unionByName(_rows(top, code, F.col("value"), F.col("n")))
            return _scalar(df, code, n_distinct=F.count_distinct(F.col(f"`{column}`")))
    return None


def _total(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    return _scalar(df, "total_count", n=F.count(F.lit(1))) if re.search("toplam.*(profil|kayit|veri)|kac profil|profil sayisi", q) else None


def _stored(q: str, df: DataFrame, r: Roles) -> DataFrame | None:
    s, spark = r.statistics, df.sparkSession
    if not s:
        return None
    make = lambda op, rows: spark.createDataFrame([(op, n, float(v)) for n, v in rows], "operation string, name string, value double")
    if "profileCount" in s and "profil" in q and _start(q, "toplam", "kac"):
        return make("meta_profile_count", [("n", s["profileCount"])])
    for code, key, word in (("meta_sector_count", "sectorCount", "sektor"), ("meta_occupation_count", "occupationCount", "meslek")):
        if key in s and _start(q, word) and _start(q, "farkli"):
            return make(code, [("n", s[key])])
    if "sectorDistribution" in s and ("sectordistribution" in q or _start(q, "sektor")):
        spread = s["sectorDistribution"]
        m = re.search(r"(\d+)\s*profil", q)
        if m:
            n = int(m[1])
            return make("meta_sector_distribution_filter", [(k, v) for k, v in sorted(spread.items()) if v == n])
        return make("meta_sector_distribution", sorted(spread.items(), key=lambda x: (-x[1], x[0])))
    return None


RULES: list[Callable[[str, DataFrame, Roles], DataFrame | None]] = [_flag, _years, _sector, _lists, _distinct, _total, _stored]


def execute(question: str, df: DataFrame, roles: Roles | None = None) -> DataFrame | None:
    """The first rule's result for a question over the chosen table; None if no rule applies."""
    roles = roles or bind(df)
    q = plain(question.strip())
    for rule in RULES:
        out = rule(q, df, roles)
        if out is not None:
            return out
    return None
