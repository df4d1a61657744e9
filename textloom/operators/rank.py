"""Relevance ranking, priority orders and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf(n: Column, df: Column) -> Column:
    """Always positive weight of a term that ``df`` of ``n`` texts hold."""
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _count_of(text: Column, term: str) -> Column:
    """Occurrences that don't overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term)))) / len(term)


def document_frequency(df: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """``term, df, idf``: texts that hold each term as a substring. One pass, one partial aggregate."""
    aggs = [F.count_if(F.contains(text, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)]
    row = df.agg(F.count("*").alias("n"), *aggs)
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))).alias("p")
    return row.select("n", pairs).select("p.term", "p.df", F.round(idf(F.greatest("n", F.lit(1)), F.col("p.df")), 6).alias("idf"))


def relevance_rank(df: DataFrame, path: Column, body: Column, query: str, extra: list[str] | None = None, symbols: Column | None = None) -> DataFrame:
    """Score files against a query: ``path, score``, positive scores only.

    Sum over terms of (1 + ln count) * idf, 25 times the idf of terms among the
    base name's words, 100 for each symbol named in the query, 1000 for paths
    in ``extra``. Terms are substrings. Frequencies are one row, joined back by
    broadcast; texts are read twice and never shuffled.
    """
    import re

    words = set(re.findall(r"[A-Za-z0-9_]+", query))
    terms = sorted({w.lower() for w in words})
    names = F.coalesce(symbols, F.array().cast("array<string>")) if symbols is not None else F.array().cast("array<string>")
    hay = F.lower(F.concat_ws(" ", path, body, F.array_join(names, " ")))
    stem = F.regexp_extract_all(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    rows = df.select(path.alias("path"), stem.alias("stem"), names.alias("names"), *(_count_of(hay, t).alias(f"c{i}") for i, t in enumerate(terms)))
    stats = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), *(F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    weights = stats.select(*(idf(F.col("n"), F.col(f"d{i}")).alias(f"w{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        score = score + F.when(F.col(f"c{i}") > 0, (1 + F.log(F.col(f"c{i}"))) * F.col(f"w{i}")).otherwise(0.0) + F.when(F.array_contains("stem", t), 25 * F.col(f"w{i}")).otherwise(0.0)
    exact = F.array(*(F.lit(w) for w in sorted(words))) if words else F.array().cast("array<string>")
    score = score + 100.0 * F.size(F.filter("names", lambda s: F.array_contains(exact, s)))
    if extra:
        score = score + F.when(F.col("path").isin(extra), 1000.0).otherwise(0.0)
    # one row of weights: a broadcast of a single row
    scored = rows.join(F.broadcast(weights)).select("path", F.round(score, 6).alias("score"))
    return scored.where("score > 0")


def dominant(df: DataFrame, group: str, value: str, is_code: Column, share: float = 0.10, ord_col: str = "ord") -> DataFrame:
    """Per group its commonest code value if code holds ``share`` of it, else its commonest value; ties to the first seen."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(ord_col).alias("first"), F.first(is_code).alias("code"))
    best = lambda cond: F.max(F.when(cond, F.struct(F.col("n"), (-F.col("first")).alias("o"), F.col(value).alias("v"))))
    out = counts.groupBy(group).agg(best(F.lit(True)).alias("any"), best(F.col("code")).alias("coded"), F.sum(F.when(F.col("code"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("t"))
    return out.select(group, F.when(F.col("c") / F.col("t") >= share, F.col("coded.v")).otherwise(F.col("any.v")).alias(value), "c", "t")


def representative(df: DataFrame, group: str, value: Column, preference: list[Column]) -> DataFrame:
    """Per group the value whose preference tuple is smallest."""
    return df.groupBy(group).agg(F.min_by(value, F.struct(*(p.alias(f"p{i}") for i, p in enumerate(preference)))).alias("value"))
