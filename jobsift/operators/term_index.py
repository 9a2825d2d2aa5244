"""Substring tests of many texts against many terms, by an inverted index.

``contains`` over a literal array costs rows x terms. Here every term is filed
under one of its n-grams, the one that texts hold least often, and a text meets
only the terms filed under a gram that it holds: an equality join of the text's
distinct grams with the index, then the exact test. Terms shorter than a gram
are filed under themselves, and a blank one matches every text (as ``contains``
has it).

A term without white space lies within a word of the text, a run between white
space and other characters that no such term holds. These terms are tested
against the distinct words of all texts only, and a text takes its matches from
its words by an equality join. Texts themselves meet the other terms alone.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast

GRAM = 3
#: Texts, about, whose gram counts choose each term's gram. They only decide
#: how many candidates are tested, never which rows match.
COUNTED = 200_000
#: Characters that separate words, unless a term without white space holds them.
SEPARATORS = [c for c in map(chr, range(128)) if c not in string.ascii_letters]
WHITE = r"[\x09-\x0D\x20]"


def grams(text: Column, n: int) -> Column:
    """The distinct substrings of length ``n``."""
    if n == 0:
        return F.array(F.lit(""))
    chars = F.split(text, "")  # a substring at a place would be found by a walk from the text's start
    following = [F.slice(chars, F.lit(k), F.length(text)) for k in range(2, n + 1)]
    whole = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), following, chars)
    return F.when(F.length(text) >= n, F.array_distinct(F.array_compact(whole))).otherwise(F.array().cast("array<string>"))


def all_grams(text: Column, lengths: list[int]) -> Column:
    return F.concat(*[grams(text, n) for n in lengths])


def filed_terms(terms: DataFrame, texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, term): every distinct term under its rarest gram."""
    n = F.least(F.length("term"), F.lit(GRAM))
    own = terms.select("term", F.explode(F.element_at(F.array(*[grams(F.col("term"), k) for k in range(GRAM + 1)]), n + 1)).alias("gram"))
    share = min(1.0, COUNTED / max(1, texts.count()))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    seen = some.select(F.explode(all_grams(F.col("text"), lengths)).alias("gram")).join(
        own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
    return (own.join(seen, "gram", "left")
               .groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram")))


def _held(texts: DataFrame, ids: list[str], terms: DataFrame, name: str) -> DataFrame:
    """(ids, owner), repeats included, of all ``texts`` (ids, text) and written
    ``terms`` (owner, term) with the term in the text."""
    size = terms.agg(F.count("*").alias("n"), F.max(F.octet_length("term")).alias("width"),
                     F.collect_set(F.least(F.length("term"), F.lit(GRAM))).alias("lengths")).first()
    if not size["n"]:
        return texts.select(*ids).join(terms.select("owner"), F.lit(False))
    lengths = sorted(size["lengths"])
    width = 64 + 4 * (size["width"] or 0)
    index = materialize(filed_terms(terms.select("term").distinct(), texts.select("text"), lengths), name)
    held = texts.select(*ids, "text", F.explode(all_grams(F.col("text"), lengths)).alias("gram"))
    found = held.join(bounded_broadcast(index, size["n"], width), "gram").filter(F.contains("text", "term")).select(*ids, "term").distinct()
    return found.join(bounded_broadcast(terms, size["n"], width), "term").select(*ids, "owner")


def _held_in_words(texts: DataFrame, ids: list[str], terms: DataFrame) -> DataFrame:
    """``_held`` for ``terms`` without white space, none of them blank."""
    kept = {r["c"] for r in terms.select(F.explode(F.split("term", "")).alias("c")).filter(
        F.col("c").isin(SEPARATORS)).distinct().collect()}  # SEPARATORS at most
    shortest = terms.agg(F.min(F.length("term"))).first()[0]
    if shortest is None:
        return texts.select(*ids).join(terms.select("owner"), F.lit(False))
    between = "[" + "".join(f"\\x{ord(c):02x}" for c in SEPARATORS if c not in kept) + "]+"
    words = F.filter(F.split("text", between), lambda w: F.length(w) >= shortest)
    words = texts.select(*ids, F.explode(F.array_distinct(words)).alias("word"))
    known = materialize(words.select(F.col("word").alias("text")).distinct(), "words")
    found = materialize(_held(known, ["text"], terms, "term-index").select(F.col("text").alias("word"), "owner").distinct(), "word-matches")
    size = found.agg(F.count("*").alias("n"), F.max(F.octet_length("word")).alias("width")).first()
    return words.join(bounded_broadcast(found, size["n"], 64 + 4 * (size["width"] or 0)), "word").select(*ids, "owner")


def matches(texts: DataFrame, ids: list[str], text: str, terms: DataFrame, lines: bool = False) -> DataFrame:
    """(ids, owner) of all ``texts`` and ``terms`` (owner, term) with the term in
    the text, both lower-cased, once each.

    With ``lines`` a text is tested line by line, so that a very long one is
    dealt out in short pieces; terms then hold no line ends. Terms, and words
    with their matches, are broadcast while their measured rows and bytes allow
    it, so texts are not shuffled; beyond that they meet by a shuffle on the
    gram or the word.
    """
    terms = materialize(terms.select("owner", F.lower("term").alias("term")).filter("term IS NOT NULL").distinct(), "terms")
    if lines and not terms.filter(F.contains("term", F.lit("\n"))).isEmpty():
        raise ValueError("terms with line ends need whole texts")
    low = F.lower(F.col(text))
    rows = texts.select(*ids, (F.explode(F.split(low, "\n")) if lines else low).alias("text")).filter("text IS NOT NULL")
    whole = (F.col("term") == "") | F.col("term").rlike(WHITE)
    return _held_in_words(rows, ids, terms.filter(~whole)).unionByName(
        _held(rows, ids, terms.filter(whole), "term-index")).distinct()


def without_matches(df: DataFrame, ids: list[str], text: str, entries: DataFrame) -> DataFrame:
    """Rows of ``df`` whose text holds none of the ``entries`` (term); blank
    entries are ignored. ``ids`` name a row and are not null."""
    terms = entries.select(F.lit(1).alias("owner"), "term").filter(F.trim("term") != "")
    return df.join(matches(df, ids, text, terms).select(*ids), ids, "left_anti")
