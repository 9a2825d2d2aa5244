"""Location tests against a table of many places, by equality joins.

The tests of ``classify.location_match_parts`` and ``location_match_simple`` are
disjunctions; each branch becomes a key:

* the city in a part (or the text): the terms index of ``term_index``;
* a part that ends with the state: the part's endings, of the lengths that
  state texts have;
* ", " and the state anywhere: what follows each ", ", cut to those lengths.

Pairs of the branches are united once each, so the cost is that of the pairs and
not of rows x places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .term_index import matches


def _parts(loc: str) -> Column:
    """Parts of a location text that do not say remote."""
    parts = F.transform(F.split(F.lower(F.col(loc)), ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: ~p.contains("remote"))


def _endings(text: Column, lengths: list[int]) -> Column:
    return F.array_compact(F.array(*[F.when(F.length(text) >= n, F.substring(text, F.length(text) - n + 1, F.lit(n)) if n else F.lit(""))
                                     for n in lengths]))


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i + 2, F.lit(n))


def _after_commas(text: Column, lengths: list[int]) -> Column:
    at = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(2)) == ", ")
    pieces = [F.transform(at, _cut(text, n)) for n in lengths]
    return F.when(F.length(text) > 0, F.concat(*pieces)).otherwise(F.array().cast("array<string>"))


def _states(places: DataFrame) -> tuple[DataFrame, list[int]]:
    states = materialize(places.select(F.col("place_id").alias("owner"), F.lower("state").alias("key")).filter(
        "key IS NOT NULL").distinct(), "states")
    return states, sorted(r["n"] for r in states.select(F.length("key").alias("n")).distinct().collect())


def _pairs(df: DataFrame, ids: list[str], keys: Column, states: DataFrame) -> DataFrame:
    held = df.select(*ids, F.explode(F.array_distinct(keys)).alias("key"))
    return held.join(states, "key").select(*ids, "owner")


def places_by_parts(df: DataFrame, ids: list[str], loc: str, places: DataFrame) -> DataFrame:
    """(ids, place_id): places (place_id, city, state) that a non-remote request
    finds in the location text by the multi-part test. Texts that are null
    match nothing."""
    states, lengths = _states(places)
    rows = df.select(*ids, F.lower(F.col(loc)).alias("text"), _parts(loc).alias("parts"))
    each = rows.select(*ids, F.explode("parts").alias("part"))
    cities = matches(each, ids, "part", places.select(F.col("place_id").alias("owner"), F.col("city").alias("term")))
    found = cities
    if lengths:
        ends = _pairs(each, ids, _endings(F.col("part"), lengths), states)
        found = found.unionByName(ends).unionByName(_pairs(rows, ids, _after_commas(F.col("text"), lengths), states))
    return found.distinct().withColumnRenamed("owner", "place_id")


def places_by_text(df: DataFrame, ids: list[str], loc: str, places: DataFrame) -> DataFrame:
    """(ids, place_id) by the simple test: the city in the text, or ", " and the
    state."""
    states, lengths = _states(places)
    rows = df.select(*ids, F.lower(F.col(loc)).alias("text"))
    found = matches(rows, ids, "text", places.select(F.col("place_id").alias("owner"), F.col("city").alias("term")))
    if lengths:
        found = found.unionByName(_pairs(rows, ids, _after_commas(F.col("text"), lengths), states))
    return found.distinct().withColumnRenamed("owner", "place_id")
