"""Queries for many roles and many places (C2, C4, C5 as joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places, term_index
from ..sources.fixtures import postings, table
from . import oracle_sql as O
from .catalog import register

# ---- C2: every role whose terms stand in a posting -------------------------------------
#: Every benchmark item is a role; its longer words are the role's keywords.
KEYWORD = "[a-z]{7,}"


def _relevant_roles(spark, d):
    roles = table(spark, d, "benchmark").select(F.col("item_id").alias("owner"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(f"({KEYWORD})")))).alias("term"))
    entries = postings(spark, d).select("seq", F.concat_ws("\n", "title", "description").alias("entry"))
    return term_index.matches(entries, ["seq"], "entry", roles, lines=True).select("seq", F.col("owner").alias("role_id"))


register("relevant_roles", f"""
WITH {O.postings_cte()},
terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{KEYWORD}')) AS term FROM benchmark)
SELECT DISTINCT seq, item_id AS role_id FROM p JOIN terms ON contains(lower(concat_ws(chr(10), title, description)), term)
""")(_relevant_roles)


# ---- C4 / C5: every place that a location text names --------------------------------------
#: A place for each part name and type; a posting's location text is its own one
#: followed by the name and type of the part with its number.
PLACES = "SELECT min(p_partkey) AS place_id, p_name AS city, substr(p_type, 1, 2) AS state FROM part GROUP BY p_name, substr(p_type, 1, 2)"
LOCATED = """SELECT seq, concat(location, CASE WHEN location = '' THEN '' ELSE ', ' END,
  CASE WHEN p_size > 25 THEN 'Remote ' ELSE '' END, p_name, ' area, ', substr(p_type, 1, 2)) AS location
FROM {p} JOIN part ON seq = p_partkey"""


def _located(rule):
    def run(spark, d):
        part = table(spark, d, "part")
        where = postings(spark, d).select("seq", "location")
        texts = spark.sql(LOCATED.format(p="{p}").replace(" part ", " {part} "), p=where, part=part)
        return rule(texts, ["seq"], "location", spark.sql(PLACES.replace(" part ", " {part} "), part=part)).select("seq", "place_id")
    return run


_PARTS = "list_filter(list_transform(string_split(low, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: NOT contains(x, 'remote'))"
_CTES = f"WITH {O.postings_cte()}, places AS ({PLACES}), texts AS (SELECT seq, lower(location) AS low FROM ({LOCATED.format(p='p')}))"

register("places_by_parts", f"""
{_CTES}
SELECT seq, place_id FROM texts JOIN places
ON len(list_filter({_PARTS}, lambda x: contains(x, lower(city)) OR ends_with(x, lower(state)))) > 0 OR contains(low, ', ' || lower(state))
""")(_located(places.places_by_parts))

register("places_by_text", f"""
{_CTES}
SELECT seq, place_id FROM texts JOIN places ON contains(low, lower(city)) OR contains(low, ', ' || lower(state))
""")(_located(places.places_by_text))
