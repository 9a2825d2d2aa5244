"""Search cells (boards x work types x locations x roles) and role pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import ENG_KEYWORDS, GLOBAL_SEARCH_BOARDS, LOCATION_BLIND_BOARDS, SearchConfig
from .joins import inline_table

CELL_SCHEMA = T.StructType([
    T.StructField("role_id", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("board_ord", T.IntegerType()),
    T.StructField("search_cell", T.IntegerType()),
    T.StructField("work_type", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("location_blind", T.BooleanType()),
])


def cell_rows(cfg: SearchConfig) -> list[tuple]:
    """Cells in search order: work type, then location; one cell per work type
    for globally searched boards; enabled, known boards only."""
    rows = []
    for role in cfg.roles:
        for b_ord, board in enumerate(cfg.enabled_boards):
            if board.name in GLOBAL_SEARCH_BOARDS:
                for i, wt in enumerate(cfg.work_types):
                    rows.append((role.role_id, board.name, b_ord, i, wt, None, None, True))
                continue
            blind = board.name in LOCATION_BLIND_BOARDS
            for i, wt in enumerate(cfg.work_types):
                for j, loc in enumerate(cfg.locations):
                    rows.append((role.role_id, board.name, b_ord, i * len(cfg.locations) + j, wt,
                                 loc.city, loc.state, blind))
    return rows


def search_cells(spark: SparkSession, cfg: SearchConfig) -> DataFrame:
    """The cell table as an inline (JVM-local) relation: no Python round trip."""
    return inline_table(spark, CELL_SCHEMA, cell_rows(cfg))


def n_cells(cfg: SearchConfig, board: str) -> int:
    n_wt = len(cfg.work_types)
    return n_wt if board in GLOBAL_SEARCH_BOARDS else n_wt * len(cfg.locations)


def role_struct(cfg: SearchConfig) -> Column:
    """All configured roles as a literal array of structs."""
    structs = []
    for ord_, r in enumerate(cfg.roles):
        lo, hi = r.level_bounds
        structs.append(F.struct(
            F.lit(r.role_id).cast("int").alias("role_id"),
            F.lit(ord_).cast("int").alias("role_ord"),
            F.lit(r.title).alias("role_title"),
            F.array(*[F.lit(t) for t in r.terms]).alias("role_terms"),
            F.lit(lo).cast("int").alias("lvl_lo"),
            F.lit(hi).cast("int").alias("lvl_hi"),
            F.lit(float(r.years_experience)).cast("double").alias("years"),
            F.lit(float(r.experience_std_dev)).cast("double").alias("sigma"),
        ))
    return F.array(*structs)


ROLE_FIELDS = ("role_ord", "role_title", "role_terms", "lvl_lo", "lvl_hi", "years", "sigma")


def attach_roles(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Role attributes for rows that already carry ``role_id`` (postings
    landed by a role's own search): a literal map lookup, no join."""
    pairs = []
    for ord_, r in enumerate(cfg.roles):
        lo, hi = r.level_bounds
        pairs += [F.lit(r.role_id), F.struct(
            F.lit(ord_).cast("int").alias("role_ord"), F.lit(r.title).alias("role_title"),
            F.array(*[F.lit(t) for t in r.terms]).alias("role_terms"),
            F.lit(lo).cast("int").alias("lvl_lo"), F.lit(hi).cast("int").alias("lvl_hi"),
            F.lit(float(r.years_experience)).cast("double").alias("years"),
            F.lit(float(r.experience_std_dev)).cast("double").alias("sigma"))]
    role = F.try_element_at(F.create_map(*pairs), F.col("role_id"))
    return df.withColumns({f: role[f] for f in ROLE_FIELDS})


def pair_roles(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Each posting once per configured role (roles are scored independently).

    A generator over the literal role list: rows multiply in place by the
    configured role count, with no join, shuffle or broadcast.
    """
    fields = [f"_role.{n}" for n in ("role_id", "role_ord", "role_title", "role_terms", "lvl_lo", "lvl_hi",
                                     "years", "sigma")]
    return df.select("*", F.explode(role_struct(cfg)).alias("_role")).select(
        *[c for c in df.columns], *fields)


def role_terms_col(cfg: SearchConfig, role_id_col: str = "role_id", with_eng: bool = False) -> Column:
    """Relevance terms of the row's role (title and keywords, lower-cased)."""
    expr = None
    for r in cfg.roles:
        terms = r.terms + (ENG_KEYWORDS if with_eng else [])
        arr = F.array(*[F.lit(t) for t in terms])
        cond = F.col(role_id_col) == r.role_id
        expr = F.when(cond, arr) if expr is None else expr.when(cond, arr)
    return expr


def assign_cells(postings: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Fixture landing rule: pair with roles, spread a board's rows over its
    cells by arrival order, and keep enabled boards only."""
    ords = cfg.board_ord()
    board_ord = None
    for name, o in ords.items():
        board_ord = (F.when(F.col("source") == name, F.lit(o)) if board_ord is None
                     else board_ord.when(F.col("source") == name, F.lit(o)))
    cell_count = F.when(F.col("source").isin(GLOBAL_SEARCH_BOARDS), F.lit(n_cells(cfg, "workatastartup"))) \
        .otherwise(F.lit(len(cfg.work_types) * len(cfg.locations)))
    out = (postings
           .filter(F.col("source").isin(list(ords)))
           .withColumns({"board_ord": board_ord.cast("int"),
                         "search_cell": (F.expr("seq div 9") % cell_count).cast("int")}))
    return pair_roles(out, cfg)


def attach_cells(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Attach the cell each landed row was fetched for (work type, location).

    The cell table is configuration, so the lookup is an ``element_at`` into
    literal arrays indexed by the cell number: no join and no broadcast job.
    Rows of cells that do not exist for their board drop out (as an inner
    join with ``search_cells`` would).
    """
    n_loc, n_wt = len(cfg.locations), len(cfg.work_types)
    wts = F.array(*[F.lit(w) for w in cfg.work_types])
    cities = F.array(*[F.lit(loc.city) for loc in cfg.locations])
    states = F.array(*[F.lit(loc.state) for loc in cfg.locations])
    cell = F.col("search_cell")
    is_global = F.col("source").isin(GLOBAL_SEARCH_BOARDS)
    n_cells = F.when(is_global, F.lit(n_wt)).otherwise(F.lit(n_wt * n_loc))
    wt_idx = F.when(is_global, cell).otherwise(F.floor(cell / F.lit(max(n_loc, 1))).cast("int"))
    loc_idx = cell % F.lit(max(n_loc, 1))
    return (df.filter((cell >= 0) & (cell < n_cells) & F.col("source").isin([b.name for b in cfg.enabled_boards]))
              .withColumns({
                  "work_type": F.element_at(wts, wt_idx + 1),
                  "city": F.when(~is_global, F.element_at(cities, loc_idx + 1)),
                  "state": F.when(~is_global, F.element_at(states, loc_idx + 1)),
                  "location_blind": is_global | F.col("source").isin(LOCATION_BLIND_BOARDS),
              }))
