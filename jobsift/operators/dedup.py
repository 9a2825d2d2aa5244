"""De-duplication, per-cell caps, cross-board URL dedup and ordering.

Skew: a single board, key or URL may hold a large share of all rows. Every
"first row per key" step is a partial aggregation plus a semi join (see
``joins.first_per_key``), and every cap is a ranking window with a limit,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import GLOBAL_SEARCH_BOARDS, SearchConfig
from .joins import bounded_broadcast, first_per_key, rows_of_min

GROUP = ["role_id", "source"]


def dedup_key(job_id: str = "job_id", company: str = "company", title: str = "title", url: str = "url") -> Column:
    """Board id, else 'company::title::url'."""
    return F.coalesce(F.nullif(F.col(job_id), F.lit("")),
                      F.concat_ws("::", F.col(company), F.col(title), F.col(url)))


def with_dedup_key(df: DataFrame) -> DataFrame:
    return df if "dedup_key" in df.columns else df.withColumn("dedup_key", dedup_key())


def dedup_board(df: DataFrame) -> DataFrame:
    """First arrival per (role, board, key); arrival = (search_cell, seq)."""
    return first_per_key(with_dedup_key(df), GROUP + ["dedup_key"], ["search_cell", "seq"])


def _cap_candidates(df: DataFrame, cap: int, n_cells: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Distributed reduction for the per-cell cap.

    In cell c only first occurrences of a key can be kept, and at most cap*c of
    them are already taken by earlier cells, so the kept rows are among the
    first cap*(c+1) first occurrences. Both steps are partial-aggregated /
    partial-limited; the result per (role, board) is bounded by configuration.
    ``carry`` columns ride along with the first occurrence.
    """
    keyed = with_dedup_key(df)
    if carry:
        first = F.min(F.struct("seq", *carry)).alias("_f")
        firsts = (keyed.groupBy(*GROUP, "search_cell", "dedup_key").agg(first)
                       .select(*GROUP, "search_cell", "dedup_key", "_f.*"))
    else:
        firsts = keyed.groupBy(*GROUP, "search_cell", "dedup_key").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy(*GROUP, "search_cell").orderBy("seq")
    # The literal bound lets Spark plan a partial WindowGroupLimit before the
    # shuffle; the per-cell bound then trims exactly.
    return (firsts.withColumn("_rn", F.row_number().over(w))
                  .filter((F.col("_rn") <= F.lit(n_cells * cap))
                          & (F.col("_rn") <= (F.col("search_cell") + 1) * cap))
                  .drop("_rn"))


def fold_cells(cand: DataFrame, cap: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Exact order-dependent fold over the bounded candidates of each (role, board).

    Cells in search order, arrival order inside a cell; a cell stops after
    ``cap`` new keys, and keys it did not reach stay available to later cells.
    Runs JVM-side, one step per cell: the cell's keys less those kept so far
    (``array_except``, a hash set), cut at ``cap``. A group has at most
    cap x cells x (cells + 1) / 2 candidates and cap x cells kept keys, both
    bounded by configuration, and a step is linear in them.
    """
    row = F.struct("seq", "dedup_key", *carry)
    by_cell = cand.groupBy(*GROUP, "search_cell").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    cells = by_cell.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("search_cell", "_rows"))).alias("_cells"))

    def step(kept, cell):
        keys = F.transform(cell["_rows"], lambda r: r["dedup_key"])
        return F.array_append(kept, F.slice(F.array_except(keys, F.flatten(kept)), 1, cap))

    kept = F.aggregate("_cells", F.array().cast("array<array<string>>"), step)
    each = cells.select(*GROUP, F.explode(F.arrays_zip("_cells", kept.alias("_kept"))).alias("_z")).select(
        *GROUP, F.col("_z._cells._rows").alias("_rows"), F.col("_z._kept").alias("_keys"))
    rows = F.filter("_rows", lambda r: F.array_contains(F.col("_keys"), r["dedup_key"]))
    return each.select(*GROUP, F.explode(rows).alias("_k")).select(*GROUP, "_k.seq", *[f"_k.{c}" for c in carry])


def cap_per_cell(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per-board dedup fused with the per-cell cap (boards searched per cell).

    Exact: the order-dependent fold runs per (role, board) over the bounded
    candidate set only; the kept (role, board, seq) set is at most
    roles x boards x cells x cap rows, so it is broadcast back to the rows.
    """
    cap = cfg.run.max_jobs_per_location
    n_cells = max(1, len(cfg.work_types) * len(cfg.locations))
    cand = _cap_candidates(df, cap, n_cells)
    kept = fold_cells(cand, cap)
    bound = len(cfg.roles) * max(1, len(cfg.enabled_boards)) * n_cells * cap
    return df.join(bounded_broadcast(kept, bound), on=["role_id", "source", "seq"], how="left_semi")


def cap_global(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Globally searched boards: dedup across the board's cells, then keep the
    first cap x number-of-locations rows in (cell, arrival) order."""
    limit = cfg.run.max_jobs_per_location * len(cfg.locations)
    firsts = dedup_board(df)
    w = Window.partitionBy(*GROUP).orderBy("search_cell", "seq")
    return firsts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn", "dedup_key")


def board_dedup_and_cap(df: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Per-board gather result: the global rule for globally searched boards,
    the per-cell rule for all others."""
    is_global = F.col("source").isin(GLOBAL_SEARCH_BOARDS)
    return cap_per_cell(df.filter(~is_global), cfg).unionByName(cap_global(df.filter(is_global), cfg))


def gather_bound(cfg: SearchConfig) -> int:
    """Upper bound on rows kept by the caps: roles x boards x cells x cap."""
    n_cells = max(1, len(cfg.work_types) * len(cfg.locations))
    return len(cfg.roles) * max(1, len(cfg.enabled_boards)) * n_cells * cfg.run.max_jobs_per_location


def capped_keys(df: DataFrame, cfg: SearchConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """(role_id, source, seq, *carry) kept by the per-board dedup and caps,
    computed on a narrow key projection (no description or other wide column)."""
    narrow = with_dedup_key(df).select(*GROUP, "seq", "search_cell", "dedup_key", *carry)
    is_global = F.col("source").isin(GLOBAL_SEARCH_BOARDS)
    regular = narrow.filter(~is_global)
    cap = cfg.run.max_jobs_per_location
    n_cells = max(1, len(cfg.work_types) * len(cfg.locations))
    kept_regular = fold_cells(_cap_candidates(regular, cap, n_cells, carry), cap, carry)
    glob = narrow.filter(is_global)
    firsts = (glob.groupBy(*GROUP, "dedup_key")
                  .agg(F.min(F.struct("search_cell", "seq", *carry)).alias("_w"))
                  .select(*GROUP, "_w.*"))
    limit = cap * len(cfg.locations)
    w = Window.partitionBy(*GROUP).orderBy("search_cell", "seq")
    kept_global = (firsts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
                         .select(*GROUP, "seq", *carry))
    return kept_regular.unionByName(kept_global)


def dedup_cross_board(df: DataFrame) -> DataFrame:
    """Per role and URL, the first board (board_ord) keeps all of its rows;
    later boards lose theirs (rank() = 1, not row_number)."""
    return rows_of_min(df, ["role_id", "url"], "board_ord")


def dedup_cross_board_bounded(df: DataFrame) -> DataFrame:
    """``dedup_cross_board`` for an input bounded by configuration (the kept
    keys of the caps): one pass with ``rank()``; a (role, url) group holds at
    most boards x cells x cap rows."""
    w = Window.partitionBy("role_id", "url").orderBy("board_ord")
    return df.withColumn("_rk", F.rank().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def newest_first_cols() -> list[Column]:
    """Newest first, unknown dates last, then board, cell and arrival order."""
    return [F.col("posted_at").desc_nulls_last(), F.col("board_ord").asc(),
            F.col("search_cell").asc(), F.col("seq").asc()]


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(*newest_first_cols())


def union_boards(frames: list[DataFrame], cfg: SearchConfig) -> DataFrame:
    """Union of per-board relations (missing columns become NULL) with board order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    ords = cfg.board_ord()
    expr = None
    for name, o in ords.items():
        expr = (F.when(F.col("source") == name, F.lit(o)) if expr is None
                else expr.when(F.col("source") == name, F.lit(o)))
    return out.withColumn("board_ord", expr.cast("int")).filter(F.col("board_ord").isNotNull())


def anti_tracked(df: DataFrame, tracked: DataFrame) -> DataFrame:
    """Drop postings whose URL is already tracked. The tracked table grows with
    history, so no broadcast is forced: AQE converts to a broadcast join only
    when the runtime size is under its threshold."""
    return df.join(tracked.select("url"), on="url", how="left_anti")


def anti_tracked_bounded(df: DataFrame, tracked: DataFrame) -> DataFrame:
    """``anti_tracked`` for a written left side bounded by configuration:
    the tracked table is streamed once against its URLs, and the few hits are
    removed. URLs have no fixed width, so Spark decides on actual sizes whether
    to broadcast them; the written side is small enough in practice. A tracker
    in hash partitions is probed by (bucket, url), which prunes at run time the
    buckets that no URL of the left side falls in."""
    probe, keys = df.select("url"), ["url"]
    if "bucket" in tracked.columns:
        n = tracked.schema["bucket"].metadata["buckets"]
        # Spark prunes partitions at run time only by a side that is filtered; this comparison is always true
        probe = probe.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(n)).cast("int")).filter(F.col("bucket") >= 0)
        keys = ["bucket", "url"]
    hits = tracked.select(*keys).join(probe, on=keys, how="left_semi").select("url")
    return df.join(hits, on="url", how="left_anti")
