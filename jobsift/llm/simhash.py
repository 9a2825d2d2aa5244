"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_distance // 2 + 1`` segments, fewer
than exact matching would need: of two fingerprints within ``max_distance``
bits at least one segment differs by at most one bit. Each segment is indexed
once for each of its bits with that bit deleted (a wildcard), so such a
segment meets its partner by plain equality; candidates are then verified on
all 64 bits.

Only distinct fingerprints enter the index (copies are one node), and only
links between them leave it. An index bucket of up to ``BUCKET`` fingerprints
is joined with itself. For those in a larger bucket all variants of the whole
fingerprint with ``max_distance`` deleted bits are indexed: two are within
the distance exactly if they share one, and as such a bucket holds at most
2**max_distance fingerprints, no group is large there and none is skipped.

Cases: a null or blank text has no word and fingerprint zero, linked like any
other; fewer words than a shingle form one shingle; repeated rows and ids are
kept, each as its own row; an empty table gives an empty result; a null id
never becomes a component id while the component holds another. Only the id
and text columns are read, so further columns cannot clash. Ids are integers:
other types are cast to long, and a text that is none fails.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from .common import connected_components, joined, slices, small_batches, written

SEED = 42
#: Largest bucket that is joined with itself; a larger one is split by further
#: deletions. With 64 members both ways make about as many rows.
BUCKET = 64
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at: at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for part in slices(batches):
            found = [fingerprint(t, shingle) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _variants(fps: DataFrame, segments: int) -> DataFrame:
    """(bit, part, fp): each segment of each fingerprint with one bit deleted,
    dealt out by (bit, part). Only bit and fp travel, as they give the part."""
    width = 64 // segments
    low = [width * s for s in range(segments)]
    high = [*low[1:], 64]
    mask = "CASE " + " ".join(
        f"WHEN bit < {b} THEN {_signed(((1 << b) - 1) ^ ((1 << a) - 1))}L" for a, b in zip(low, high, strict=True)) + " END"
    part = F.expr(f"fp & ({mask}) & ~shiftleft(1L, bit)")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = fps.repartition(tasks, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return kept.repartition(F.col("bit"), part).select("bit", part.alias("part"), "fp")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints ``fp`` within
    ``max_distance`` bits. All such pairs are linked directly or, inside a
    crowded bucket, through the smallest fingerprint of a shared variant, so
    the components are those of all pairs."""
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3")
    variants = _variants(fps, max_distance // 2 + 1)
    near = f"bit_count(a ^ b) <= {max_distance}"
    # the members of buckets of two and more; both sides read the variants as they are dealt out
    sizes = variants.groupBy("bit", "part").agg(F.count("*").alias("n")).where("n > 1")
    members = written(variants.join(sizes.hint("shuffle_hash"), ["bit", "part"]), "simhash-members")

    some = members.where(f"n <= {BUCKET}")
    left, right = some.withColumnRenamed("fp", "a"), some.select("bit", "part", F.col("fp").alias("b"))
    groups = left.join(right, ["bit", "part"]).where(f"a < b AND {near}").select("a", "b")

    crowded = members.where(f"n > {BUCKET}").select("fp").distinct()
    masks = [_signed(((1 << 64) - 1) ^ sum(1 << i for i in bits)) for bits in combinations(range(64), max_distance)]
    deleted = crowded.select("fp", F.posexplode(F.array(*map(F.lit, masks))).alias("which", "mask"))
    stars = deleted.groupBy("which", (F.col("fp").bitwiseAND(F.col("mask"))).alias("part")).agg(
        F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where("size(all) > 1")
    stars = stars.select("a", F.explode("all").alias("b")).where("a < b")
    return groups.unionAll(stars).distinct()


def classes(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """(fp, root, component, winner, n) of each distinct fingerprint in
    ``prints`` (id, fp): the class it belongs to, the smallest id in it, whether
    the class's kept document (smallest id, then smallest fingerprint) has it,
    and how many rows have the fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = connected_components(links(nodes.select("fp"), max_distance), "simhash-components")
    known = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least", "n")
    first = known.groupBy("root").agg(
        F.min("least").alias("component"), F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("kept"))
    return known.join(first, "root").select("fp", "root", "component", (F.col("kept.fp") == F.col("fp")).alias("winner"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """(id, fp, component) for every row: the smallest id reachable through
    links of at most ``max_distance`` differing bits."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    found = written(classes(prints, max_distance).select("fp", "component", "n"), "simhash-classes")
    return joined(prints, found, "fp", "n").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) with one row of each class: that with
    the smallest id; of rows that share id and fingerprint, the first by text."""
    small_batches(docs.sparkSession)
    name = "_llm_fp"

    @F.arrow_udf(LongType())  # texts go to Python, and only fingerprints come back
    def fp(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py(), shingle) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    marked = written(docs.withColumn(name, fp(F.col(f"`{text_col}`"))), "simhash-rows")
    prints = marked.select(F.col(id_col).cast("long").alias("id"), F.col(name).alias("fp"))
    kept = classes(prints, max_distance).where("winner").select(
        F.col("fp").alias(name), F.col("component").alias("_llm_least"))
    # copies of a text part by their ids
    rows = marked.join(kept, (marked[name] == kept[name]) & marked[id_col].cast("long").eqNullSafe(kept["_llm_least"])).drop(kept[name])
    # a class keeps rows of one fingerprint and id only, so those of one class are together already
    order = Window.partitionBy(name).orderBy(text_col)
    return rows.withColumn("_llm_rank", F.row_number().over(order)).where("_llm_rank = 1").select(*docs.columns)
