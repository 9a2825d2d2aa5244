"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Of equal vectors one, with the smallest id, goes on with their number. Those are
dealt to shards of SHARD rows by a hash, so that a group of copies is spread over
all of them, and each shard builds its graph: a node has up to NEIGHBOURS links
on each of its levels (twice as many on the lowest), chosen so that no link is
nearer to another than to the node, and a node is on a level with a share of
1 / NEIGHBOURS of those on the one below. Rows join in batches that the graph
grows by a quarter with; each batch is looked up in the graph and in itself. At
last every node is searched for, and one that is not met gets more links to it.

A search goes down the upper levels to the nearest node it meets and on the
lowest keeps a beam; in addition every node within the threshold is opened,
whether it is in the beam or not, so a group larger than the beam is walked
whole. Each shard audits its graph: AUDIT of its rows, each turned away at
random to the threshold's angle, are queries whose links within the shard are
known by brute force, and so are those of the rows themselves; the beam is
doubled until at least RECALL of these links are found (a beam of a whole shard
finds all).

Then the rows of every shard query the graph of every shard with their beams, a
shard of rows against one graph in a task; of two shards one queries the other,
by turns. Pairs found are verified by cosine in double precision on the original
vectors. A task hands on counts of links and, for each row that has any, one
link to the least row of its group within the task (a spanning star), never the
pairs. Stars of all tasks are united by ``connected_components``.

Cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite components link with nothing; their row stands alone. Ids are
integers (other types are cast to long; 2^63 - 1 stands for none). Rows that share
an id are rows of their own, each linked and counted. A row without an id is
linked and counted, and names no component unless all rows of it lack ids: then
the component is null. ``kept`` is true where the row's id is its component's.
An empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, discard, written
from .vectors import finite, matrix, usual_length

THRESHOLD = 0.95
SHARD = 8192
NEIGHBOURS = 16
BEAM = 64
AUDIT = 256
RECALL = 0.999
#: Queries searched at a time, and open nodes whose links are read at a time.
BLOCK = 512
OPEN = 1 << 16
#: Equal vectors that stand for more than this share of all rows are joined apart.
HOT = 1000
#: Slack of single precision in the search; found pairs are verified in double.
SLACK = 1e-4
NO_ID = (1 << 63) - 1


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, also of very large and very small ones."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@dataclass
class Graph:
    """Links of the nodes of each level (-1: none), lowest level first; node
    numbers are rows of ``points`` (unit vectors, single precision)."""

    points: np.ndarray
    levels: np.ndarray
    links: list[np.ndarray]
    top: int  # entry node

    def _descend(self, queries: np.ndarray, floor: int) -> np.ndarray:
        """The nearest node met above level ``floor``, for each query."""
        at = np.full(len(queries), self.top)
        near = queries @ self.points[self.top]
        for level in range(len(self.links) - 1, floor, -1):
            moving = np.arange(len(queries))
            while len(moving):
                options = self.links[level][at[moving]]
                sims = np.where(options >= 0, np.einsum("bmd,bd->bm", self.points[options], queries[moving]), -2)
                best = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), best]
                better = value > near[moving]
                moving = moving[better]
                at[moving], near[moving] = options[better, best[better]], value[better]
        return at

    def search(self, queries: np.ndarray, beam: int, level: int = 0, within: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(beam nodes, their similarities, seen): the ``beam`` nearest found of
        each query, nearest first (-1: none), and for ``within`` <= 1 which
        nodes at least that near were met."""
        n, b = len(self.points), len(queries)
        links = self.links[level]
        rows = np.arange(b)
        start = self._descend(queries, level)
        nodes = np.full((b, beam), -1)
        sims = np.full((b, beam), -2.0, np.float32)
        nodes[:, 0], sims[:, 0] = start, np.einsum("bd,bd->b", self.points[start], queries)
        done = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        seen[rows, start] = True
        near = np.zeros((b, n), bool)
        opened = np.zeros((b, n), bool)
        near[rows, start] = sims[:, 0] >= within
        while True:
            open_ = np.where(done | (nodes < 0), np.float32(-3), sims)
            pick = open_.argmax(axis=1)
            busy = np.flatnonzero(open_[rows, pick] > -2)
            if not len(busy):
                break
            node = nodes[busy, pick[busy]]
            done[busy, pick[busy]] = True
            opened[busy, node] = True
            options = np.where(links[node] >= 0, links[node], node[:, None])  # the node itself is seen already
            fresh = ~seen[busy[:, None], options]
            seen[busy[:, None], options] = True
            value = np.where(fresh, np.einsum("bmd,bd->bm", self.points[options], queries[busy]), np.float32(-2))
            if within <= 1:
                r, c = np.nonzero(value >= within)
                near[busy[r], options[r, c]] = True
            all_sims = np.concatenate([sims[busy], value], axis=1)
            keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            all_nodes = np.concatenate([nodes[busy], np.where(fresh, options, -1)], axis=1)
            all_done = np.concatenate([done[busy], np.zeros_like(fresh)], axis=1)
            sims[busy] = np.take_along_axis(all_sims, keep, axis=1)
            nodes[busy] = np.take_along_axis(all_nodes, keep, axis=1)
            done[busy] = np.take_along_axis(all_done, keep, axis=1)
        if within <= 1:  # open what is near enough and has not been
            while (todo := np.nonzero(near & ~opened))[0].size:
                opened[todo] = True
                for lo in range(0, len(todo[0]), OPEN):
                    q, node = todo[0][lo: lo + OPEN], todo[1][lo: lo + OPEN]
                    options = links[node]
                    fresh = (options >= 0) & ~seen[q[:, None], options]
                    pairs = np.unique(np.broadcast_to(q[:, None], options.shape)[fresh] * n + options[fresh])
                    q, node = pairs // n, pairs % n
                    seen[q, node] = True
                    for part in range(0, len(q), OPEN):
                        p = slice(part, part + OPEN)
                        value = np.einsum("pd,pd->p", self.points[node[p]], queries[q[p]])
                        good = value >= within
                        near[q[p][good], node[p][good]] = True
        return nodes, sims, near


def _choose(points: np.ndarray, node: int, options: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of ``options`` (nearest first) that are nearer to the node
    than to any option taken before; the nearest others fill the rest."""
    if len(options) <= most:
        return options
    between = points[options] @ points[options].T
    taken: list[int] = []
    for i in range(len(options)):
        if not taken or (between[i, taken] <= sims[i]).all():
            taken.append(i)
            if len(taken) == most:
                break
    if len(taken) < most:
        taken += [i for i in range(len(options)) if i not in set(taken)][:most - len(taken)]
    return options[taken]


def build(points: np.ndarray, draws: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BEAM) -> Graph:
    """The graph of unit ``points``; ``draws`` (0 to 1, of each point) decide levels."""
    n = len(points)
    levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(neighbours)).astype(int), 8)
    order = np.argsort(-levels, kind="stable")  # the entry node is on the top level from the start
    height = int(levels.max(initial=0)) + 1
    links = [np.full((n, neighbours * (1 if level else 2)), -1, np.int32) for level in range(height)]
    graph = Graph(points, levels, links, int(order[0]))
    joined = 1
    while joined < n:
        batch = order[joined: joined + max(1, min(BLOCK, joined // 4))]
        queries = points[batch]
        inside = queries @ queries.T
        np.fill_diagonal(inside, -2)
        for level in range(int(levels[batch].max()), -1, -1):
            on = np.flatnonzero(levels[batch] >= level)
            found, sims, _ = graph.search(queries[on], beam, level)
            own = np.where(levels[batch] >= level, inside[on], -2)
            options = np.concatenate([found, np.broadcast_to(batch, own.shape)], axis=1)
            values = np.concatenate([np.where(found >= 0, sims, -2), own], axis=1)
            best = np.argsort(-values, axis=1, kind="stable")[:, :beam]
            most = links[level].shape[1]
            back: dict[int, list[int]] = {}
            for r, i in enumerate(on):
                good = best[r][values[r][best[r]] > -2]
                node = int(batch[i])
                chosen = _choose(points, node, options[r][good], values[r][good], neighbours)
                links[level][node, :len(chosen)] = chosen
                for other in chosen.tolist():
                    back.setdefault(other, []).append(node)
            for other, new in back.items():  # links back; too many are chosen anew
                old = links[level][other]
                all_ = np.unique(np.concatenate([old[old >= 0], np.array(new, np.int32)]))
                if len(all_) > most:
                    near = points[all_] @ points[other]
                    turn = np.argsort(-near, kind="stable")
                    all_ = _choose(points, other, all_[turn], near[turn], most)
                links[level][other] = -1
                links[level][other, :len(all_)] = all_
        joined += len(batch)
    return graph


def mended(graph: Graph, beam: int = BEAM, rounds: int = 6) -> int:
    """Every node is searched for by its own vector; one that is not met gets a
    link from each of the nearest nodes that are, until all are met. Returns how
    many are left unmet."""
    n = len(graph.points)
    lost = np.arange(n)
    for turn in range(rounds + 1):
        missed, hosts = [], []
        for lo in range(0, len(lost), BLOCK):
            some = lost[lo: lo + BLOCK]
            nodes, sims, near = graph.search(graph.points[some], beam, within=1 - SLACK)
            out = ~near[np.arange(len(some)), some]
            missed.append(some[out])
            hosts.append(nodes[out, :4])
        lost = np.concatenate([*missed, np.zeros(0, int)])
        if not len(lost) or turn == rounds:
            break
        host = np.concatenate(hosts)
        pairs = np.unique(host[host >= 0].astype(np.int64) * n + np.broadcast_to(lost[:, None], host.shape)[host >= 0])
        host, node = pairs // n, pairs % n
        place = np.arange(len(host)) - np.searchsorted(host, host)
        wider = np.full((n, int(place.max()) + 1), -1, np.int32)
        wider[host, place] = node
        graph.links[0] = np.hstack([graph.links[0], wider])
    return len(lost)


def audited(graph: Graph, threshold: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL, seed: int = 5) -> tuple[int, float]:
    """(beam, recall): the beam doubled until it finds ``recall`` of the links
    of audit queries that brute force finds in the shard."""
    n, rng = len(graph.points), np.random.default_rng(seed)
    picked = rng.permutation(n)[:audit]
    rows = graph.points[picked]
    away = rng.normal(size=rows.shape)
    away -= (away * rows).sum(axis=1, keepdims=True) * rows
    away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-30)
    angle = np.arccos(min(1.0, threshold + 0.002))
    queries = np.vstack([rows, np.cos(angle) * rows + np.sin(angle) * away]).astype(np.float32)
    true = queries @ graph.points.T >= threshold
    true[np.arange(len(picked)), picked] = False  # a row's own node does not count
    while True:
        share = 1.0
        if true.any():
            share = float((graph.search(queries, beam, within=threshold - SLACK)[2] & true).sum() / true.sum())
        if share >= recall or beam >= n:
            return beam, share
        beam = min(2 * beam, n)


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) for all nodes of the links left - right."""
    if not len(left):
        return left, right
    names, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = where[:len(left)], where[len(left):]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        following = root.copy()
        np.minimum.at(following, root[a], least)
        np.minimum.at(following, root[b], least)
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        following = following[following]
        if (following == root).all():
            return names, names[root]
        root = following


def linked(graph: Graph, beam: int, exact: np.ndarray, queries: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, node) with cosine of at least ``threshold`` that the search
    finds; each pair once, and no node with itself, if both are one shard."""
    single = queries.astype(np.float32)
    out = []
    for lo in range(0, len(queries), BLOCK):
        q, node = np.nonzero(graph.search(single[lo: lo + BLOCK], beam, within=threshold - SLACK)[2])
        q = q + lo
        if same:
            pair = np.unique(np.minimum(q, node) * len(exact) + np.maximum(q, node))
            q, node = pair // len(exact), pair % len(exact)
            q, node = q[q != node], node[q != node]
        for part in range(0, len(q), OPEN):
            p = slice(part, part + OPEN)
            good = (queries[q[p]] * exact[node[p]]).sum(axis=1) >= threshold
            out.append((q[p][good], node[p][good]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    q, node = (np.concatenate(x) for x in zip(*out, strict=True))
    if same:
        pair = np.unique(q * len(exact) + node)
        q, node = pair // len(exact), pair % len(exact)
    return q, node


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


SHARDS = ("shard int, rows binary, copies binary, vectors binary, levels binary, links array<binary>, top int, length int, "
          "beam int, recall double")


def _tasks(df: DataFrame, groups: int) -> int:
    """Partitions for ``groups`` of much work each: a stated number, which
    adaptive execution doesn't merge by bytes, and so many that few meet."""
    return min(8 * groups, max(4000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def shards(groups: DataFrame, count: int, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each shard of ``groups`` (id, g, v, n): its rows, its graph and
    the beam that its audit asks for."""
    def make(keys, table):
        shard = keys[0].as_py()
        table = table.sort_by([("id", "ascending"), ("g", "ascending")])
        vectors = units(matrix(table.column("v")))
        draws = np.random.default_rng(shard).random(len(vectors))
        graph = build(vectors.astype(np.float32), draws)
        mended(graph)
        beam, recall = audited(graph, threshold)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "rows": _binary(np.column_stack([np.asarray(table.column(c), np.int64) for c in ("id", "g")])),
            "copies": _binary(np.asarray(table.column("n"), np.int64)), "vectors": _binary(vectors),
            "levels": _binary(graph.levels.astype(np.int8)),
            "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
            "top": pa.array([graph.top], pa.int32()), "length": pa.array([vectors.shape[1]], pa.int32()),
            "beam": pa.array([beam], pa.int32()), "recall": pa.array([recall])})

    dealt = groups.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int"))
    return dealt.repartition(_tasks(groups, count), "shard").groupBy("shard").applyInArrow(make, SHARDS)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["length"])
    return np.frombuffer(row["rows"], np.int64).reshape(-1, 2), np.frombuffer(row["copies"], np.int64), vectors


def _counts(built: DataFrame, count: int, threshold: float) -> DataFrame:
    """(g, n, id, root_id, root): for each row g that has links in a task, their
    number, its id, and the least row (by id, then g) of its group there. A task
    has one shard's rows and one shard's graph; shard a queries shard b if a is
    b or b is in the half of all shards that follows a, so that each two shards
    meet once."""
    steps = F.sequence(F.lit(0), F.lit(count // 2))
    other = F.pmod(F.col("a") + F.col("step"), F.lit(count))

    def meets(df: DataFrame) -> DataFrame:
        return df if count % 2 else df.where((F.col("step") * 2 < count) | (F.col("a") < F.col("b")))

    asking = meets(built.select(F.col("shard").alias("a"), "rows", "copies", "vectors", "length", F.explode(steps).alias("step"))
                   .withColumn("b", other))
    held = meets(built.withColumnRenamed("shard", "b").withColumn("step", F.explode(steps)).withColumn(
        "a", F.pmod(F.col("b") - F.col("step"), F.lit(count))))

    def match(left, right):
        mine, theirs = left.to_pylist()[0], right.to_pylist()[0]
        (rows, copies, queries), (held_rows, held_copies, exact) = _unpack(mine), _unpack(theirs)
        links = [np.frombuffer(x, np.int32).reshape(len(exact), -1) for x in theirs["links"]]
        graph = Graph(exact.astype(np.float32), np.frombuffer(theirs["levels"], np.int8), links, theirs["top"])
        same = mine["a"] == theirs["b"]
        q, node = linked(graph, theirs["beam"], exact, queries, threshold, same)
        # both shards' rows by id, then g; a row of the one shard has one place
        order = np.unique(np.vstack([rows, held_rows]), axis=0)
        place = {(i, g): at for at, (i, g) in enumerate(map(tuple, order.tolist()))}
        a = np.array([place[x] for x in map(tuple, rows.tolist())])[q] if len(q) else q
        b = np.array([place[x] for x in map(tuple, held_rows.tolist())])[node] if len(q) else node
        totals = np.zeros(len(order), np.int64)
        np.add.at(totals, a, held_copies[node])
        np.add.at(totals, b, copies[q])
        at, root = _stars(a, b)
        return pa.table({"g": pa.array(order[at, 1]), "n": pa.array(totals[at]), "id": pa.array(order[at, 0]),
                         "root_id": pa.array(order[root, 0]), "root": pa.array(order[root, 1])})

    tasks = _tasks(built, count * (count // 2 + 1))
    asking, held = (df.repartition(tasks, "a", "b") for df in (asking, held))
    return asking.groupBy("a", "b").cogroup(held.groupBy("a", "b")).applyInArrow(match, "g long, n long, id long, root_id long, root long")


def _node(id_col: str, g_col: str):
    """Rows in order of id, then g, as one number."""
    return (F.col(id_col).cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col(g_col).cast("decimal(19,0)")).cast("decimal(38,0)")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    shard: int = SHARD) -> DataFrame:
    """(id, n_links, component, kept) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    sound = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    length = usual_length(rows.where(sound), "v")
    rows = written(rows.withColumn("v", F.when(sound & (F.size("v") == length), F.transform(
        "v", lambda x: x.cast("double") + F.lit(0.0)))), "hnsw-rows")
    # g: a number of its own for each distinct vector, fixed once the table is written
    groups = written(rows.where("v is not null").groupBy("v").agg(F.coalesce(F.min("id"), F.lit(NO_ID)).alias("id"), F.count("*").alias("n"))
                     .withColumn("g", F.monotonically_increasing_id()), "hnsw-groups")
    total = groups.count()
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = rows.where("v is null").select("id", *alone)
    if total:
        built = written(shards(groups, -(-total // shard), threshold), "hnsw-shards")
        found = written(_counts(built, -(-total // shard), threshold), "hnsw-links")
        discard(built)
        edges = found.where("g <> root").select(_node("id", "g").alias("a"), _node("root_id", "root").alias("b"))
        parts = connected_components(edges, "hnsw-components")
        reached = F.floor(F.col("component") / F.lit(1 << 62).cast("decimal(19,0)")).cast("long")
        parts = parts.select(F.pmod("node", F.lit(1 << 62).cast("decimal(19,0)")).cast("long").alias("g"), reached.alias("component"))
        counts = found.groupBy("g").agg(F.sum("n").alias("links"))
        judged = written(groups.join(counts, "g", "left").join(parts, "g", "left").select(
            "v", "id", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component")), "hnsw-judged")
        judged = judged.withColumn("id", F.when(F.col("id") < NO_ID, F.col("id"))).withColumn(
            "component", F.when(F.col("component") < NO_ID, F.col("component")))
        out = out.unionByName(judged.where("n = 1").select("id", "n_links", "component")).unionByName(_spread(rows, judged))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def _spread(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Each row of equal vectors with its group's result. Groups over 1 / HOT of
    all rows, HOT at most, are broadcast; in the shuffle of the others no vector
    weighs more than that."""
    several = judged.where("n > 1").drop("id")
    total = judged.agg(F.sum("n")).first()[0]
    often = F.col("n") * HOT > total
    hot = F.broadcast(several.where(often))
    rest = rows.where("v is not null").join(hot.select("v"), "v", "left_anti").join(several.where(~often), "v")
    return rows.join(hot, "v").unionByName(rest).select("id", "n_links", "component")
