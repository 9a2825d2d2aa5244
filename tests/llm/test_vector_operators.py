"""Vector codes, whitening and vector de-duplication against brute force, and
their defined results on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.llm import ann_forest, dual_lloyd, hnsw_dedup, queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, x array<long>, v int, n long, g long"
MORE = ("clash", "clash", [7], 1, 1, 1)


def awkward_rows(rng):
    """Nulls in every column, empty, zero and broken vectors, another length,
    repeated ids and rows, ties, and columns that clash."""
    good = [(i, [float(c) for c in rng.normal(size=16)], i % 3 if i % 5 else None, *MORE) for i in range(90)]
    same = [(200 + i, good[7][1], None, *MORE) for i in range(40)]
    bad = [(300, None, 1, *MORE), (301, [], 1, *MORE), (302, [0.0] * 16, 2, *MORE), (303, [math.nan] * 16, 1, *MORE),
           (304, [math.inf, *[1.0] * 15], 1, *MORE), (305, [None, *[1.0] * 15], 1, *MORE), (306, [1.0] * 5, 1, *MORE)]
    odd = [(None, good[3][1], None, None, None, None, None, None, None), good[5], good[5], (8, good[9][1], 1, *MORE)]
    return good + same + bad + odd


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(np.random.default_rng(4)), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sound(rows, length=16):
    return [r for r in rows if r.embedding and len(r.embedding) == length
            and all(c is not None and math.isfinite(c) for c in r.embedding)]


# --- 11: vector codes

def lloyd(rows, parts=16, entries=64, rounds=2):
    """(rows in order of ids, codes, errors, codebooks) by full distance tables."""
    rows = sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id, r.embedding))
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    cut = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = cut[:, :entries].copy()
    near = lambda: ((cut[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        at = near().argmin(axis=2)
        for p in range(parts):
            for j in np.unique(at[p]):
                books[p, j] = cut[p][at[p] == j].sum(axis=0) // (at[p] == j).sum()
    distances = near()
    return rows, distances.argmin(axis=2).T, distances.min(axis=2).sum(axis=0), books


@pytest.mark.parametrize(("n", "k", "width", "kind"), [
    (1, 1, 1, "wide"), (5, 3, 2, "wide"), (700, 64, 4, "wide"), (3000, 37, 3, "clustered"), (900, 64, 1, "ties"), (400, 64, 4, "equal")])
def test_dual_trees_assign_as_full_tables_do(n, k, width, kind):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(size=(n, width)) * {"wide": 32, "clustered": 2, "ties": 3, "equal": 0}[kind]).astype(np.int64)
    if kind == "clustered":
        x += np.floor(rng.normal(size=(20, width)) * 400).astype(np.int64)[rng.integers(0, 20, n)]
    book = x[rng.choice(n, k, replace=False)]
    got = dual_lloyd.assign(dual_lloyd.tree(x, dual_lloyd.LEAF), book)
    want = ((x[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    sums = np.zeros_like(book)
    np.add.at(sums, want, x)
    assert (got.entry == want).all() and (got.counts == np.bincount(want, minlength=k)).all() and (got.sums == sums).all()
    if kind == "clustered":
        assert got.whole > 0.3 * n  # nodes, not parts, are assigned


def test_codes_of_awkward_rows(spark, awkward, nothing):
    rows, codes, errors, books = lloyd(sound(awkward.collect()))
    coded, got_books = dual_lloyd.encode(awkward, chunk=50)
    got = sorted(coded.collect(), key=lambda r: (r.id is None, r.id or 0, r.code, r.label is None))
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    want = sorted(((r.vec_id, r.label, c.tolist(), int(e), by_label[r.label]) for r, c, e in zip(rows, codes, errors, strict=True)),
                  key=lambda t: (t[0] is None, t[0] or 0, t[2], t[1] is None))
    assert [(r.id, r.label, r.code, r.error, r.label_error) for r in got] == want
    assert dual_lloyd.digest(got_books) == hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert dual_lloyd.encode(nothing)[0].collect() == []


def test_components_too_large_for_exact_distances_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="not supported"):
        dual_lloyd.encode(df, parts=2)
    with pytest.raises(ValueError, match="not supported"):
        whitening.whiten(df)


def test_hot_and_rare_labels_sum_alike(spark):
    coded = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id")).alias("label"),
                                     F.array(F.lit(1)).alias("code"), F.col("id").alias("error"))
    got = {r.id: r.label_error for r in dual_lloyd.with_label_error(coded).collect()}
    even = sum(range(0, 3000, 2))
    assert got == {i: i if i % 2 else even for i in range(3000)}


# --- 12: whitening

def test_rank_one_updates_keep_the_eigenpairs():
    rng = np.random.default_rng(1)
    tables = [rng.normal(size=(300, 24)) * 8, rng.normal(size=(9, 24)) * 8, np.repeat(rng.normal(size=(12, 6)), 15, axis=0),
              np.eye(8)[rng.integers(0, 8, 100)], np.zeros((7, 3)), np.ones((9, 1)) * np.arange(9)[:, None],
              rng.normal(size=(200, 10)) * np.logspace(0, 5, 10)]
    for x in tables:
        own = whitening.Spectrum.nothing(x.shape[1])
        for some in np.array_split(x, 3):  # spectra of three tasks, combined
            part = whitening.Spectrum.nothing(x.shape[1])
            for row in some:
                part.add(row)
            own.merge(part)
        centred = x - x.mean(axis=0)
        scatter = centred.T @ centred
        size = max(np.linalg.eigvalsh(scatter)[-1], 1e-300)
        assert np.abs(own.vectors.T @ own.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(scatter @ own.vectors - own.vectors * own.values).max() / size < 1e-12


def test_secular_roots_interlace():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 40):
        poles, weights = np.sort(rng.normal(size=k)) * 10, rng.random(k) ** 6
        away = whitening.roots(poles, weights)
        root = (poles - away)[:, 0]
        ends = np.append(poles[1:], poles[-1] + weights.sum())
        assert ((poles <= root) & (root <= ends)).all()
        assert np.allclose(root, np.linalg.eigvalsh(np.diag(poles) + np.sqrt(np.outer(weights, weights))), atol=1e-12)


def whitened(rows, k=16):
    x = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    v = ((n * fit - sums) / n).T @ ((n * fit - sums) / n) / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return ((n * x - sums) / n) @ vectors / np.sqrt(values), n, ((n * x - sums) ** 2).sum(axis=1), values / np.trace(v)


def check_whitened(got, rows, k=16):
    want, n, deviation, explained = whitened(rows, k)
    table = {}
    for r in got:
        table.setdefault(r[0], []).append(r)
    per_id = {}
    for row, w, d in zip(rows, want, deviation, strict=True):
        per_id.setdefault(row.vec_id, []).append((w, d))
    signs = np.zeros(k)
    assert table.keys() == per_id.keys()
    for key, found in table.items():
        assert len(found) == k * len(per_id[key])
        if len(per_id[key]) > 1:
            continue
        w, d = per_id[key][0]
        found.sort(key=lambda r: r.component)
        mine = np.array([r.whitened for r in found])
        signs = np.where(signs == 0, np.sign(mine * w) * (np.abs(w) > 1e-6), signs)
        assert np.allclose(mine, w * np.where(signs == 0, 1, signs), atol=1e-8)
        assert all(r.n == n and r.deviation == d and r.identity_error < 1e-8 for r in found)
        assert np.allclose([r.explained for r in found], explained, rtol=1e-8)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitened(queries.QUERIES["op12_whitening"](spark, SF).collect(), rows)


def test_whitening_of_awkward_rows(spark, awkward, nothing):
    check_whitened(whitening.whiten(awkward, components=9).collect(), sound(awkward.collect()), 9)
    assert whitening.whiten(nothing).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).collect() == []  # no component has variance
    line = spark.createDataFrame([(i, [float(i), 0.0, -2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert sorted(r.id for r in got) == list(range(9)) and {r.component for r in got} == {1}


def test_spectra_of_many_tasks_are_combined_level_by_level(spark):
    x = np.floor(np.random.default_rng(6).normal(size=(400, 5)) * 50).astype(np.int64)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(20)
    own = whitening.spectrum(fit, np.zeros(5, np.int64))
    centred = x - x.mean(axis=0)
    assert own.n == 400 and np.allclose(own.values, np.linalg.eigvalsh(centred.T @ centred))


def test_ritz_step_mends_a_poor_basis(spark):
    x = np.floor(np.random.default_rng(7).normal(size=(300, 12)) * np.linspace(10, 90, 12)).astype(np.int64)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    poor = np.linalg.qr(np.random.default_rng(8).normal(size=(12, 4)))[0]
    values, vectors, worst = whitening.refined(fit, 300, x.sum(axis=0), poor, 3)
    v = np.cov(x.T, bias=True)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:3]) and worst < 1e-10


# --- 13: vector de-duplication

def links(rows):
    """{position: (links, component, kept)} over all rows by full cosine tables."""
    ok = [i for i, r in enumerate(rows) if r.embedding and len(r.embedding) == 16 and any(r.embedding)
          and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = np.array([rows[i].embedding for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([hnsw_dedup.NO_ID if rows[i].vec_id is None else rows[i].vec_id for i in ok], np.int64)
    least = ids.copy()
    for _ in range(len(ok)):
        following = np.minimum(least, np.where(near, least, hnsw_dedup.NO_ID).min(axis=1))
        if (following == least).all():
            break
        least = following
    out = [(r.vec_id, 0, r.vec_id, True) for r in rows]
    for i, n, c in zip(ok, near.sum(axis=1).tolist(), least.tolist(), strict=True):
        out[i] = (rows[i].vec_id, n, c, rows[i].vec_id == c)
    return out


def by_all(rows):
    return sorted(rows, key=lambda t: tuple((x is None, x or 0) for x in t))


def clustered(rng, n, groups, size):
    centres = rng.normal(size=(groups, 16))
    rows = [c + 0.05 * rng.normal(size=16) for c in centres for _ in range(size)] + list(rng.normal(size=(n, 16)))
    chain = rng.normal(size=16)
    for _ in range(30):  # each linked with the next, the ends far apart
        rows.append(chain.copy())
        chain = chain / np.linalg.norm(chain) + 0.065 * rng.normal(size=16)
    return [(int(i), [float(c) for c in rows[j]]) for i, j in enumerate(rng.permutation(len(rows)))]


def test_links_between_and_within_shards_are_those_of_brute_force(spark):
    df = spark.createDataFrame(clustered(np.random.default_rng(9), 500, 12, 25), "vec_id long, embedding array<double>")
    want = by_all(links(df.collect()))
    assert sum(w[1] for w in want) > 5000
    for shard in (1000, 200, 130):  # one shard, an odd and an even number of them
        got = hnsw_dedup.near_duplicates(df, shard=shard)
        assert by_all(map(tuple, got.collect())) == want


def test_links_of_awkward_rows(spark, awkward, nothing):
    want = by_all(links(awkward.collect()))
    assert by_all(map(tuple, hnsw_dedup.near_duplicates(awkward, shard=50).collect())) == want
    assert hnsw_dedup.near_duplicates(nothing).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert by_all(map(tuple, hnsw_dedup.near_duplicates(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    sized = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e-300, 0.0]), (-3, [1e300, 1e299])], "vec_id long, embedding array<double>")
    assert by_all(map(tuple, hnsw_dedup.near_duplicates(sized).collect())) == [(-3, 2, -3, True), (1, 2, -3, False), (2, 2, -3, False)]


def test_groups_larger_than_the_beam_are_walked_whole():
    rng = np.random.default_rng(10)
    centre = rng.normal(size=24)
    x = hnsw_dedup.units(np.vstack([centre + 0.1 * rng.normal(size=(300, 24)), rng.normal(size=(700, 24))]))
    graph = hnsw_dedup.build(x.astype(np.float32), rng.random(1000))
    assert hnsw_dedup.mended(graph) == 0
    q, node = hnsw_dedup.linked(graph, 16, x, x, 0.95, True)
    true = np.triu(x @ x.T >= 0.95, 1)
    assert len(q) == true.sum() > 40000 and true[np.minimum(q, node), np.maximum(q, node)].all()


def test_an_audit_widens_the_beam():
    rng = np.random.default_rng(11)
    x = hnsw_dedup.units(rng.normal(size=(3000, 48))).astype(np.float32)
    graph = hnsw_dedup.build(x, rng.random(3000), neighbours=4, beam=8)
    low = hnsw_dedup.audited(graph, 0.95, beam=1, recall=0)[1]
    beam, recall = hnsw_dedup.audited(graph, 0.95, beam=1)
    assert low < hnsw_dedup.RECALL <= recall and beam > 1


def test_the_table_has_no_lost_links(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    assert queries.QUERIES["op13_hnsw_dedup"](spark, "/root/testdata/sf0.1").agg(F.sum("n_links")).first()[0] == (
        x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95).sum() - len(x)


# --- 10: the share of rows that a search opens

def test_clustered_vectors_open_few_leaves():
    rng = np.random.default_rng(12)
    spread, centres = rng.normal(size=(4000, 32)), rng.normal(size=(200, 32))
    clustered = np.repeat(centres, 20, axis=0) + 0.05 * rng.normal(size=(4000, 32))
    shares = [ann_forest.share_for(ann_forest.fit(x, leaf=32), x / np.linalg.norm(x, axis=1, keepdims=True), 10) for x in (clustered, spread)]
    assert shares[0] <= 0.2 < shares[1]
    tiny = rng.normal(size=(1, 3))
    assert ann_forest.share_for(ann_forest.fit(tiny), tiny, 5) == ann_forest.SHARES[-1]
