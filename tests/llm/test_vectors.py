"""Vector operators against plain numpy, on planted neighbours, hostile rows and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemill.llm import hard_negatives as H, vector_dedup as D, whitening as W

NAN, INF = float("nan"), float("inf")
COLUMNS = "vec_id long, embedding array<float>, label int, n_links string, kept int, component string, id int"
# rows that take no part in one operator or another: (id, vector, label)
HOSTILE = [
    (None, [1.0] * 8, 1), (900, None, 1), (901, [], 1), (902, [1.0] * 7, 1), (903, [1.0] * 7 + [None], 1),
    (904, [1.0] * 7 + [NAN], 1), (905, [INF] + [1.0] * 7, 1), (906, [0.0] * 8, 1), (907, [1.0] * 8, None), (908, [0.0] * 7 + [-0.0], 1),
]


def planted(seed=5, size=8):
    """Groups of vectors about a threshold of 0.93, copies, repeated rows, multiples."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for members, noise in ((60, 0.18), (40, 0.3), (30, 0.05), (80, 2.0), (1, 0.0)):
        centre = rng.normal(size=size)
        for _ in range(members):
            rows.append((at, [float(np.float32(x)) for x in centre + noise * rng.normal(size=size)], int(rng.integers(0, 2))))
            at += 1
    rows += [(at + i, rows[3][1], rows[3][2]) for i in range(5)] + [rows[10], rows[10]]
    return rows + [(at + 10, [2.0 * x for x in rows[0][1]], rows[0][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 3, "x", 1) for r in rows], COLUMNS).repartition(3)


def sound(vector, size=8):
    return vector is not None and len(vector) == size and all(x is not None and math.isfinite(x) for x in vector)


def linked(rows, threshold):
    """(id, links, component) of each row by comparing all pairs."""
    own = [i if label is not None and sound(v) and any(v) and i is not None else None for i, v, label in rows]
    neighbours = [set() for _ in rows]
    for a, (_, v, k) in enumerate(rows):
        for b, (_, w, m) in enumerate(rows):
            if a != b and own[a] is not None and own[b] is not None and k == m:
                x, y = np.array(v), np.array(w)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    neighbours[a].add(b)
    answers = []
    for a, (i, _, _) in enumerate(rows):
        seen, open_ = {a}, [a]
        while open_:
            for b in neighbours[open_.pop()] - seen:
                seen.add(b)
                open_.append(b)
        answers.append((i, len(neighbours[a]), min(rows[b][0] for b in seen) if i is not None else None))
    return sorted(answers, key=str)


@pytest.mark.parametrize("list_, block", [(1024, 2048), (16, 2048), (16, 20)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, list_, block):
    monkeypatch.setattr(D, "LIST", list_)
    monkeypatch.setattr(D, "BLOCK", block)
    rows = planted() + HOSTILE
    made = D.near_duplicate_vectors(frame(spark, rows))
    assert made.columns == ["vec_id", "embedding", "label", "component", "id", "n_links", "component_id", "kept"]
    got = made.collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == linked(rows, 0.93)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_wide_vectors_link_in_double_precision(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.93, math.sqrt(1 - 0.93**2) - 1e-12], 1), (3, [0.93, -math.sqrt(1 - 0.93**2) - 1e-12], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.near_duplicate_vectors(table).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_bands_keep_the_chance_of_a_miss():
    for rows in (0, 1, 500, 5000, 10**6, 10**9):
        bits, bands = D.bands_of(rows, 0.93)
        met = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - met) ** bands <= D.MISS and rows / 2**bits <= D.LIST


def test_estimates_are_unbiased_and_within_their_bounds():
    """Over many rotations the mean error vanishes and no error leaves the bound."""
    rng = np.random.default_rng(1)
    cosine = 0.93
    errors, allowed = [], []
    for seed in range(400):
        o, w = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        q = cosine * o + math.sqrt(1 - cosine**2) * w
        turn = D.rotation(64, 128, seed)
        assert np.allclose(turn.T @ turn, np.eye(64))
        signs, factors = D.encode(o[None], turn)
        errors.append(float(D.estimates(signs, factors, (turn @ q)[None])[0, 0]) - cosine)
        allowed.append(D.deviations(factors, 128, cosine)[0])
    errors, allowed = np.array(errors), np.array(allowed)
    assert abs(errors.mean()) < 4 * errors.std() / 20 and np.abs(errors / allowed).max() < 4.5
    assert errors.std() == pytest.approx(allowed.mean(), rel=0.15)


def negatives(rows, anchor, positives=2, found=3, low=30, high=90):
    """Rows by scoring everything, anchors by place."""
    part = [(i, np.floor(256 * np.array(v, dtype=float)).astype(int), k) for i, v, k in rows if i is not None and k is not None and sound(v)]
    answer, seen = [], set()
    for i, v, k in part:
        if not anchor(i) or (i, k, tuple(v)) in seen:
            continue
        seen.add((i, k, tuple(v)))
        scored = sorted((-int(v @ w), j, m) for j, w, m in part)
        near = [(j, -s) for s, j, m in scored if m == k and j != i][:positives]
        for j, p in near:
            fit = [(h, -s) for s, h, m in scored if m != k and low * p <= 100 * -s <= high * p][:found]
            answer += [(i, j, n + 1, h, p, s) for n, (h, s) in enumerate(fit)]
    return sorted(answer)


@pytest.mark.parametrize("anchors, chunk", [(1024, 1024), (4, 7)])
def test_hard_negatives_are_those_of_all_scores(spark, monkeypatch, anchors, chunk):
    monkeypatch.setattr(H, "ANCHORS", anchors)
    monkeypatch.setattr(H, "CHUNK", chunk)
    rows = planted() + HOSTILE + [(50, [5000.0] * 8, 1)]
    made = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=3).collect()
    wanted = negatives(rows[:-1], lambda i: i % 10 == 0)
    assert sorted(map(tuple, made)) == wanted and len(wanted) > 20


def test_planes_and_tables_give_inner_products():
    rng = np.random.default_rng(2)
    for length, bits in ((8, 2), (64, 10), (13, 21), (1, 1)):
        low, high = -(1 << bits - 1), (1 << bits - 1)
        a, c = (rng.integers(low, high, size=(n, length)) for n in (5, 9))
        planes = H.pack_planes(c, bits)
        assert planes.shape == (9, bits, -(-length // 8))
        assert (H.unpack_planes(planes)[:, :length] == c).all()
        tables = H.subset_sums(H.unpack_planes(H.pack_planes(a, bits)))
        assert (H.look_up(tables, planes) == c @ a.T).all()


def test_whitening_is_that_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 256)
    monkeypatch.setattr(W, "BLOCK_COLUMNS", 5)
    monkeypatch.setattr(W, "BLOCKS_A_TASK", 2)
    rows = [r for r in planted() if r[0] != 215] + HOSTILE
    got = W.whiten(frame(spark, rows), components=6).collect()
    part = [(i, v) for i, v, _ in rows if sound(v)]
    x = np.floor(64 * np.array([v for _, v in part])).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:6]
    wanted = centred @ directions[:, order] / np.sqrt(values[order])
    wanted *= np.sign(wanted[0])
    ids = [i for i, _ in part]
    sign = [next(r.whitened for r in got if r.vec_id == 0 and r.component == c + 1) for c in range(6)]
    key = lambda i: -1 if i is None else i
    mine = sorted((key(r.vec_id), r.component, r.whitened * np.sign(sign[r.component - 1])) for r in got)
    theirs = sorted((key(i), c + 1, float(w[c])) for i, w in zip(ids, wanted) for c in range(6))
    assert len(mine) == len(theirs) and np.allclose(mine, theirs, atol=1e-8)
    deviations = {i: int(d) for i, d in zip(ids, ((n * x - sums) ** 2).sum(axis=1))}
    assert all(r.n == n and int(r.deviation) == deviations[r.vec_id] and r.identity_error < 1e-9 for r in got)
    assert {r.component: r.explained for r in got} == pytest.approx({c + 1: values[o] / values.sum() for c, o in enumerate(order)})


def test_dimensions_without_variance_give_no_component(spark):
    rows = [(i, [float(i), 7.0, float(-i), float(i % 3)], 1) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.component for r in W.whiten(table).collect()} == {1, 2}
    same = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(5)], "vec_id long, embedding array<double>, label int")
    assert W.whiten(same).count() == 0


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(1, [1.0e10, 0.5]), (2, [-1.0e10, 3.0]), (3, [2.0e9, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    wanted = {i: sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(rows, x)}
    assert {r.vec_id: int(r.deviation) for r in W.whiten(table).collect()} == wanted


@pytest.mark.parametrize("rows", [[], HOSTILE[1:3]])
def test_tables_without_vectors(spark, rows):
    table = frame(spark, rows)
    got = D.near_duplicate_vectors(table)
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.orderBy("vec_id").collect()] == [(r[0], 0, r[0], True) for r in rows]
    assert H.hard_negatives(table, F.col("vec_id") % 10 == 0).count() == 0
    assert W.whiten(table).count() == 0
