"""Vector codes and centroid clustering against plain loops over all entries and all centroids."""

import hashlib
import itertools

import numpy as np
import pytest

from beamframe.llm import centroids, vector_codes
from tests.llm.cases import clash, same

SCHEMA = "vec_id long, embedding array<float>, label int"


def floors(v, scale):
    return np.floor(np.asarray(v, np.float32).astype(float) * scale).astype(int).tolist()


def nearest(point, centres):
    d = [sum((a - b) ** 2 for a, b in zip(point, c, strict=True)) for c in centres]
    return d.index(min(d)), min(d)


def lloyd(points, centres, rounds):
    for _ in range(rounds):
        at = [nearest(p, centres)[0] for p in points]
        for i in range(len(centres)):
            own = [p for p, a in zip(points, at, strict=True) if a == i]
            if own:
                centres[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return centres


def usable(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]


def plain_codes(rows, dims, parts, size, rounds, scale):
    kept = usable(rows, dims)
    w, q = dims // parts, [floors(r[1], scale) for r in kept]
    seeds = sorted((r[0], x) for r, x in zip(kept, q, strict=True) if r[0] is not None)[:size]
    books = [lloyd([x[p * w : p * w + w] for x in q], [s[1][p * w : p * w + w] for s in seeds], rounds) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by = [], {}
    for r, x in zip(kept, q, strict=True):
        found = [nearest(x[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for i, _ in found), sum(d for _, d in found), r[2]))
        by[r[2]] = by.get(r[2], 0) + out[-1][2]
    return [(i, c, e, by[label], digest) for i, c, e, label in out]


def plain_clusters(rows, k, rounds, dims, scale):
    kept = usable(rows, dims)
    q = [floors(r[1], scale) for r in kept]
    seeds = sorted((hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), x) for r, x in zip(kept, q, strict=True) if r[0] is not None)[:k]
    centres = lloyd(q, [s[1] for s in seeds], rounds)
    found = [(r[0], *nearest(x, centres)) for r, x in zip(kept, q, strict=True)]
    own = [sum(d for _, a, d in found if a == i) for i in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, a, d, own[a], sum(own), digest[a]) for i, a, d in found]


def odd_vectors(dims, n=150, seed=3):
    r = np.random.default_rng(seed)
    own = [(int(i), [float(x) for x in r.normal(size=dims) * 0.1 + (i % 3)], int(i % 4) if i % 5 else None) for i in range(n)]
    same_one = [float(x) for x in r.normal(size=dims)]
    own += [(1000 + i, same_one, 1) for i in range(n // 2)] + [own[3], (own[4][0], own[5][1], None), (None, own[6][1], 2)]
    bad = [None, [], own[0][1][:-1], own[0][1] + [0.0], [None] * dims, [float("nan")] + own[0][1][1:], [float("inf")] + own[0][1][1:], [-float("inf")] + own[0][1][1:]]
    return own + [(2000 + i, v, 0) for i, v in enumerate(bad)]


@pytest.mark.parametrize("size", [5, 70, 256])
def test_codes_are_those_of_plain_loops(spark, size):
    rows = odd_vectors(8)
    df = clash(spark.createDataFrame(rows, SCHEMA), "code", "error", "v", "q", "own").repartition(3)
    got = vector_codes.report(df, dims=8, parts=4, size=size, rounds=3, scale=1024)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same([tuple(r) for r in got.collect()], plain_codes(rows, 8, 4, size, 3, 1024))


@pytest.mark.parametrize("k", [1, 4, 16])
def test_clusters_are_those_of_plain_loops(spark, k):
    rows = odd_vectors(10)
    df = clash(spark.createDataFrame(rows, SCHEMA), "cluster", "distance", "ids", "place", "low").repartition(3)
    got = centroids.report(df, k=k, rounds=3, dims=10, scale=64)
    same([tuple(r) for r in got.collect()], plain_clusters(rows, k, 3, 10, 64))


def test_nothing_usable(spark):
    for rows in ([], [(1, None, 2)], [(None, [0.0] * 8, 1)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert vector_codes.report(df, dims=8).collect() == [] and centroids.report(df, dims=8).collect() == []


def test_fewer_rows_than_entries(spark):
    rows = [(i, [float(i), 0.5, -0.5, 0.0], i % 2) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    same([tuple(r) for r in vector_codes.report(df, dims=4, parts=2).collect()], plain_codes(rows, 4, 2, 256, 4, 1024))
    same([tuple(r) for r in centroids.report(df, dims=4).collect()], plain_clusters(rows, 16, 3, 4, 64))


@pytest.mark.parametrize("k", [1, 63, 64, 65, 200])
def test_masks_give_the_nearest_entry(k):
    r = np.random.default_rng(k)
    entries = r.integers(-30, 30, (k, 3))
    entries[k // 2] = entries[0]  # a tie
    points = np.concatenate([r.integers(-40, 40, (300, 3)), entries, r.integers(-100_000, 100_000, (20, 3))])
    at, distance = vector_codes.SliceMasks(entries).nearest(points)
    d = ((points[:, None, :] - entries) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_a_cube_holds_what_lies_in_it():
    entries = np.random.default_rng(1).integers(-50, 50, (130, 4))
    masks = vector_codes.SliceMasks(entries)
    found = np.unpackbits(masks.inside(entries[:20], np.full(20, 25)).view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (found == (np.abs(entries[:20, None, :] - entries).max(axis=2) <= 25)).all()


def test_codes_decode_within_their_error(spark):
    rows = usable(odd_vectors(8), 8)
    codes, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), dims=8, size=32)
    by = {r[0]: r[1] for r in rows if r[0] not in (3, 4, None)}
    for r in codes.where("vec_id > 4").collect():
        assert ((vector_codes.decode(r["code"], books) - floors(by[r["vec_id"]], 1024)) ** 2).sum() == r["error"]


@pytest.mark.parametrize(("d", "bits"), [(2, 4), (3, 3), (8, 1)])
def test_the_curve_visits_each_cell_once_and_steps_to_a_neighbour(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = centroids.hilbert_keys(cells, bits)
    assert len(set(keys.tolist())) == len(cells)
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_centroids_but_never_the_nearest():
    r = np.random.default_rng(5)
    centres = r.integers(-100, 100, (40, 3))
    left = 0
    for _ in range(50):
        points = r.integers(-100, 100, 3) + r.integers(-8, 8, (30, 3))
        few = centroids.candidates(points.min(axis=0), points.max(axis=0), centres)
        left += len(few)
        d = ((points[:, None, :] - centres) ** 2).sum(axis=2)
        at, distance = centroids.assign(points, few, centres)
        assert (at == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert left < 50 * 20


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e38] * 4, 0)], SCHEMA)
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.report(df, dims=4).collect()
