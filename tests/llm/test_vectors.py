"""Vector searches against brute force, and their edge cases."""

import numpy as np
import pytest

pytest.importorskip("feedwright.llm")

from feedwright.llm import multi_index, vantage, vectors
from feedwright.llm.queries import QUERIES

NAN = float("nan")


def table_rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()]


def brute_nearest(rows, step, k):
    """{search: [(id, score)]}, over usable rows with distinct (id, vector)."""
    fine = sorted({(n, tuple(float(np.float32(x)) for x in v)) for n, v, *_ in rows if n is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    data, ids = np.array([v for _, v in fine], dtype=float), np.array([n for n, _ in fine])
    out = {}
    for name in sorted({n for n in ids if n % step == 0}):
        own = data[np.flatnonzero(ids == name)[0]]
        score = (data * own).sum(axis=1)
        order = [k_ for k_ in np.lexsort([ids, -score]) if ids[k_] != name][:k]
        out[int(name)] = [(int(ids[k_]), float(score[k_])) for k_ in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def same(got, want):
    assert {k: [n for n, _ in v] for k, v in got.items()} == {k: [n for n, _ in v] for k, v in want.items() if v}
    assert all(abs(a - b) < 1e-9 for k in got for (_, a), (_, b) in zip(got[k], want[k]))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_query(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    want = brute_nearest(table_rows(spark, sf_dir), 20, 20)
    got = found(QUERIES["op11_vantage_point_search"](spark, sf_dir))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({n for n, _ in got[k]} & {n for n, _ in want[k]}) / 20 for k in want])
    assert recall >= 0.95
    exact = {k: dict(v) for k, v in want.items()}
    assert all(abs(exact[k][n] - s) < 1e-12 for k, v in got.items() for n, s in v if n in exact[k])


def test_factor_one_is_exact_and_less_prunes():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 6
    points = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8)) * rng.uniform(0.1, 2, (4000, 1))
    tree = vantage.VantagePointTree(points)
    searches = points[::200]
    rows, scores = tree.search(searches, 10, 1.0)
    want = np.argsort(-(searches @ points.T), axis=1)[:, :10]
    assert all(set(a) == set(b) for a, b in zip(rows, want))
    assert sorted(tree.order) == list(range(4000))
    loose, _ = tree.search(searches, 10, 0.05)
    assert (loose >= 0).all() and all(len(set(line)) == 10 for line in loose)


HARD = [
    (0, [1.0, 0.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0, 0.0], 2), (2, [1.0, 0.0, 0.0, 0.0], 2),
    (3, None, 1), (4, [], 1), (5, [0.0] * 4, 1), (6, [NAN, 1.0, 0.0, 0.0], 1), (7, [None, 1.0, 0.0, 0.0], 1),
    (8, [float("inf"), 1.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (9, [-3.0, 0.5, 0.0, 0.0], None), (10, [0.5, 0.5, 0.5, 0.5], 2),
    (20, [5.0, 0.1, 0.0, 0.0], 1), (40, [0.0, 0.0, 0.0, 2.0], 3), (60, None, 1), (80, [0.0] * 4, 2), (-20, [0.1, 0.1, 0.0, 0.0], 2),
]


def test_nearest_of_hard_rows(spark):
    many = HARD + [(100 + k, [1.0, 0.0, 0.0, 0.0], 4) for k in range(120)]
    for rows in (HARD, many):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
        for factor in (1.0, 0.25):
            got = found(vantage.nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), k=6, factor=factor))
            same(got, brute_nearest([(n, v) for n, v, _ in rows], 20, 6))
    none = frame.limit(0)
    assert vantage.nearest_neighbours(none, frame.where("vec_id = 20")).count() == 0
    assert vantage.nearest_neighbours(frame, none).count() == 0
    alone = frame.where("vec_id = 20")
    assert vantage.nearest_neighbours(alone, alone).count() == 0


def brute_negatives(rows, anchor_step, positives=5, negatives=10, window=(30, 90)):
    fine = sorted({(n, g, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for n, v, g in rows if n is not None and g is not None and v and None not in v and np.isfinite(v).all()})
    out = []
    for name, label, own in fine:
        if name % anchor_step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v)), n, g) for n, g, v in fine if n != name)
        for s, n, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(t, m) for t, m, g in scored if g != label and window[0] * -s <= 100 * -t <= window[1] * -s][:negatives]
            out += [(name, n, rank, m, -s, -t) for rank, (t, m) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_of_hard_rows(spark):
    rng = np.random.default_rng(2)
    noise = [(k, rng.normal(size=6).astype("f4").tolist(), int(rng.integers(0, 3))) for k in range(400)]
    equal = [(1000 + k, [0.5, 0.5, 0.0, 0.0, 0.1, 0.1], k % 2) for k in range(60)]
    huge = [(2000, [3e18, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (2001, [0.0, 1e3, 0.0, 0.0, 0.0, 0.0], 0)]
    pad = [(n if n is None else n + 3000, v and [*v, 0.0, 0.0], g) for n, v, g in HARD]
    for rows in (noise, noise[:3] + equal, noise + equal + pad):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
        got = multi_index.mine_negatives(frame, frame.where("vec_id % 20 = 0"))
        assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 20)
    none = frame.limit(0)
    assert multi_index.mine_negatives(none, frame).count() == 0 and multi_index.mine_negatives(frame, none).count() == 0
    index = multi_index.MultiIndex(spark.createDataFrame(huge, "id long, vec array<double>, label long").toArrow(), (np.zeros((1, 3)), np.zeros((1, 3))), 1.0)
    assert index.scores(np.array([0, 1]), np.array([3.0, 2.0, 0, 0, 0, 0])).tolist() == [int(np.float64(3e18)) * 3 + 2, 2000]


def test_walk_visits_every_row_in_order_of_bounds(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(500, 6))
    frame = spark.createDataFrame([(k, row.tolist(), k % 3) for k, row in enumerate(data)], "id long, vec array<double>, label long")
    index = multi_index.MultiIndex(frame.toArrow(), multi_index.fit_codebooks(frame, 256), 256)
    search = np.floor(256 * data[0])
    seen, last = [], np.inf
    for rows, later in index.walk(search):
        assert index.scores(rows, search).max() <= last
        seen += rows.tolist()
        last = later
    assert sorted(seen) == list(range(500))


def test_vectors_of_different_lengths_are_refused(spark):
    frame = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<double>")
    with pytest.raises(ValueError):
        vectors.matrix(frame.toArrow().column("vec").combine_chunks())
