"""Near-duplicate vectors against all pairs, and the recall of the index."""

import numpy as np
import pytest

from tablevitals.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, limit=0.98):
    """n_links and component of each row, by comparing all pairs."""
    rows = list(dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows))

    def able(vector, label):
        return label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)

    vectors = [np.array(v, dtype=np.float32).astype(float) if able(v, label) else None for _, v, label in rows]
    links = {at: set() for at in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is not None and y is not None and len(x) == len(y) and rows[a][2] == rows[b][2]:
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y >= limit * np.linalg.norm(x) * np.linalg.norm(y):
                    links[a].add(b)
                    links[b].add(a)
    found = {}
    for at in range(len(rows)):
        reached, todo = {at}, [at]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        ids = [rows[r][0] for r in reached if rows[r][0] is not None]
        found[rows[at]] = len(links[at]), min(ids, default=None)
    return found


def noisy(random, base, spread, count):
    return [list(map(float, base + random.normal(0, spread, len(base)))) for _ in range(count)]


def fixture(dims=64, seed=3):
    random = np.random.default_rng(seed)
    rows = [(i, list(map(float, random.standard_normal(dims))), i % 3) for i in range(300)]
    rows += [(400 + i, v, 1) for i, v in enumerate(noisy(random, np.array(rows[10][1]), 0.08, 60))]
    rows += [(500 + i, v, 1) for i, v in enumerate(noisy(random, np.array(rows[10][1]), 0.16, 60))]
    rows += [(600 + i, rows[5][1], 2) for i in range(40)] + [(700, [2 * x for x in rows[5][1]], 2), (701, rows[5][1], 0)]
    return rows


def test_links_and_components_equal_all_pairs(spark):
    rows = fixture()
    found = embeddings.linked(spark.createDataFrame(rows, SCHEMA).repartition(4), cell=16).collect()
    truth = {key[0]: value for key, value in expected(rows).items()}
    links = sum(n for n, _ in truth.values())
    assert len(found) == len(rows) and links > 2000
    assert all(r.n_links <= truth[r.vec_id][0] for r in found)
    assert sum(r.n_links for r in found) >= 0.97 * links
    assert sum(r.component_id == truth[r.vec_id][1] for r in found) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("dims", [8, 64, 200])
def test_recall_of_pairs_at_the_limit(dims):
    """The candidates among pairs whose cosine is barely 0.98, and how few others there are."""
    random = np.random.default_rng(dims)
    sample = embeddings.unit(random.standard_normal((5000, dims)))
    model = embeddings.fitted(sample)
    at = embeddings.unit(random.standard_normal((4000, dims)))
    across = random.standard_normal(at.shape)
    across = embeddings.unit(across - (across * at).sum(axis=1, keepdims=True) * at)
    near = 0.981 * at + np.sqrt(1 - 0.981**2) * across
    codes = [embeddings.quantised(rows, model.mean, model.rotation) for rows in (at, near)]
    equal, bits = embeddings.differing(*codes)
    assert ((equal >= model.same) & (bits <= model.radius)).mean() >= 0.9
    balance = np.unpackbits(codes[0].view(np.uint8)).reshape(-1, 64).mean(axis=0)
    assert abs(balance - 0.5).max() < 0.15
    if dims >= 64:
        equal, bits = embeddings.differing(codes[0][:2000], codes[0][2000:])
        assert ((equal >= model.same) & (bits <= model.radius)).mean() < 0.001


def test_rows_that_cannot_be_compared(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, nan, 3.0], 1), (9, [1.0, inf, 3.0], 1),
            (10, v, 2), (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (13, [1e-38, 2e-38, 3e-38], 1), (14, [1e38, 2e38, 3e38], 1), (15, [-1.0, -2.0, -3.0], 1)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = {1, 2, 13, 14}
    for vec_id, *_ in rows:
        want = (3, 1, vec_id == 1) if vec_id in one else (1, 11, vec_id == 11) if vec_id in (11, 12) else (0, vec_id, True)
        assert found[vec_id] == want, vec_id


def test_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (3, w, 1), (4, w, 1), (None, [1.0, -1.0], 1), (None, [1.0, -1.0], 1)]
    found = sorted(map(str, (tuple(r) for r in embeddings.linked(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = [(None, 1, 3, False), (3, 1, 3, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True), (None, 0, None, True)]
    assert found == sorted(map(str, want))


def test_hot_vector_and_doubles(spark):
    random = np.random.default_rng(1)
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 == 0 else list(map(float, random.standard_normal(3))), 1) for i in range(600)]
    found = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    hot = [r for r in found if r.vec_id % 3 == 0]
    assert len(found) == 600 and len({r.component_id for r in hot}) == 1 and all(r.n_links >= 199 for r in hot)


def test_empty_table_and_other_columns(spark):
    assert embeddings.linked(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embeddings.linked(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == [(1, 0, 1, True)]
    rows = [(1, [1.0, 1.0], 1, 5, "x"), (2, [1.0, 1.01], 1, 6, "y")]
    found = embeddings.linked(spark.createDataFrame(rows, SCHEMA + ", node int, code string")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_hot_places_of_tables_lose_nothing(spark, monkeypatch):
    """Where blocks are paired and not codes, the same links come out, as cells look at the same rule."""
    rows = fixture()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(embeddings, "HOT", 1 << 40)
    plain = sorted(map(tuple, embeddings.linked(frame).collect()))
    monkeypatch.setattr(embeddings, "HOT", 3)
    assert sorted(map(tuple, embeddings.linked(frame, cell=16).collect())) == plain
