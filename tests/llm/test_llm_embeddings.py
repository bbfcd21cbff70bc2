import numpy as np
import pytest

from keelson.llm import embeddings

NAN, INF = float("nan"), float("inf")


def plain(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    return sorted(((d, n, least[g], d is not None and d == least[g]) for (d, _), n, g in zip(rows, links, group)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out, f = [], lambda v: np.asarray(v, np.float32).tolist()
    for c in range(12):
        center = rng.normal(size=32)
        out += [(100 * c + k, f(center + rng.normal(size=32) * 0.12)) for k in range(1 + c)]
    out += [(5000 + k, f(rng.normal(size=32))) for k in range(60)]
    copy = out[3][1]
    out += [(9000 + k, copy) for k in range(20)] + [(9100, f(np.array(copy) * 8)), (9101, f(-np.array(copy)))]
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_planted_groups(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = plain(rows)
    assert sum(w[1] for w in want) > 400
    assert got(embeddings.near_duplicates(df, recall=0.9999)) == want
    assert got(embeddings.near_duplicates(df, recall=0.9999, block_rows=3)) == want


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
            (8, [2.0, 4.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [3e38, 3e38]), (11, [1e-30, 1e-30]), (None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, node string, keys string")
    assert got(embeddings.near_duplicates(df, recall=0.9999)) == plain(rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_near_the_threshold(spark):
    """Pairs planted at cosine 0.9 to 0.92 among others: at least 0.9 of them are found, none below."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.92, (len(base), 1))
    twin = cos * base + np.sqrt(1 - cos ** 2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, twin]))]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    linked = sum(r.n_links for r in out) / (2 * len(base))
    assert 0.9 <= linked <= 1.0
    assert embeddings.tables_for(10 ** 9)[1] > embeddings.tables_for(10 ** 4)[1]
