import numpy as np
import pytest

from flowlake.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, whitened string, size double, data binary"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, 1, "w", 0.5, b"") for k, v in rows], SCHEMA)


def plain(vectors):
    """Eigenvalues, eigenvectors and deviations by numpy on the whole covariance."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = away / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return values[::-1], axes[:, ::-1], centred, (away.astype(object) ** 2).sum(axis=1)


def compare(rows, ids, vectors, count):
    values, axes, centred, squares = plain(vectors)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == len(ids) * count
    want = centred @ axes[:, :count] / np.sqrt(values[:count])
    got = np.array([[by[k, c]["whitened"] for c in range(1, count + 1)] for k in ids])
    signs = np.sign((want * got).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7
    for c in range(count):
        assert by[ids[0], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert all(by[k, 1]["deviation"] == s for k, s in zip(ids, squares))
    assert {r["n"] for r in rows} == {len(ids)}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-8


@pytest.mark.parametrize(
    ("spectrum", "count"),
    [
        (np.linspace(200, 1, 200), 32),
        (np.r_[1e4, 50, 20, np.full(90, 1.0) - np.arange(90) * 1e-3], 5),
        (np.r_[np.full(6, 3.0), np.full(50, 1.0)], 6),
        (np.r_[9, 4, 1, np.zeros(70)], 3),
        (np.ones(4), 32),
    ],
)
def test_leading_pairs_of_given_spectra(spectrum, count):
    size = len(spectrum)
    axes = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    whole = (axes * spectrum) @ axes.T
    asked = []

    def multiply(q):
        asked.append(q.shape[1])
        return whole @ q

    found = whitening.leading(multiply, size, count, spectrum.sum())
    assert np.allclose(found.values, np.sort(spectrum)[::-1][:count], atol=1e-9 * spectrum.max())
    left = np.linalg.norm(whole @ found.vectors - found.vectors * found.values, axis=0)
    assert left.max() < 1e-11 * spectrum.max()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(found.vectors.shape[1])).max() < 1e-12
    # blocks stay narrower than the space where there is room for it, and few passes suffice
    assert max(asked) <= max(count + max(8, count // 2) + 1, 1) and len(asked) == found.passes <= 120


def test_a_lower_bound_of_the_spectrum():
    values = np.linspace(100, 50, 60)
    lanczos = whitening._Lanczos(60, 12, np.random.default_rng(1))
    while lanczos.wanted:
        assert lanczos.lowest() == 0
        lanczos.take(values * lanczos.basis[-1])
    assert 20 < lanczos.lowest() <= 50


def test_registered_whitening_matches_numpy(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.op12_whitening(spark, small).collect()
    compare(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table], 32)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(50, 6)).astype(np.float32)
    good[20:30] = good[20]
    rows = [(i, v.tolist()) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0]]
    found = whitening.whiten(frame(spark, rows + [(100 + i, v) for i, v in enumerate(bad)]).repartition(5))
    compare(found.withColumnRenamed("id", "vec_id").collect(), list(range(50)), good, 6)
    # no id, and the same row twice
    again = whitening.whiten(frame(spark, [*rows, (None, rows[0][1]), rows[1]]))
    assert again.where("id IS NULL").count() == 6 and again.where("id = 1").count() == 12
    for nothing in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]):
        assert whitening.whiten(frame(spark, nothing)).count() == 0
    # two points have one direction
    assert whitening.whiten(frame(spark, [(1, [0.0, 3.0]), (2, [4.0, 0.0])])).select("component").distinct().count() == 1


def test_sums_of_squares_beyond_63_bits(spark):
    rows = [(i, [float(i % 7) * 2.0**33, 1.0]) for i in range(70)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    _, _, _, squares = plain([v for _, v in rows])
    assert max(squares) > 1 << 63
    assert {r["id"]: int(r["deviation"]) for r in found.where("component = 1").collect()} == dict(enumerate(squares))
