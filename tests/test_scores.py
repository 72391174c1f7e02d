"""Orientations against singular values of the centred points."""

import numpy as np

from shapelab.plans.scores import principal_axes


def test_principal_axes(spark):
    rng = np.random.default_rng(5)
    shapes = {k: rng.gamma(1.5, 1, (60, 3)) * [4, 2, 1] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for k in range(4)}
    rows = [(k, *map(float, x)) for k, p in shapes.items() for x in p]
    got = {r.label: np.array(r.axes).reshape(3, 3) for r in principal_axes(spark.createDataFrame(rows, "label int, x double, y double, z double"), "label").collect()}
    assert set(got) == set(shapes)
    for k, p in shapes.items():
        c = p - p.mean(axis=0)
        want = np.linalg.svd(c.T)[0].T
        own = c @ want.T
        want[own.max(axis=0) + own.min(axis=0) < 0] *= -1
        assert np.allclose(got[k], want, atol=1e-6)
    assert principal_axes(spark.createDataFrame([], "label int, x double, y double, z double"), "label").count() == 0
