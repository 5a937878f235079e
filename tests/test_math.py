"""Kernels and gradients, without Spark."""

import numpy as np
import pytest

from tessella.functions.kernels import softmax_rows, sparsemax_rows, unit_rows
from tessella.operators import fit as FT
from tessella.operators import frames as FR

rng = np.random.default_rng(11)


def test_sparsemax_properties():
    x = rng.standard_normal((500, 6)) * 3
    w = sparsemax_rows(x)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and (w == 0).any()
    assert np.allclose(sparsemax_rows(w), w)  # a point of the simplex projects to itself
    other = rng.dirichlet(np.ones(6), 500)
    assert (((x - w) ** 2).sum(axis=1) <= ((x - other) ** 2).sum(axis=1) + 1e-12).all()
    assert np.allclose(softmax_rows(x).sum(axis=1), 1)


def numeric(f, theta, h=1e-6):
    g = np.zeros_like(theta)
    for i in np.ndindex(theta.shape):
        a, b = theta.copy(), theta.copy()
        a[i] += h
        b[i] -= h
        g[i] = (f(a) - f(b)) / (2 * h)
    return g


@pytest.mark.parametrize("activation", ["sparsemax", "softmax"])
def test_unmix_gradient(activation):
    z, y = unit_rows(rng.standard_normal((20, 7))), (rng.random((20, 3)) < 0.5).astype(float)
    raw, log_tau = rng.standard_normal((3, 7)), np.log(np.array([3.0, 2.0, 4.0]))
    loss = lambda p, lt: (lambda o: o[0] + 0.7 * o[1])(FT.unmix_sums(z, y, p, np.exp(lt), 0.7, activation))
    _, _, g, gt, gz = FT.unmix_sums(z, y, raw, np.exp(log_tau), 0.7, activation)
    assert np.allclose(g, numeric(lambda p: loss(p, log_tau), raw), atol=1e-4)
    assert np.allclose(gt, numeric(lambda t: loss(raw, t), log_tau), atol=1e-4)
    whole = lambda v: (lambda o: o[0] + 0.7 * o[1])(FT.unmix_sums(v, y, raw, np.exp(log_tau), 0.7, activation))
    assert np.allclose(gz, numeric(whole, z), atol=1e-4)


def test_repulsion_and_subspace_gradients():
    raw = rng.standard_normal((4, 6))
    assert np.allclose(FT.repulsion(raw, 0.5)[1], numeric(lambda p: FT.repulsion(p, 0.5)[0], raw), atol=1e-5)
    z, y = unit_rows(rng.standard_normal((15, 6))), np.ones((15, 3))
    w, q = np.linalg.qr(rng.standard_normal((6, 4)))[0].T, rng.standard_normal((3, 4))
    tau = np.full(3, 2.0)
    _, _, gw, gq = FT.subspace_sums(z, y, w, q, tau, 0.0)
    assert np.allclose(gw, numeric(lambda v: FT.subspace_sums(z, y, v, q, tau, 0.0)[0], w), atol=1e-4)
    assert np.allclose(gq, numeric(lambda v: FT.subspace_sums(z, y, w, v, tau, 0.0)[0], q), atol=1e-4)


@pytest.mark.parametrize("gammas", [(0.0, 0.0, 0.0), (1.0, 4.0, 0.05), (0.0, 2.0, 0.1)])
def test_head_gradients(gammas):
    logits, y = rng.standard_normal((30, 4)), (rng.random((30, 4)) < 0.5).astype(float)
    assert np.allclose(FT.bce_sums(logits, y)[1], numeric(lambda t: FT.bce_sums(t, y)[0], logits), atol=1e-5)
    f = lambda t: FT.asymmetric_sums(t, y, *gammas)[0]
    assert np.allclose(FT.asymmetric_sums(logits, y, *gammas)[1], numeric(f, logits), atol=1e-4)
    if gammas == (0.0, 0.0, 0.0):  # plain cross-entropy
        assert np.isclose(f(logits), FT.bce_sums(logits, y)[0])


def test_attention_gradient():
    z, d_bag = unit_rows(rng.standard_normal((9, 5))), rng.standard_normal(5)
    parts = [rng.standard_normal((3, 5)), rng.standard_normal((3, 5)), rng.standard_normal(3)]

    def bag(v, u, w):
        m = FT.AttentionModel(("a",), v, u, w, np.zeros((1, 5)), np.zeros(1))
        a = np.exp(m.energy(z) - m.shift())
        return m, a.sum(), (a[:, None] * z).sum(axis=0) / a.sum()

    m, mass, b = bag(*parts)
    got = FT.attention_tile_grad(z, np.tile(b, (9, 1)), np.tile(d_bag, (9, 1)), np.full(9, mass), m)
    for i in range(3):
        f = lambda t, i=i: float(bag(*[t if j == i else p for j, p in enumerate(parts)])[2] @ d_bag)
        assert np.allclose(got[i], numeric(f, parts[i]), atol=1e-5)


def test_row_uniform_is_uniform_and_order_free():
    ids = np.arange(5000, dtype=np.uint64)
    u = FT.row_uniform(ids, 8, 3)
    assert abs(u.mean() - 0.5) < 0.01 and u.min() >= 0 and u.max() < 1
    assert np.array_equal(FT.row_uniform(ids[::-1], 8, 3), u[::-1])


def test_gaussian_and_resize_matrices():
    a = rng.random(40)
    g = FR.gaussian_matrix(40, 2.0, "reflect")
    assert np.allclose(g.sum(axis=1), 1)
    r = int(4 * 2.0 + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / 2.0) ** 2)
    assert np.allclose(g @ a, np.convolve(np.pad(a, r, mode="symmetric"), k / k.sum(), "valid"))
    z = FR.gaussian_matrix(40, 2.0, "zero")
    k = np.exp(-0.5 * (np.arange(-6, 7) / 2.0) ** 2)
    assert np.allclose(z @ a, np.convolve(a, k / k.sum(), "same"))
    assert z.sum(axis=1)[0] < 1
    up = FR.resize_matrix(3, 6, antialias=False) @ np.array([0.0, 1.0, 2.0])
    assert np.allclose(up, [0, 0.25, 0.75, 1.25, 1.75, 2.0])
    assert np.allclose(FR.resize_matrix(8, 4) @ np.ones(8), 1)


def test_flatten_removes_a_gain_field():
    gain = np.linspace(0.6, 1.4, 96)[None, :, None]
    scene = np.full((96, 96, 3), 120.0)
    out = FR.flatten_of(scene * gain, "divide", 12.0, 4, "reflect")
    assert out[16:-16, 16:-16].std() < (scene * gain).std() / 5
    assert FR.flatten_of(scene, "none").max() == 120
    with pytest.raises(ValueError):
        FR.flatten_of(scene, "median")


def test_augment_plan_stays_inside(spark):
    """Corners inside the frame, areas of the wanted share at least, angles near a quarter turn where only these fit, draws by id alone."""
    frames = spark.range(600).selectExpr("id AS image_id", "IF(id % 3 = 0, 194, 80) AS height", "IF(id % 3 = 2, 400, 259) AS width")
    rows = FR.augment_plan(frames, 2, 0.4, 9).collect()
    assert len(rows) == 1200 and sorted({r.aug_idx for r in rows}) == [0, 1]
    turned = set()
    for r in rows:
        t, half = np.radians(r.angle), (r.side - 1) / 2
        corners = np.exp(1j * t) * np.array([-1 - 1j, 1 - 1j, 1 + 1j, -1 + 1j]) * half
        x, y = corners.real + (r.width - 1) / 2 + r.ox, corners.imag + (r.height - 1) / 2 + r.oy
        assert x.min() > -1e-6 and x.max() < r.width - 1 + 1e-6 and y.min() > -1e-6 and y.max() < r.height - 1 + 1e-6
        room = min(r.height, r.width) - 2
        assert min(np.ceil(np.sqrt(0.4 * r.height * r.width)), room) <= r.side <= room
        turned.add(int(r.angle // 90))
        if r.side == room:  # only a quarter turn fits
            assert min(r.angle % 90, 90 - r.angle % 90) < 1e-6 or r.height * r.width * 0.4 < room * room
    assert turned == {0, 1, 2, 3}
    again = FR.augment_plan(frames.repartition(7), 2, 0.4, 9)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, FR.augment_plan(frames, 2, 0.4, 10).collect())) != sorted(map(tuple, rows))


def test_crop_at_quarter_turns_and_shifts():
    a = rng.integers(0, 255, (21, 21, 3)).astype(np.uint8)
    assert np.array_equal(FR.crop_at(a, 0.0, 11, 0, 0), a[5:16, 5:16])
    assert np.array_equal(FR.crop_at(a, 0.0, 11, 2, -3), a[7:18, 2:13])
    assert np.array_equal(FR.crop_at(a, 180.0, 11, 0, 0), a[5:16, 5:16][::-1, ::-1])
    quarter = FR.crop_at(a, 90.0, 11, 0, 0)
    assert any(np.array_equal(quarter, np.rot90(a[5:16, 5:16], k)) for k in (1, 3))


def test_gather_is_bilinear():
    a = rng.random((6, 7, 2))
    y, x = np.array([0.0, 2.5, 5.0, -1.0]), np.array([0.0, 3.25, 6.0, 9.0])
    got = FR.gather(a, y, x)
    assert np.allclose(got[0], a[0, 0]) and np.allclose(got[2], a[5, 6]) and np.allclose(got[3], a[0, 6])
    assert np.allclose(got[1], (0.75 * a[2, 3] + 0.25 * a[2, 4] + 0.75 * a[3, 3] + 0.25 * a[3, 4]) / 2)


def test_noise_depends_on_image_and_severity():
    a = rng.integers(60, 200, (40, 40, 3)).astype(np.uint8)
    noise = FR.corrupted(a, "sensor_noise", 2, 7)
    assert np.array_equal(noise, FR.corrupted(a, "sensor_noise", 2, 7)) and not np.array_equal(noise, FR.corrupted(a, "sensor_noise", 2, 8))
    spread = [(FR.corrupted(a, "sensor_noise", s, 7).astype(float) - a).std() for s in (1, 2, 3)]
    assert spread[0] < spread[1] < spread[2]
