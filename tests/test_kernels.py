import math
import time

import numpy as np
import pytest

from loomstore.functions import exprs, kernels as K
from loomstore.operators import facility, planner


def test_content_hash_vectors():
    assert K.content_hash(b"") == "99aa06d3014798d86001c324468d497f"
    assert K.content_hash(b"hello") == "b5e9c1ad071b3e7fc779cfaa5e523818"
    assert K.content_hash(bytes([0, 1, 2, 3])) == "eb70bf5fc779e9e6a6111d53e80a3db5"


def test_seeds():
    assert K.lcg_seeds(3) == [10481999410520546993, 4159066171780167020, 7615522811268512075]
    assert K.row_seeds(2) == [12035703340208240907, 5197257009675513325]


def test_sketch_vectors_and_additivity():
    a = np.array([0x1234, 0x5678, 0, 0xFFFF], "<u2").tobytes()
    b = np.array([0x1234, 0x5679, 1, 0xFFFE], "<u2").tobytes()
    sa, sb = K.sketch(a, 2, 4), K.sketch(b, 2, 4)
    assert sa.tolist() == [-5, 0, 4, 0, -5, 4, -2, 0]
    assert sb.tolist() == [-5, 0, 3, 0, -6, 3, -3, 0]
    assert K.sketch_distance(sa, sb, 64) == 0.03125
    assert K.hamming(a, b) == 3
    assert (K.sketch(a[:4], 2, 4) + K.sketch(a[4:], 2, 4, 2) == sa).all()
    assert K.sketch(b"odd", 2, 4) is None


@pytest.mark.parametrize("p,cr", [(0, 0), (0.001, 0), (0.01, 0.0700), (0.05, 0.1929), (0.1, 0.2823), (0.2, 0.5006), (0.3, 0.6821), (0.35, 0.7004), (0.4, 0.6351), (0.45, 0.4584), (0.5, 0.1401)])
def test_predictor_vectors(p, cr):
    assert abs(planner.ratios(np.array([float(p)]))[0] - cr) < 6e-5


def test_transforms():
    x = bytes([0xA0, 0xA1, 0xB0, 0xB1, 0xC0, 0xC1])
    assert K.transpose(x, 2) == bytes([0xA0, 0xB0, 0xC0, 0xA1, 0xB1, 0xC1])
    assert K.untranspose(K.transpose(x, 2), 2) == x
    assert K.ungroup_bf16(K.regroup_bf16(x)) == x
    assert np.frombuffer(K.zigzag16(np.array([0, -1, 1, -2], "<i2").tobytes()), "<u2").tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("item,n", [(2, 8), (4, 8), (2, 0), (2, 65536 * 2), (4, 5 << 20)])
def test_delta_roundtrip(item, n):
    rng = np.random.default_rng(1)
    t, b = rng.integers(0, 9, n, dtype=np.uint8).tobytes(), rng.integers(0, 9, n, dtype=np.uint8).tobytes()
    assert K.decode_delta(K.encode_delta(t, b, item), b, item) == t
    with pytest.raises(ValueError):
        K.encode_delta(t + b"x", b, item)


def test_greedy_attach_rules():
    s = [np.array(v, np.int64) for v in ([0] * 8, [1] * 8, [500] * 8)] + [None]
    plan = planner.attach_group(s, np.array([1000] * 4), threshold=0.1)
    assert [p[0] for p in plan] == ["base", "delta", "base" if plan[2][0] == "base" else "delta", "skipped"]
    assert planner.attach_group([], np.array([])) == []


def test_flexsplit_on_drift():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 100, 8)
    r = planner.matrix(np.stack([base + 10 * i for i in range(10)]), 81000)
    bases = planner.open_bases(r)
    near, cost = planner.nearest_of(r, bases)
    assert 0 in bases and (cost == r[:, bases].min(1)).all()
    assert facility.cost(r, bases) <= facility.cost(r, [0]) + 1e-9


def test_solvers_against_exhaustive():
    rng = np.random.default_rng(3)
    x = rng.random((9, 3))
    r = np.clip(facility.euclidean(x), 0, 1)
    best = facility.cost(r, facility.exhaustive(r))
    for plan in (facility.greedy(r), facility.primal_dual(r), facility.one_more(r), planner.open_bases(r)):
        assert best - 1e-9 <= facility.cost(r, plan) <= 9
    assert facility.cost(r, facility.greedy(r)) <= best * 1.3
    ids, m, cover = facility.symmetric([("a", "b", 0.5), ("b", "a", 0.25), ("c", "d", 1.0)])
    assert ids == ["a", "b", "c", "d"] and m[0, 1] == m[1, 0] == 0.25 and math.isinf(m[0, 2]) and cover == 4 / 12


def test_curve_is_known_at_zero():
    assert exprs.KNEE > 0


def test_solvers_take_a_large_group():
    rng = np.random.default_rng(3)
    x = rng.random((1500, 3))
    r = np.clip(facility.euclidean(x), 0, 1)
    np.fill_diagonal(r, 0)
    start = time.time()
    plans = [f(r) for f in (facility.one_more, facility.greedy, facility.primal_dual, planner.open_bases)]
    assert time.time() - start < 60 and facility.cost(r, plans[1]) <= min(facility.cost(r, p) for p in plans) * 1.05
    b = plans[1]  # no single move helps
    assert min(facility.cost(r, [y for y in b if y != x] + [c]) for x in b for c in range(0, 1500, 7) if c not in b) >= facility.cost(r, b) - 1e-9
