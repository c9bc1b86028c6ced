"""Random numbers: known answers, moments, continuation."""

import numpy as np
import pytest

from gridframe.meta import ArrayMeta
from gridframe.random.cbrng import CBRNG
from gridframe.random.generators import Bijection, State, gamma, normal_bm, seed_key, uniform_float, uniform_integer, vonmises

#: Words of all-zero keys and counters (fixed values).
KNOWN = {
    ("philox", 32, 2): "ff1dae59 6cd10df2",
    ("philox", 32, 4): "6627e8d5 e169c58d bc57ac4c 9b00dbd8",
    ("philox", 64, 2): "ca00a0459843d731 66c24222c9a845b5",
    ("philox", 64, 4): "16554d9eca36314c db20fe9d672d0fdc d7e772cee186176b 7e68b68aec7ba23b",
    ("threefry", 32, 2): "6b200159 99ba4efe",
    ("threefry", 32, 4): "9c6ca96a e17eae66 fc10ecd4 5256a7d8",
    ("threefry", 64, 2): "c2b6e3a8c2c69865 6f81ed42f350084d",
    ("threefry", 64, 4): "09218ebde6c85537 55941f5266d86105 4bd25e16282434dc ee29ec846bd2e40b",
}


@pytest.mark.parametrize("kind", sorted(KNOWN))
def test_known_answers(kind):
    b = Bijection(*kind)
    words = b(np.zeros((1, b.key_words), b.kind), np.zeros((1, b.words), b.kind))[0]
    assert " ".join(f"{int(w):0{kind[1] // 4}x}" for w in words) == KNOWN[kind]


@pytest.mark.parametrize("bad", [("philox", 32, 3), ("philox", 16, 2), ("philox", 64, 4, 13), ("threefry", 64, 4, 73), ("other", 64, 4)])
def test_bad_bijections(bad):
    with pytest.raises(ValueError):
        Bijection(*bad)


def test_keys():
    with pytest.raises(ValueError):
        seed_key(Bijection("philox", 32, 2), 1)
    with pytest.raises(ValueError):
        seed_key(Bijection(), np.zeros(1, np.uint32))
    key = seed_key(Bijection("threefry", 64, 4), 7)
    assert key[0] >> np.uint64(32) and key[-1] == 0


def test_counter_carries():
    b = Bijection("philox", 32, 4)
    state = State(b, seed_key(b, 1), np.arange(1), np.array([[0, 0, 1, 0xFFFFFFFF]]))
    state.raw32(np.arange(1))
    assert state.next_counters().tolist() == [[0, 0, 2, 0]]


SAMPLES = {
    "integer": (uniform_integer("int32", -10, 98), 43.5, np.sqrt((108**2 - 1) / 12)),
    "float": (uniform_float("float64", -5, 7.7), 1.35, 12.7 / np.sqrt(12)),
    "normal": (normal_bm("float64", -2, 10), -2, 10),
    "gamma": (gamma("float64", 3, 10), 30, 10 * np.sqrt(3)),
    "small gamma": (gamma("float64", 0.3, 2), 0.6, 2 * np.sqrt(0.3)),
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_moments(name):
    sampler, mean, std = SAMPLES[name]
    b = Bijection()
    n = 40_000
    state = State(b, seed_key(b, 456), np.arange(n), np.zeros((n, 4)))
    x = sampler.draw(state, np.arange(n)).astype(float)
    assert abs(x.mean() - mean) < 5 * std / np.sqrt(x.size)
    assert abs(x.std() - std) < 0.05 * std


def test_vonmises():
    b = Bijection()
    state = State(b, seed_key(b, 3), np.arange(20_000), np.zeros((20_000, 4)))
    x = vonmises("float64", 1.0, 0.7).draw(state, np.arange(20_000))
    assert abs(np.angle(np.exp(1j * x).mean()) - 1) < 0.05 and x.min() >= -np.pi and x.max() < np.pi


def test_partitioning_and_continuation(spark):
    op = CBRNG.uniform_integer(ArrayMeta((8, 5, 3), "int32"), 2, {"low": 0, "high": 64}, seed=1)
    counters = op.create_counters(spark)
    first = op.bind(counters=counters)
    more = op.bind(counters=first["counters"])["randoms"].to_numpy()
    again = op.bind(counters=type(counters)(counters.df.repartition(7), counters.meta))["randoms"].to_numpy()
    assert np.array_equal(first["randoms"].to_numpy(), again) and not np.array_equal(more, again)
    long = CBRNG.uniform_integer(ArrayMeta((16, 5, 3), "int32"), 2, {"low": 0, "high": 64}, seed=1)
    assert np.array_equal(long.bind(counters=counters)["randoms"].to_numpy(), np.concatenate([again, more]))


def test_sampler_kind():
    with pytest.raises(ValueError, match="same data type"):
        CBRNG(ArrayMeta((4,), "float32"), 1, uniform_float("float64"))
