"""Counter-based random numbers, vectorised over generators in numpy.

A bijection turns a key and a counter into words. Every generator has its own key
(the seed's key plus its number) and counter, so a value depends on nothing but
(seed, generator, draw), whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Philox multipliers and Weyl constants, Threefry rotations and parity (fixed values).
PHILOX_M = {(32, 2): (0xD256D193,), (32, 4): (0xD2511F53, 0xCD9E8D57), (64, 2): (0xD2B74407B1CE6E93,), (64, 4): (0xD2E7470EE14C6C93, 0xCA5A826395121157)}
PHILOX_W = {32: (0x9E3779B9, 0xBB67AE85), 64: (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B)}
THREEFRY_ROT = {
    (32, 2): ((13,), (15,), (26,), (6,), (17,), (29,), (16,), (24,)),
    (32, 4): ((10, 26), (11, 21), (13, 27), (23, 5), (6, 20), (17, 11), (25, 10), (18, 20)),
    (64, 2): ((16,), (42,), (12,), (31,), (16,), (32,), (24,), (21,)),
    (64, 4): ((14, 16), (52, 57), (23, 40), (5, 37), (25, 33), (46, 12), (58, 22), (32, 32)),
}
PARITY = {32: 0x1BD11BDA, 64: 0x1BD11BDAA9FC1A22}


@dataclass(frozen=True)
class Bijection:
    """``name`` is philox or threefry; words of ``bitness`` bits."""

    name: str = "philox"
    bitness: int = 64
    words: int = 4
    rounds: int = 0

    def __post_init__(self) -> None:
        limit = 12 if self.name == "philox" else 72
        if self.rounds == 0:
            object.__setattr__(self, "rounds", 10 if self.name == "philox" else 20)
        if self.name not in ("philox", "threefry") or self.bitness not in (32, 64) or self.words not in (2, 4) or not 1 <= self.rounds <= limit:
            raise ValueError("bijection parameters are out of range")

    @property
    def key_words(self) -> int:
        return self.words // 2 if self.name == "philox" else self.words

    @property
    def kind(self) -> type:
        return np.uint32 if self.bitness == 32 else np.uint64

    def __call__(self, key: np.ndarray, counter: np.ndarray) -> np.ndarray:
        """Words for keys (n, key_words) and counters (n, words)."""
        with np.errstate(over="ignore"):
            return self._philox(key, counter) if self.name == "philox" else self._threefry(key, counter)

    def _mulhilo(self, m: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.bitness == 32:
            full = np.uint64(m) * x.astype(np.uint64)
            return (full >> np.uint64(32)).astype(np.uint32), full.astype(np.uint32)
        half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
        ml, mh, xl, xh = np.uint64(m & 0xFFFFFFFF), np.uint64(m >> 32), x & mask, x >> half
        low, a, b = ml * xl, mh * xl, ml * xh
        carry = (low >> half) + (a & mask) + (b & mask)
        return mh * xh + (a >> half) + (b >> half) + (carry >> half), np.uint64(m) * x

    def _philox(self, key: np.ndarray, counter: np.ndarray) -> np.ndarray:
        k = [key[:, j].copy() for j in range(self.key_words)]
        x = [counter[:, j] for j in range(self.words)]
        m, w = PHILOX_M[self.bitness, self.words], PHILOX_W[self.bitness]
        for r in range(self.rounds):
            if r:
                k = [a + self.kind(b) for a, b in zip(k, w)]
            if self.words == 2:
                hi, lo = self._mulhilo(m[0], x[0])
                x = [hi ^ k[0] ^ x[1], lo]
            else:
                (h0, l0), (h1, l1) = self._mulhilo(m[0], x[0]), self._mulhilo(m[1], x[2])
                x = [h1 ^ x[1] ^ k[0], l1, h0 ^ x[3] ^ k[1], l0]
        return np.stack(x, axis=1)

    def _threefry(self, key: np.ndarray, counter: np.ndarray) -> np.ndarray:
        n, kind = self.words, self.kind
        ks = [key[:, j] for j in range(n)]
        last = np.full(len(key), PARITY[self.bitness], kind)
        for k in ks:
            last = last ^ k
        ks.append(last)
        x = [counter[:, j] + ks[j] for j in range(n)]
        rot = THREEFRY_ROT[self.bitness, n]

        def turned(v: np.ndarray, by: int) -> np.ndarray:
            return (v << kind(by)) | (v >> kind(self.bitness - by))

        for r in range(self.rounds):
            if n == 2:
                pairs = ((0, 1),)
            else:
                pairs = ((0, 1), (2, 3)) if r % 2 == 0 else ((0, 3), (2, 1))
            for (a, b), by in zip(pairs, rot[r % 8]):
                x[a] = x[a] + x[b]
                x[b] = turned(x[b], by) ^ x[a]
            if r % 4 == 3:
                s = r // 4 + 1
                x = [x[j] + ks[(s + j) % (n + 1)] for j in range(n)]
                x[n - 1] = x[n - 1] + kind(s)
        return np.stack(x, axis=1)


def seed_key(bijection: Bijection, seed: int | np.ndarray | None, reserve_id_space: bool = True) -> np.ndarray:
    """Key words of a seed.

    With ``reserve_id_space`` the last 32 bits (or word) are left for the generator's
    number. Without it the seed takes the whole key and numbers are added to that, so
    generators still differ, but two seeds may share sequences.
    """
    if reserve_id_space and bijection.bitness == 32 and bijection.key_words == 1:
        raise ValueError("a key of 32 bits has no room for generator numbers")
    size = bijection.key_words * bijection.bitness // 32
    free = 0 if not reserve_id_space else 2 if bijection.bitness == 64 and bijection.key_words > 1 else 1
    pieces = size - free
    if isinstance(seed, np.ndarray):
        if seed.dtype != np.uint32 or seed.size != pieces:
            raise ValueError(f"a seed array must have {pieces} values of uint32")
        parts = [int(s) for s in seed.ravel()]
    else:
        halves = np.random.default_rng(seed).integers(0, 1 << 16, 2 * pieces)
        parts = [(int(a) << 16) | int(b) for a, b in zip(halves[::2], halves[1::2])]
    parts += [0] * free
    if bijection.bitness == 64:
        parts = [(a << 32) | b for a, b in zip(parts[::2], parts[1::2])]
    return np.array(parts, dtype=bijection.kind)


@dataclass(frozen=True)
class KeyGenerator:
    """Keys of generators by their number."""

    bijection: Bijection
    base: tuple[int, ...]

    @classmethod
    def create(cls, bijection: Bijection, seed: int | np.ndarray | None = None, reserve_id_space: bool = True) -> KeyGenerator:
        return cls(bijection, tuple(int(w) for w in seed_key(bijection, seed, reserve_id_space)))

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Key words of each generator number."""
        out = np.tile(np.array(self.base, self.bijection.kind), (len(ids), 1))
        with np.errstate(over="ignore"):
            out[:, -1] += np.asarray(ids).astype(self.bijection.kind)
        return out

    def key(self, number: int) -> np.ndarray:
        return self.keys(np.array([number]))[0]


class State:
    """Generators side by side: keys, counters, and words of the current counters not yet used."""

    def __init__(self, bijection: Bijection, base: np.ndarray, ids: np.ndarray, counters: np.ndarray):
        self.bijection = bijection
        self.keys = KeyGenerator(bijection, tuple(base)).keys(ids)
        self.counters = counters.astype(bijection.kind).copy()
        self.halves = 1 if bijection.bitness == 32 else 2  # 32-bit parts of a word
        self.room = bijection.words * self.halves
        self.used = np.full(len(ids), self.room)  # parts used; a full buffer is drawn on demand
        self.drawn = np.zeros(len(ids), bool)
        self.buffer = np.zeros((len(ids), self.room), np.uint32)

    def _refill(self, rows: np.ndarray) -> None:
        """Words of the next counter for ``rows``."""
        again = rows[self.drawn[rows]]
        self._bump(again)
        words = self.bijection(self.keys[rows], self.counters[rows])
        self.buffer[rows] = words if self.halves == 1 else np.ascontiguousarray(words).view(np.uint32).reshape(len(rows), self.room)  # low half first
        self.used[rows], self.drawn[rows] = 0, True

    def _bump(self, rows: np.ndarray) -> None:
        carry = rows
        for word in range(self.bijection.words - 1, -1, -1):
            with np.errstate(over="ignore"):
                self.counters[carry, word] += self.bijection.kind(1)
            carry = carry[self.counters[carry, word] == 0]
            if not len(carry):
                return

    def skip(self, steps: int) -> None:
        """Add to all counters, with carries."""
        bits = self.bijection.bitness
        for word in range(self.bijection.words - 1, -1, -1):
            part = self.bijection.kind(steps & (1 << bits) - 1)
            steps >>= bits
            if not part and not steps:
                return
            with np.errstate(over="ignore"):
                self.counters[:, word] += part
            carried = self.counters[:, word] < part
            for higher in range(word - 1, -1, -1):
                with np.errstate(over="ignore"):
                    self.counters[carried, higher] += self.bijection.kind(1)
                carried &= self.counters[:, higher] == 0

    def raw32(self, rows: np.ndarray) -> np.ndarray:
        empty = rows[self.used[rows] >= self.room]
        if len(empty):
            self._refill(empty)
        out = self.buffer[rows, self.used[rows]]
        self.used[rows] += 1
        return out

    def raw64(self, rows: np.ndarray) -> np.ndarray:
        if self.halves == 1:
            first = self.raw32(rows).astype(np.uint64)
            return (first << np.uint64(32)) + self.raw32(rows)
        self.used[rows] += self.used[rows] % 2  # a partly used word is skipped
        low = self.raw32(rows).astype(np.uint64)
        return low | (self.raw32(rows).astype(np.uint64) << np.uint64(32))

    def next_counters(self) -> np.ndarray:
        """Counters from which a later call goes on."""
        self._bump(np.flatnonzero(self.drawn))
        self.drawn[:] = False
        self.used[:] = self.room
        return self.counters


# ------------------------------------------------------------ samplers


@dataclass(frozen=True)
class Sampler:
    """``draw`` gives ``per_call`` values of each of the rows.

    ``plain`` describes a sampler that column expressions can stand for: ("integer", low, width of
    a value, limit of what is accepted) or ("float", low, high).
    """

    dtype: str
    per_call: int
    draw: object
    deterministic: bool = True
    plain: tuple | None = None


def _unit(state: State, rows: np.ndarray, dtype: str) -> np.ndarray:
    """Uniform in [0, 1), computed in doubles."""
    if dtype in ("float32", "complex64"):
        return state.raw32(rows).astype(np.float64) / 2.0**32
    return (state.raw64(rows) >> np.uint64(11)).astype(np.float64) / 2.0**53


def uniform_integer(dtype: str = "int32", low: int = 0, high: int | None = None) -> Sampler:
    """Whole numbers in [low, high), or [0, low) if high is not given."""
    if high is None:
        low, high = 0, low
    n = high - low
    bits = 32 if n <= 1 << 32 else 64
    if n < 1 or n > 1 << 64:
        raise ValueError("the range is empty or too wide")
    part, limit = (1 << bits) // n, (1 << bits) - (1 << bits) % n

    def draw(state: State, rows: np.ndarray) -> np.ndarray:
        raw = state.raw32 if bits == 32 else state.raw64
        out, left = np.zeros(len(rows), object if bits == 64 else np.int64), np.arange(len(rows))
        while len(left):
            t = raw(rows[left]).astype(np.uint64)
            good = np.ones(len(left), bool) if limit == 1 << 64 else t < np.uint64(limit)
            value = t[good] // np.uint64(part)
            out[left[good]] = [int(v) + low for v in value] if bits == 64 else value.astype(np.int64) + low
            left = left[~good]
        return out.reshape(-1, 1)

    return Sampler(dtype, 1, draw, (1 << bits) % n == 0, ("integer", low, part, limit) if bits == 32 else None)


def uniform_float(dtype: str = "float32", low: float = 0.0, high: float = 1.0) -> Sampler:
    """Floats in [low, high)."""
    if not low < high:
        raise ValueError("the range is empty")
    most = np.nextafter(np.dtype(dtype).type(high), np.dtype(dtype).type(low))
    return Sampler(dtype, 1, lambda state, rows: np.minimum(_unit(state, rows, dtype) * (high - low) + low, most).reshape(-1, 1), plain=("float", low, high, float(most)))


def _box_muller(state: State, rows: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    u1, u2 = 1.0 - _unit(state, rows, dtype), _unit(state, rows, dtype)
    r = np.sqrt(-2.0 * np.log(u1))
    return r * np.cos(2 * np.pi * u2), r * np.sin(2 * np.pi * u2)


def normal_bm(dtype: str = "float32", mean: complex = 0.0, std: float = 1.0) -> Sampler:
    """Normal values, two a call; complex ones with the deviation split over both parts."""
    if dtype.startswith("complex"):

        def draw(state: State, rows: np.ndarray) -> np.ndarray:
            a, b = _box_muller(state, rows, dtype)
            return ((a + 1j * b) * (std / np.sqrt(2.0)) + mean).reshape(-1, 1)

        return Sampler(dtype, 1, draw)
    return Sampler(dtype, 2, lambda state, rows: np.stack(_box_muller(state, rows, dtype), axis=1) * std + mean)


def gamma(dtype: str = "float32", shape: float = 1.0, scale: float = 1.0) -> Sampler:
    """Gamma values by squeeze and rejection; shapes below 1 are boosted."""
    if shape <= 0 or scale <= 0:
        raise ValueError("shape and scale must be positive")
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3
    c = 1 / np.sqrt(9 * d)

    def draw(state: State, rows: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(rows)), np.arange(len(rows))
        spare = np.full(len(rows), np.nan)
        while len(left):
            x = spare[left]
            need = np.isnan(x)
            fresh, second = _box_muller(state, rows[left[need]], dtype)
            x[need] = fresh
            spare[left[~need]] = np.nan
            spare[left[need]] = second
            v = (1 + c * x) ** 3
            u = 1.0 - _unit(state, rows[left], dtype)
            with np.errstate(invalid="ignore", divide="ignore"):
                good = (v > 0) & ((u < 1 - 0.0331 * x**4) | (np.log(u) < x * x / 2 + d * (1 - v + np.log(v))))
            out[left[good]] = d * v[good]
            left = left[~good]
        if shape < 1:
            out *= (1.0 - _unit(state, rows, dtype)) ** (1 / shape)
        return (out * scale).reshape(-1, 1)

    return Sampler(dtype, 1, draw, deterministic=False)


def vonmises(dtype: str = "float32", mu: float = 0.0, kappa: float = 1.0) -> Sampler:
    """Angles around ``mu``, wrapped to [-pi, pi)."""
    if kappa <= 0:
        raise ValueError("kappa must be positive")
    tau = 1 + np.sqrt(1 + 4 * kappa**2)
    rho = (tau - np.sqrt(2 * tau)) / (2 * kappa)
    r = (1 + rho**2) / (2 * rho)

    def draw(state: State, rows: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(rows)), np.arange(len(rows))
        while len(left):
            z = np.cos(np.pi * _unit(state, rows[left], dtype))
            u2 = 1.0 - _unit(state, rows[left], dtype)
            f = (1 + r * z) / (r + z)
            c = kappa * (r - f)
            with np.errstate(divide="ignore", invalid="ignore"):
                good = (u2 < c * (2 - c)) | (c <= np.log(c / u2) + 1)
            sign = np.where(_unit(state, rows[left[good]], dtype) < 0.5, -1.0, 1.0)
            out[left[good]] = sign * np.arccos(np.clip(f[good], -1, 1))
            left = left[~good]
        return (np.mod(out + mu + np.pi, 2 * np.pi) - np.pi).reshape(-1, 1)

    return Sampler(dtype, 1, draw, deterministic=False)


SAMPLERS = {"uniform_integer": uniform_integer, "uniform_float": uniform_float, "normal_bm": normal_bm, "gamma": gamma, "vonmises": vonmises}


def draws(state: State, sampler: Sampler, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(draw number, values of all generators); a call's surplus is discarded."""
    rows = np.arange(len(state.keys))
    for at in range(0, n, sampler.per_call):
        got = sampler.draw(state, rows)
        for j in range(min(sampler.per_call, n - at)):
            yield at + j, got[:, j]
