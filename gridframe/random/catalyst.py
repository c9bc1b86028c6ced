"""Threefry and simple samplers as column expressions, so draws need no Python worker.

Words are longs: 32-bit ones masked, 64-bit ones by their bits, added in halves (a sum of
longs must not overflow). Rounds are an array of their constants; the state, a struct
of words, is threaded through it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .generators import PARITY, THREEFRY_ROT, Bijection

LOW = (1 << 32) - 1


def signed(word: int) -> int:
    """The long with the bits of an unsigned word."""
    return word - (1 << 64) if word >> 63 else word


def literal(word: int) -> Column:
    return F.lit(signed(word)).cast("bigint")


class Words:
    """Arithmetic of words of so many bits."""

    def __init__(self, bits: int):
        self.bits = bits

    def add(self, a: Column, b: Column) -> Column:
        if self.bits == 32:
            return (a + b).bitwiseAND(literal(LOW))
        low = a.bitwiseAND(literal(LOW)) + b.bitwiseAND(literal(LOW))
        high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(literal(LOW)))

    def turned(self, a: Column, by: Column) -> Column:
        """Bits moved left, around the end."""
        both = F.call_function("shiftleft", a, by).bitwiseOR(F.call_function("shiftrightunsigned", a, F.lit(self.bits) - by))
        return both.bitwiseAND(literal(LOW)) if self.bits == 32 else both

    def below(self, a: Column, b: Column) -> Column:
        """Unsigned comparison."""
        return a < b if self.bits == 32 else a.bitwiseXOR(literal(1 << 63)) < b.bitwiseXOR(literal(1 << 63))

    def from_decimal(self, a: Column) -> Column:
        if self.bits == 32:
            return a.cast("bigint")
        return F.when(a > F.lit((1 << 63) - 1), a - F.lit(Decimal(1 << 64)).cast("decimal(21,0)")).otherwise(a).cast("bigint")

    def to_decimal(self, a: Column) -> Column:
        wide = a.cast("decimal(21,0)")
        return F.when(a < 0, wide + F.lit(Decimal(1 << 64)).cast("decimal(21,0)")).otherwise(wide).cast("decimal(20,0)")


def threefry(bijection: Bijection, key: Column, counter: list[Column]) -> Column:
    """Array of words for a key (an array, with the parity word at its end) and a counter."""
    n, w = bijection.words, Words(bijection.bitness)
    rot = THREEFRY_ROT[bijection.bitness, n]
    names = [f"x{j}" for j in range(n)]
    rounds = F.array(*[F.struct(F.lit(rot[r % 8][0]).alias("a"), F.lit(rot[r % 8][-1]).alias("b"), F.lit(n == 4 and r % 2 == 1).alias("crossed"), F.lit(r // 4 + 1 if r % 4 == 3 else 0).alias("s")) for r in range(bijection.rounds)])

    def step(state: Column, r: Column) -> Column:
        x = [state[c] for c in names]
        if n == 2:
            first = w.add(x[0], x[1])
            x = [first, w.turned(x[1], r["a"]).bitwiseXOR(first)]
        else:
            one, two = F.when(r["crossed"], x[3]).otherwise(x[1]), F.when(r["crossed"], x[1]).otherwise(x[3])
            first, third = w.add(x[0], one), w.add(x[2], two)
            y, z = w.turned(one, r["a"]).bitwiseXOR(first), w.turned(two, r["b"]).bitwiseXOR(third)
            x = [first, F.when(r["crossed"], z).otherwise(y), third, F.when(r["crossed"], y).otherwise(z)]
        keyed = [w.add(v, F.get(key, F.pmod(r["s"] + j, F.lit(n + 1)))) for j, v in enumerate(x)]
        keyed[-1] = w.add(keyed[-1], r["s"].cast("bigint"))
        return F.struct(*[F.when(r["s"] > 0, k).otherwise(v).alias(c) for k, v, c in zip(keyed, x, names)])

    start = F.struct(*[w.add(c, F.get(key, F.lit(j))).alias(name) for j, (c, name) in enumerate(zip(counter, names))])
    return F.aggregate(rounds, start, step, lambda s: F.array(*[s[c] for c in names]))


def generator_key(bijection: Bijection, base: list[int], number: Column) -> Column:
    """Key words of a generator and their parity word."""
    w = Words(bijection.bitness)
    words = [literal(int(k)) for k in base]
    words[-1] = w.add(words[-1], number.cast("bigint").bitwiseAND(literal(LOW)) if w.bits == 32 else number.cast("bigint"))
    parity = literal(PARITY[bijection.bitness])
    for k in words:
        parity = parity.bitwiseXOR(k)
    return F.array(*words, parity)


def advanced(bijection: Bijection, counter: list[Column], by: Column) -> list[Column]:
    """A counter so many steps on, with carries; the last word counts fastest."""
    w = Words(bijection.bitness)
    out = [w.add(counter[-1], by.cast("bigint"))]
    carry = w.below(out[0], counter[-1])
    for c in reversed(counter[:-1]):
        own = w.add(c, F.when(carry, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        carry = carry & (own == 0)
        out.insert(0, own)
    return out


def raw32(bijection: Bijection, key: Column, counter: list[Column], steps: int) -> Column:
    """32-bit parts of the words of so many counters, in the order in which generators use them."""
    each = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: threefry(bijection, key, advanced(bijection, counter, j)))
    words = F.flatten(each)
    if bijection.bitness == 32:
        return words
    return F.flatten(F.transform(words, lambda x: F.array(x.bitwiseAND(literal(LOW)), F.shiftrightunsigned(x, 32))))
