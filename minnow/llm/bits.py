"""A set of 64-bit hashes as one bitmap of bounded size, for tests within any expression.

A hash that is in the set always passes; others pass by chance, about one in 1,200 while the set has
BITS_EACH bits a hash, more often beyond MOST_BITS / BITS_EACH hashes. Whoever asks verifies what passes.

Defined cases: null hashes are left out of the set, and their test is null; an empty set lets nothing pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap for each hash, and in all (32 MB).
BITS_EACH, MOST_BITS = 32, 1 << 28
#: How far a hash is shifted for each of the bits that stand for it.
SHIFTS = (0, 18, 36)


class Members:
    """The hashes of one column of a stored table."""

    def __init__(self, hashes: DataFrame, column: str, most_bits: int | None = None):
        self.n = hashes.count()
        self.n_bits = min(most_bits or MOST_BITS, 1 << max(6, (BITS_EACH * self.n - 1).bit_length()))
        places = F.explode(F.array(*(self.place(F.col(column), k) for k in SHIFTS)))
        marked = hashes.filter(F.col(column).isNotNull()).select(places.alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("w"))
        every = hashes.sparkSession.range(self.n_bits >> 6).withColumnRenamed("id", "i").join(marked, "i", "left")
        #: One row: array<bigint> of n_bits bits.
        self.bits = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("bits"))

    def place(self, hash_: Column, shift: int) -> Column:
        return F.shiftrightunsigned(hash_, shift).bitwiseAND(F.lit(self.n_bits - 1))

    def test(self, hash_: Column) -> Column:
        """Whether all bits of a hash are set. The bitmap goes to the tasks as the value of a subquery; this is no use within lambdas."""
        if not self.n:
            return F.lit(False)
        bits = self.bits.scalar()
        marks = [F.getbit(F.get(bits, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in (self.place(hash_, k) for k in SHIFTS)]
        return reduce(lambda a, b: a & b, marks)
