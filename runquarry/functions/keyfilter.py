"""Look-ups of a few keys in a large table without a shuffle of that table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runquarry.functions.scale import MAX_BROADCAST_ROWS

#: Words of 64 bits that a filter has at most: 16 MB that are broadcast, good for some ten million keys.
MAX_WORDS = 1 << 20
_BITS = 4  # that a key sets in its word


def _word(keys: Sequence[str], words: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(words)).cast("int")


def _mask(keys: Sequence[str]) -> Column:
    """The bits of a key, all in one word."""
    second = F.xxhash64(F.lit("bits"), *keys)
    mask = F.lit(0).cast("bigint")
    for i in range(_BITS):
        place = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


@dataclass(frozen=True)
class KeyFilter:
    """A Bloom filter of keys as a table (word, bits) of at most ``words`` rows, so its broadcast is bounded.

    What it lets through may be a key, what it does not is none. Filters of equal size are merged by joining their bits, so a
    filter can be built part by part.
    """

    keys: tuple[str, ...]
    words: int
    table: DataFrame

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], words: int) -> KeyFilter:
        table = df.select(_word(keys, words).alias("_word"), _mask(keys).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        return cls(tuple(keys), words, table)

    def merged(self, other: KeyFilter) -> KeyFilter:
        if (self.keys, self.words) != (other.keys, other.words):
            raise ValueError("filters of other keys or sizes cannot be merged")
        both = self.table.unionByName(other.table).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        return KeyFilter(self.keys, self.words, both)

    def maybe(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key may be in the filter; nothing is shuffled."""
        tested = df.withColumns({"_word": _word(self.keys, self.words), "_mask": _mask(self.keys)})
        passed = tested.join(F.broadcast(self.table), "_word").where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        return passed.select(*[df[c] for c in df.columns])


def words_for(n_keys: int, bits_per_key: int = 24) -> int:
    """Words for so many keys, a power of two; about one key in a few hundred passes wrongly."""
    return 1 << max(4, (n_keys * bits_per_key // 64).bit_length())


def possible_hits(source: DataFrame, target: DataFrame, keys: Sequence[str], max_local: int = MAX_BROADCAST_ROWS, max_words: int = MAX_WORDS) -> DataFrame:
    """Keys of ``target`` that may occur in ``source``: all that do, and few others.

    Up to about ``max_local`` source keys are broadcast themselves. More are broadcast as a Bloom filter, as long as one of
    ``max_words`` words holds them; beyond that the target is of the source's own size and a shuffle of both is due. NULL keys hit
    nothing in the joins that this serves.
    """
    keys = list(keys)
    there, asked = target.select(*keys), source.select(*keys)
    if [f.dataType for f in there.schema] != [f.dataType for f in asked.schema]:
        return there  # the join compares these after a cast, hashes would not
    n = asked.select(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    if n <= max_local:
        few = asked.distinct().limit(2 * max_local + 1).toArrow()  # the count is an estimate, the bound is not
        if few.num_rows <= 2 * max_local:
            return there.join(F.broadcast(source.sparkSession.createDataFrame(few, schema=asked.schema)), keys, "left_semi")
    words = words_for(n)
    return there if words > max_words else KeyFilter.of(source, keys, words).maybe(there)


def known_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], known: bool = True, **limits: int) -> DataFrame:
    """Rows of ``source`` whose key the target has, or with ``known=False`` has not. Only possible hits of the target travel."""
    return source.join(possible_hits(source, target, keys, **limits), list(keys), "left_semi" if known else "left_anti")
