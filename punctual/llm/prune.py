"""Tell rows that a join can't match apart from the rest, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.session import staged

#: Bits of the filter: a table of BITS / 64 numbers, which can always be broadcast.
BITS = 1 << 20


def marked(df: DataFrame, key: Sequence[Column], ids: DataFrame, name: str = "__maybe") -> DataFrame:
    """The rows with one more column: false where the key is not among ``ids``, true where it may be.

    ``ids`` has the columns of the key.  Their hashes set bits of a table of fixed size.  With very
    many ids most rows are true; a join has to follow in any case.
    """
    place = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(BITS)).cast("int")
    words = staged(
        ids.select(place([F.col(c) for c in ids.columns]).alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("__word")).agg(
            F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("__bits")
        )
    )
    rows = df.withColumn("__place", place(key)).withColumn("__word", F.floor(F.col("__place") / 64).cast("int"))
    rows = rows.join(F.broadcast(words), "__word", "left")
    known = F.coalesce(F.getbit("__bits", F.col("__place") % 64) == 1, F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], known.alias(name))
