"""A bitmap of hashes that rules rows out before they are exchanged.

It has a fixed size whatever the tables hold: words with a bit set are gathered by an aggregate and
broadcast. A row whose bit is unset has no partner; one whose bit is set may have one, and the join tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def maybe_among(hashes: DataFrame, bits: int = BITS):
    """A column function: whether a 64-bit hash may be among those of ``hashes`` (one long column); null is never."""
    place = hashes.toDF("h").filter("h is not null").select(F.pmod("h", F.lit(bits)).alias("at"))
    words = place.groupBy(F.expr("at >> 6").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word")).toArrow()
    full = np.zeros(bits // 64, np.int64)
    full[words.column("at").to_numpy()] = words.column("word").to_numpy()
    sent = hashes.sparkSession.sparkContext.broadcast(full.tobytes())

    @F.arrow_udf("boolean")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            at = batch.to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.array((held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda h: found(F.pmod(F.coalesce(h, F.lit(0)).cast("long"), F.lit(bits))) & h.isNotNull()
