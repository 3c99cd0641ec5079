"""A membership bitmap: rows that can't be in a set of ids are dropped before a join has to move them. The join decides; the bitmap saves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _worker  # noqa: F401

#: log2 of the bits: 16 a member of the set, within these bounds. The upper one (16 MB) is the bound of what is sent to the workers; a set
#: that fills such a bitmap passes more rows on to the join.
LEAST, MOST = 12, 27


@dataclass(frozen=True)
class Bitmap:
    words: np.ndarray
    bits: int


def _slot(column: str, bits: int):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))


def bitmap(ids: DataFrame, column: str) -> Bitmap:
    """ids: a saved table, as its rows are counted first."""
    bits = min(max((16 * ids.count()).bit_length(), LEAST), MOST)
    rows = ids.select(_slot(column, bits).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    found = rows.toArrow()  # 2 ** (bits - 6) rows at most
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return Bitmap(words.view(np.uint64), bits)


def may_contain(df: DataFrame, column: str, found: Bitmap, inside: bool = True) -> DataFrame:
    """Rows of df whose id may be in the set; with inside=False those that are surely not."""
    words = found.words

    def run(batches):
        for batch in batches:
            s = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = ((words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit == inside))

    return df.withColumn("_slot", _slot(column, found.bits)).mapInArrow(run, df.schema)
