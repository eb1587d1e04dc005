"""Vectors of a stored table, looked up by key inside the tasks: keys move between them, not vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType

from treespark.session import cut_lineage, shared_dir
from treespark.sources.records import opened_path

#: Bytes of vectors that a task holds; a larger table is joined.
HELD = 1 << 28
#: Vectors that are gathered at once.
GATHERED = 1 << 14

# What this worker holds: one table, by path.
_held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Vectors:
    """A stored table of vectors of one length, each under a key of its own."""

    path: str
    key: str
    vec: str
    dim: int

    def _loaded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.path not in _held:
            system, inner = opened_path(self.path)
            rows = ds.dataset(inner, filesystem=system, format="parquet").to_table(columns=[self.key, self.vec])
            keys = rows.column(self.key).to_numpy().astype(np.int64)
            flat = rows.column(self.vec).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            _held.clear()
            _held[self.path] = keys[order], order, flat.reshape(-1, self.dim)
        return _held[self.path]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the vectors of the keys are, -1 for a key that the table lacks."""
        known, order, _ = self._loaded()
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, order[at], -1)

    def rows(self, places: np.ndarray) -> np.ndarray:
        return self._loaded()[2][places].astype(np.float64)

    def listed(self, keys: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(how many of each list's keys the table has, where their vectors are)."""
        lengths = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = keys.flatten()
        at = self.places(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at[~flat.is_valid().to_numpy(zero_copy_only=False)] = -1
        found = at >= 0
        if not found.all():
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[found], minlength=len(lengths))
        return lengths, at[found]

    def means(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The mean vector of each run of so many places; zeros for an empty run."""
        out = np.zeros((len(counts), self.dim))
        full = np.flatnonzero(counts)
        ends = np.cumsum(counts[full])
        begin = 0
        while begin < len(full):
            low = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, low + GATHERED, side="right")))
            some, last = full[begin:end], ends[begin:end]
            own = counts[some]
            x = self.rows(places[low : last[-1]])
            first = last - own - low
            if own.max() > 8:
                summed = np.add.reduceat(x, first, axis=0)
            else:
                summed = x[first]
                for k in range(1, own.max()):
                    more = np.flatnonzero(own > k)
                    summed[more] += x[first[more] + k]
            out[some] = summed / own[:, None]
            begin = end
        return out

    def lists(self, vectors: np.ndarray) -> pa.ListArray:
        """Vectors as an Arrow array."""
        return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * self.dim, pa.int32()), pa.array(vectors.reshape(-1)))


def held(table: DataFrame, key: str, vec: str = "vec", most: int = HELD) -> Vectors | None:
    """``table`` stored for look-ups by the tasks, which read it from the shared folder.

    None if it has to be joined: above ``most`` bytes, with a key that is null or comes twice, with nulls in the vectors or
    vectors of different lengths, or where Arrow cannot open the shared folder.
    """
    spark, kinds = table.sparkSession, {f.name: f.dataType for f in table.schema}
    item = kinds[vec].elementType if isinstance(kinds[vec], ArrayType) else None
    if not isinstance(kinds[key], IntegerType | LongType) or not isinstance(item, FloatType | DoubleType):
        return None
    try:
        opened_path(shared_dir(spark))
    except (pa.ArrowException, OSError, ValueError):
        return None
    whole = F.col(key).isNotNull() & F.coalesce(~F.exists(vec, lambda x: x.isNull()), F.lit(False))
    seen = table.agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.count_if(whole).alias("whole"),
        F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("dim")).first()
    alike = seen["rows"] == seen["keys"] == seen["whole"] and seen["least"] == seen["dim"]
    if not alike or not seen["dim"] or seen["rows"] * seen["dim"] * (4 if isinstance(item, FloatType) else 8) > most:
        return None
    return Vectors(cut_lineage(table.select(key, vec)).inputFiles()[0].rpartition("/")[0], key, vec, seen["dim"])
