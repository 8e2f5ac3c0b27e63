"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

#: Words of digits, a-z and everything beyond ASCII: A-Z become a-z, all other ASCII bytes become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Only A-Z become a-z.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased UTF-8 text; none of null."""
    return text.translate(WORD_BYTES).split() if text else []


def bucket(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def map_batches(
    df: DataFrame,
    f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    rows: int | None = 1024,
) -> DataFrame:
    """df.mapInArrow(f), whose batches come in slices of so many rows: texts become Python objects a few at a time."""

    def sliced(batches):
        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    def g(batches):
        yield from f(sliced(batches))
        release()

    return df.mapInArrow(g, schema)


def map_groups(groups: GroupedData, f: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    def g(table):
        out, large = f(table), table.nbytes > 1 << 22
        if large:
            del table
            release()
        return out

    return groups.applyInArrow(g, schema)


#: A Python worker of less memory than this keeps what it has.
KEPT_BYTES = 256_000_000


def release() -> None:
    """Gives memory that a large Python worker no longer uses back to the machine: workers outlive their tasks."""
    import ctypes
    import os

    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return
    if held > KEPT_BYTES:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def with_fields(df: DataFrame, carry: list[str], *new: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in carry), *new])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_bounded(big: DataFrame, small: DataFrame, on: str | list[str], how: str, max_rows: int = 2_000_000) -> DataFrame:
    """Broadcasts small if it has at most max_rows (narrow) rows, else leaves a shuffled join to Spark."""
    return big.join(F.broadcast(small) if small_enough(small, max_rows) else small, on, how)


class BlobReader:
    """Column access for Arrow batches by name."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.names = batch, batch.schema.names

    def list(self, name: str) -> list:
        return self.batch.column(self.names.index(name)).to_pylist()

    def keep(self, names: list[str]) -> list[pa.Array]:
        return [self.batch.column(self.names.index(n)) for n in names]
