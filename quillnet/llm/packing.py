"""Best-fit packing of encoded documents into sequences: hierarchical residual packing.

1. Every document is encoded and closed with the end id. A document longer than a sequence is cut from its end, so that
   only its first piece is shorter than a sequence. Full pieces are sequences of their own.
2. Each partition packs its pieces best-fit, longest first. Bins that are nearly full, or too full for the shortest piece
   of the corpus, are emitted; the others go on as items.
3. The underfull bins are dealt to fewer tasks, packed again as items, and so on, until one task is left or a round
   no longer brings the bins down. A task gets ``max_items`` items on average, and not many more, in these rounds: bins are dealt round robin.

Each round is written to the shared folder before it is read twice, so a lost executor cannot pack a round again in another
order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import BlobReader, fresh, map_batches, with_fields
from quillnet.llm.tokens import _some, encoder, tokenizer_path
from quillnet.session import cut

END_ID = 2


def pieces(
    docs: DataFrame,
    limit: int = 1024,
    end_id: int = END_ID,
    text_col: str = "text",
    carry: list[str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """One row for each piece of each document: carried columns, piece, start, and ids (little-endian 32-bit, binary).

    Null and empty texts give one piece that holds the end id only. Repeated rows give their pieces each.
    """
    path = path or tokenizer_path()
    new = ("piece", "start", "ids")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text = fresh(docs, "_text")
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        for batch in batches:
            for i, texts in _some(batch, text):
                rows, piece, start, ids = [], [], [], []
                part = encoder(path).encode(texts)
                for k, coded in enumerate(part):
                    coded += end
                    n = len(coded) // 4
                    bounds = [0, *range((n - 1) % limit + 1, n, limit)]
                    for p, a in enumerate(bounds):
                        b = bounds[p + 1] if p + 1 < len(bounds) else n
                        rows.append(k)
                        piece.append(p)
                        start.append(a)
                        ids.append(coded[4 * a : 4 * b])
                kept = pa.RecordBatch.from_arrays(
                    BlobReader(batch).keep(carry), [f"c{j}" for j in range(len(carry))]
                ).slice(i, len(part))
                kept = kept.take(pa.array(rows, pa.int64())).columns if carry else []
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())],
                    [*carry, *new],
                )

    return map_batches(
        docs.select(*carry, F.col(text_col).alias(text)),
        encode,
        with_fields(
            docs,
            carry,
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ),
    )


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit, longest first: each item's bin, and each bin's fill.

    Bins are kept by the room they have left; a bit mask of the rooms in use finds the tightest that fits at once.
    """
    order = np.argsort(-sizes, kind="stable")
    into = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    left: list[int] = []
    mask = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = open_bins[r].pop()
            if not open_bins[r]:
                mask ^= 1 << r
        else:
            r, k = room, len(left)
            left.append(room)
        left[k] = r - size
        open_bins[r - size].append(k)
        mask |= 1 << (r - size)
        into[i] = k
    return into, room - np.array(left, np.int64)


BIN = "fill int, closed boolean, task int, bin int, members array<{}>, offsets array<long>"


def _round(items: DataFrame, limit: int, near: int, member: str) -> DataFrame:
    """Packs each partition's bins as items; items: fill, members (whose first field is the length)."""

    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        sizes = table.column("fill").to_numpy().astype(np.int64)
        into, fill = best_fit(sizes, limit)
        order = np.argsort(into, kind="stable")
        members = table.column("members").combine_chunks().take(pa.array(order))
        per_item = np.diff(members.offsets.to_numpy())
        counts = np.zeros(len(fill), np.int64)
        np.add.at(counts, into[order], per_item)
        flat = members.flatten()
        step = 20_000
        ends = np.concatenate([[0], np.cumsum(counts)])
        lengths = flat.field("length").to_numpy().astype(np.int64)
        before = np.cumsum(lengths) - lengths
        offsets = pa.array(before - np.repeat(before[np.minimum(ends[:-1], len(before) - 1)], counts))
        for a in range(0, len(fill), step):
            z = min(len(fill), a + step)
            part = flat.slice(ends[a], ends[z] - ends[a])
            bounds = pa.array((ends[a : z + 1] - ends[a]).astype(np.int32))
            listed = pa.ListArray.from_arrays(bounds, part)
            places = pa.ListArray.from_arrays(bounds, offsets.slice(ends[a], ends[z] - ends[a]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fill[a:z], pa.int32()),
                    pa.array(limit - fill[a:z] < near),
                    pa.array(np.full(z - a, task), pa.int32()),
                    pa.array(np.arange(a, z), pa.int32()),
                    listed,
                    places,
                ],
                ["fill", "closed", "task", "bin", "members", "offsets"],
            )

    return map_batches(items.select("fill", "members"), pack, BIN.format(member))


def pack_sequences(
    items: DataFrame,
    limit: int = 1024,
    length_col: str = "length",
    near_full: int = 4,
    max_items: int = 200_000,
    min_items: int = 20_000,
    fan_in: int = 8,
    max_rounds: int = 12,
) -> DataFrame:
    """Adds sequence_id and offset to items of 1 to ``limit`` tokens; offsets of a sequence run gapless from 0.

    A bin closes when less than ``near_full`` tokens, or less than the shortest item of all, is left in it. Small
    partitions are joined until they hold ``min_items``: the more a task sees, the fuller its bins. Null lengths,
    and lengths outside 1 to limit, get a null sequence. Columns named sequence_id or offset are replaced; an empty table gives
    no rows, and rows that repeat are items each.
    """
    cols = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    n = F.col(length_col)
    items = items.select(*cols)
    fits = n.isNotNull() & (n >= 1) & (n <= limit)
    stats = items.where(fits & (n < limit)).agg(F.min(n), F.count(F.lit(1))).first()
    shortest, left = stats[0] or limit, stats[1]
    near = max(near_full, shortest)
    names = {c: f"f{i}" for i, c in enumerate(cols)}
    member = T.StructType(
        [T.StructField("length", T.IntegerType())] + [T.StructField(names[c], items.schema[c].dataType) for c in cols]
    )
    packed = F.struct(n.cast("int").alias("length"), *[F.col(c).alias(names[c]) for c in cols])
    live = items.where(fits & (n < limit)).select(n.cast("int").alias("fill"), F.array(packed).alias("members"))
    if live.rdd.getNumPartitions() < -(-left // max_items):
        live = live.repartition(-(-left // max_items))
    elif live.rdd.getNumPartitions() > -(-left // min_items):
        live = live.coalesce(max(1, -(-left // min_items)))
    tasks, closed = live.rdd.getNumPartitions(), []
    for k in range(max_rounds):
        done = cut(_round(live, limit, near, member.simpleString()).withColumn("round", F.lit(k)))
        open_bins = done.where(~F.col("closed"))
        now = open_bins.count()
        fewer = max(-(-tasks // fan_in), -(-now // max_items), 1)
        if now == 0 or tasks == 1 or (fewer >= tasks and now > 0.99 * left) or k == max_rounds - 1:
            closed.append(done)
            break
        closed.append(done.where(F.col("closed")))
        live, tasks, left = open_bins.select("fill", "members").repartition(fewer), fewer, now
    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    sequence = F.shiftleft(F.col("round").cast("long") + 1, 58) + F.shiftleft(F.col("task").cast("long"), 31) + F.col("bin")
    placed = bins.select(sequence.alias("sequence_id"), F.explode(F.arrays_zip("members", "offsets")).alias("_m")).select(
        *[F.col(f"_m.members.{names[c]}").alias(c) for c in cols], "sequence_id", F.col("_m.offsets").alias("offset")
    )
    full = items.where(fits & (n == limit)).select(
        *cols, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    odd = items.where(~F.coalesce(fits, F.lit(False))).select(
        *cols, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")
    )
    return full.unionByName(placed).unionByName(odd)


def pack_documents(
    docs: DataFrame, limit: int = 1024, text_col: str = "text", carry: list[str] | None = None, path: str | None = None
) -> DataFrame:
    """Pieces of all documents with their places: carry, piece, start, length, ids_crc32, sequence_id, offset.

    The ids themselves are not carried through the rounds; ``write_sequences`` brings them to their places. A null or empty
    text is one piece of the end id alone; repeated rows are packed each; an empty table gives no rows. Columns that bear
    the name of a new one are replaced.
    """
    new = ("piece", "start", "ids", "length", "ids_crc32", "sequence_id", "offset")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    made = pieces(docs, limit, text_col=text_col, carry=carry, path=path)
    keep = [c for c in made.columns if c != "ids"]
    digests = made.select(
        *keep,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return pack_sequences(cut(digests), limit)


def write_sequences(made: DataFrame, placed: DataFrame, key: list[str], path: str) -> None:
    """Joins pieces' ids to their places by (key, piece) and writes one row of ids for each sequence."""
    on = [*key, "piece"]
    rows = made.select(*on, "ids").join(placed.select(*on, "sequence_id", "offset"), on)
    (
        rows.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (s, p) -> concat(s, p.ids))").alias("ids"))
        .write.parquet(path)
    )
