"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Rows of equal text are one class; the rest works on one row for each class.
2. Every class's set of word shingles is hashed. Each batch of rows sends its hashes, packed by hash range, to be counted;
   back come only the hashes that two classes or more hold, with their counts. A hash that a batch holds several times is
   sent once, and the batch keeps the list of its holders, so no hash gathers its documents in one task.
3. The order is rare-first: by count, then hash. A shingle of a single class cannot make a pair, so a class whose prefix
   (its first n - ceil(t n) + 1 shingles) holds none but such shingles links with nothing and is done.
4. The others meet by prefix shingle. Every class takes a home: the smallest class with which it shares a prefix shingle. Small homes
   are put together into blocks of a bounded number of shingles, large ones are cut into such blocks by length band and hash.
   A class goes to its own block, and besides only to the blocks in which one of its prefix shingles stands too (of
   neighbouring length bands); shingles that stand in the same blocks are looked up once. So two classes meet only if they
   share a prefix shingle, and then in exactly one task. Neither pairs nor posting lists are gathered.
5. In a task, documents come shortest first; prefix postings give candidates, which pass the length, positional and suffix
   filters and are then counted out, once for each pair.

Hashes have 64 bits when made, and log2(ranges) + 32 bits when counted and compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillnet.llm.common import LOWER_BYTES, BlobReader, fresh, join_bounded, map_batches, map_groups
from quillnet.operators.components import connected_components
from quillnet.session import cut

_BYTE = np.random.RandomState(7).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS))
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _ODD)]), dtype=np.uint64)
            _INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
    return _POWERS, _INVERSE


def ngram_hashes(text: bytes | None, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of all n-grams of words of the given sizes, in order and repeated.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A text of fewer words, but not none, has its whole
    word sequence as one n-gram; null and wordless texts have none.
    """
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(len(line) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[line] * up[: len(line)], dtype=np.uint64)])
        spaces = np.flatnonzero(line == 32)
        firsts = np.concatenate([[0], spaces + 1])
        lasts = np.concatenate([spaces, [len(line)]])
        found = []
        for k in sizes:
            if len(words) > k:
                starts, ends = firsts[: len(words) - k + 1], lasts[k - 1 :]
            else:
                starts, ends = firsts[:1], lasts[-1:]
            h = (sums[ends] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(32)
            found.append(h)
    return np.concatenate(found)


def shingle_hashes(text: bytes | None, k: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""
    return np.unique(ngram_hashes(text, (k,)))


def need(n: int, num: int, den: int) -> int:
    """The smallest overlap that a set of n can have with a set that it links to."""
    return -(-num * n // den)


def _send(bits: int, k: int, per_message: int):
    """Batches of (id, text) -> packed messages; part = -1 is what a batch keeps for itself."""

    def f(batches):
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        ids: list = []
        sets: list[np.ndarray] = []
        held = 0

        def flush(serial):
            n = np.array([len(s) for s in sets])
            h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            one = count == 1
            at = (task << 24) + serial
            sent_h, sent_doc = h[first], np.where(one, doc[first], 0xFFFF).astype(np.uint16)
            many = np.repeat(~one, count)
            part = (sent_h >> np.uint64(64 - bits)).astype(np.int64)
            rest = ((sent_h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            parts, begin = np.unique(part, return_index=True)
            stop = np.append(begin[1:], len(part))
            own = h[many] >> np.uint64(32 - bits)
            rows = [(int(p), at, rest[a:z].tobytes(), sent_doc[a:z].tobytes(), count[a:z].astype(np.uint16).tobytes() if (count[a:z] > 1).any() else None)
                    for p, a, z in zip(parts.tolist(), begin.tolist(), stop.tolist(), strict=True)]
            rows.append((-1, at, own.astype("<u8").tobytes(), doc[many].tobytes(), np.array(ids, "<i8").tobytes() + n.astype("<i8").tobytes()))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["part", "batch", "hash", "doc", "more"]
            )

        for batch in batches:
            b = BlobReader(batch)
            for i, text in zip(b.list("id"), b.list("text"), strict=True):
                s = shingle_hashes(text, k)
                if not len(s):
                    continue
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held >= per_message or len(ids) == 0xFFFE:
                    yield flush(serial)
                    serial, ids, sets, held = serial + 1, [], [], 0
        if ids:
            yield flush(serial)

    return f


#: A table of at most so many narrow rows, some 20 MB, is sent to all tasks.
MAX_SENT = 400_000
MESSAGE = "part int, batch long, hash binary, doc binary, more binary"


def _count(table: pa.Table) -> pa.Table:
    """All messages of one hash range -> replies: for each batch its hashes that two classes or more hold."""
    part = table.column("part")[0].as_py()
    hs, docs, batch, count = [], [], [], []
    serials = table.column("batch").to_pylist()
    for j, (h, d, m) in enumerate(zip(*(table.column(c).to_pylist() for c in ("hash", "doc", "more")), strict=True)):
        a = np.frombuffer(h, "<u4")
        hs.append(a)
        docs.append(np.frombuffer(d, "<u2"))
        batch.append(np.full(len(a), j, np.int32))
        count.append(np.frombuffer(m, "<u2") if m is not None else np.ones(len(a), np.uint16))
    h, doc, b, c = map(np.concatenate, (hs, docs, batch, count))
    del hs, docs, batch, count
    order = np.argsort(h, kind="stable").astype(np.int32)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.add.reduceat(c[order], first, dtype=np.int64)
    on = np.repeat(df > 1, np.diff(np.append(first, len(h))))
    df = np.repeat(np.minimum(df, 2**32 - 1).astype(np.uint32), np.diff(np.append(first, len(h))))[on]
    h, order = h[on], order[on]
    doc, b = doc[order], b[order]
    del c, on, first
    order = np.argsort(b, kind="stable")
    h, doc, b, df = h[order], doc[order], b[order], df[order]
    which, begin = np.unique(b, return_index=True)
    stop = np.append(begin[1:], len(b))[: len(begin)]
    spans = list(zip(begin.tolist(), stop.tolist(), strict=True))
    return pa.table(
        {
            "part": pa.array([part] * len(which), pa.int32()),
            "batch": pa.array([serials[w] for w in which.tolist()], pa.int64()),
            "hash": pa.array([h[a:z].tobytes() for a, z in spans], pa.binary()),
            "doc": pa.array([doc[a:z].tobytes() for a, z in spans], pa.binary()),
            "more": pa.array([df[a:z].tobytes() for a, z in spans], pa.binary()),
        }
    )


def _gather(num: int, den: int):
    """All replies of one batch, and what it kept -> (id, n, unique, tokens, prefix) of documents that may link."""

    def f(table: pa.Table) -> pa.Table:
        hs, docs, dfs, own_h, own_doc, head = [], [], [], None, None, b""
        for p, h, d, m in zip(*(table.column(c).to_pylist() for c in ("part", "hash", "doc", "more")), strict=True):
            if p < 0:
                own_h, own_doc, head = np.frombuffer(h, "<u8"), np.frombuffer(d, "<u2"), m
            else:
                hs.append((np.uint64(p) << np.uint64(32)) | np.frombuffer(h, "<u4").astype(np.uint64))
                docs.append(np.frombuffer(d, "<u2"))
                dfs.append(np.frombuffer(m, "<u4"))
        out: dict[str, list] = {c: [] for c in ("id", "n", "tokens", "prefix", "unique")}
        if hs:
            half = len(head) // 2
            ids, ns = np.frombuffer(head[:half], "<i8"), np.frombuffer(head[half:], "<i8")
            h, doc, df = map(np.concatenate, (hs, docs, dfs))
            held = doc == 0xFFFF
            keys, weight = h[held], df[held]
            order = np.argsort(keys)
            keys, weight = keys[order], weight[order]
            own_df = weight[np.searchsorted(keys, own_h)] if len(own_h) else np.empty(0, np.uint32)
            h = np.concatenate([h[~held], own_h])
            doc = np.concatenate([doc[~held], own_doc])
            df = np.concatenate([df[~held], own_df])
            order = np.lexsort((h, df, doc))
            h, doc = h[order], doc[order]
            which, begin = np.unique(doc, return_index=True)
            stop = np.append(begin[1:], len(doc))
            for k, a, z in zip(which.tolist(), begin.tolist(), stop.tolist(), strict=True):
                n = int(ns[k])
                unique = n - (z - a)
                prefix = n - need(n, num, den) + 1 - unique
                if prefix > 0:
                    out["id"].append(int(ids[k]))
                    out["n"].append(n)
                    out["unique"].append(unique)
                    out["tokens"].append(h[a:z].astype("<u8").tobytes())
                    out["prefix"].append(h[a : a + prefix].astype(np.int64))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return f


def _link(members: list[tuple], num: int, den: int):
    """Links among (id, n, unique, tokens, copies, side) of one task; yields index pairs, each once.

    side: with two blocks only pairs of different sides count, else side is 0 for all.
    """
    if len(members) < 2:
        return
    members.sort(key=lambda r: (r[1], r[0]))
    sets = [np.frombuffer(r[3], "<u8") for r in members]
    n = np.array([r[1] for r in members])
    unique = np.array([r[2] for r in members])
    side = np.array([r[5] for r in members])
    size = np.array([len(s) for s in sets])
    prefix = np.minimum(size, n - -(-num * n // den) + 1 - unique)
    two_sided = side.any() and not side.all()

    def postings(lengths):
        token = np.concatenate([s[:z] for s, z in zip(sets, lengths.tolist(), strict=True)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(token, kind="stable").astype(np.int32)
        token = token[order]
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        start = np.repeat(new.astype(np.int32), np.diff(np.append(new, len(token))))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        begin = np.empty(len(order), np.int32)
        begin[order] = start
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
        pos = np.arange(len(order), dtype=np.int32) - np.repeat(ends[:-1].astype(np.int32), lengths)
        return doc[order], pos[order], begin, place, ends

    p_doc, p_pos, p_begin, p_place, p_at = postings(prefix)
    full = None
    ranges = np.zeros((len(sets), 16), np.int64)
    for k, s in enumerate(sets):
        ranges[k] = np.bincount((s & np.uint64(15)).astype(np.int64), minlength=16)
    for x in range(len(sets)):
        a, z = p_at[x], p_at[x + 1]
        spans = [(b, e, i) for i, (b, e) in enumerate(zip(p_begin[a:z].tolist(), p_place[a:z].tolist(), strict=True)) if e > b]
        if not spans:
            continue
        at = np.concatenate([np.arange(b, e) for b, e, _ in spans])
        pos_x = unique[x] + np.repeat([i for _, _, i in spans], [e - b for b, e, _ in spans])
        y = p_doc[at]
        ok = den * n[y] >= num * n[x]  # length filter
        if two_sided:
            ok &= side[y] != side[x]
        y, pos_x, pos_y = y[ok], pos_x[ok], unique[y[ok]] + p_pos[at[ok]]
        if not len(y):
            continue
        shared = -(-num * (n[x] + n[y]) // (num + den))  # overlap that a link needs
        first = np.full(len(sets), -1)
        first[y[::-1]] = np.arange(len(y))[::-1]  # the first common prefix shingle of each pair
        lead = first[np.unique(y)]
        y, pos_x, pos_y, shared = y[lead], pos_x[lead], pos_y[lead], shared[lead]
        ok = 1 + np.minimum(n[x] - pos_x - 1, n[y] - pos_y - 1) >= shared  # positional filter
        y, shared = y[ok], shared[ok]
        # Suffix filter: shingles outside the other set, from counts over fixed ranges of hashes; unique ones never match.
        apart = np.abs(ranges[y] - ranges[x]).sum(1) + unique[x] + unique[y]
        ok = apart <= n[x] + n[y] - 2 * shared
        y, shared = y[ok], shared[ok]
        if not len(y):
            continue
        if len(y) <= 4:
            own = set(sets[x].tolist())
            overlap = np.array([sum(t in own for t in sets[k].tolist()) for k in y.tolist()])
        else:
            if full is None:
                full = postings(size)
            f_doc, _, f_begin, f_place, f_at = full
            a, z = f_at[x], f_at[x + 1]
            got = [f_doc[b:e] for b, e in zip(f_begin[a:z].tolist(), f_place[a:z].tolist(), strict=True) if e > b]
            overlap = np.bincount(np.concatenate(got), minlength=len(sets))[y]
        for k in y[overlap >= shared].tolist():
            yield k, x


def _linked(members: list[tuple], num: int, den: int) -> list[tuple[int, int, int]]:
    """(id, copies that it links to, smallest id of its component) of those that link, of one pair of blocks."""
    degree = np.zeros(len(members), np.int64)
    root = list(range(len(members)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y, x in _link(members, num, den):
        degree[x] += members[y][4]
        degree[y] += members[x][4]
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
    least: dict[int, int] = {}
    on = np.flatnonzero(degree).tolist()
    for i in on:
        r = find(i)
        least[r] = min(least.get(r, members[i][0]), members[i][0])
    return [(members[i][0], int(degree[i]), least[find(i)]) for i in on]


def _task(num: int, den: int):
    """The pairs of blocks of one task, one after the other. Of two different blocks only pairs across count."""

    def f(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out: list[tuple[int, int, int]] = []
        for i, z in zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True):
            part = table.slice(i, z - i)
            sides = set(part.column("side").to_pylist())
            if z - i < 2 or (a[i] != b[i] and len(sides) < 2):
                continue
            out += _linked(list(zip(*(part.column(c).to_pylist() for c in ("id", "n", "unique", "tokens", "copies", "side")), strict=True)), num, den)
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("id", "n", "root"), cols, strict=True)})

    return f


def _set_sizes(docs: DataFrame, k: int, carry: list[str], text: str) -> DataFrame:
    """carry, n_shingles and a digest of the text, for every row."""

    def f(batches):
        for batch in batches:
            b = BlobReader(batch)
            n = [len(shingle_hashes(t, k)) for t in b.list(text)]
            yield pa.RecordBatch.from_arrays([*b.keep([*carry, "_digest"]), pa.array(n, pa.int64())], [*carry, "_digest", "n_shingles"])

    rows = docs.select(*carry, F.unhex(F.md5(F.col(text))).alias("_digest"), F.col(text).cast("binary").alias(text))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("_digest", T.BinaryType()), T.StructField("n_shingles", T.LongType())])
    return map_batches(rows, f, schema)


def _meetings(may: DataFrame, num: int, den: int, block: int, block_shingles: int) -> DataFrame:
    """(id, size, a, b, side): the pairs of blocks (a <= b) to which every class goes; a = b is its own block alone."""
    post = may.select("id", F.explode("prefix").alias("token"))
    least = post.groupBy("token").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = cut(post.join(least.select("token", "least"), "token"))
    sizes = may.select("id", "n", F.floor(F.octet_length("tokens") / 8).alias("size"))
    homes = cut(shared.groupBy("id").agg(F.min("least").alias("home")).join(sizes, "id"))
    # A little more than the length filter's ratio, so that rounding cannot part two that may link.
    width = math.log(den / num) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / width) if num < den else F.col("n")
    held = homes.groupBy("home").agg(F.count(F.lit(1)).alias("held"), F.sum("size").alias("all"))
    large = held.where((F.col("held") > block) | (F.col("all") > block_shingles)).select("home", F.lit(True).alias("large"))
    homes = join_bounded(homes, large, "home", "left", MAX_SENT).withColumn("band", F.when(F.col("large"), band.cast("long")))
    parts = homes.where("large").groupBy("home", "band").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / block_shingles)).alias("parts")
    )
    weight = homes.where("large is null").agg(F.sum("size"), F.count(F.lit(1))).first()
    bundles = max(1, -(-(weight[0] or 0) // block_shingles), -(-(weight[1] or 0) // block))
    placed = join_bounded(homes, parts, ["home", "band"], "left", MAX_SENT)
    mine = F.when(F.col("large"), F.xxhash64("home", "band", F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(
        F.xxhash64(F.pmod(F.xxhash64("home"), F.lit(bundles)))
    )
    at = cut(placed.select("id", "size", "band", mine.alias("block")))

    where = cut(shared.select("id", "token").join(at.select("id", "band", "block"), "id"))
    stands = where.select("token", "block", "band").distinct()
    # Shingles that stand in the same blocks are alike here; one of them tells which blocks these are.
    alike = stands.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("block", "band")).alias("sig")).where("k > 1")
    alike = cut(alike)
    one = alike.groupBy("k", "sig").agg(F.min("token").alias("token"))
    of = one.join(stands, "token").select("k", "sig", F.col("block").alias("other"), F.col("band").alias("other_band"))
    across = where.join(alike, "token").select("id", "block", "band", "k", "sig").distinct().join(of, ["k", "sig"])
    near = F.coalesce(F.abs(F.col("band") - F.col("other_band")) <= 1, F.lit(True))
    across = across.where((F.col("block") != F.col("other")) & near).select("id", "block", "other").distinct()
    both = at.select("id", "size", "block", F.col("block").alias("other")).unionByName(
        join_bounded(across, at.select("id", "size"), "id", "inner", MAX_SENT)
    )
    return cut(
        both.select(
            "id", "size", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
        )
    )


def jaccard_components(
    docs: DataFrame,
    k: int = 4,
    similarity: tuple[int, int] = (85, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    per_message: int = 500_000,
    per_range: int = 500_000,
    block: int = 2000,
    block_shingles: int = 500_000,
) -> DataFrame:
    """(id_col, n_shingles, class_id, n_links, component_id): one row for each row of docs.

    Rows link when den * |intersection| >= num * |union| of their sets of distinct k-word shingles. class_id: smallest id
    of the same text. n_links: other rows that the row links to directly. component_id: smallest id reachable by links.

    Ids are integers. A null, empty or wordless text has an empty set and links with nothing. A null id links with nothing and has a null
    class and component. Rows that repeat an id are one node of a component. An empty table gives no rows.
    """
    num, den = similarity
    text = fresh(docs, "_text")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text))
    sizes = cut(_set_sizes(base, k, ["id"], text))
    classes = cut(
        sizes.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("_digest", "n_shingles")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("id").alias("last"))
    )
    # A class is known by a hash of its digest; where two classes would share one, another seed is taken.
    for seed in range(64):
        cid = F.xxhash64(F.lit(seed), "_digest")
        if not classes.groupBy(cid.alias("cid")).count().where("count > 1").limit(1).count():
            break
    classes = classes.withColumn("cid", cid)
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(20, max(6, math.ceil(math.log2(max(1, total / per_range)))))

    # One row of text for each class: rows that are another row's copy are left out.
    copies = classes.where("copies > 1").select("_digest", "rep")
    copied = cut(
        join_bounded(sizes.where("id is not null"), copies, "_digest", "inner", MAX_SENT)
        .groupBy("id", "_digest")
        .agg(F.count(F.lit(1)).alias("rows"), F.first("rep").alias("rep"))
    )
    others = copied.where(F.col("id") != F.col("rep")).select("id", "_digest")
    known_ids = base.where(F.col("id").isNotNull()).withColumn("_digest", F.unhex(F.md5(F.col(text))))
    texts = join_bounded(known_ids, others, ["id", "_digest"], "left_anti", MAX_SENT)
    texts = texts.select(cid.alias("id"), F.col(text).cast("binary").alias("text"))
    sent = cut(map_batches(texts, _send(bits, k, per_message), MESSAGE))
    replies = map_groups(sent.where("part >= 0").groupBy("part"), _count, MESSAGE)
    back = map_groups(
        replies.unionByName(sent.where("part < 0")).groupBy("batch"),
        _gather(num, den),
        "id long, n long, tokens binary, prefix array<long>, unique long",
    )
    if copied.where((F.col("id") == F.col("rep")) & (F.col("rows") > 1)).limit(1).count():
        back = back.dropDuplicates(["id"])
    may = cut(back)
    ships = _meetings(may, num, den, block, block_shingles)
    tasks = F.lit(max(1, -(-(ships.agg(F.sum("size")).first()[0] or 0) // (2 * block_shingles))))
    narrow = join_bounded(ships.drop("size"), classes.select(F.col("cid").alias("id"), "copies"), "id", "inner", MAX_SENT)
    rows = join_bounded(may.drop("prefix"), narrow, "id", "inner", MAX_SENT)
    links = cut(map_groups(rows.groupBy(F.pmod(F.xxhash64("a", "b"), tasks)), _task(num, den), "id long, n long, root long"))
    degree = links.groupBy(F.col("id").alias("cid")).agg(F.sum("n").alias("linked"))
    end = lambda cid, name: classes.select(F.col("cid").alias(cid), F.col("rep").alias(name))
    edges = links.join(end("id", "src"), "id").join(end("root", "dst"), "root").select("src", "dst").unionByName(
        sizes.join(classes.where("last > rep").select("_digest", "rep"), "_digest").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    )
    component = connected_components(edges).withColumnRenamed("id", "_id")
    known = classes.select(F.col("_digest").alias("_d"), "cid", "rep", "copies").join(degree, "cid", "left")
    full = sizes.join(known, (F.col("_digest") == F.col("_d")) & F.col("id").isNotNull(), "left").join(
        component, F.col("id") == F.col("_id"), "left"
    )
    return full.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
