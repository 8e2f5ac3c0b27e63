"""Conversation structure repair: the cheapest edits that make a conversation alternate, found by a persistent audit DP.

A conversation is in order when its role initials read ``(s?(ua)+)?``. The DP walks its rows once and keeps, for each of the four
states of that pattern, the cheapest audit (a string of edit letters) that ends there. Audits share their prefixes: each is a
node with a parent, a rolling hash of the whole string, and ancestors at distances 1, 2, 4, ... . Of two audits of one cost the
ASCII-least one wins; the first letter in which they differ is found by binary lifting over equal hashes, and what the hashes
call equal is verified: it must be the same node, or the letters are compared one by one.

Two audits of one cost over the same rows are never prefixes of each other (what follows a whole prefix could be
insertions only, and these cost), so the least prefix stays the least whatever follows. That is also why a
conversation can be cut: ``repair_conversations`` sends ordinary conversations whole to one task, sorted, and takes those of more
than ``max_rows`` rows or ``max_bytes`` of text in segments. A segment gives the cheapest audit from each state to each;
a fold over the segments of a conversation picks the path, and the repaired text is hashed as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import fresh, join_bounded, map_batches, map_groups
from quillnet.session import cut

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 3, 4, 3, 3
#: State 0: nothing yet; 1: after s; 2: after u; 3: after a. A conversation may end in 0 or 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
TURN_TO = {0: 2, 1: 2, 3: 2, 2: 3}
ENDS = (0, 3)
_MOD, _BASE = (1 << 61) - 1, 1_000_003
NEW = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class Audits:
    """Strings that share prefixes. Node 0 is the empty one."""

    def __init__(self, mod: int = _MOD):
        self.mod, self.letter, self.depth, self.hash, self.up = mod, [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        """The node of parent's string with one letter more."""
        k, up = len(self.letter), [parent]
        j = 0
        while up[j] and j < len(self.up[up[j]]):
            up.append(self.up[up[j]][j])
            j += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % self.mod)
        self.up.append(up)
        return k

    def at(self, node: int, depth: int) -> int:
        """The ancestor of that depth."""
        away = self.depth[node] - depth
        while away:
            j = away.bit_length() - 1
            node = self.up[node][j]
            away -= 1 << j
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        n = min(self.depth[a], self.depth[b])
        x, y = self.at(a, n), self.at(b, n)
        if x == y:
            return self.depth[a] < self.depth[b]
        if self.hash[x] != self.hash[y]:
            for j in range(len(self.up[x]) - 1, -1, -1):
                p, q = (self.up[v][j] if j < len(self.up[v]) else 0 for v in (x, y))
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
            p, q = self.up[x][0], self.up[y][0]
            if p == q and self.letter[x] != self.letter[y]:
                return self.letter[x] < self.letter[y]
        # Equal hashes of different nodes: the strings themselves decide.
        return self.text(a) < self.text(b)


def cheapest(rows: list[tuple[str, bool, bool]], start: int = 0, mod: int = _MOD) -> dict[int, tuple[int, str]]:
    """State after the rows -> (cost, least audit) from state ``start``. A row: role initial, must go, has an open end."""
    audits = Audits(mod)

    def offer(into, state, cost, parent, letter):
        held = into.get(state)
        if held is None or cost < held[0]:
            into[state] = (cost, parent, letter)
            return True
        if cost > held[0]:
            return False
        if held[2]:
            held = into[state] = (cost, audits.add(held[1], held[2]), "")
        node = audits.add(parent, letter)
        if held[1] != node and audits.less(node, held[1]):
            into[state] = (cost, node, "")
            return True
        return False

    def node_of(into, state):
        cost, parent, letter = into[state]
        if letter:
            into[state] = (cost, audits.add(parent, letter), "")
        return into[state][:2]

    def inserted(into):
        moved = list(into)
        while moved:
            again = []
            for s in moved:
                cost, node = node_of(into, s)
                if offer(into, TURN_TO[s], cost + INSERT, node, "I"):
                    again.append(TURN_TO[s])
            moved = again

    now = {start: (0, 0, "")}
    inserted(now)
    for initial, gone, open_end in rows:
        after: dict[int, tuple[int, int, str]] = {}
        extra = OPEN_END if open_end else 0
        for s in sorted(now):
            cost, node = node_of(now, s)
            offer(after, s, cost + DELETE, node, "D")
            if gone:
                continue
            if (s, initial) in STEP:
                offer(after, STEP[s, initial], cost + KEEP + extra, node, "K")
            offer(after, TURN_TO[s], cost + REROLE + extra, node, "R")
        inserted(after)
        now = after
    return {s: (c, audits.text(node)) for s in now for c, node in [node_of(now, s)]}


def best_end(found: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(found[s] for s in ENDS if s in found)


def spoken(rows, letters: str, shape: int, said: int = 0):
    """The repaired rows as ``role:text``; shape: 1 if the whole conversation begins with s; said: rows spoken before these."""
    rows = iter(rows)
    for x in letters:
        if x == "D":
            next(rows)
            continue
        turn = ("user", "assistant")[(said - shape) % 2]
        if x == "I":
            yield f"{turn}:"
        else:
            role, text = next(rows)
            yield f"{role if x == 'K' else turn}:{text}"
        said += 1


def _damaged(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """(key, conv, turn, role, text, n): rows after damage; n copies, 0 of a dropped one."""
    conv, turn, role, text = (F.col(names[c]) for c in ("conv_id", "turn", "role", "text"))
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", as_text(conv), as_text(turn))) % 20
    said = as_text(text)
    return rows.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"),
        conv.alias("conv"),
        turn.cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(as_text(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


ORDER = ("key", "turn", "role", "text")


class Tally:
    """What is counted while rows pass in order."""

    def __init__(self):
        self.rows, self.said, self.blank, self.duplicate, self.truncated, self.illegal = [], [], 0, 0, 0, 0
        self.turns, self.first, self.last, self.first_turn, self.last_turn = 0, None, None, None, None

    def take(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        initial, bare = role[:1], text.rstrip(SPACE)
        blank = not bare
        duplicate = not blank and seen
        open_end = not blank and not duplicate and bare[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + open_end
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((initial, blank or duplicate, open_end))
        self.said.append((role, text))

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that one task takes whole: rows are dealt by conversation and sorted; one conversation is held at a time."""
    conv = rows.schema["conv"]

    def finish(t: Tally) -> tuple:
        cost, audit = best_end(cheapest(t.rows))
        shape = sum(x != "D" for x in audit) % 2
        digest = hashlib.sha256("\n".join(spoken(t.said, audit, shape)).encode()).hexdigest()
        return t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, cost, audit, digest

    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def walk(batches):
        held, conv_id, tally, seen, out = None, None, None, None, []

        def flush():
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], kind), *(pa.array([r[1][i] for r in out], k) for i, k in enumerate(kinds))],
                ["conv", *NEW],
            )
            out.clear()
            return made

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("conv").type
            for key, conv, turn, role, text, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != held:
                    if tally is not None:
                        out.append((conv_id, finish(tally)))
                    held, conv_id, tally, seen = key, conv, Tally(), set()
                for _ in range(n):
                    tally.take(turn, role, text, (role, text) in seen)
                    seen.add((role, text))
            if len(out) >= 1024:
                yield flush()
        if tally is not None:
            out.append((conv_id, finish(tally)))
            yield flush()

    dealt = rows.repartition("key").sortWithinPartitions(*ORDER)
    return map_batches(dealt, walk, f"conv {conv.dataType.simpleString()}, {RESULT}")


def _segments(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(key, conv, seg, pos, turn, role, text, n, again): rows in order; a segment has at most max_rows rows and max_bytes."""
    same = rows.where("n > 0").groupBy("key", "conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    same = cut(same)
    total = same.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-total[0] // max_rows), -(-(total[1] or 0) // max_bytes))
    digest, place = F.sha2("text", 256).alias("digest"), F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    first = same.groupBy("key", "role", digest).agg(F.min(place).alias("first"))
    marked = same.withColumn("digest", F.sha2("text", 256)).join(first, ["key", "role", "digest"]).select(*same.columns, (F.col("first") < place).alias("again"))
    dealt = marked.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)

    def number(batches):
        from pyspark import TaskContext

        seg, pos, size, held = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in batches:
            segs, places = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if key != held or pos >= max_rows or size >= max_bytes:
                    seg, pos, size, held = seg + 1, 0, 0, key
                segs.append(seg)
                places.append(pos)
                pos, size = pos + 1, size + len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "seg", "pos"])

    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"key string, conv {kind}, turn long, role string, text string, n long, again boolean, seg long, pos long"
    return cut(map_batches(dealt, number, schema))


PATHS = "array<struct<start:int,stop:int,cost:bigint,audit:string>>"
COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, first_turn long, last_turn long"


def _ordered(table: pa.Table) -> list[dict]:
    return table.sort_by("pos").select(["turn", "role", "text", "n", "again"]).to_pylist()


def _in_segments(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Conversations of any length: costs and audits by segment, folded by conversation; repaired texts pass as a stream."""
    parts = _segments(rows, max_rows, max_bytes)
    kind = parts.schema["conv"].dataType.simpleString()

    def costs(table: pa.Table) -> pa.Table:
        t = Tally()
        for r in _ordered(table):
            for k in range(r["n"]):
                t.take(r["turn"], r["role"], r["text"], r["again"] or k > 0)
        paths = [{"start": s, "stop": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in cheapest(t.rows, s).items()]
        one = [table.column("key")[0].as_py(), table.column("seg")[0].as_py(), paths, t.blank, t.duplicate, t.truncated, t.illegal, t.turns, t.first, t.last, t.first_turn, t.last_turn]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["key", "seg", "paths", *(c.split()[0] for c in COUNTS.split(", "))]
        return pa.table([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names=names)

    matrix = cut(map_groups(parts.groupBy("key", "seg"), costs, f"key string, seg long, paths {PATHS}, {COUNTS}"))

    def fold(table: pa.Table) -> pa.Table:
        segs = table.sort_by("seg").to_pylist()
        best = {0: (0, "", ())}  # state -> cost, audit, audits of the segments
        for r in segs:
            after: dict = {}
            for p in r["paths"]:
                if p["start"] in best:
                    cost, audit, kept = best[p["start"]]
                    one = (cost + p["cost"], audit + p["audit"], (*kept, p["audit"]))
                    if p["stop"] not in after or one[:2] < after[p["stop"]][:2]:
                        after[p["stop"]] = one
            best = after
        cost, audit, kept = min(best[s] for s in ENDS if s in best)
        total = {c: sum(r[c] for r in segs) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        ends = [(a, b) for a, b in zip(segs, segs[1:], strict=False)]
        total["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in ends)
        timed = [r for r in segs if r["turns"]]
        turns = total["turns"] - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
        counts = [gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost]
        shape, said, out = sum(x != "D" for x in audit) % 2, 0, []
        for r, letters in zip(segs, kept, strict=True):
            out.append((r["key"], r["seg"], letters, shape, said, counts if r is segs[0] else [None] * 6, audit if r is segs[0] else None))
            said += sum(x != "D" for x in letters)
        cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))]
        cols += [pa.array([r[5][i] for r in out], pa.int64()) for i in range(6)] + [pa.array([r[6] for r in out], pa.string())]
        return pa.table(cols, names=["key", "seg", "letters", "shape", "said", *NEW[:7]])

    chosen = "key string, seg long, letters string, shape int, said long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    paths = cut(map_groups(matrix.groupBy("key"), fold, chosen))

    def speak(table: pa.Table, path: pa.Table) -> pa.Table:
        rows = [(r["role"], r["text"]) for r in _ordered(table) for _ in range(r["n"])]
        p = path.to_pylist()[0]
        lines = list(spoken(rows, p["letters"], p["shape"], p["said"]))
        # A line break stands before every line but the conversation's first.
        raw = ("\n" if p["said"] and lines else "") + "\n".join(lines)
        return pa.table([pa.array([p["key"]]), pa.array([p["seg"]], pa.int64()), pa.array([raw.encode()], pa.binary())], names=["key", "seg", "raw"])

    lines = parts.groupBy("key", "seg").cogroup(paths.select("key", "seg", "letters", "shape", "said").groupBy("key", "seg")).applyInArrow(speak, "key string, seg long, raw binary")

    def digest(batches):
        held, state, out = None, None, []
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != held:
                    if held is not None:
                        out.append((held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                state.update(raw)
        if held is not None:
            out.append((held, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string())], ["key", "repaired_sha256"])

    hashes = map_batches(lines.repartition("key").sortWithinPartitions("key", "seg"), digest, "key string, repaired_sha256 string", rows=8)
    ids = parts.groupBy("key").agg(F.first("conv").alias("conv"))
    found = paths.where("audit is not null").select("key", *NEW[:7])
    return found.join(hashes, "key").join(ids, "key").select(F.col("conv").cast(kind).alias("conv"), *NEW)


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    max_rows: int = 20_000,
    max_bytes: int = 16_000_000,
) -> DataFrame:
    """Damages rows by crc32 of ``conv:turn``, then repairs each conversation: conv_col, the counts, cost, audit, repaired_sha256.

    A null role or text is one space, and so is a null in the text that crc32 takes. Rows are taken by turn, nulls first; of
    one turn, by role, then text (both as bytes). A null conv_id is a conversation of its own. A conversation of which every row was
    dropped has zeros, an empty audit and the hash of the empty string; an empty table gives no rows. Rows that repeat are
    rows each, so the later ones are duplicates. Roles that begin with neither s, u nor a can't be kept. Other columns
    of any name are ignored.

    max_rows, max_bytes: a longer conversation goes in segments of that size; the result does not depend on them.
    """
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    damaged = _damaged(rows, names)
    long = damaged.groupBy("key").agg(F.sum("n").alias("rows"), F.sum(F.octet_length("text") * F.col("n")).alias("bytes"))
    long = cut(long.where((F.col("rows") > max_rows) | (F.col("bytes") > max_bytes)).select("key"))
    if not long.limit(1).count():
        return _whole(damaged).withColumnRenamed("conv", conv_col)
    short = _whole(join_bounded(damaged, long, "key", "left_anti", 100_000).select(*damaged.columns))
    parts = _in_segments(join_bounded(damaged, long, "key", "left_semi", 100_000).select(*damaged.columns), max_rows, max_bytes)
    return short.unionByName(parts).withColumnRenamed("conv", conv_col)
