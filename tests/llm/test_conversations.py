import hashlib
import random
import zlib

import pytest

from oracle import rows_of, sql_rows
from quillnet.llm.conversations import ENDS, STEP, TURN_TO, Audits, best_end, cheapest, repair_conversations
from quillnet.llm.sql import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
EMPTY = hashlib.sha256(b"").hexdigest()


def by_strings(rows, start=0):
    """The DP with whole strings."""

    def inserted(now):
        for _ in range(3):
            for s, (c, a) in list(now.items()):
                one = (c + 3, a + "I")
                if TURN_TO[s] not in now or one < now[TURN_TO[s]]:
                    now[TURN_TO[s]] = one
        return now

    now = inserted({start: (0, "")})
    for initial, gone, open_end in rows:
        after = {}
        for s, (c, a) in now.items():
            for t, one in [(s, (c + 4, a + "D"))] + ([] if gone else [(TURN_TO[s], (c + 3 + 3 * open_end, a + "R"))] + ([(STEP[s, initial], (c + 3 * open_end, a + "K"))] if (s, initial) in STEP else [])):
                if t not in after or one < after[t]:
                    after[t] = one
        now = inserted(after)
    return now


def every_way(rows):
    """All edit sequences with up to two insertions at each place; for tables of a few rows."""
    found = []

    def go(k, s, cost, audit, room):
        if k == len(rows) and s in ENDS:
            found.append((cost, audit))
        if room:
            go(k, TURN_TO[s], cost + 3, audit + "I", room - 1)
        if k < len(rows):
            initial, gone, open_end = rows[k]
            go(k + 1, s, cost + 4, audit + "D", 2)
            if not gone:
                go(k + 1, TURN_TO[s], cost + 3 + 3 * open_end, audit + "R", 2)
                if (s, initial) in STEP:
                    go(k + 1, STEP[s, initial], cost + 3 * open_end, audit + "K", 2)

    go(0, 0, 0, "", 2)
    return min(found)


def some(rng, n):
    return [(rng.choice("suaax "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_audits_are_the_least_of_all():
    rng = random.Random(5)
    for _ in range(60):
        rows = some(rng, rng.randrange(5))
        assert best_end(cheapest(rows)) == every_way(rows)


@pytest.mark.parametrize("mod", [(1 << 61) - 1, 3, 1])
def test_audits_equal_strings_even_if_hashes_collide(mod):
    rng = random.Random(7)
    for _ in range(40):
        rows = some(rng, rng.randrange(60))
        for start in range(4):
            assert cheapest(rows, start, mod) == by_strings(rows, start)


def test_nodes():
    a = Audits()
    node = 0
    for x in "KDIKR" * 20:
        node = a.add(node, x)
    other = a.add(a.at(node, 57), "A")
    assert a.text(node) == "KDIKR" * 20 and a.text(a.at(node, 3)) == "KDI" and a.at(node, 0) == 0
    assert a.less(other, node) and not a.less(node, other) and a.less(a.at(node, 9), node)


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marks, count = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\v\f\r")
            k = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if k is not None:
                count[k] += 1
            marks.append((role[:1], k in (0, 1), k == 2))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit = min(v for s, v in by_strings(marks).items() if s in ENDS)
        out, at = [], iter(mine)
        odd = sum(x != "D" for x in audit) % 2
        for x in audit:
            row = None if x == "I" else next(at)
            turn = "user" if (len(out) - odd) % 2 == 0 else "assistant"
            if x != "D":
                out.append(f"{row[2] if x == 'K' else turn}:{row[3] if row else ''}")
        found[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def table(rng, n_convs, longest):
    words = ["Hello there.", "What?", "no end", "", " \t", "Yes!", "A long answer. ", "é ß.", None, "x.y"]
    rows = []
    for c in [None, *range(n_convs)]:
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 1, 5])
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ua"]), rng.choice(words), "x"))
    return rows


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_whole_and_in_segments_equal_brute_force(spark):
    rows = table(random.Random(1), 40, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(repair_conversations(df)) == want
    assert got(repair_conversations(df, max_rows=7)) == want
    assert got(repair_conversations(df, max_rows=1, max_bytes=1)) == want


def test_one_conversation_holds_most_rows_and_copies(spark):
    rows = [(1, t // 3, "user" if t % 2 else "assistant", "Same text." if t % 5 else f"Text {t}.", "") for t in range(900)] + [(2, 0, "user", "Hi.", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair_conversations(df, max_rows=50)) == brute(rows)


def test_edges(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", ""), (kept, 0, None, None, ""), (kept, 0, "user", "x" * 200_000, "")], SCHEMA)
    found = got(repair_conversations(df.withColumnRenamed("extra", "cost")))
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert found[kept][:5] == (0, 1, 0, 1, 1) and found[kept][5:7] == (8, "DD")
    assert repair_conversations(df.limit(0)).count() == 0
    assert repair_conversations(df.limit(0)).columns[0] == "conv_id"


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(table(random.Random(3), 30, 12), SCHEMA).drop("extra")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    made = repair_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert rows_of(made) == sql_rows(ORACLES["op13_conversations"], str(tmp_path), made.columns)
