import functools
import hashlib
import random
import zlib

from tabgauge.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
NEXT = {0: "su", 1: "u", 2: "a", 3: "u"}
GO = {"s": 1, "u": 2, "a": 3}


def damaged(rows):
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        role = "user" if fate == 4 else role
        found[conv] += [(turn, role, text)] * (fate > 0) * (1 + (fate == 3))
    return found


def repaired_by_trying(rows):
    """The least (cost, audit) and the repaired rows, over all edits."""

    @functools.cache
    def least(i, state, inserted):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, must, late = rows[i]
            cost, audit, lines = least(i + 1, state, 0)
            found.append((4 + cost, "D" + audit, lines))
            if not must:
                for to in NEXT[state]:
                    cost, audit, lines = least(i + 1, GO[to], 0)
                    if role[:1] == to:
                        found.append((3 * late + cost, "K" + audit, ((role, text), *lines)))
                    if to != "s":
                        name = {"u": "user", "a": "assistant"}[to]
                        found.append((3 + 3 * late + cost, "R" + audit, ((name, text), *lines)))
        if inserted < 3:
            for to in NEXT[state].replace("s", ""):
                cost, audit, lines = least(i, GO[to], inserted + 1)
                name = {"u": "user", "a": "assistant"}[to]
                found.append((3 + cost, "I" + audit, ((name, ""), *lines)))
        return min(found, default=(10**9, "", ()))

    return least(0, 0, 0)


def brute_force(by_conv):
    expected = {}
    for conv, rows in by_conv.items():
        rows = sorted(
            rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
        )
        seen, faults, marked = set(), [0, 0, 0], []
        for _, role, text in rows:
            late = False
            if not text.strip(SPACES):
                faults[0] += 1
                must = True
            elif (role, text) in seen:
                faults[1] += 1
                must = True
            else:
                must, late = False, text.strip(SPACES)[-1] not in ".!?"
                faults[2] += late
            seen.add((role, text))
            marked.append((role, text, must, late))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = repaired_by_trying(tuple(marked))
        joined = "\n".join(f"{r}:{t}" for r, t in lines)
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        digest = hashlib.sha256(joined.encode()).hexdigest()
        expected[conv] = (gaps, *faults, illegal, cost, audit, digest, lines)
    return expected


def found(table):
    return {r.conv_id: tuple(r)[1:] for r in table.collect()}


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "why?", " ", None, "a\nb!", "x . ", "", "long one. é"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(most + 1)):
            at = rng.choice([turn, turn, turn, turn + 5, None])
            text = rng.choice(texts)
            unique = f"{turn}{text}" if text and rng.random() < 0.7 else text
            rows.append((conv, at, rng.choices(roles, [1, 6, 6, 1, 1, 1])[0], unique))
    return rows


def test_as_all_edits_tried(spark):
    rows = some_rows(7, 60, 14)
    by_conv = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    expected = brute_force(by_conv)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plain = found(conversations.repair(table))
    assert plain == {c: v[:-1] for c, v in expected.items()}
    # chunks of three rows: tables of chunks are chained
    assert found(conversations.repair(table, chunk_rows=3)) == plain
    lines = {}
    for r in conversations.repaired(table, chunk_rows=3).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert lines == {c: list(v[-1]) for c, v in expected.items() if v[-1]}


def test_damage_nulls_and_clashing_columns(spark):
    rows = [(*r, "x", 3, True) for r in some_rows(11, 80, 9)]
    table = spark.createDataFrame(rows, SCHEMA + ", part string, no int, again boolean")
    expected = brute_force(damaged([r[:4] for r in rows]))
    assert found(conversations.repair(conversations.damaged(table))) == {c: v[:-1] for c, v in expected.items()}
    assert None in expected


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty)).collect() == []
    assert conversations.repaired(empty).collect() == []


def test_hot_conversation_and_repeated_rows(spark):
    long = "word " * 100_000 + "end."
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(5000)]
    rows += [(2, 0, "user", "same.")] * 3000 + [(2, None, "user", "same.")] * 2000
    rows += [(3, 0, "user", long), (3, 1, "assistant", long)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    results = found(conversations.repair(table, chunk_rows=64))
    joined = "\n".join(f"{r}:{x}" for _, _, r, x in rows[:5000])
    assert results[1] == (0, 0, 0, 0, 0, 0, "K" * 5000, hashlib.sha256(joined.encode()).hexdigest())
    assert results[2][2] == 4999 and results[2][4] == 4999
    # one question is cheaper to answer than to delete
    assert results[2][5:7] == (4 * 4999 + 3, "K" + "D" * 4999 + "I")
    assert results[3][5:7] == (0, "KK")


def test_blocks_lead_where_their_symbols_lead():
    t = conversations.tables()
    for block in range(0, conversations._SYMBOLS**conversations.BLOCK, 37):
        digits = [block // conversations._SYMBOLS**k % conversations._SYMBOLS for k in (3, 2, 1, 0)]
        for start in range(len(t.vectors)):
            vector, cost = start, 0
            for s in reversed(digits):
                cost += t.one_cost[s][vector]
                vector = t.one_to[s][vector]
            assert (t.to[block, start], t.cost[block, start]) == (vector, cost)
