import hashlib
import heapq
import random
import re
import zlib

import pytest

from peeratlas.llm import queries, turn_repair

SPACE = " \t\n\x0b\x0c\r"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def plain(rows):
    """counts, cost, audit, repaired rows of (turn, role, text) rows in order: shortest
    paths over (row, roles' state), audits as labels, no shortcuts."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        kind = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(kind)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = (gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs))
    # states: what the output so far is, as the automaton of the shape
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done and not (i == len(rows) and state in ("", "a")):
            continue
        if i == len(rows) and state in ("", "a"):
            assert SHAPE.match("".join(r[:1] for r, _ in out))
            return counts, cost, audit, out
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, role[0]], (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] in (0, 3):
                stay = 5 if faults[i] == 3 else 0
                _, own, text = rows[i]
                for letter, role, price in (("K", own, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (state, role[:1]) in step:
                        heapq.heappush(heap, (cost + stay + price, audit + letter, i + 1, step[state, role[:1]], (*out, (role, text))))


def exhaustive(rows_marks):
    """(cost, audit) of all edit sequences of a few rows, without any search order."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if i == len(rows_marks) and SHAPE.match(roles):
            best = min(filter(None, [best, (cost, audit)]))
        if not inserted:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", True)
        if i < len(rows_marks):
            mark = rows_marks[i]
            go(i + 1, roles, cost + 2, audit + "D", False)
            if mark != "-":
                stay = 5 * mark.isupper()
                go(i + 1, roles + mark.lower(), cost + stay, audit + "K", False)
                for r in "ua":
                    go(i + 1, roles + r, cost + stay + 1, audit + "R", False)

    go(0, "", 0, "", False)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_solutions_of_signatures_equal_all_edit_sequences(n):
    rng = random.Random(n)
    marks = ["".join(rng.choice("suaoSUAO-") for _ in range(n)) for _ in range(60)]
    for m in marks:
        costs, audits, exits = turn_repair.solve(m + "$")
        assert (costs[0], audits[0]) == exhaustive(m)
        assert exits[0] in (turn_repair.START, turn_repair.ASSISTANT)


def test_parts_solved_apart_equal_the_whole():
    rng = random.Random(7)
    for _ in range(200):
        m = "".join(rng.choice("suaoUA-") for _ in range(rng.randint(3, 14))) + "$"
        a = rng.randint(1, len(m) - 2)
        after = turn_repair.solve(m[a:])
        front = turn_repair.solve(m[:a], tuple(after[0]))
        whole = turn_repair.solve(m)
        assert front[0][0] == whole[0][0] and front[1][0] + after[1][front[2][0]] == whole[1][0]


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def random_rows(rng, n):
    texts = ["Yes.", "No!", "maybe", "", " \t", "Why? ", "é.", "x\n"]
    turns = sorted(rng.choices(range(2 * n), k=n))
    return [(None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.") for t in turns]


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(rows, key=key)


@pytest.mark.parametrize("most_rows", [2, 128])
def test_repair_equals_plain_search(spark, monkeypatch, most_rows):
    rng = random.Random(11)
    talks = {i: random_rows(rng, rng.randint(0, 12)) for i in range(150)}
    for rows in talks.values():  # one turn has one role and text, but for exact repeats
        kept = {}
        rows[:] = [(t, *kept.setdefault(t, (r, x))) for t, r, x in rows]
    talks[None] = [(0, "user", "Hm."), (1, "assistant", "So."), (1, "assistant", "So.")]
    talks[999] = [(t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(700)]
    rows = [(i, t, r, x, 1) for i, rows in talks.items() for t, r, x in rows]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int").repartition(7)
    segments = turn_repair.segments
    monkeypatch.setattr(turn_repair, "segments", lambda *args: segments(*args, most_rows=most_rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        done = turn_repair.repair(table)
        assert done.where("size(roles) <> size(texts)").count() == 0
        found = {r.conv_id: r for r in turn_repair.digests(done).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == {i for i, rows in talks.items() if rows}
    for i, r in found.items():
        counts, cost, audit, out = plain(in_order(talks[i]))
        assert ((r.gaps, r.blank, r.duplicate, r.truncated, r.illegal), r.cost, r.audit, r.repaired_sha256) == (counts, cost, audit, digest(out)), i


def test_nulls_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello " * 200_000 + ".")]
    found = turn_repair.digests(turn_repair.repair(spark.createDataFrame(rows, schema))).collect()
    assert [(r.conv_id, r.gaps, r.blank, r.illegal, r.cost, r.audit) for r in found] == [(1, 0, 1, 1, 2, "DKK")]
    assert turn_repair.digests(turn_repair.repair(spark.createDataFrame([], schema))).count() == 0


def test_query_equals_plain_search(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randint(1, 5)
        rows += [(i, t, r, f"Some text {rng.random()}." if rng.random() < 0.9 else "a? b! c") for t, r in enumerate(roles)]
    rows += [(7, None, "user", "No turn."), (300, 0, None, None), (301, 3, "user", None)]
    rows += [(i, 0, "user", "Alone.") for i in range(400, 440)]  # some of them lose their only row
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in queries.QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    talks = {i: [] for i, *_ in rows}
    for i, t, r, x in in_order_of_turn(rows):
        r, x = r if r is not None else " ", x if x is not None else " "
        h = zlib.crc32(f"{i}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        talks[i] += [(t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    assert set(found) == set(talks) and any(not rows for rows in talks.values())
    for i, rows in talks.items():
        counts, cost, audit, out = plain(rows)
        r = found[i]
        assert ((r.gaps, r.blank, r.duplicate, r.truncated, r.illegal), r.cost, r.audit, r.repaired_sha256) == (counts, cost, audit, digest(out)), i


def in_order_of_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
