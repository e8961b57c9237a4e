"""Repair of conversations' structure: each distinct signature of roles and faults is solved once."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import checked, cut, drop

#: What was said last: nothing, system, user, assistant; and who must speak next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SAID = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 40  # the cost of what can't be
END = "$"


def solve(signature: str, after: tuple[int, ...] = (0, 0, 0, 0)) -> tuple[list[int], list[str | None], list[int]]:
    """For each state before the rows of a signature: the least cost from there to the end,
    the edits' initials and the state after them.

    A signature has a letter a row: s, u, a or o (any other role), capital if the text is
    cut off, - if the row must go; the last part of a conversation ends with $, where only
    a complete conversation costs nothing. after: costs of going on behind other parts, by
    state. Of equally cheap edits the ASCII-least: every letter leads to one state, so the
    least letter of a cheapest edit is enough at each step. Nothing is inserted twice in a
    row, for both insertions could be left out.
    """
    memo: dict[tuple[int, int, bool], tuple] = {}

    def best(i: int, state: int, inserted: bool) -> tuple:
        """(cost, letter, what follows) of the cheapest edits from row i on."""
        key = (i, state, inserted)
        if key in memo:
            return memo[key]
        if i == len(signature):
            found = [(after[state], "", None)]
        else:
            mark, found = signature[i], []
            if not inserted:
                to = (i, NEXT[state], True)
                found.append((INSERT + best(*to)[0], "I", to))
            if mark == END:
                if state in (START, ASSISTANT):
                    found.append((0, "", None))
            else:
                to = (i + 1, state, False)
                found.append((DELETE + best(*to)[0], "D", to))
                if mark != "-":
                    whole = 0 if mark.islower() else CUT_OFF
                    to = (i + 1, NEXT[state], False)
                    found.append((whole + RENAME + best(*to)[0], "R", to))
                    said = SAID.get(mark.lower())
                    if said is not None and (said == NEXT[state] or (said == SYSTEM and state == START)):
                        to = (i + 1, said, False)
                        found.append((whole + best(*to)[0], "K", to))
        memo[key] = min(found, key=lambda f: f[:2], default=(NEVER, "", None))
        return memo[key]

    costs, audits, exits = [], [], []
    for state in range(4):
        cost, letter, to = best(0, state, False)
        letters, place = [letter], (0, state, False)
        while to is not None:
            place = to
            _, letter, to = memo[place]
            letters.append(letter)
        costs.append(min(cost, NEVER))
        audits.append("".join(letters) if cost < NEVER else None)
        exits.append(place[1])
    return costs, audits, exits


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The rows after the edits."""
    out_roles, out_texts, i = [], [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            role, state = roles[i], SAID[roles[i][0]]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out_roles.append(role)
        out_texts.append("" if edit == "I" else texts[i])
        i += edit != "I"
    return out_roles, out_texts


SEGMENT = "conv_id {id}, seg long, whole boolean, signature string, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"


def _said(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = 128) -> DataFrame:
    """Conversations in parts of up to most_rows rows, in order of turn (null first; ties by
    role, hash of the text, text), with the parts' signatures and faults; whole: the part
    is the conversation. Null roles and texts are empty.

    Faults: blank texts; duplicates, rows whose role and text came earlier in the same
    conversation; texts that don't end with a mark. Earlier rows are found by the least
    turn of each repeated role and text (an aggregate of digests, no window over a
    conversation), and those of one turn by the row before. Rows are dealt by ranges of all
    sort keys, so that neither a long conversation nor a turn with very many rows is one task.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    same = F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256)
    talk = rows.where(_said(F.col("text"))).select("conv_id", same.alias("same"), F.coalesce("turn", F.lit(-(1 << 63))).alias("at"))
    repeated = talk.groupBy("conv_id", "same").agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).where("earliest < latest").drop("latest")
    repeated = checked(cut(repeated.toDF("of", "key", "earliest"), "repeated-rows"), 200_000)
    met = rows.withColumn("same", same).join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("key")), "left")
    late = F.coalesce(F.coalesce("turn", F.lit(-(1 << 63))) > F.col("earliest"), F.lit(False))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~_said(F.col("text")), 1).when(late, 2).when(~ended, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = met.select("conv_id", "turn", "role", F.xxhash64("text").alias("hash"), "text", fault.cast("byte").alias("fault"), kind.alias("kind"))
    keys = ["conv_id", "turn", "role", "hash"]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    names = [f.split()[0] for f in SEGMENT.split(", ")]

    def of(batches):
        place, seen, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            codes = {c: both[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in ("conv_id", "turn", "role", "text")}
            equal = lambda *columns, codes=codes: np.logical_and.reduce([codes[c][1:] == codes[c][:-1] for c in columns])
            pad = lambda flags, last=last: flags if last is not None else np.concatenate([[False], flags])
            again, same_turn = pad(equal("conv_id", "turn", "role", "text")), pad(equal("conv_id", "turn"))
            last = batch.slice(batch.num_rows - 1, 1)
            n = batch.num_rows
            fault = batch.column(5).to_numpy(zero_copy_only=False).copy()
            fault[again & (fault != 1)] = 2
            initials = np.frombuffer("".join(batch.column(6).to_pylist()).encode(), np.uint8)
            marks = np.where(fault == 3, initials - 32, initials)
            marks[(fault == 1) | (fault == 2)] = ord("-")
            own = codes["conv_id"][-n:]
            begins = np.concatenate([[True], own[1:] != own[:-1]])
            first_row = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            starts = np.flatnonzero((np.arange(n) - first_row) % most_rows == 0)
            stops = np.append(starts[1:], n)
            count = lambda flags, starts=starts: pa.array(np.add.reduceat(flags.astype(np.int64), starts))
            pairs = initials[:-1].astype(np.int64) * 256 + initials[1:]
            legal = np.isin(pairs, [ord(p[0]) * 256 + ord(p[1]) for p in ("su", "ua", "au")])
            inside = np.ones(n, bool)
            inside[starts] = False
            illegal = inside & np.concatenate([[False], ~legal])
            whole = begins[starts] & np.append(begins[starts[1:]], False)
            whole[0] = False  # the first and last of a batch may go on elsewhere
            new_turn = ~(same_turn & inside) & pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            letters, at = marks.tobytes().decode(), np.append(starts, n).astype(np.int32)
            valid = pa.array(starts), pa.array(stops - 1)
            lists = [pa.ListArray.from_arrays(pa.array(at), batch.column(c).cast(pa.string())) for c in (2, 4)]
            turn = batch.column(1)
            least = _first_valid(turn, starts, stops)
            values = [batch.column(0).take(valid[0]), pa.array(place + seen + np.arange(len(starts))), pa.array(whole), pa.array([letters[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])]
            values += [count(fault == f) for f in (1, 2, 3)] + [count(illegal), batch.column(6).take(valid[0]), batch.column(6).take(valid[1]), least, turn.take(valid[1]), count(new_turn), *lists]
            seen += len(starts)
            yield pa.RecordBatch.from_arrays(values, names)

    return dealt.mapInArrow(of, SEGMENT.format(id=turns.schema[conv_col].dataType.simpleString()))


def _first_valid(turn: pa.Array, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Each part's first turn that isn't null (nulls come first), else null."""
    valid = pc.is_valid(turn).to_numpy(zero_copy_only=False)
    at = np.where(valid, np.arange(len(valid)), len(valid))
    first = np.minimum.reduceat(at, starts)
    return turn.take(pa.array(np.where(first < stops, first, 0), mask=first >= stops))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _solved(keys: DataFrame) -> DataFrame:
    """signature, after with costs, audits and exits by the state before; keys are distinct."""
    schema = pa.schema([("signature", pa.string()), ("after", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])

    def of(batches):
        for batch in batches:
            asked = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield _batch([(s, a, *solve(s, tuple(a))) for s, a in asked], schema)

    return keys.select("signature", "after").mapInArrow(of, "signature string, after array<long>, costs array<long>, audits array<string>, exits array<int>")


AUDIT = "seg long, state int, audit string, cost long, illegal_before long, shared_turn long"


def audits(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits: by signature for whole conversations, by seg for the others.

    Whole conversations: each distinct signature is solved once. Conversations in several
    parts are short rows here, without texts: costs of each distinct signature between all
    states first; a stream over a conversation's parts from the last to the first adds them
    up to the costs of going on behind each part; each distinct signature with these costs
    is solved once; a stream from the first part to the last says in which state each
    begins. Streams hold one part at a time.
    """
    none = F.array(*[F.lit(0).cast("long")] * 4)
    singles = parts.where("whole").select(F.concat("signature", F.lit(END)).alias("signature")).distinct().withColumn("after", none)
    some = parts.where("not whole").select("conv_id", "seg", "signature", "first_role", "last_role", "first_turn", "last_turn")
    ends = some.groupBy("conv_id").agg(F.max("seg").alias("last_seg"))
    final = F.when(F.col("seg") == F.col("last_seg"), F.concat("signature", F.lit(END))).otherwise(F.col("signature"))
    some = cut(some.join(checked(ends.select("last_seg", F.lit(True).alias("final")), 200_000), F.col("seg") == F.col("last_seg"), "left").withColumn("signature", final).drop("last_seg", "final"), "split-conversations")
    unit = F.explode(F.array(*[F.array(*[F.lit(0 if n == m else NEVER).cast("long") for m in range(4)]) for n in range(4)])).alias("after")
    between = _solved(some.select("signature").distinct().select("signature", unit)).groupBy("signature").agg(F.collect_list(F.struct("after", "costs")).alias("between"))

    first = object()
    met = some.join(between, "signature").select("conv_id", "seg", "between")

    def back(batches):
        now, after = first, [0] * 4
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if now is first or now != r["conv_id"]:
                    now, after = r["conv_id"], [0] * 4
                rows.append((r["seg"], after))
                after = _behind(r["between"], after)
            yield _batch(rows, pa.schema([("seg", pa.int64()), ("after", pa.list_(pa.int64()))]))

    afters = met.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc()).mapInArrow(back, "seg long, after array<long>")
    placed = cut(some.join(afters, "seg"), "split-costs")
    solved = cut(_solved(singles.union(placed.select("signature", "after")).distinct()), "solved")
    schema = pa.schema([("seg", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal_before", pa.int64()), ("shared_turn", pa.int64())])

    def forth(batches):
        now, state, role, turn = first, START, None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                illegal = shared = 0
                if now is first or now != r["conv_id"]:
                    now, state = r["conv_id"], START
                else:
                    illegal = int(role + r["first_role"] not in ("su", "ua", "au"))
                    shared = int(turn is not None and turn == r["first_turn"])
                end = r["exits"][state]
                cost = r["costs"][state] - (0 if r["signature"].endswith(END) else r["after"][end])
                rows.append((r["seg"], state, r["audits"][state], cost, illegal, shared))
                state, role, turn = end, r["last_role"], r["last_turn"]
            yield _batch(rows, schema)

    known = placed.join(solved, ["signature", "after"]).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    split = cut(known.select("conv_id", "seg", "signature", "first_role", "last_role", "first_turn", "last_turn", "after", "costs", "audits", "exits").mapInArrow(forth, AUDIT), "split-audits")
    by_signature = solved.join(singles, ["signature", "after"], "left_semi").select("signature", F.get("audits", F.lit(0)).alias("audit"), F.get("costs", F.lit(0)).alias("cost"))
    by_signature = cut(by_signature, "audits")
    for table in (some, placed, solved):
        drop(table)
    return by_signature, split


def _behind(between: list, after: list[int]) -> list[int]:
    """Costs before a part from those behind it; the least is taken off all, for only
    differences decide, and so they stay few."""
    found = [NEVER] * 4
    for entry in between:
        behind = after[entry["after"].index(0)]
        found = [min(f, c + behind, NEVER) for f, c in zip(found, entry["costs"], strict=True)]
    least = min(found)
    return [f - least if f < NEVER else NEVER for f in found]


REPAIRED = "conv_id {id}, seg long, whole boolean, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, audit string, cost long, roles array<string>, texts array<string>"


def repaired(parts: DataFrame) -> DataFrame:
    """The parts after their cheapest edits, with audit and cost. Audits are joined by
    signature, those of conversations in several parts by part; they are broadcast where
    their counted rows are few, else met by a shuffle that AQE can split."""
    by_signature, split = audits(parts)
    known = by_signature.withColumnRenamed("signature", "solved")
    one = parts.where("whole").join(checked(known, 200_000), F.concat("signature", F.lit(END)) == F.col("solved")).withColumn("state", F.lit(START))
    more = parts.where("not whole").join(checked(split, 200_000), "seg").withColumn("illegal", F.col("illegal") + F.col("illegal_before")).withColumn("turns", F.col("turns") - F.col("shared_turn"))
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    rows = one.select(*names, "state").union(more.select(*names, "state"))

    def of(batches):
        for batch in batches:
            out = [replay(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("audit", "state", "roles", "texts")), strict=True)]
            lists = [pa.array([o[n] for o in out], pa.list_(pa.string())) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-2]] + lists, names)

    return rows.mapInArrow(of, REPAIRED.format(id=parts.schema["conv_id"].dataType.simpleString()))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repaired conversations in parts: conv_id, seg (their order), faults, audit, cost, and
    the rows after the edits as roles and texts.

    Edits: keep, rename the role (1), delete (2; a must for blank and duplicate rows),
    insert a turn without text (5); a row that is cut off and stays costs 5. The roles
    after them are those of an optional system turn and pairs of user and assistant, or
    nothing. Null roles and texts are empty; null ids make one conversation; repeated rows
    are duplicates; other roles than the three must go or be renamed; an empty table gives
    no rows; other columns are ignored. Both tables that this reads again stay written.
    """
    parts = cut(segments(turns, conv_col, turn_col, role_col, text_col), "conversation-parts")
    done = cut(repaired(parts), "repaired-parts")
    drop(parts)
    return done


def digests(done: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, faults, cost, audit and the digest of the
    repaired rows. A digest is a chain over a conversation's bytes: those of conversations
    in one part are made where they are read, one task streams through the parts of others."""
    order = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    span = F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = done.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *sums, F.array_join(F.transform(order, lambda x: x["audit"]), "").alias("audit"))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    kind = done.schema["conv_id"].dataType.simpleString()

    def chain(batches):
        now, state, begun, type_ = None, None, False, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], type_), pa.array([state.hexdigest()])], ["conv_id", "sha"])

        for batch in batches:
            type_ = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if state is None or now != r["conv_id"]:
                    if state is not None:
                        yield row()
                    now, state, begun = r["conv_id"], hashlib.sha256(), False
                if r["said"]:
                    state.update((b"\n" if begun else b"") + r["said"].encode())
                    begun = True
        if state is not None:
            yield row()

    split = done.where("not whole").select("conv_id", "seg", said.alias("said")).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    hashes = done.where("whole").select("conv_id", F.sha2(said, 256).alias("sha")).union(split.select("conv_id", "said").mapInArrow(chain, f"conv_id {kind}, sha string"))
    met = hashes.withColumnRenamed("conv_id", "of")
    return found.join(met, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("sha", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of the registered query, damaged by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")
