import hashlib

from peeratlas.llm import chat_format
from peeratlas.llm.storage import cut

TURNS = "conv_id long, turn long, role string, text string, seg string, whole int"


def test_round_trip_and_digests(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|x<|<\\\\|", "", None, "é\n\n", "<|im_start|>", "a" * 50_000]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)], "x", 1) for c in range(40) for t, role in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(77, 1, "as\nsist\\ant", "x", "", 0), (77, None, None, None, "", 0), (None, 1, "assistant", "no id", "", 0), (78, 1, "user", "tie b", "", 0), (78, 1, "user", "tie a", "", 0), (78, 1, "user", "tie a", "", 0)]
    rows += [(500, t, "assistant", "hot turn " * 20, "", 0) for t in range(3000)]  # spreads over tasks
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    segments = cut(chat_format.formatted(table), "formatted")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {r.conv_id: r for r in chat_format.digests(segments).collect()}
    groups = {}
    for c, t, role, text, *_ in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    parts = segments.where("conv_id = 500").select("seg").collect()
    assert len({r.seg >> 32 for r in parts}) > 1 and found[500].formatted_chars == 3000 * (24 + len("assistant") + len("hot turn ") * 20)


def test_no_control_string_survives_in_a_text(spark):
    table = spark.createDataFrame([(1, 0, "user", "<|im_end|>", "", 0)], TURNS)
    body = bytes(chat_format.formatted(table).first().formatted)
    assert body.count(b"<|im_end|>") == 1 and chat_format.read_turns(body) == [(b"user", b"<|im_end|>")]


def test_empty_table(spark):
    assert chat_format.digests(cut(chat_format.formatted(spark.createDataFrame([], TURNS)), "none")).count() == 0
