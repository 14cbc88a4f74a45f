"""Chat windows: read back exactly, budgeted, and planned without Python."""

import hashlib
import random
import re

from vetloom.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def sample():
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<\\|", "<", "|", "\n", "assistant", "é🙂", " word", "", "<|", "\\\\<|", "<\\n|", "<|im_end|>\n"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 30)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "sys\ntem", "a\\n", "<\\n|", None])
            text = rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))])
            rows.append((conv, turn, role, text))
    rows += [(50, 1, "assistant", "x")] * 2 + [(51, None, "user", "no turn"), (51, 0, "assistant", "y"), (None, 0, "assistant", "no conversation")]
    rows += [(52, 0, "assistant", "long word " * 30_000), (52, 1, "assistant", "after")]
    return rows


def test_reads_back_exactly(spark):
    rows = sample()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", formatted string")
    for budget, history in ((1024, 256), (60, 20), (40, 0), (30, 100)):
        windows = chat.format_chats(frame, budget=budget, history=history)
        found = {r.conv: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
        assert found == expected(rows)
    assert chat.digests(chat.format_chats(frame.where("false"))).count() == 0


def test_windows_keep_to_the_budget_and_repeat_what_they_should(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "word " * rng.randrange(1, 12)) for t in range(1, 80)]
    budget, history = 100, 30
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history).orderBy("window").collect()
    assert len(windows) > 5
    cost = {r[1]: len(r[3].split()) + 4 for r in rows}
    seen = 0
    for w in windows:
        turns = re.findall(r"<\|im_start\|>(.*?)<\|im_end\|>\n", w.formatted, re.S)
        fresh = len(turns) - w.n_repeated
        repeated = range(1, seen)[::-1][: max(w.n_repeated - 1, 0)]
        assert turns[0] == "system\nbe kind"
        assert sum(cost[t] for t in range(seen, seen + fresh)) <= budget - history
        assert sum(cost[t] for t in repeated) <= history
        assert turns == [f"{r}\n{t}" for _, n, r, t in rows if n == 0 or n in repeated or seen <= n < seen + fresh]
        texts = [w.formatted[s.start : s.end] for s in w.loss]
        assert texts == [t for _, n, r, t in rows if seen <= n < seen + fresh and r == "assistant"]
        seen += fresh
    assert seen == len(rows)


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = chat.digests(chat.format_chats(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_escaping_is_reversible(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("<|\\n\n!a") for _ in range(rng.randrange(12))),) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"),
        chat.escape_role(F.col("t")).alias("r"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v"))
    for row in frame.collect():
        assert row.u == row.t == row.v and "<|" not in row.e and "\n" not in row.r and "<|" not in row.r
