import hashlib
import itertools
import random
import time

import rows  # noqa: F401
from pyspark.sql import functions as F
from tidewatch.llm import chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_formatted_conversations_read_back(spark):
    draw = random.Random(2)
    pieces = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<\\|", "<", "|", "\\", "\n", "x", "é😀", "assistant", "<|", "\\n"]
    given = []
    for conversation, turns in enumerate(itertools.chain(range(1, 8), [40, 128, 600])):
        for turn in range(turns):
            text = None if draw.random() < 0.1 else "".join(draw.choices(pieces, k=draw.randrange(9)))
            role = draw.choice(["user", "assistant", "assistant", "system", "", "a\\n\nb<|", None])
            given.append((conversation, turn, role, text, "clash"))
    given += [(None, 1, "user", "no id", "c"), (99, None, "assistant", "no turn", "c"), (99, 1, "assistant", "x", "c"), (99, 1, "assistant", "x", "c")]
    table = spark.createDataFrame(given, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    formatted = chat.format_conversations(table)
    out = {
        r.conv_id: r
        for r in formatted.select("conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(chat.pieces_of(F.col("formatted")), F.col("loss")).alias("learned")).collect()
    }
    told = {r.conv_id: r for r in chat.digests(formatted).collect()}
    keys = {k for k, *_ in given}
    assert set(out) == keys
    for key in keys:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x, _ in given if k == key))
        assert [(t.role, t.text) for t in out[key].turns] == [(r, x) for _, r, x in turns]
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert out[key].learned == learned
        blocks = len(list(itertools.groupby(turns, key=lambda t: t[1])))
        assert out[key].formatted.count("<|im_start|>") == blocks
        row = told[key]
        assert row.n_turns == len(turns) and row.loss_chars == len(learned) and row.formatted_chars == len(out[key].formatted)
        assert row.turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert row.loss_sha256 == digest(learned)


def test_no_rows_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none)).count() == 0


def test_long_conversations(spark):
    """Time grows with the turns, alternating or all of one role."""

    def spent(turns, roles):
        table = spark.range(turns).selectExpr(
            "1L as conv_id", "id as turn", f"element_at({roles}, cast(id % 2 as int) + 1) as role", "repeat(concat('t😀', id), 8) as text"
        )
        started = time.time()
        row = chat.digests(chat.format_conversations(table)).first()
        assert row.n_turns == turns
        learned = "".join(f"t😀{i}" * 8 for i in range(turns) if i % 2 or "user" not in roles)
        assert row.loss_sha256 == digest(learned) and row.loss_chars == len(learned)
        return time.time() - started

    for roles in ("array('user', 'assistant')", "array('assistant', 'assistant')"):
        spent(100, roles)
        assert spent(16_000, roles) < 8
