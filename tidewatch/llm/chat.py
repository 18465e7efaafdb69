"""Chat formatting by relational steps: turns sorted, same roles merged, texts joined.

A conversation becomes blocks `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Adjacent
turns of one role share a block, with `<|im_sep|>` between their texts, so every
turn can be read back. Inside roles and texts a control string cannot appear:
`<` , any number of backslashes, `|` gets one more backslash, and reading takes
it off again. A role's own line breaks and backslashes are escaped as well.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 4096  # characters of a formatted text that are sought through for a span
GROUP = 128  # turns whose places are counted together
START, END, JOIN = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.regexp_replace(plain, r"\\\\", r"\\")


def blocks_of(turns: Column) -> Column:
    """Blocks (role, texts) of sorted turns: a turn of the last block's role joins it.

    A block begins where the role differs from the turn before; its texts are
    the slice up to the next beginning.
    """
    begins = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(begins.alias("begin"), ends.alias("end")),
        lambda x: F.struct(
            F.get(turns, x["begin"])["role"].alias("role"),
            F.transform(F.slice(turns, x["begin"] + 1, x["end"] - x["begin"]), lambda turn: turn["text"]).alias("texts"),
        ),
    )


def format_conversations(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`conv_id`, `formatted`, `loss`: the text and the parts that are learned from.

    `loss` lists (start, length) in code points of `formatted`, one for each
    assistant turn, escaped texts without marks. Turns are put in order of turn,
    ties by role and text; repeated rows are turns of their own; a null turn
    comes first, a null role or text is empty. A null id is a conversation like
    others. No rows give no conversations. Other columns are ignored.
    """
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            )
        ),
    )
    sorted_turns = rows.groupBy(F.col(conversation).alias("conv_id")).agg(turns.alias("turns"))
    pieces = sorted_turns.select("conv_id", F.explode(F.array(blocks_of(F.col("turns")))).alias("blocks")).select(
        "conv_id",
        F.transform(
            "blocks",
            lambda block: F.struct(
                (block["role"] == LEARNED).alias("learned"),
                F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")).alias("head"),
                F.transform(block["texts"], escape).alias("texts"),
            ),
        ).alias("blocks"),
    )
    formatted = F.array_join(
        F.transform(
            "blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], JOIN), F.lit(END + "\n"))
        ),
        "",
    )
    lengths = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    b["learned"].alias("learned"),
                    F.when(k == 0, F.length(b["head"])).otherwise(len(JOIN)).alias("before"),
                    F.length(t).alias("length"),
                    F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).alias("after"),
                ),
            ),
        )
    )
    measured = computed(pieces, "conv_id", formatted.alias("formatted"), lengths.alias("lengths"))
    grouped = computed(measured, "conv_id", "formatted", groups_of(F.col("lengths")).alias("groups"))
    offsets = F.aggregate(
        "groups",
        F.array(F.lit(0)),
        lambda done, group: F.concat(done, F.array(F.element_at(done, -1) + group["at"])),
    )
    placed = computed(grouped, "conv_id", "formatted", "groups", offsets.alias("offsets"))
    loss = F.flatten(
        F.transform(
            "groups",
            lambda group, i: F.transform(
                group["spans"],
                lambda span: F.struct((F.get("offsets", i) + span["start"]).alias("start"), span["length"].alias("length")),
            ),
        )
    )
    return placed.select("conv_id", "formatted", loss.alias("loss"))


def computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A projection that later steps cannot take apart and compute again for every element."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*")


def groups_of(lengths: Column) -> Column:
    """For every `GROUP` turns: how far they reach, and the learned spans counted from their first."""

    def step(done: Column, x: Column) -> Column:
        span = F.struct((done["at"] + x["before"]).alias("start"), x["length"].alias("length"))
        return F.struct(
            (done["at"] + x["before"] + x["length"] + x["after"]).alias("at"),
            F.when(x["learned"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(GROUP))
    return F.transform(firsts, lambda i: F.aggregate(F.slice(lengths, i, GROUP), start, step))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were given."""
    blocks = F.transform(
        F.filter(F.split(formatted, r"<\|im_start\|>"), lambda block: block != ""),
        lambda block: F.struct(
            unescape_role(F.regexp_extract(block, r"^([^\n]*)\n", 1)).alias("role"),
            F.split(F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1), r"<\|im_sep\|>").alias("texts"),
        ),
    )
    return F.flatten(
        F.transform(
            blocks,
            lambda block: F.transform(
                block["texts"], lambda text: F.struct(block["role"].alias("role"), unescape(text).alias("text"))
            ),
        )
    )


def pieces_of(formatted: Column) -> Column:
    """A text cut every `PIECE` characters, so that a span is not sought from the text's start."""
    return F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)


def read_loss(pieces: Column, loss: Column) -> Column:
    """The texts below the loss mask, unescaped, end to end; `pieces` is a column that holds the cut text."""

    def text_of(span: Column) -> Column:
        first = F.floor(span["start"] / PIECE).cast("int")
        last = F.floor((span["start"] + span["length"]) / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(F.substring(held, span["start"] - first * PIECE + 1, span["length"]))

    return F.array_join(F.transform(loss, text_of), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation reads back as: turns, learned text and sizes."""
    cut = computed(formatted, "conv_id", "formatted", "loss", pieces_of(F.col("formatted")).alias("pieces"))
    read = computed(
        cut,
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("pieces"), F.col("loss")).alias("learned"),
    )
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
