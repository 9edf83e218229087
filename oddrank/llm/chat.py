"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes one training example: all turns before it are the
context and only its own text is trainable. Turns that no assistant turn follows
would be lost, so a conversation that ends without an assistant turn leaves one
more example, over all its turns and with an empty loss span.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and
texts ``\\`` is written ``\\b`` and ``<|`` is written ``\\l``; inside roles a
newline is written ``\\n``. No control string can then occur in a turn, and the
parser gets back exactly what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BACKSLASH = "<|im_start|>", "<|im_end|>\n", "\\"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(BACKSLASH), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit(BACKSLASH))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Training examples: conv_id, example, n_turns, text, loss_start, loss_end.

    ``text[loss_start:loss_end]`` (code points, from 0) is the trainable reply in
    its escaped form. Each row holds one conversation's prefix, so memory is
    bounded by the longest conversation, not by the examples of it.

    Defined cases: null roles and texts are empty; rows are ordered by turn, a
    null turn first, ties and repeated rows by role and then text, none dropped;
    a null conv_id is a conversation of its own; an empty table gives no rows;
    extra columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = F.transform("ts", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
    bodies = F.transform("ts", lambda t: escape(t["text"]))
    formatted = whole.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == F.lit(target_role)).alias("is_target"),
        heads.alias("heads"),
        bodies.alias("bodies"),
    )
    size = F.size("heads")
    ends = F.filter(
        F.sequence(F.lit(1), size),
        lambda i: F.element_at("is_target", i) | (i == size),
    )
    examples = formatted.select("conv_id", "is_target", "heads", "bodies", F.posexplode(ends).alias("example", "last"))
    last = F.col("last")
    before = F.array_join(
        F.zip_with(
            F.slice("heads", F.lit(1), last - 1),
            F.slice("bodies", F.lit(1), last - 1),
            lambda h, b: F.concat(h, b, F.lit(END)),
        ),
        "",
    )
    trains = F.element_at("is_target", last)
    head, body = F.element_at("heads", last), F.element_at("bodies", last)
    opened = examples.select(
        "conv_id", "example", last.alias("n_turns"), F.concat(before, head).alias("opened"), body.alias("body"), trains.alias("trains")
    )
    start = F.length("opened")
    return opened.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("opened", "body", F.lit(END)).alias("text"),
        start.cast("long").alias("loss_start"),
        (start + F.when(F.col("trains"), F.length("body")).otherwise(0)).cast("long").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """Array of (role, text) structs read back from a formatted example."""
    pieces = F.filter(F.split(text, r"<\|im_start\|>"), lambda p, i: i > 0)
    stripped = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - F.lit(len(END))))
    return F.transform(
        stripped,
        lambda p: F.struct(
            unescape_role(F.substring(p, F.lit(1), F.locate("\n", p) - 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable reply of an example, unescaped."""
    return unescape(F.substring(text, start.cast("int") + 1, (end - start).cast("int")))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """What the formatted examples of each conversation hold, read back from them.

    formatted_chars counts the code points of all examples of the conversation.
    """
    read = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.struct("n_turns", "text").alias("longest"),
    )
    merged = read.groupBy("conv_id").agg(
        F.max_by("longest", "example").alias("longest"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), ""
        ).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = merged.withColumn("turns", parse_turns(F.col("longest.text")))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
