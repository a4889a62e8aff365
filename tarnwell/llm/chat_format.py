"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context and only
its own text is trainable. Turns that follow the last assistant turn make one more example with
nothing to train, so that the output holds the whole conversation.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash
becomes ``\\s``, ``<|`` becomes ``<\\p|`` and, in roles, a line end becomes ``\\n``; so control
strings in a text never look like marks, and :func:`unescaped` gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p|"))
    return F.replace(text, F.lit("\n"), F.lit("\\n")) if role else text


def unescaped(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("<\\p|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row per assistant turn, and a last one
    for turns after it. The mask covers code points loss_start to loss_end (from 0, end excluded).

    Needs conv_id, turn, role and text; other columns are not read. Null texts and roles count as
    empty; null turns come first; equal turns go by role, then text. Rows with a null conv_id are
    one conversation. An empty table gives no example.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escaped(role, True), F.lit("\n"))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    last = F.size("ts")
    targets = F.filter(F.sequence(F.lit(1), last), lambda i: (F.get("ts", i - 1)["role"] == "assistant") | (i == last))
    rows = turns.select("conv_id", "ts", F.posexplode(targets).alias("example", "target"))
    whole = F.concat_ws("", F.transform(F.slice("ts", 1, F.col("target")), lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))))
    own = F.get("ts", F.col("target") - 1)
    end = F.length("text") - len(END) - 1
    rows = rows.select("conv_id", "example", whole.alias("text"), own["role"].alias("role"), F.length(own["body"]).alias("n"))
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "example", "text", F.when(trained, end - F.col("n")).otherwise(0).alias("loss_start"), F.when(trained, end).otherwise(0).alias("loss_end")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, parsed from its examples: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars (of all examples) and n_examples (those with something to train)."""
    loss = unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    trained = F.struct(F.col("example").alias("example"), loss.alias("loss"))
    found = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("full"),
        F.sort_array(F.collect_list(trained)).alias("trained"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count_if(F.col("loss_end") > 0).alias("n_examples"),
    )
    parts = F.slice(F.split("full", "<\\|im_start\\|>"), 2, F.size(F.split("full", "<\\|im_start\\|>")))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - len(END) - 2)
        return F.concat(unescaped(role, True), F.lit("\n"), unescaped(body), F.lit("\n"))

    losses = F.concat_ws("", F.transform("trained", lambda t: t["loss"]))
    return found.select(
        "conv_id",
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform(parts, turn)).cast("binary"), 256).alias("turns_sha256"),
        F.length(losses).cast("long").alias("loss_chars"),
        F.sha2(losses.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        "n_examples",
    )
