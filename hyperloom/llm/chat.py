"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only the reply is trainable. A conversation that does not end with a
reply also gives one example with all its turns as context and nothing trainable, so
that no turn is lost from the output.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside
roles and texts are escaped reversibly: a backslash is doubled, then a backslash is
put inside ``<|``; in roles a line break becomes ``<\\n`` written out. After the
doubling every run of backslashes has even length, so the single ones are known.

Null role or text is empty. Turns are ordered by turn (null last), then role and text;
repeated rows are turns of their own. Rows with a null conversation id form one
conversation. An empty table gives an empty result; extra columns are ignored. A
conversation is one value of the output, and its digests cover all of it, so its turns
meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_end (code points, end excluded; equal if nothing is trainable)."""
    one = F.struct(F.col(turn).isNull().alias("no_turn"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conv = conversations.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    conv = conv.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END + "\n"))).alias("said"),
        F.transform("turns", lambda t: F.when(t["role"] == TRAINED, F.length(escaped(t["text"])))).alias("trained"),
    )
    size = F.size("said")
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.get("trained", i - 1).isNotNull() | (i == size))
    each = conv.select("conv_id", "said", "trained", F.posexplode(ends).alias("example", "upto"))
    each = each.select("conv_id", "example", F.array_join(F.slice("said", F.lit(1), F.col("upto")), "").alias("formatted"), F.get("trained", F.col("upto") - 1).alias("n"))
    end = F.length("formatted") - len(END) - 1
    return each.select("conv_id", "example", "formatted", F.when(F.col("n").isNull(), F.length("formatted")).otherwise(end - F.col("n")).alias("loss_start"), F.when(F.col("n").isNull(), F.length("formatted")).otherwise(end).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what its examples say: turns from the longest, replies from the masks."""
    loss = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    each = formatted.select("conv_id", "example", "formatted", unescaped(loss).alias("loss"))
    conv = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.split(F.col("whole"), r"<\|im_end\|>\n")
    turns = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    role = lambda t: F.substring_index(t, "\n", 1)
    said = F.transform(turns, lambda t: F.concat(unescaped_role(role(t)), F.lit("\n"), unescaped(F.substring(t, F.length(role(t)) + 2, F.length(t))), F.lit("\n")))
    conv = conv.select("conv_id", said.alias("said"), "loss", "formatted_chars")
    return conv.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("said", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
