"""Chat conversations as one training text each, by DataFrame expressions only.

A text is a run of blocks ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Adjacent turns of one role
share a block, parted by ``<|next|>``. Inside roles and texts every control string is escaped by one
more backslash after its ``<``, so what the template wrote can always be told from what was said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from temblor.llm.arrays import running_sums

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|next|>"
LINE = "<|line|>"  # a line feed inside a role, which ends at one
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``; a string that looks escaped already gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation.

    ``loss_spans`` holds (start, length) in code points of ``formatted``: the assistant's texts, as
    escaped, without markers. Turns are sorted by turn, then role and text; repeated rows are turns
    of their own. A null role or text is empty, a null turn comes first, and rows with a null
    conversation id form one conversation. An empty table gives no rows.

    A conversation is one row of text by nature. Its turns are cut to what is written before they
    are collected.
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Each turn with what the template puts before and after it: a block opens where the role
    # changes and closes where the next role differs.
    size = F.size("turns")

    def written(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])
        closes = (i == size - 1) | (F.get(F.col("turns"), i + 1)["role"] != t["role"])
        before = F.when(opens, F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))).otherwise(F.lit(NEXT))
        return F.struct(
            before.alias("before"), escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("after"),
            (t["role"] == LEARNED_ROLE).alias("learned"))

    parts = sorted_.select("conv_id", F.transform("turns", written).alias("parts"))
    formatted = F.array_join(
        F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    spans = F.filter(_placed("parts"), lambda s: s["learned"])
    return parts.select("conv_id", formatted.alias("formatted"), F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def _placed(parts: str) -> Column:
    """(start, length, learned, body) of each part's body, from running sums of the lengths."""
    ends = running_sums(F.transform(parts, lambda p: (F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).cast("bigint")))
    return F.zip_with(parts, ends, lambda p, end: F.struct(
        (end - F.length(p["after"]) - F.length(p["body"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length"),
        p["learned"].alias("learned"), p["body"].alias("body")))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the turns (role, text) read back from the text, and
    all text under the loss mask, unescaped."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        """Each turn with what stands before and after its body in the text."""
        role = F.substring_index(block, "\n", 1)
        bodies = F.split(F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END)), r"<\|next\|>")
        plain = unescape(F.replace(role, F.lit(LINE), F.lit("\n")))
        return F.transform(bodies, lambda t, i: F.struct(
            plain.alias("role"), t.alias("body"), (plain == LEARNED_ROLE).alias("learned"),
            F.when(i == 0, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(NEXT)).alias("before"),
            F.when(i == F.size(bodies) - 1, F.lit(END)).otherwise(F.lit("")).alias("after")))

    read = formatted.withColumn("_parts", F.flatten(F.transform(blocks, turns_of)))
    # The mask decides. A span is mostly the learned turn of its rank; cutting it out of the whole text,
    # which takes the text's length for each span, is for masks that are not.
    read = read.withColumn("_learned", F.filter(_placed("_parts"), lambda s: s["learned"]))
    loss = F.zip_with(F.slice("_learned", F.lit(1), F.size("loss_spans")), "loss_spans", lambda t, s: unescape(
        F.when((t["start"] == s["start"]) & (t["length"] == s["length"]), t["body"]).otherwise(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return read.select(
        "conv_id", F.transform("_parts", lambda p: F.struct(p["role"].alias("role"), unescape(p["body"]).alias("text"))).alias("turns"),
        F.array_join(loss, "").alias("loss_text"), "formatted")


def digest_conversations(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
