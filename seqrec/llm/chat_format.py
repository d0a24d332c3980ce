"""Chat formatting into budgeted windows (operator 2). DataFrame functions only.

Template: a turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.
Inside texts and roles a control string cannot occur: in every ``<``, backslashes, ``|`` one
backslash is added, which unescape() takes away again; in roles backslash and line feed are written
``\\s`` and ``\\n``.

Method: prefix sums of turn tokens, in the order of turns, choose turn-aligned spans. A turn belongs
to the cell of a fixed grid (half of what the budget leaves for new turns) in which its prefix sum
starts; a turn larger than a cell is a span by itself. So a span of several turns never exceeds the
budget, and each turn is new in exactly one window. A window repeats the conversation's system turn
(its first turn, if that is a system turn) and then, as far as a history budget reaches, the turns
just before the span; the loss mask covers the texts of the span's own assistant turns only, so
repeated targets are masked out.

Scale: spans come from window functions over a conversation's turn sizes, which spill; texts are
gathered by window, whose size the budget bounds (a single turn may be longer). History is bounded
by the number of turns looked back.

Defined results: null text and null role count as empty; turns are ordered by turn number, then role
and text, nulls first; repeated rows are separate turns; a null conv_id is a conversation of its own;
an empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of its repeated history, and how many turns are looked back for it.
BUDGET, HISTORY, LOOK_BACK = 2048, 256, 8


def tokens(text: Column) -> Column:
    """Words and other visible characters."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: (conv_id, window, n_repeated, n_new, formatted, loss_spans).

    loss_spans: array<struct<start, end>> in code points of ``formatted``, end exclusive.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")) + 4)
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = conv.rowsBetween(Window.unboundedPreceding, 0)
    cell = max(1, (budget - history) // 2)
    t = t.withColumn("no", F.row_number().over(conv)).withColumn("upto", F.sum("n").over(so_far))
    # a large turn ends the span before it and its own
    big = F.col("n") > cell
    t = t.withColumn("cuts", 2 * F.sum(big.cast("long")).over(so_far) - big.cast("long")).withColumn("grid", F.floor((F.col("upto") - F.col("n")) / cell))
    t = t.withColumn("new_span", F.coalesce((F.lag("cuts").over(conv) != F.col("cuts")) | (F.lag("grid").over(conv) != F.col("grid")), F.lit(True)))
    t = t.withColumn("window", F.sum(F.col("new_span").cast("long")).over(so_far) - 1)
    t = t.withColumn("system", F.when((F.first("role").over(so_far) == "system") & (F.col("no") > 1), F.struct(F.lit(0).alias("no"), F.first("role").over(so_far).alias("role"), F.first("text").over(so_far).alias("text"))))
    # the turns before a span's first turn, as far as the history budget reaches
    before = F.collect_list(F.struct("no", "role", "text", "n")).over(conv.rowsBetween(-LOOK_BACK, -1))
    t = t.withColumn("before", F.when(F.col("new_span"), before))
    turn = F.struct("no", "role", "text")
    w = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("new"), F.max("system").alias("system"), F.max_by("before", F.when(F.col("new_span"), F.lit(1))).alias("before"))
    reach = F.reverse("before")
    fits = F.filter(
        F.transform(reach, lambda x, i: F.struct(x["no"].alias("no"), x["role"].alias("role"), x["text"].alias("text"), F.aggregate(F.slice(reach, 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("sum"))),
        lambda x: (x["sum"] <= history) & ~((x["no"] == 1) & (x["role"] == "system")),
    )
    w = w.withColumn("past", F.reverse(F.transform(fits, lambda x: F.struct(x["no"].alias("no"), x["role"].alias("role"), x["text"].alias("text")))))
    w = w.withColumn("system", F.when(F.col("new")[0]["no"] > 1, F.col("system")))
    w = w.withColumn("repeated", F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<struct<no:int,role:string,text:string>>")), F.coalesce("past", F.array().cast("array<struct<no:int,role:string,text:string>>"))))
    w = w.select("conv_id", "window", F.size("repeated").alias("n_repeated"), F.size("new").alias("n_new"), F.concat("repeated", "new").alias("turns"))
    w = w.withColumn("parts", F.transform("turns", lambda x, i: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), ((i >= F.col("n_repeated")) & (x["role"] == "assistant")).alias("loss"))))
    ends = len(END) + 1
    placed = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + ends).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    formatted = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return w.select("conv_id", "window", "n_repeated", "n_new", formatted.alias("formatted"), placed.alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows alone."""
    segment = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("n_repeated") + 1, F.col("n_new"))
    turn = F.transform(segment, lambda s: F.substr(s, F.lit(len(START) + 1)))
    text = F.array_join(F.transform(turn, lambda s: F.concat(unescape_role(F.substring_index(s, "\n", 1)), F.lit("\n"), unescape(F.substr(s, F.instr(s, F.lit("\n")) + 1)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    parts = windows.select("conv_id", "window", F.col("n_new"), F.length("formatted").alias("chars"), text.alias("turns"), loss.alias("loss"))
    whole = parts.groupBy("conv_id").agg(F.sum("n_new").alias("n"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    turns, loss = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )
