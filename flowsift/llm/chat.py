"""Chat formatting with Spark expressions alone: turns to one marked text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, JOIN, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: consecutive turn numbers whose rows are sorted and merged together before a conversation is put together
BLOCK_TURNS = 64


def escaped(text: Column) -> Column:
    """No control string is left: each ``<`` ... ``|`` with backslashes or nothing between gets one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``: one marked text per conversation, and the spans learned from.

    Rows are collected as structs per conversation and block of turn numbers, sorted by turn, role
    and text (null turns first), and neighbours of one role become one message, its texts joined by
    a mark; blocks are then put together in order, again merging where roles meet. ``loss`` holds
    ``(start, end)`` in characters, end exclusive, one span per text of ``loss_role``; joints and
    marks lie between spans. Two-step collection keeps what is sorted at once small; a conversation
    is one row of output, so its text is in one task at the end.

    Null texts and roles are empty. Rows that are alike are turns of their own. A null conversation
    id is a conversation. No rows give no rows.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.floor(F.col(turn) / BLOCK_TURNS).alias("block"),
        F.struct(
            F.col(turn).alias("turn"),
            F.url_encode(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    message = "array<struct<role:string,texts:array<string>>>"

    def merge(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        same = (F.size(done) > 0) & (last["role"] == t["role"])
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    merged = F.aggregate(F.array_sort(F.collect_list("t")), F.array().cast(message), merge)
    blocks = rows.groupBy("conv_id", "block").agg(merged.alias("messages"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "messages"))).alias("blocks"))
    whole = whole.select("conv_id", F.flatten(F.transform("blocks", lambda b: b["messages"])).alias("m"))
    before = lambda i: F.get("m", i - 1)["role"]
    after = lambda i: F.get("m", i + 1)["role"]
    head = lambda m, i: F.when((i > 0) & before(i).eqNullSafe(m["role"]), F.lit(JOIN)).otherwise(F.concat(F.lit(OPEN), m["role"], F.lit("\n")))
    tail = lambda m, i: F.when(after(i).eqNullSafe(m["role"]), F.lit("")).otherwise(F.lit(CLOSE))
    parts = whole.select(
        "conv_id",
        F.transform("m", lambda m, i: F.struct(head(m, i).alias("head"), m["texts"].alias("texts"), tail(m, i).alias("tail"), (m["role"] == loss_role).alias("learned"))).alias("p"),
    )
    text_of = lambda p: F.concat(p["head"], F.array_join(p["texts"], JOIN), p["tail"])
    size = lambda p: F.length(text_of(p)).cast("long")
    span = "array<struct<start:bigint,end:bigint>>"

    def own_spans(p: Column, at: Column) -> Column:
        first = F.struct((at + F.length(p["head"])).alias("at"), F.array().cast(span).alias("s"))

        def add(done: Column, t: Column) -> Column:
            end = done["at"] + F.length(t)
            return F.struct((end + len(JOIN)).alias("at"), F.concat(done["s"], F.array(F.struct(done["at"].alias("start"), end.alias("end")))).alias("s"))

        return F.when(p["learned"], F.aggregate(p["texts"], first, add)["s"]).otherwise(F.array().cast(span))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("s"))

    def walk(done: Column, p: Column) -> Column:
        return F.struct((done["at"] + size(p)).alias("at"), F.concat(done["s"], own_spans(p, done["at"])).alias("s"))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("p", text_of), "").alias("formatted"),
        F.aggregate("p", start, walk)["s"].alias("loss"),
    )


def parsed_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns as they were, read from a formatted text."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda m: m != "")
    text = lambda m: F.substring(m, F.instr(m, "\n") + 1, F.length(m))
    role = lambda m: F.url_decode(F.substring(m, F.lit(len(OPEN) + 1), F.instr(m, "\n") - len(OPEN) - 1))
    turns = lambda m: F.transform(F.split(text(m), r"<\|im_sep\|>", -1), lambda t: F.struct(role(m).alias("role"), unescaped(t).alias("text")))
    return F.flatten(F.transform(messages, turns))


def report(chats: DataFrame) -> DataFrame:
    """Digests of the turns and of the learned texts, both read back from the formatted text."""
    read = chats.select("conv_id", "formatted", "loss", parsed_turns(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), lines.alias("l"), F.array_join(learned, "").alias("a"), "formatted")
    return read.select(
        "conv_id", "n_turns", F.sha2("l", 256).alias("turns_sha256"), F.length("a").cast("long").alias("loss_chars"),
        F.sha2("a", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
