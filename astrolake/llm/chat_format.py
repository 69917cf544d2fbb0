"""Chat formatting in budgeted, turn-aligned windows.

Turns of a conversation stand by turn number (ties by role, then text).  Prefix sums
of their tokens place each turn: with capacity C a turn that starts at token P belongs
to span floor(P / C), and a turn that reaches over the end of its span stands alone, so
no window's new turns exceed C unless a single turn does.  A window repeats the system
turn that opens the conversation, and up to ``history`` turns before it of together at
most ``history_tokens``; repeated turns are outside the loss mask, so every assistant
text is a target exactly once.

A turn is written <s>[ROLE]role[/ROLE]text</s>.  Control strings inside roles and texts
get a backslash after their first character, and backslashes are doubled, which
``unescape`` takes back.

Prefix sums are taken per chunk of turn numbers and then over the chunks of a
conversation, windows are groups of bounded size and numbered without their texts, and
only the turns that a window repeats are joined to it, by position, so one very long
conversation is spread over many tasks.

Defined cases: null text and null role are empty; a null turn number comes first;
repeated rows are turns of their own; a null conv_id is a conversation; without
rows there are no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TOKENS, LEAST = 512, 2, 128, 64
CHUNK = 4096
#: Strings with a meaning in the template or in common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
_AHEAD = r"(<|\[)(?=s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|<SYS>>|</SYS>>)"
_TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _AHEAD, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    """Budgeted tokens of a turn: words and signs, and four for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4


def placed(turns: DataFrame) -> DataFrame:
    """Turns with position ``p`` in their conversation, tokens ``n``, tokens before ``before``, and tokens ``system_n`` of the system turn that opens it (else null).

    Only counts of chunks go along a conversation; texts stay where their chunk is sorted."""
    rows = turns.withColumn("n", tokens(F.col("text")).cast("long")).withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    along = Window.partitionBy("key").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.min_by(F.when(F.col("role") == "system", F.col("n")), F.struct("turn", "role", "text"))
    chunks = rows.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"), opening.alias("o"))
    chunks = chunks.select("key", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.first("o").over(along).alias("system_n"))
    inside = Window.partitionBy("key", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("p", F.row_number().over(inside) - 1).withColumn("before", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return rows.join(chunks, ["key", "chunk"]).select("key", (F.col("p") + F.col("c0")).alias("p"), "role", "text", "n", (F.col("before") + F.col("t0")).alias("before"), "system_n")


def windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, first (position of its first new turn), n_repeated, formatted, loss (spans of code points)."""
    # a struct is equal to another with the same null, so that a null conv_id needs no join of its own kind
    turns = placed(conversations.select(F.struct(F.col(conv_id).alias("conv_id")).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    capacity = F.greatest(F.lit(budget - history_tokens) - F.coalesce("system_n", F.lit(0)), F.lit(LEAST))
    spans = turns.withColumn("c", capacity)
    spans = spans.withColumn("span", F.floor(F.col("before") / F.col("c"))).withColumn("over", F.floor((F.col("before") + F.col("n") - 1) / F.col("c")) > F.col("span"))
    new = spans.groupBy("key", "span", "over").agg(F.sort_array(F.collect_list(F.struct("p", "role", "text"))).alias("new"), F.min("p").alias("first"), F.min("before").alias("start"), F.first("system_n").isNotNull().alias("has"))
    # windows are numbered, and their history is chosen, by positions alone
    heads = new.select("key", "first", "start", "has", (F.row_number().over(Window.partitionBy("key").orderBy("first")) - 1).alias("window"))
    before = F.transform(F.array(*[F.lit(i) for i in range(1, history + 1)]).cast("array<bigint>"), lambda i: F.col("first") - i)
    before = F.filter(before, lambda p: p >= F.when(F.col("has"), 1).otherwise(0))
    opening = F.when(F.col("has") & (F.col("first") > 0), F.array(F.lit(0).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    asked = heads.select("key", "first", "start", "has", F.explode(F.concat(opening, before)).alias("p"))
    past = asked.join(turns.select("key", "p", "role", "text", "before"), ["key", "p"]).where((F.col("start") - F.col("before") <= history_tokens) | (F.col("has") & (F.col("p") == 0)))
    past = past.groupBy("key", "first").agg(F.sort_array(F.collect_list(F.struct("p", "role", "text"))).alias("past"))
    full = new.select("key", "first", "new").join(heads.select("key", "first", "window"), ["key", "first"]).join(past, ["key", "first"], "left")
    none = F.expr("cast(array() as array<struct<p:bigint,role:string,text:string>>)")
    repeated = F.coalesce("past", none)
    full = full.withColumn("n_repeated", F.size(repeated)).withColumn(
        "parts",
        F.transform(
            F.concat(repeated, F.col("new")),
            lambda t: F.struct(F.concat(F.lit("<s>[ROLE]"), escape(t["role"]), F.lit("[/ROLE]")).alias("head"), escape(t["text"]).alias("body"), ((t["p"] >= F.col("first")) & (t["role"] == "assistant")).alias("loss")),
        ),
    )
    zero = F.expr("struct(0L as at, cast(array() as array<struct<start:bigint,length:bigint>>) as spans)")

    def step(done, part):
        start = done["at"] + F.char_length(part["head"])
        length = F.char_length(part["body"]).cast("long")
        return F.struct((start + length + 4).alias("at"), F.when(part["loss"], F.concat(done["spans"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(done["spans"]).alias("spans"))

    return full.select(
        F.col("key.conv_id").alias("conv_id"),
        "window",
        "first",
        "n_repeated",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "").alias("formatted"),
        F.aggregate("parts", zero, step, lambda done: done["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows with their new turns (role, text) and target texts, parsed from ``formatted`` and ``loss`` alone."""
    roles = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    return formatted.withColumn("turns", F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0)))).withColumn(
        "targets", F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, read back from them."""
    read = read_back(formatted).select(
        "conv_id",
        "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("parts"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    said, target = F.array_join("parts.said", ""), F.array_join("parts.target", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length(target).cast("long").alias("loss_chars"), F.sha2(target.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows"
    )
