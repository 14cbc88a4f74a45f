"""Chat formatting into token-budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
#: A token of the budget, and what the marks of a turn count.
TOKEN, OVERHEAD = r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]", 4


def escape(text: Column) -> Column:
    """No control string can occur in the result: backslashes are doubled, then ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a single backslash after ``<`` can only come from it."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; a line end, which closes the role, becomes ``<\\n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order with their tokens and the prefix sum of the tokens before them."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    counted = named.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + OVERHEAD).cast("long"))
    placed = counted.withColumn("pos", F.row_number().over(order)).withColumn(
        "before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    )
    return placed.withColumn("kept", (F.col("pos") == 1) & (F.col("role") == "system"))


def _windowed(turns: DataFrame, step: int, history: int) -> DataFrame:
    """One row per turn and window it stands in; ``fresh`` where it stands for the first time."""
    own = turns.withColumn("w", F.floor(F.col("before") / step).cast("long"))
    parts = ["conv", "w", "pos", "fresh", "role", "text"]
    fresh = own.withColumn("fresh", F.lit(1)).select(parts)
    starts = own.groupBy("conv", "w").agg(F.min("before").alias("start"))
    later = F.floor((F.col("before") + history) / step).cast("long")
    reach = own.where(~F.col("kept") & (later > F.col("w"))).withColumn("v", F.explode(F.sequence(F.col("w") + 1, later)))
    starts_of = starts.select(F.col("conv").alias("c"), F.col("w").alias("sw"), "start")
    repeated = reach.join(starts_of, F.col("conv").eqNullSafe(F.col("c")) & (F.col("v") == F.col("sw")))
    repeated = repeated.where(F.col("start") <= F.col("before") + history)
    repeated = repeated.select("conv", F.col("v").alias("w"), "pos", F.lit(0).alias("fresh"), "role", "text")
    systems = own.where("kept").select(F.col("conv").alias("c"), "pos", F.lit(0).alias("fresh"), "role", "text")
    retained = starts.where("w > 0").join(systems, F.col("conv").eqNullSafe(F.col("c"))).select(parts)
    return fresh.unionByName(repeated).unionByName(retained)


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = 1024, history: int = 256, target: str = "assistant",
) -> DataFrame:
    """Windows of conversations: ``conv``, ``window``, ``n_repeated``, ``formatted`` and ``loss``.

    Turns are never cut. Prefix sums of their tokens choose the window in which a turn is new: windows
    begin at multiples of half of what ``budget`` leaves beside ``history``, so the new turns of a
    window stay within it unless a single turn is longer than that half. Every later window repeats
    the system turn (a first turn of that role) and the whole turns of the last ``history`` tokens.
    ``n_repeated`` turns at its head are repeated. ``loss`` holds character spans (start, end) of the
    texts of ``target`` turns that are new; repeated targets are masked, so every target counts once.

    Turns are ordered by turn (null first), role, text; repeated rows are turns of their own. Null text
    and role count as empty; a null conversation is one of its own; an empty table gives an empty
    result; other columns are ignored.
    """
    step = max((budget - history) // 2, 1)
    pieces = _windowed(_turns(rows, conv, turn, role, text), step, history)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct(
        "pos", "fresh", F.concat(head, body, F.lit(END)).alias("form"), F.char_length(head).alias("head"),
        F.char_length(body).alias("body"), ((F.col("role") == target) & (F.col("fresh") == 1)).alias("learn"),
    )
    gathered = pieces.groupBy("conv", "w").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    size = F.lit(len(END))
    ends = F.aggregate(
        "turns", F.array(F.lit(0)),
        lambda sums, t: F.concat(sums, F.array(F.element_at(sums, -1) + t["head"] + t["body"] + size)),
    )
    spans = F.filter(
        F.transform("turns", lambda t, i: F.struct(
            (F.get("ends", i) + t["head"]).alias("start"), (F.get("ends", i) + t["head"] + t["body"]).alias("end"),
            t["learn"].alias("learn"))),
        lambda s: s["learn"],
    )
    return gathered.withColumn("ends", ends).select(
        "conv", F.col("w").alias("window"),
        F.size(F.filter("turns", lambda t: t["fresh"] == 0)).alias("n_repeated"),
        F.array_join(F.transform("turns", lambda t: t["form"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Windows with ``turns`` (role, text of the new turns) and ``targets`` (texts under the loss mask)."""
    forms = F.split("formatted", r"<\|im_end\|>\n")
    forms = F.slice(forms, F.col("n_repeated") + 1, F.size(forms) - 1 - F.col("n_repeated"))
    mark = F.lit(len(START) + 1)

    def turn(form: Column) -> Column:
        inner = F.substring(form, mark, F.char_length(form))
        name = F.substring_index(inner, "\n", 1)
        said = F.substring(inner, F.char_length(name) + 2, F.char_length(inner))
        return F.struct(unescape_role(name).alias("role"), unescape(said).alias("text"))

    targets = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumns({"turns": F.transform(forms, turn), "targets": targets})


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation with what can be read back from its windows."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(windows).select(
        "conv", "window", F.size("turns").alias("n"), told.alias("told"), F.array_join("targets", "").alias("learned"),
        F.char_length("formatted").alias("chars"),
    )
    both = F.sort_array(F.collect_list(F.struct("window", "told", "learned")))
    whole = read.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), both.alias("parts"))
    joined = {c: F.array_join(F.col(f"parts.{c}"), "") for c in ("told", "learned")}
    return whole.withColumns(joined).select(
        "conv", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
