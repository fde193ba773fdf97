r"""Chat formatting in budgeted windows, with DataFrame functions only.

Each conversation is written as one or more windows. Prefix sums of its turns' tokens choose turn-aligned
spans of new turns; a window starts with the conversation's system turn, repeats the last turns before its
span as far as the history allowance goes, and trains on its new assistant turns only, so that each of these
is a target once.

A turn is `### Role: text</turn>`; inside a text `#`, `<` and the backslash are written `\h`, `\l` and `\b`, so no text
can hold a mark, and unescaped() gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escaped(text: Column, colon: bool = False) -> Column:
    for plain, coded in ESCAPES[: 4 if colon else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    for plain, coded in ESCAPES[::-1]:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Words and single marks of a text, as a tokenizer-free measure of its length."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def _title(role: Column) -> Column:
    """Role as written: a plain word with its first letter in upper case, any other escaped behind `=`."""
    return F.when(role.rlike("^[a-z]+$"), F.initcap(role)).otherwise(F.concat(F.lit("="), escaped(role, colon=True)))


def _role(title: Column) -> Column:
    return F.when(title.startswith("="), unescaped(F.substring(title, 2, 1 << 30))).otherwise(F.lower(title))


def format_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 192, history_turns: int = 2) -> DataFrame:
    """One row for each window: conv_id, window, text, n_tokens, turns (array of turn, role, start, length, is_new, is_target).

    turns: conv_id, turn, role, text; other columns are not looked at. start and length (code points) say where
    in the window's text the turn's escaped text stands. A null text or role counts as empty; turns of one
    conversation are ordered by turn, then role, then text, so repeated turn numbers keep all their rows.
    A window's new turns end inside one block of half of what the budget leaves beside system turn and history,
    so a window stays within the budget unless one turn alone is longer than such a block: turns are never cut.
    A conversation's system turn is its first turn, if that has the role system. Rows without conv_id are one
    conversation. An empty table gives an empty table.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    base = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns({"n": tokens(F.col("text")) + 4})
    base = base.withColumns({"pos": F.row_number().over(order), "total": F.sum("n").over(upto)})
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    base = base.withColumns({"system": system, "sys_n": F.first(F.when(system, F.col("n")).otherwise(0)).over(upto)})
    half = F.greatest(F.floor((F.lit(budget - history_tokens) - F.col("sys_n")) / 2), F.lit(64))
    place = F.floor((F.col("total") - F.col("sys_n") - 1) / half)
    base = base.withColumn("block", F.when(F.col("system"), F.lit(None)).otherwise(F.greatest(place, F.lit(0))).cast("long"))
    base = base.withColumn("piece", F.concat(F.lit("### "), _title(F.col("role")), F.lit(": "), escaped(F.col("text")), F.lit(END)))
    lead = F.length(_title(F.col("role"))) + 6
    base = base.withColumns({"head": lead, "size": F.length("piece")})

    # Windows of which a turn is part: its own, and as history those whose first turn comes soon behind it.
    later = [F.struct(F.lead("block", j).over(order).alias("block"), (F.lead("total", j - 1).over(order) if j > 1 else F.col("total")).alias("upto")) for j in range(1, history_turns + 1)]
    base = base.withColumn("later", F.array(*later))
    repeats = F.filter("later", lambda x: (x["block"] > F.col("block")) & (x["upto"] - F.col("total") + F.col("n") <= history_tokens))
    seen = F.array_distinct(F.transform(repeats, lambda x: x["block"]))
    # In a window behind the next one, a turn is history only if the turns up to that window's first are too.
    place = F.concat(F.array(F.struct(F.col("block").alias("window"), F.lit(True).alias("is_new"))), F.transform(seen, lambda b: F.struct(b.alias("window"), F.lit(False).alias("is_new"))))
    parts = base.where("not system").withColumn("in", F.explode(place)).select("*", "in.window", "in.is_new").drop("in", "later", "block", "total")
    # The system turn goes into each window of its conversation.
    heads = base.where("system").drop("later", "block", "total")
    whole = parts.groupBy(F.col("conv_id").alias("cw")).agg(F.max("window").alias("last"))
    heads = heads.join(whole, F.col("conv_id").eqNullSafe(F.col("cw")), "left").drop("cw")
    used = parts.select(F.col("conv_id").alias("cw"), "window").distinct()
    alone = heads.where("last is null").withColumn("window", F.lit(0).cast("long"))
    ahead = heads.where("last is not null").join(used, F.col("conv_id").eqNullSafe(F.col("cw"))).drop("cw")
    first = F.min("window").over(Window.partitionBy("conv_id"))
    ahead = ahead.withColumn("is_new", F.col("window") == first)
    columns = ["conv_id", "window", "pos", "turn", "role", "head", "size", "n", "piece", "is_new"]
    rows = parts.select(columns).unionByName(ahead.select(columns)).unionByName(alone.withColumn("is_new", F.lit(True)).select(columns))

    cells = F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "head", "size", "n", "piece", "is_new")))
    made = rows.groupBy("conv_id", "window").agg(cells.alias("cells"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn:bigint,role:string,start:int,length:int,is_new:boolean,is_target:boolean>>").alias("turns"))

    def step(s: Column, c: Column) -> Column:
        one = F.struct(
            c["turn"].cast("long").alias("turn"), c["role"].alias("role"), (s["at"] + c["head"]).alias("start"), (c["size"] - c["head"] - len(END)).alias("length"),
            c["is_new"].alias("is_new"), (c["is_new"] & (c["role"] == "assistant")).alias("is_target"),
        )
        return F.struct((s["at"] + c["size"]).alias("at"), F.concat(s["turns"], F.array(one)).alias("turns"))

    return made.select(
        "conv_id",
        "window",
        F.array_join(F.transform("cells", lambda c: c["piece"]), "").alias("text"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n_tokens"),
        F.aggregate("cells", start, step)["turns"].alias("turns"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, roles and texts of each conversation's turns in order, targets (the text under the loss mask), formatted_chars.

    Turns are parsed from the windows' text by its marks, not taken from any other column; of these, only the
    flags say which parsed turns are new and which are targets.
    """
    marked = F.split("text", END)
    bare = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda t: F.substring(t, 5, 1 << 30))
    title = lambda t: F.substring_index(t, ": ", 1)
    said = F.transform(bare, lambda t: F.struct(_role(title(t)).alias("role"), unescaped(F.substring(t, F.length(title(t)) + 3, F.length(t))).alias("text")))
    under = F.transform(F.filter("turns", lambda t: t["is_target"]), lambda t: unescaped(F.substring(F.col("text"), t["start"] + 1, t["length"])))
    parsed = windows.select(
        "conv_id",
        "window",
        F.filter(F.arrays_zip(said.alias("said"), F.col("turns").alias("flags")), lambda x: x["flags"]["is_new"]).alias("new"),
        F.array_join(under, "").alias("targets"),
        F.length("text").cast("long").alias("chars"),
    )
    rows = F.array_sort(F.collect_list(F.struct("window", "new", "targets")))
    whole = parsed.groupBy("conv_id").agg(rows.alias("rows"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("rows", lambda r: F.transform(r["new"], lambda x: x["said"])))
    return whole.select(
        "conv_id",
        turns.alias("said"),
        F.array_join(F.transform("rows", lambda r: r["targets"]), "").alias("targets"),
        "formatted_chars",
    )
