"""Chat formatting: quoted passages are linked to the messages they come from, and dropped from the replies.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import back, cut, numbered

#: The marks before a quoted line, one `>` a level.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: The line that mail programs put before a quote.
ATTRIBUTION = r"^On .{1,200} wrote:[ \t]*$"


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def unquoted(text: Column) -> Column:
    """The text without quoted and attribution lines and without blank lines at its ends."""
    own = F.filter(lines(text), lambda x: ~x.rlike(r"^[ \t]*>") & ~x.rlike(ATTRIBUTION))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Runs of lines of one quote level: `key`, run, level, texts of the lines. A message's lines are counted within it."""
    quoting = messages.where(F.col(text).rlike(r"(?m)^[ \t]*>")).select(*key, F.posexplode(lines(F.col(text))).alias("_i", "_line")).distinct()
    mark = F.regexp_extract("_line", MARKS, 0)
    quoted = quoting.select(*key, "_i", F.char_length(F.regexp_replace(mark, r"[^>]", "")).alias("_level"), F.regexp_replace("_line", MARKS, "").alias("_line"))
    # The number of a line less its rank in its level is the same all along a run.
    rank = F.row_number().over(Window.partitionBy(*key, "_level").orderBy("_i"))
    runs = quoted.where("_level > 0").withColumn("_run", F.col("_i") - rank)
    return runs.groupBy(*key, "_level", "_run").agg(F.array_sort(F.collect_list(F.struct("_i", "_line"))).alias("_lines")).select(*key, "_run", F.col("_level"), F.col("_lines._line").alias("_texts"))


def link(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """`messages` with clean_text, n_quotes, n_linked, parent_turn, thread_root and depth, by conversation, thread and turn.

    A quoted passage is linked to the first message of its conversation, before the quoting one, whose own text has it
    as a whole, as a paragraph or as a line; failing that, to the first that has one of its lines. A message replies to
    the latest message linked at its lowest linked quote level. `thread_root` is the first message up the replies (a
    message without links is its own), `depth` the number of replies between.

    Null texts give null clean_text and no quotes; a null conversation or turn has no links. Repeated rows each come
    out. Empty texts give empty clean_text and no quotes; texts may be of any length. Blank passages link to nothing. An
    empty table gives an empty one. Columns named like an output are replaced; others stay, whatever their names.
    """
    own = ["clean_text", "n_quotes", "n_linked", "parent_turn", "thread_root", "depth"]
    messages, names = numbered(messages.drop(*own))
    conversation, turn, text = names[conversation], names[turn], names[text]
    messages = messages.withColumns({"clean_text": unquoted(F.col(text)), "_m": F.xxhash64(conversation, turn, text)})
    key = ["_conv", "_turn", "_m"]
    named = messages.select(F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"), "_m", F.col(text).alias("_text"), F.col("clean_text").alias("_clean"))
    quotes = passages(named, key, "_text")
    digest = lambda c: F.md5(normal(c).cast("binary"))
    parts = F.array_union(F.array(F.struct(F.lit(0).alias("by"), digest(F.array_join("_texts", "\n")).alias("h"))), F.transform("_texts", lambda x: F.struct(F.lit(1).alias("by"), digest(x).alias("h"))))
    blank = F.md5(F.lit("").cast("binary"))
    asked = quotes.select(*key, "_run", "_level", F.explode(parts).alias("p")).select(*key, "_run", "_level", F.col("p.by").alias("_by"), F.col("p.h").alias("_h")).where(F.col("_h") != blank)
    pieces = F.array_union(F.array(F.col("_clean")), F.array_union(F.split("_clean", r"\n\s*\n"), lines(F.col("_clean"))))
    said = named.select("_conv", "_turn", F.explode(F.transform(pieces, digest)).alias("_h")).where(F.col("_h") != blank)
    first = said.groupBy("_conv", "_h").agg(F.min("_turn").alias("_origin"))
    # Only joins whose two sides are shuffled for them can split a hot key, so the first uses get a key of their own.
    first = first.select(F.xxhash64("_conv", "_h").alias("_k"), F.col("_conv").alias("_c"), F.col("_h").alias("_g"), "_origin")
    met = asked.join(first, [F.xxhash64("_conv", "_h") == F.col("_k"), F.col("_conv") == F.col("_c"), F.col("_h") == F.col("_g")]).where("_origin < _turn")
    linked = met.groupBy(*key, "_run", "_level").agg(F.min(F.struct("_by", "_origin"))["_origin"].alias("_origin"))
    parents = cut(linked.groupBy(*key).agg(F.count("*").alias("n_linked"), F.min(F.struct("_level", -F.col("_origin")))["col2"].alias("_up")).withColumn("parent_turn", -F.col("_up")).drop("_up"))
    counts = quotes.groupBy("_m").agg(F.count("*").alias("n_quotes")).withColumnRenamed("_m", "_q")
    roots = _roots(parents.groupBy("_conv", "_turn").agg(F.min("parent_turn").alias("_up")))
    found = parents.join(roots, ["_conv", "_turn"]).select(F.col("_m").alias("_p"), "n_linked", "parent_turn", "_root", "_depth")
    out = messages.join(counts, F.col("_m") == F.col("_q"), "left").join(found, F.col("_m") == F.col("_p"), "left")
    out = out.withColumns({"n_quotes": F.coalesce("n_quotes", F.lit(0)).cast("long"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread_root": F.coalesce("_root", F.col(turn)), "depth": F.coalesce("_depth", F.lit(0)).cast("long")})
    return back(out.orderBy(conversation, "thread_root", turn), names, *own)


def _roots(up: DataFrame) -> DataFrame:
    """(_conv, _turn, _root, _depth) by doubling the steps up, log2 of the longest chain of replies times."""
    now = cut(up.select("_conv", "_turn", F.col("_up").alias("_root"), F.lit(1).alias("_depth")))
    while True:
        above = now.select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), F.col("_root").alias("_r"), F.col("_depth").alias("_d"))
        moved = now.join(above, [F.col("_conv") == F.col("_c"), F.col("_root") == F.col("_t")])
        if moved.isEmpty():
            return now
        now = cut(now.join(above, [F.col("_conv") == F.col("_c"), F.col("_root") == F.col("_t")], "left").select("_conv", "_turn", F.coalesce("_r", "_root").alias("_root"), (F.col("_depth") + F.coalesce("_d", F.lit(0))).alias("_depth")))
