"""Chat formatting with a grammar round trip.

The template's grammar is deterministic: a text is a run of turns, and a turn is
the mark of a begin, a role up to the first new line, content, and the mark of an
end, with neither mark inside role or content.  Each turn is rendered as it is and
parsed again.  A turn that does not come back identical conflicts with the grammar:
it alone is escaped one level further, until it does.  The parser takes one level
off, so a turn that needs none stays as it was written.  The parsed whole text of a
conversation is compared to its turns once more.  Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.session import materialize

# The control strings of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Levels of escapes that are tried.  One is always enough: it leaves no control string, and the parser takes it off.
LEVELS = 1


def escape(text: Column) -> Column:
    """One more backslash in every ``<|``, ``<\\|``, ...: no control string is left, and unescape undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<\\")), F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    # double backslashes are taken from the left, so what is between them has only marks of a new line
    taken = unescape(F.array_join(F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))
    return F.when(F.contains(role, F.lit("\\")), taken).otherwise(role)


def render(role: Column, text: Column) -> Column:
    """A turn of an escaped (or unconflicting) role and text."""
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END))


def segments(formatted: Column) -> Column:
    """What stands behind each mark of a begin."""
    cut = F.split(formatted, r"<\|im_start\|>")
    return F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))


def _content(segment: Column) -> Column:
    return F.substring(segment, F.instr(segment, "\n") + 1, F.length(segment))


def _derived(segment: Column) -> Column:
    """Whether a segment is role, new line, content and the one mark of an end."""
    body = _content(segment)
    return (F.instr(segment, "\n") > 0) & (F.instr(segment, END[:-1]) > F.instr(segment, "\n")) & (F.instr(body, END[:-1]) == F.length(body) - len(END) + 1) & F.endswith(body, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns (role, text), escapes taken off; null where the text is not of the grammar."""
    turn = lambda s: F.struct(_role_in(F.substring_index(s, "\n", 1)).alias("role"), unescape(F.substring(_content(s), F.lit(1), F.length(_content(s)) - len(END))).alias("text"))
    whole = (formatted == "") | (F.startswith(formatted, F.lit(BEGIN)) & F.forall(segments(formatted), _derived))
    return F.when(whole, F.transform(segments(formatted), turn))


def _returns(piece: Column, role: Column, text: Column) -> Column:
    return F.coalesce(parse(piece) == F.array(F.struct(role.alias("role"), text.alias("text"))), F.lit(False))


def rendered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, level, piece, head): each turn's piece of the text, and how many of its characters stand before the content."""
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = own.withColumn("r", F.col("role")).withColumn("t", F.col("text")).withColumn("level", F.lit(0))
    for _ in range(LEVELS):
        # every control string and every escape has one of these characters
        may = F.contains("t", F.lit("<")) | F.contains("r", F.lit("<")) | F.contains("r", F.lit("\\")) | F.contains("r", F.lit("\n"))
        conflict = F.when(may, ~_returns(render(F.col("r"), F.col("t")), F.col("role"), F.col("text"))).otherwise(F.lit(False))
        out = out.withColumn("conflict", conflict)
        deeper = lambda c, e: F.when(F.col("conflict"), e(F.col(c))).otherwise(F.col(c))
        out = out.select("conv_id", "turn", "role", "text", deeper("r", _role_out).alias("r"), deeper("t", escape).alias("t"), (F.col("level") + F.col("conflict").cast("int")).alias("level"))
    return out.select("conv_id", "turn", "role", "text", "level", render(F.col("r"), F.col("t")).alias("piece"), (F.length("r") + len(BEGIN) + 1).alias("head"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, level, formatted, mask): one text for each conversation of ``rows`` (conv_id, turn, role, text).

    ``mask`` holds a span for each assistant turn, in order: its number, where the
    turn begins in ``formatted``, and where its content begins and ends (characters
    from 0, end exclusive); these contents are what a loss is taken over.  ``level``
    is 0 where no turn was escaped, else 1.

    A null role or text is empty, equal turns are ordered by role and text,
    repeated rows are repeated turns, a null conv_id is a conversation of its own,
    an empty table gives no row, other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rendered_turns(rows).withColumn("number", F.row_number().over(order) - 1)
    placed = placed.withColumn("begin", F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    span = F.struct(F.col("number").alias("turn"), F.col("begin").alias("turn_begin"), (F.col("begin") + F.col("head")).alias("begin"), (F.col("begin") + F.length("piece") - len(END)).alias("end"))
    turn = F.struct("number", "role", "text", "piece", F.when(F.col("role") == "assistant", span).alias("span"))
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("held"), F.max("level").alias("level"))
    turns = F.transform("held", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    mask = F.array_compact(F.transform("held", lambda t: t["span"]))
    whole = held.select("conv_id", "level", F.array_join(F.transform("held", lambda t: t["piece"]), "").alias("formatted"), turns.alias("turns"), mask.alias("mask"))
    same = F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    sure = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
    return whole.select("conv_id", "level", sure.alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from formatted conversations.

    ``loss`` holds the texts under the mask, escapes taken off, nothing between.  A
    span is read within its turn's segment, which is found by its number.  ``turns``
    and ``loss`` are null where the text is not of the grammar.
    """
    cut = formatted.select("conv_id", "formatted", "mask", segments(F.col("formatted")).alias("segments"), parse(F.col("formatted")).alias("turns"))
    under = lambda m: F.substring(F.get("segments", m["turn"]), (m["begin"] - m["turn_begin"] - len(BEGIN) + 1).cast("int"), (m["end"] - m["begin"]).cast("int"))
    loss = F.when(F.col("turns").isNotNull(), F.array_join(F.transform("mask", lambda m: unescape(under(m))), ""))
    return cut.select("conv_id", "turns", loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_files(rows: DataFrame) -> DataFrame:
    """Formats, writes the formatted conversations, and reads them back."""
    return read_back(materialize(format_conversations(rows), "formatted"))


def digests(back: DataFrame) -> DataFrame:
    """Digest columns of the contract, from what was read back."""
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
