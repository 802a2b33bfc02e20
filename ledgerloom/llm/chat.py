"""Chat formatting with a grammar round trip, in Column expressions only.

Grammar: conversation = turn*; turn = ``<|im_start|>`` role newline text ``<|im_end|>`` newline. The
parser cuts at every end mark, takes the start mark off each piece, the role up to the first
newline, and undoes escapes in both. A turn whose rendering doesn't parse back to itself has its
control strings escaped; other turns keep their text as it is. Escaped text holds no control string,
so one round suffices; the parser is run over the result again and its turns are what is returned.

An escape is ``␛`` and a code: every control string and ``␛`` itself has one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "␛"
#: Control strings and their codes; those of other chat templates are kept out of texts too.
CODES = {"<|im_start|>": "a", "<|im_end|>": "b", "<|endoftext|>": "c", "[INST]": "d", "[/INST]": "e", "<<SYS>>": "f", "<</SYS>>": "g", "<s>": "h", "</s>": "i"}
SELF, NEWLINE = "z", "n"


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + SELF))
    text = reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(ESCAPE + c[1])), CODES.items(), text)
    return F.replace(text, F.lit("\n"), F.lit(ESCAPE + NEWLINE)) if role else text


def unescape(text: Column) -> Column:
    codes = [*CODES.items(), ("\n", NEWLINE)]
    text = reduce(lambda t, c: F.replace(t, F.lit(ESCAPE + c[1]), F.lit(c[0])), codes, text)
    return F.replace(text, F.lit(ESCAPE + SELF), F.lit(ESCAPE))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, rf"\Q{END}\E\n", -1)
    bare = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substring(x, len(START) + 1, 2**31 - 1))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.right(x, F.length(x) - F.length(role) - 1)).alias("text"))

    return F.transform(bare, turn)


def format_conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Returns (``conv_col``, formatted, turns) of every conversation.

    ``turns`` is parsed from ``formatted``. Turns go by ``turn_col``, then role and text, so
    ties and repeated rows have one order; a null turn comes first, null roles and texts are empty, a
    null conversation is one conversation. Other columns are ignored, an empty table gives no rows.
    One shuffle; a conversation is one string, so it must fit a task.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    raw = parse(render(F.col("role"), F.col("text")))
    same = (F.size(raw) == 1) & (F.get(raw, F.lit(0)) == F.struct("role", "text")) & ~controls(F.col("text")) & ~controls(F.col("role"))
    made = F.when(same, render(F.col("role"), F.col("text"))).otherwise(render(escape(F.col("role"), True), escape(F.col("text"))))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "made")))
    joined = rows.withColumn("made", made).groupBy("conv").agg(turns.alias("rows"))
    formatted = joined.select("conv", F.transform("rows", lambda x: F.struct(x["role"], x["text"])).alias("source"), F.array_join(F.transform("rows", lambda x: x["made"]), "").alias("formatted"))
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    bad = F.raise_error(F.lit("a conversation doesn't read back as it was"))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(bad)
    return read.select(F.col("conv").alias(conv_col), "formatted", checked.alias("turns"))


def controls(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in (*CODES, ESCAPE)))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the assistant's texts in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
