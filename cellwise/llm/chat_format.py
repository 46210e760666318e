r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Template of a turn: ``### role: text </turn>\n``. In texts and roles the backslash, ``#`` and ``<`` (and the colon of
a role) are written as a backslash and a letter, so that no marker can occur inside them and reading back is exact.
Each assistant turn makes an example: the conversation up to and with that turn, of which only the reply's text is trained.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, ROLE_END, TURN_END = "### ", ": ", " </turn>\n"
#: Character and its letter; the backslash is first when written, last when read.
TEXT_ESCAPES = (("\\", "b"), ("#", "h"), ("<", "l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "c"))


def escape(text: Column, escapes: tuple = TEXT_ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit("\\" + e[1])), escapes, text)


def unescape(text: Column, escapes: tuple = TEXT_ESCAPES) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit("\\" + e[1]), F.lit(e[0])), reversed(escapes), text)


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example_no, input, loss_start,
    loss_chars (code points of input), and is_last (the example holds the whole conversation).

    Turns are ordered by turn, then role, then text; null texts and roles are empty; rows of null conv_id are one
    conversation; repeated rows are turns of their own; an empty table gives no rows. Where the last turn is not
    the assistant's, a last example without trained text (loss_chars 0) carries the remaining turns.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = turns.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            escape(F.col("text")).alias("body"),
            F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    each = whole.select("conv_id", "parts", F.posexplode("parts").alias("at", "part"))
    kept = each.where((F.col("part.role") == "assistant") | (F.col("at") == F.size("parts") - 1))
    rendered = F.transform(F.slice("parts", F.lit(1), F.col("at") + 1), lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END)))
    made = kept.select("conv_id", F.col("at").alias("example_no"), F.array_join(rendered, "").alias("input"), "part", "parts")
    trained = F.when(F.col("part.role") == "assistant", F.length("part.body")).otherwise(0)
    return made.select("conv_id", "example_no", "input", (F.length("input") - len(TURN_END) - trained).alias("loss_start"), trained.alias("loss_chars"), (F.col("example_no") == F.size("parts") - 1).alias("is_last"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of structs of role and text."""
    split = F.split(text, TURN_END, -1)
    turns = F.slice(split, F.lit(1), F.size(split) - 1)

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), ROLE_END, 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(x, F.length(role) + len(HEAD) + len(ROLE_END) + 1)).alias("text"))

    return F.transform(turns, turn)


def trained_text(text: Column, start: Column, chars: Column) -> Column:
    return unescape(F.substr(text, start + 1, chars))


def summarise(examples: DataFrame) -> DataFrame:
    """Per conversation, all read back from the examples: turns of the longest one, trained texts of all in order."""
    turns = read_turns(F.col("input"))
    script = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    marked = examples.select(
        "conv_id",
        "example_no",
        F.length("input").alias("chars"),
        trained_text(F.col("input"), F.col("loss_start"), F.col("loss_chars")).alias("trained"),
        F.when(F.col("is_last"), F.col("input")).alias("input"),
    )
    read = marked.select("conv_id", "example_no", "chars", "trained", F.size(turns).alias("n"), F.sha2(script, 256).alias("sha"))
    trained = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "trained"))), lambda x: x["trained"]), "")
    out = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        trained.alias("trained"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def awkward_conversation(like: DataFrame) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn whose text is full of control strings."""
    rows = like.sparkSession.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    kinds = dict(like.dtypes)
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("conv_id", "turn", "role", "text")])
