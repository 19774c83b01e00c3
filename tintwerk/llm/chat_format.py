"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged into one
block, and the blocks are aggregated into one string. Every text is escaped first, so that no control string
of the template can come from a text, and the formatted string can be read back turn by turn.

Template: ``<s>[INST] `` user texts `` [/INST]``; blank, assistant texts, ``</s>``; ``<<SYS:role>>`` texts ``<</SYS>>``
for every other role. Texts merged into one block are parted by ``<|next|>``. The loss mask covers the assistant texts.

Defined cases: a null text or role is empty; a null turn sorts first, equal turns by role and text, and repeated rows
all stay; rows with a null conv_id form one conversation; extra columns are ignored; an empty table gives no row.
One conversation is one training example and one row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS:", ">>", "<</SYS>>", "<|next|>"]
_CONTROL = r"(<|\[|>)(?=s>|/s>|INST\]|/INST\]|<SYS:|</SYS>>|>|\|next\|>)"


def escaped(text: Column) -> Column:
    r"""A backslash becomes two, and ``\e`` parts the first character of a control string from the rest."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\e")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:e|(\\))", "$1")


def escaped_role(role: Column) -> Column:
    r"""As ``escaped``, and ``\e`` behind every ``>``, so that a role can't run into the ``>>`` behind it."""
    return F.replace(escaped(role), F.lit(">"), F.lit(">\\e"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` of rows ``conv_id, turn, role, text``."""
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    turn = lambda i: F.get("turns", i)["role"]

    def opened(role: Column) -> Column:
        return F.when(role == "user", "<s>[INST] ").when(role == "assistant", " ").otherwise(F.concat(F.lit("<<SYS:"), escaped_role(role), F.lit(">>")))

    def closed(role: Column) -> Column:
        return F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").otherwise("<</SYS>>")

    def part(t: Column, i: Column) -> Column:
        """A turn opens a block unless the turn before has its role, and closes it unless the next one has: linear in the turns."""
        joins, goes_on = turn(i - 1).eqNullSafe(t["role"]), turn(i + 1).eqNullSafe(t["role"])
        return F.concat(F.when(joins, "<|next|>").otherwise(opened(t["role"])), escaped(t["text"]), F.when(goes_on, "").otherwise(closed(t["role"])))

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(sorted_turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", part), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns that a formatted string holds."""
    blocks = F.filter(F.split(formatted, r"(?<= \[/INST\]|</s>|<</SYS>>)"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.when(F.startswith(b, F.lit("<s>[INST] ")), "user").when(F.startswith(b, F.lit("<<SYS:")), unescaped(F.substring_index(F.substring(b, 7, 1 << 30), ">>", 1))).otherwise("assistant")
        body = (
            F.when(F.startswith(b, F.lit("<s>[INST] ")), F.substring(b, F.lit(11), F.length(b) - 18))
            .when(F.startswith(b, F.lit("<<SYS:")), F.substring(b, F.instr(b, ">>") + 2, F.length(b) - F.instr(b, ">>") - 9))
            .otherwise(F.substring(b, F.lit(2), F.length(b) - 5))
        )
        return F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def summarize(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what each formatted conversation holds, read back from it."""
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    shown = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("back", read_back(F.col("formatted"))).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
