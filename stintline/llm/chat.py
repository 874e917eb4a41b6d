"""Chat formatting with Spark expressions only: turns to one training string with a loss mask, and back.

Template: `<|im_start|>role`, a newline, the text, `<|im_end|>`, a newline, for every run of adjacent turns of one role;
`<|im_next|>` parts the turns within a run. Texts cannot forge marks: a backslash is doubled and `<|` becomes `<\\|`, so a
formatted text never holds `<|`; reading back undoes both. A newline in a role is `<|im_line|>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|im_line|>"
SLASH = "\\"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SLASH), F.lit(SLASH * 2)), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit(SLASH * 2), F.lit(SLASH))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
              train_on: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of every conversation; loss: structs of start (from 1) and length of the trained texts.

    Turns go by turn number, nulls first, then role and text, so ties and repeated rows have one order and all are kept. A
    null role or text reads as empty. A null conversation id is a conversation of its own. An empty table gives no rows; other
    columns are not read. The state of a task is one conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        text = F.array(escaped(t["text"]))
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], text).alias("texts"))
        alone = F.struct(t["role"].alias("role"), text.alias("texts"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(alone)))

    runs = sorted_turns.select("conv_id", F.aggregate("turns", empty, step).alias("runs"))

    def head(r: Column) -> Column:
        return F.concat(F.lit(START), F.replace(escaped(r["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))

    parts = runs.select("conv_id", F.transform("runs", lambda r: F.struct(
        r["role"].alias("role"), head(r).alias("head"), r["texts"].alias("texts"))).alias("parts"))
    whole = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], F.array_join(p["texts"], NEXT), F.lit(END + "\n"))))

    def mask(done: Column, p: Column) -> Column:
        begin = done["at"] + F.length(p["head"])
        spans = F.aggregate(p["texts"], F.struct(begin.alias("at"), done["spans"].alias("spans")), lambda d, t: F.struct(
            (d["at"] + F.length(t) + len(NEXT)).alias("at"),
            F.when(p["role"] == train_on, F.concat(d["spans"], F.array(F.struct(d["at"].alias("start"), F.length(t).alias("length"))))).otherwise(d["spans"]).alias("spans")))
        return F.struct((spans["at"] - len(NEXT) + len(END) + 1).alias("at"), spans["spans"].alias("spans"))

    begin = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return parts.select("conv_id", whole.alias("formatted"), F.aggregate("parts", begin, mask)["spans"].alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) from `formatted` alone: role and text of every turn, and the texts under the mask."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.lit(1), F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)

    def turns(block: Column) -> Column:
        body = F.substr(block, F.instr(block, "\n") + 1)
        role = unescaped(F.replace(F.substr(block, F.lit(len(START) + 1), F.instr(block, "\n") - len(START) - 1), F.lit(LINE), F.lit("\n")))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    texts = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"], s["length"])))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.concat_ws("", texts).alias("loss_text"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
