"""Chat transcripts to messages, and batches of messages bounded by characters, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markup of templates in messages: a break, and marks around text.
BREAK, MARKS = "[BR]", "BUIS"


def stamp_of(line: Column) -> Column:
    """The moment in brackets that a line begins with, as text; null for other lines."""
    text = F.substring(line, 2, 19)
    return F.when(F.startswith(line, F.lit("[")) & (F.substring(line, 21, 1) == "]") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), text)


def phone_of(label: Column) -> Column:
    """The phone in parentheses at the end of a label, without blanks; null where they hold anything else, or there are none."""
    text = F.trim(label)
    inner = F.translate(F.substring_index(F.substring_index(text, ")", 1), "(", -1), " \t", "")
    number = F.when(F.startswith(inner, F.lit("+")), F.substring(inner, 2, 99)).otherwise(inner)
    return F.when(F.endswith(text, F.lit(")")) & F.contains(text, F.lit("(")) & (number != "") & (F.translate(number, "0123456789", "") == ""), inner)


def without_markup(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit(BREAK), F.lit("\n")), F.lit(BREAK.lower()), F.lit("\n"))
    for mark in MARKS + MARKS.lower():
        for form in (f"[{mark}]", f"[/{mark}]"):
            out = F.replace(out, F.lit(form), F.lit(""))
    return F.trim(out)


def lines_of(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per line of a text: keys, n from 0, line, and stamped where the line begins a message."""
    out = rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return out.withColumn("stamped", stamp_of(F.col("line")).isNotNull())


def messages(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Transcripts to messages: keys, message from 1, sent_at, speaker, phone, text.

    A line with a time begins a message, lines without belong to the one before, and lines before the first are left out.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    numbered = lines_of(rows, text, keys).withColumn("message", F.sum(F.col("stamped").cast("int")).over(order)).where("message > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    whole = numbered.groupBy(*keys, "message").agg(body.alias("body"))
    first = F.split_part(F.col("body"), F.lit("\n"), F.lit(1))
    label = F.when(F.col("cut") > 0, F.expr("substring(head, 1, cut - 1)")).when(F.col("head").endswith(":"), F.expr("substring(head, 1, length(head) - 1)")).otherwise(F.col("head"))
    said = F.when(F.col("cut") > 0, F.expr("substring(head, cut + 2)")).otherwise("")
    rest = F.expr("substring(body, length(first) + 1)")
    out = whole.withColumn("first", first).withColumn("head", F.trim(F.expr("substring(first, 22)"))).withColumn("cut", F.instr("head", ": ")).withColumns({"label": label, "said": F.concat(said, rest)})
    phone = phone_of(F.col("label"))
    speaker = F.trim(F.when(phone.isNotNull(), F.expr("substring(label, 1, length(label) - length(substring_index(label, '(', -1)) - 1)")).otherwise(F.col("label")))
    return out.select(*keys, "message", stamp_of(F.col("first")).alias("sent_at"), speaker.alias("speaker"), phone.alias("phone"), without_markup(F.col("said")).alias("text"))


def with_roles(found: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with the role of the member whose name holds, or is held by, the speaker's; members (keys, name, role)."""
    both = F.lower("speaker").contains(F.lower("name")) | F.lower("name").contains(F.lower("speaker"))
    near = found.select(*keys, "speaker").distinct().join(members, keys).where(both & (F.length("name") > 0)).groupBy(*keys, "speaker").agg(F.min("role").alias("role"))
    return found.join(near, [*keys, "speaker"], "left")


def batches(found: DataFrame, keys: list[str], order: str, size: str, most: int) -> DataFrame:
    """Messages in order with batch, cut greedily so that a batch holds at most so many characters; a longer message is alone.

    The running state folds over one conversation's list of sizes, which is far smaller than its texts.
    """
    sizes = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("all"))
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,batch:bigint>>").alias("out"))

    def step(acc, x):
        over = (acc["used"] > 0) & (acc["used"] + x["s"] > most)
        batch = acc["batch"] + F.when(over, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(over, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), batch.alias("batch")))).alias("out"))

    dealt = sizes.select(*keys, F.explode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("x"))
    return dealt.select(*keys, F.col("x.o").alias(order), F.col("x.batch").alias("batch"))
