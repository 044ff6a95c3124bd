"""Chat formatting with Spark expressions only.

Template: ``<turn:ROLE>text</turn>\n`` per message. Adjacent turns of one role are
one message whose texts are parted by ``<part>``. Inside roles and texts, ``\\``, ``<``
and ``>`` are written ``\\s``, ``\\l`` and ``\\g``, so no text can hold a control string
and every text can be read back.

The formatter also returns the loss mask as ``segments``: pieces whose texts joined
are exactly the formatted string, each marked with whether it is trained on (the
assistant's texts, without the marks around them).

Defined cases: null text or role reads as empty; turns are ordered by turn (null
first), then role, then text, so ties and repeated rows have one order and all stay;
rows with a null conv_id form one conversation; an empty table gives no rows; extra
columns are ignored. A conversation becomes one row, so it must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE, PART = "</turn>\n", "<part>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, n_messages."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"),
    )
    # First turn of each run of one role, then the runs as slices: linear in the turns.
    places = F.sequence(F.lit(1), F.size("turns"))
    starts = F.filter(
        places,
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    grouped = grouped.withColumn("starts", starts).withColumn("n_messages", F.size("starts"))
    messages = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s).alias("turns"),
        ),
    )
    grouped = grouped.select("conv_id", "n_messages", messages.alias("messages"))

    def pieces(m: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        loss = m["role"] == F.lit(trained_role)
        body = F.flatten(
            F.transform(
                m["turns"],
                lambda t, i: F.array(
                    piece(F.when(i == 0, F.concat(F.lit("<turn:"), m["role"], F.lit(">"))).otherwise(F.lit(PART)), F.lit(False)),
                    piece(t["text"], loss),
                ),
            )
        )
        return F.concat(body, F.array(piece(F.lit(CLOSE), F.lit(False))))

    with_pieces = grouped.select("conv_id", "n_messages", F.flatten(F.transform("messages", pieces)).alias("segments"))
    return with_pieces.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_messages")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""

    def message(block: Column) -> Column:
        role = F.substring_index(block, ">", 1)
        body = F.substring_index(F.substr(block, F.length(role) + 2), "</turn>", 1)
        return F.transform(F.split(body, PART), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    blocks = F.slice(F.split(formatted, "<turn:"), F.lit(2), F.lit(2147483646))
    return F.flatten(F.transform(blocks, message))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
