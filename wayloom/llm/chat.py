"""Chat formatting from event logs: fold events into messages, render them, read them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"

# Escape: a '<', any backslashes, then '|' gets one backslash more, so that no
# text holds '<|'. Read back, such a run loses one. Roles also lose line breaks.
_ESCAPE, _ESCAPED = r"<(\\*)\|", r"<$1\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, _ESCAPED)


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log.

    ``events``: conv_id, message (its place in the conversation, a long), copy (an
    int that tells messages of one place apart), seq, kind, role, text. Kinds:
    ``open`` starts a message and gives its role, ``delta`` adds text,
    ``edit`` replaces all text so far, ``regenerate`` drops all text so far (its own
    text, mostly none, begins the new one). Events of a message count in the order
    of seq, then kind and text; other kinds are ignored; null text is empty. A
    message without ``open`` has a null role. Grouping is by message, so that a long
    conversation is many small groups.
    """
    body = F.coalesce("text", F.lit(""))
    known = events.filter(F.col("kind").isin("open", "delta", "edit", "regenerate"))
    order = F.struct("seq", "kind", body.alias("text"), "role")
    log = F.array_sort(F.collect_list(order))
    grouped = known.groupBy("conv_id", "message", "copy").agg(log.alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1).otherwise(1))
    return (
        grouped.withColumn("_from", F.array_max(resets))
        .withColumn("_role", F.when(F.exists("log", lambda e: e["kind"] == "open"), F.try_element_at(F.filter("log", lambda e: e["kind"] == "open"), F.lit(1))["role"]))
        .select("conv_id", "message", "copy", F.col("_role").alias("role"), F.array_join(F.transform(F.slice("log", F.col("_from"), F.size("log")), lambda e: e["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """``piece`` of each message: marked turn with escaped role and text; trained: whether a model learns it.

    The formatted conversation is its pieces in the order of message and copy. Null
    role or text counts as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    return messages.select("conv_id", "message", "copy", piece.alias("piece"), (role == "assistant").alias("trained"))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, text and mask (character ranges to train on) of whole conversations, for conversations of a size that fits a row."""
    piece = F.struct("message", "copy", "piece", "trained")
    grouped = render(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    size = lambda e: F.char_length(e["piece"])
    begin = lambda e: F.instr(e["piece"], "\n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("mask"))
    span = lambda s, e: F.array(F.struct((s["at"] + begin(e)).alias("begin"), (s["at"] + size(e) - len(END) - 1).alias("end")))
    mask = F.aggregate("p", start, lambda s, e: F.struct((s["at"] + size(e)).alias("at"), F.when(e["trained"], F.concat(s["mask"], span(s, e))).otherwise(s["mask"]).alias("mask")), lambda s: s["mask"])
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda e: e["piece"]), "").alias("text"), mask.alias("mask"))


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def digests(rendered: DataFrame, block: int = 64) -> DataFrame:
    """Read formatted conversations back, one row each.

    Neighbouring pieces are first put together in blocks, then a sorted pass
    runs over the blocks of each partition with one running digest: memory does
    not grow with a conversation. (A digest over a conversation is sequential,
    so the bytes of one conversation do go through one task.)
    """
    piece = F.struct("message", "copy", "piece")
    blocks = (
        rendered.groupBy("conv_id", F.floor(F.col("message") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(piece)).alias("p"))
        .select("conv_id", "block", F.array_join(F.transform("p", lambda e: e["piece"]), "").alias("text"))
    )
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        done: list[dict] = []

        def end() -> None:
            if state is not None:
                done.append(state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})

        for frame in frames:
            for conv, text in zip(frame["conv_id"], frame["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state["conv_id"] != conv:
                    end()
                    state = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                state["formatted_chars"] += len(text)
                for role, body in parse(text):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{body}\n".encode())
                    if role == "assistant":
                        state["loss_chars"] += len(body)
                        state["loss_sha256"].update(body.encode())
            if done:
                yield pd.DataFrame(done).astype({"conv_id": "Int64"})
                done = []
        end()
        if done:
            yield pd.DataFrame(done).astype({"conv_id": "Int64"})

    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """An event log of finished turns: opened, drafted, redone or edited, and streamed in two halves.

    Rows of one turn get copies in the order of role and text; repeated rows are
    messages of their own. Null ids, roles and texts are kept as they are.
    """
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("message"), F.col(f"`{role}`").alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    same = rows.groupBy("conv_id", "message", "role", "text").agg(F.count(F.lit(1)).cast("int").alias("n"))
    per_turn = same.withColumn("_before", F.expr("coalesce(sum(n) over (partition by conv_id, message order by role, text rows between unbounded preceding and 1 preceding), 0)"))
    copies = per_turn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("copy", (F.col("_before") + F.col("_copy")).cast("int"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text"))
    event = lambda seq, kind, body: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), body.alias("text"))
    none, draft = F.lit(""), F.concat(F.lit("draft of "), F.coalesce("role", F.lit("")))
    redone = F.array(event(0, "open", none), event(1, "delta", draft), event(2, "regenerate", none), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "open", none), event(1, "delta", draft), event(2, "edit", head), event(3, "delta", tail))
    log = copies.withColumn("e", F.explode(F.when(F.col("role") == "assistant", redone).otherwise(edited)))
    return log.select("conv_id", "message", "copy", "e.seq", "e.kind", "role", "e.text")
