"""Chat formatting: typed content parts in, marked text with a loss mask out, and back.

A message is a list of parts. ``flatten_parts`` visits them in order: text is
escaped, and an image, audio or document part becomes a numbered placeholder
while its reference and the tokens it will expand to are recorded. ``format_turns``
wraps each message in turn marks and marks the assistant's text for the loss.
``read_back`` undoes all of it.

Template of a turn, where the role is escaped like the text:

    <turn ROLE>\\nTEXT\\n</turn>\\n          (assistant: <turn ROLE loss>)

Escapes are reversible: a backslash is doubled, ``<`` becomes ``\\l``, and ``>`` in
a role becomes ``\\g``. So no mark can occur inside a text, whatever the text says.

A null role or text is empty; null part lists have no parts; parts of an unknown
kind are kept as documents. Turns are ordered by (turn, role, text), nulls first.
A null conversation id is a conversation of its own. Repeated rows are repeated
turns. Extra columns are ignored. A conversation may be longer than a task's
memory: rows are sorted by Spark and digested as they stream by.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind: string, text: string, uri: string, size: bigint>>"
#: Tokens that a placeholder expands to: a fixed number, and one for so many units of size (0: none).
EXPANSION = {"image": (85, 512), "audio": (4, 40), "document": (16, 4)}
ASSISTANT = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(F.replace(out, F.lit(">"), F.lit("\\g")), F.lit(" "), F.lit("\\s")) if role else out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "g": ">", "s": " "}.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


def flatten_parts(parts: Column) -> Column:
    """struct(flat, attachments, expanded_tokens) of a list of typed parts.

    Placeholders are ``<KIND N>`` with N counting the attachments of the message
    from 1, so they differ from text, in which every ``<`` is escaped.
    """
    known = F.array(*map(F.lit, EXPANSION))

    def kind(p):
        return F.when(p["kind"] == "text", "text").when(F.array_contains(known, p["kind"]), p["kind"]).otherwise("document")

    def tokens(p):
        sized = [F.when(kind(p) == k, F.lit(fixed) + F.ceil(F.coalesce(p["size"], F.lit(0)) / F.lit(unit))) for k, (fixed, unit) in EXPANSION.items()]
        return F.coalesce(*sized, F.lit(0)).cast("long")

    state = F.struct(F.lit("").alias("flat"), F.lit(0).alias("seen"))

    def visit(s, p):
        n = (s["seen"] + F.when(kind(p) == "text", 0).otherwise(1)).cast("int")
        piece = F.when(kind(p) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind(p), F.lit(" "), n.cast("string"), F.lit(">")))
        return F.struct(F.concat(s["flat"], piece).alias("flat"), n.alias("seen"))

    present = F.filter(F.coalesce(parts, F.expr(f"CAST(array() AS {PARTS})")), lambda p: p.isNotNull())
    attached = F.filter(present, lambda p: kind(p) != "text")
    return F.struct(
        F.aggregate(present, state, visit)["flat"].alias("flat"),
        F.transform(attached, lambda p, i: F.struct((i + 1).alias("n"), kind(p).alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens"))).alias("attachments"),
        F.aggregate(F.transform(attached, tokens), F.lit(0).cast("long"), lambda a, b: a + b).alias("expanded_tokens"),
    )


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("size")))


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv_id, turn, role, formatted, loss_from, loss_to, attachments, expanded_tokens), one row per message.

    ``formatted`` is the marked turn; characters loss_from up to loss_to of it are under the loss mask.
    """
    name = F.coalesce(F.col(role).cast("string"), F.lit(""))
    loss = name == ASSISTANT
    shaped = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), name.alias("role"), flatten_parts(F.col(parts)).alias("m"))
    head = F.concat(F.lit("<turn "), escaped(name, role=True), F.when(loss, " loss").otherwise(""), F.lit(">\n"))
    marked = shaped.select("conv_id", "turn", "role", "m", head.alias("head"))
    return marked.select(
        "conv_id", "turn", "role", F.concat("head", "m.flat", F.lit("\n</turn>\n")).alias("formatted"),
        F.length("head").cast("long").alias("loss_from"),
        (F.length("head") + F.when(F.col("role") == ASSISTANT, F.length("m.flat")).otherwise(0)).cast("long").alias("loss_to"),
        "m.attachments", "m.expanded_tokens",
    )


_TURN = re.compile(r"<turn ([^ >]*)( loss)?>\n([^<]*(?:<(?!/turn>)[^<]*)*)\n</turn>\n")


def read_turn(formatted: str) -> tuple[str, str, bool]:
    """(role, text, under the loss mask) of one marked turn."""
    role, loss, text = _TURN.fullmatch(formatted).groups()
    return unescaped(role), unescaped(text), loss is not None


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the marked turns and their loss ranges."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches):
        now, turns, loss = None, None, None
        counts = [0, 0, 0]
        done = []

        def close():
            if now is not None:
                done.append((now[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))
            for conv, text, begin, end in zip(*columns):
                if now is None or now[0] != conv:
                    close()
                    now, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, said, _ = read_turn(text)
                turns.update(f"{role}\n{said}\n".encode())
                masked = unescaped(text[begin:end])
                loss.update(masked.encode())
                counts[0] += 1
                counts[1] += len(masked)
                counts[2] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k in (2, 4) else pa.array(list(c), pa.int64()) for k, c in enumerate(zip(*done))], names)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) if k in (2, 4) else pa.array(list(c), pa.int64()) for k, c in enumerate(zip(*done))], names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, DIGESTS)
