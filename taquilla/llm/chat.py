r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it in order, and a loss mask
over its text alone. Turns after the last assistant turn, or those of a conversation without one,
end in an example whose mask is empty, so that no turn is lost.

The template writes a turn as ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash
is doubled and a backslash is put before each of the template's control strings, so any text can
be read back, control strings and all. ``read_back`` parses an example and undoes that.

A conversation is formatted by one task, since an example holds all of its earlier turns anyway;
examples are made one after the other and never held together.

Defined results. NULL text: empty. NULL role: empty, and no assistant. Order: by turn, then role,
then text, NULL turns first. Rows that agree in all three: a turn each. NULL ``conv_id``: one
conversation. No rows: no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, (BEGIN, HEAD, BODY, END))) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = rf"((?:\\.|(?!{'|'.join(map(re.escape, (BEGIN, HEAD, BODY, END)))})[^\\])*)"
_TURN = re.compile(
    re.escape(BEGIN + HEAD) + _PLAIN + re.escape(BODY) + _PLAIN + re.escape(END), re.DOTALL
)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    head = BEGIN + HEAD + escaped(role) + BODY
    return head + escaped(text) + END, len(head)


def examples(turns: list[tuple[str, str]]) -> Iterator[dict]:
    """Examples of one conversation: ``formatted`` and the trained span, if any."""
    done = ""
    last_trained = -1
    for number, (role, text) in enumerate(turns):
        formatted, begin = turn_text(role, text)
        if role == TRAINED:
            start = len(done) + begin
            yield {
                "target": number,
                "formatted": done + formatted,
                "mask_start": start,
                "mask_end": len(done) + len(formatted) - len(END),
            }
            last_trained = number
        done += formatted
    if turns and last_trained < len(turns) - 1:
        yield {"target": None, "formatted": done, "mask_start": 0, "mask_end": 0}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of an example."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def _gathered(conversations: DataFrame) -> DataFrame:
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )


def _conversations(batches):
    """Conversation by conversation, so that no more than one is held as Python values."""
    for batch in batches:
        ids, held = batch.column("conv_id"), batch.column("turns")
        for i in range(batch.num_rows):
            yield ids[i].as_py(), [(t["role"], t["text"]) for t in held[i].as_py()]


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id``, ``target``, ``formatted``, ``mask_start``, ``mask_end``."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("target", pa.int32()),
            ("formatted", pa.string()),
            ("mask_start", pa.int64()),
            ("mask_end", pa.int64()),
        ]
    )

    def expand(batches):
        for conv_id, turns in _conversations(batches):
            for example in examples(turns):
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, **example}], schema=schema)

    return _gathered(conversations).mapInArrow(
        expand, "conv_id long, target int, formatted string, mask_start long, mask_end long"
    )


def digests(examples_: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trained text, formatted size."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss", pa.string()),
            ("chars", pa.int64()),
        ]
    )

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                turns = read_back(row["formatted"])
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                found = {
                    "conv_id": row["conv_id"],
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(told.encode()).hexdigest(),
                    "loss": unescaped(row["formatted"][row["mask_start"] : row["mask_end"]]),
                    "chars": len(row["formatted"]),
                }
                yield pa.RecordBatch.from_pylist([found], schema=schema)

    seen = examples_.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss string, chars long"
    )
    return (
        seen.groupBy("conv_id")
        .agg(
            F.max("n_turns").alias("n_turns"),
            F.max_by("turns_sha256", "n_turns").alias("turns_sha256"),
            F.sort_array(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"),
            F.sum("chars").alias("formatted_chars"),
        )
        .withColumn("loss", F.array_join("losses.loss", ""))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
