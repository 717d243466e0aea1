"""Chat formatting by prefix-target expansion (operator 5).

Every assistant turn becomes an example of its own: all turns before it as context, its reply alone
trainable. A conversation whose last turn is not an assistant's gets one more example without a target, so
that no turn is lost. The template is ``### role: text </turn>`` and a newline per turn. Inside roles and texts
the backslash, ``#`` and ``<`` become ``\\\\``, ``\\h`` and ``\\l``, so neither mark can occur there, and back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship, table

_OUT = str.maketrans({"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"})
_TEXT = str.maketrans({"\\": "\\\\", "#": "\\h", "<": "\\l"})
_BACK = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":"}
_TURN = re.compile(r"### ([^:]*): ([^<]*) </turn>\n")
EXAMPLES = "conv_id long, example long, n_turns long, last boolean, text string, loss_start long, loss_end long"


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _BACK[m[0]], text)


def _format(role: str, text: str) -> tuple[str, int, int]:
    head, body = f"### {role.translate(_OUT)}: ", text.translate(_TEXT)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_chat(conversations: DataFrame) -> DataFrame:
    """Examples of conversations (conv_id, turn, role, text), in order of turn, role, text.

    Null role or text is empty; rows without conv_id are left out, null turns come first, equal turns go by role and text,
    repeated rows stay. Other columns are not read; an empty table gives no examples. One conversation is one record, so its
    turns meet in one task and must fit it (2 GB at most); examples are made one after another and are never all in memory,
    though their total length grows with the square of a conversation's: that is the method.
    """
    ship(conversations.sparkSession)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def expand(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in EXAMPLES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        out, size = [], 0
        for batch in batches:
            for conv, turns in zip(batch.column("conv_id"), batch.column("turns"), strict=True):
                conv, turns = conv.as_py(), turns.as_py()
                prefix, examples = "", 0
                for k, turn in enumerate(turns, 1):
                    part, start, end = _format(turn["role"], turn["text"])
                    at, prefix, last = len(prefix), prefix + part, k == len(turns)
                    if turn["role"] == "assistant":
                        out.append((conv, examples, k, last, prefix, at + start, at + end))
                    elif last:
                        out.append((conv, examples, k, last, prefix, 0, 0))
                    else:
                        continue
                    examples, size = examples + 1, size + len(prefix)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return grouped.mapInArrow(expand, EXAMPLES)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turns from the longest example, losses from all."""
    ship(examples.sparkSession)

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            b = batch.to_pydict()
            out = {"conv_id": b["conv_id"], "example": b["example"], "chars": [], "loss": [], "n_turns": [], "sha": []}
            for text, last, start, end in zip(b["text"], b["last"], b["loss_start"], b["loss_end"], strict=True):
                out["chars"].append(len(text))
                out["loss"].append(unescape(text[start:end]))
                turns = parse(text) if last else []
                out["n_turns"].append(len(turns) if last else None)
                out["sha"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() if last else None)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("chars", pa.int64()), ("loss", pa.string()), ("n_turns", pa.int64()), ("sha", pa.string())]))

    x = examples.mapInArrow(read, "conv_id long, example long, chars long, loss string, n_turns long, sha string")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    return (
        x.groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("_loss"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
    )


def op5_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return digests(materialize(format_chat(rows), "chat"))
