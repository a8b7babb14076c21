"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example holds all turns before the reply as context and the reply as the only
trainable part. The template puts each turn between control strings; whatever looks
like one inside a role or text is escaped with a backslash and comes back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import BATCH_BYTES, number_within
from rivulet.plans.fixpoint import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that tokenisers and common templates treat as control strings. Fixed values.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of each turn of a formatted string, with the span of the escaped text."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


EXAMPLES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("example", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("trainable", T.BooleanType()),
])


#: Turns of a conversation whose examples one task writes; a longer conversation is dealt out.
BLOCK = 256


def _expand(batches: Iterator[pd.DataFrame], block_turns: int) -> Iterator[pd.DataFrame]:
    """Turns in order to the examples of each block; holds the prefix of one conversation and at most BATCH_BYTES of output.

    A block comes with all turns up to its last one; the examples of earlier blocks are counted but not written.
    """
    out: list[tuple] = []
    size, current, prefix, example, at, pending = 0, None, "", 0, 0, False

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=EXAMPLES.names)

    def put(start: int, end: int, trainable: bool) -> None:
        nonlocal size, example
        out.append((conv, example, prefix, start, end, trainable))
        size, example = size + len(prefix), example + 1

    def close() -> None:
        if current is not None and pending and current[-1]:
            put(len(prefix), len(prefix), False)

    conv = None
    for batch in batches:
        for none, key, block, last, role, text in zip(*[batch[c] for c in ("none", "conv", "block", "last", "role", "text")]):
            if current is None or current != (none, key, block, last):
                close()
                current, conv, prefix, example, at = (none, key, block, last), None if none else int(key), "", 0, 0
            head = f"{prefix}{TURN}{escape(role)}{TEXT}"
            body = escape(text)
            prefix = f"{head}{body}{END}"
            pending = role != "assistant"
            if not pending:
                if at >= block * block_turns:
                    put(len(head), len(head) + len(body), True)
                else:
                    example += 1
            at += 1
            if size >= BATCH_BYTES // 4:
                yield frame()
                out, size = [], 0
    close()
    if out:
        yield frame()


def expand(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One example per assistant turn: (conv_id, example, formatted, loss_start, loss_end, trainable).

    `formatted[loss_start:loss_end]` is the reply. Turns after the last reply make a
    final example with an empty mask and `trainable` false, so that no turn is lost. Turns are
    ordered by number, nulls first; equal numbers by role and text, so repeated rows
    stay and ties are stable. Null text and null role are empty; rows with a null conv_id are one conversation. An empty table
    gives no rows; other columns are not read. A conversation of up to `block` turns is one task's work; of a longer one, and of the null one, every block of turns is
    a group of its own that gets the turns before it again, which is one `block`-th of what it writes. Rows are sorted in the
    shuffle's partitions and streamed; a worker holds one conversation's prefix. The output grows with the square of a conversation's length,
    which is what this expansion means.
    """
    rows = conversations.select(
        F.col(conv_id).isNull().alias("none"), F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    key = ["none", "conv"]
    long = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block))
    whole = rows.withColumn("block", F.lit(0)).withColumn("last", F.lit(True))
    if not long.isEmpty():
        numbered = number_within(rows.join(long, key), key, ["turn", "role", "text"], "at")
        end = F.floor((F.col("n") - 1) / block).cast("int")
        parts = numbered.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block).cast("int"), end))).withColumn("last", F.col("block") == end)
        whole = whole.join(long, key, "left_anti").select(*key, "turn", "role", "text", "block", "last").unionByName(parts.drop("n", "at"))
    dealt = whole.repartition(*key, "block").sortWithinPartitions(*key, "block", "turn", "role", "text")
    return dealt.select(*key, "block", "last", "role", "text").mapInPandas(lambda batches: _expand(batches, block), EXAMPLES)


DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_examples", T.LongType()),
])


READ = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("example", T.LongType()), T.StructField("reply", T.StringType()), T.StructField("chars", T.LongType()),
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each example read back by itself: its reply from under the mask, and its turns."""
    for batch in batches:
        out = []
        for conv, example, formatted, start, end in zip(*[batch[c] for c in ("conv_id", "example", "formatted", "loss_start", "loss_end")]):
            turns, count = hashlib.sha256(), 0
            for role, text, _, _ in read_turns(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                count += 1
            out.append((None if pd.isna(conv) else int(conv), example, unescape(formatted[start:end]), len(formatted), count, turns.hexdigest()))
        yield pd.DataFrame(out, columns=READ.names)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples of whole conversations in order: replies joined, turns as the last one has them."""
    current, started = None, False
    loss, loss_chars, chars, n, turns = hashlib.sha256(), 0, 0, 0, (0, "")

    def row() -> tuple:
        return current, *turns, loss_chars, loss.hexdigest(), chars, n

    for batch in batches:
        out = []
        for conv, reply, size, count, digest in zip(*[batch[c] for c in ("conv_id", "reply", "chars", "n_turns", "turns_sha256")]):
            conv = None if pd.isna(conv) else int(conv)
            if not started or conv != current:
                if started:
                    out.append(row())
                current, started = conv, True
                loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
            loss.update(reply.encode())
            loss_chars, chars, n, turns = loss_chars + len(reply), chars + size, n + 1, (count, digest)
        if out:
            yield pd.DataFrame(out, columns=DIGEST.names)
    if started:
        yield pd.DataFrame([row()], columns=DIGEST.names)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: turns and replies as read from the formatted examples, in whatever order and partitions these come.

    `examples` has the columns of `expand`, of whole conversations; others are not read. Every example is read where it lies; only replies and digests are
    shuffled, so a conversation's one task gets what is linear in its length. Examples with a null conv_id are one
    conversation. An empty table gives no rows.
    """
    parts = examples.select("conv_id", "example", "formatted", "loss_start", "loss_end").mapInPandas(_read, READ)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "example").drop("example").mapInPandas(_digest, DIGEST)
