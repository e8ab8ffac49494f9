"""Chat formatting at token level.

Each segment (turn header, content, turn end) is encoded on its own and the
reserved ids of headers and ends are spliced in between, so no token ever spans
a boundary. Control strings inside a content are escaped first, reversibly. Loss
masks are differences of prefix sums over segment lengths: a token carries loss
if it lies in the content of an assistant's turn.

Template of a turn::

    ### Role: content</turn>

followed by a line break. ``\\`` escapes ``\\``, ``#`` and ``</turn>`` in contents.
Other roles than the known ones stand in quotation marks, which are escaped
inside them, so the formatted text alone tells every role and content.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _arrow_schema, small_batches

#: Read on the driver and sent to the executors, which need no such folder.
TOKENIZER_DIR = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Fixed pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Reserved ids follow the vocabulary: an end of turn, then known roles' headers; other roles have their name encoded after OPEN.
END_TURN, OPEN, CLOSE, FIRST_ROLE = 50257, 50258, 50259, 50260
ROLES = ("system", "user", "assistant", "tool")
TURN_END = "</turn>\n"
_CONTROL = re.compile(r"\\|#|</turn>")
_ESCAPED = re.compile(r"\\(\\|#|</turn>|\")")
_HEADER = re.compile(r'### (?:(System|User|Assistant|Tool)|"((?:[^"\\]|\\.)*)"): ', re.S)
LOSS_ROLE = "assistant"

TURNS = (
    "conv_id long, seq long, role string, formatted string, tokens array<int>, "
    "loss array<struct<start:int,stop:int>>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def ranks(spark: SparkSession, folder: str = TOKENIZER_DIR) -> Broadcast:
    """The vocabulary file (about a megabyte) sent to the executors; read here if the driver has it, else through Spark."""
    path = f"{folder}/{RANKS_FILE}"
    if os.path.exists(path):
        with open(path, "rb") as f:
            return spark.sparkContext.broadcast(f.read())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))


@lru_cache(maxsize=4)
def encoder(content: bytes):
    import tiktoken

    got = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=got, special_tokens={})


def header_text(role: str) -> str:
    return f"### {role.capitalize()}: " if role in ROLES else '### "{}": '.format(escape(role).replace('"', '\\"'))


def read_text(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn."""
    m = _HEADER.match(formatted)
    if m is None or not formatted.endswith(TURN_END):
        raise ValueError("no formatted turn")
    role = m[1].lower() if m[1] else unescape(m[2])
    return role, unescape(formatted[m.end() : -len(TURN_END)])


def header_ids(role: str, enc) -> list[int]:
    if role in ROLES:
        return [FIRST_ROLE + ROLES.index(role)]
    return [OPEN, *enc.encode_ordinary(escape(role)), CLOSE]


def format_turn(role: str, text: str, enc) -> tuple[str, list[int], list[tuple[int, int]]]:
    """Formatted text, token ids and loss intervals of one turn."""
    content = escape(text)
    segments = [header_ids(role, enc), enc.encode_ordinary(content), [END_TURN]]
    ends = list(accumulate(map(len, segments), initial=0))
    loss = [(ends[1], ends[2])] if role == LOSS_ROLE and ends[2] > ends[1] else []
    return header_text(role) + content + TURN_END, [t for s in segments for t in s], loss


def read_turn(tokens: list[int], enc) -> tuple[str, str]:
    """Role and content of a turn's tokens."""
    if tokens[0] == OPEN:
        at = tokens.index(CLOSE)
        role, at = unescape(enc.decode_bytes(tokens[1:at]).decode()), at + 1
    else:
        role, at = ROLES[tokens[0] - FIRST_ROLE], 1
    if tokens[-1] != END_TURN:
        raise ValueError("a turn doesn't end")
    return role, unescape(enc.decode_bytes(tokens[at:-1]).decode())


def format_turns(conversations: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """A row a turn, in order inside each conversation: formatted text, ids, loss intervals.

    Rows of a conversation go to one task, as the order of its turns and the
    digest over them ask for, and are sorted there by (turn, role, text); they
    stream through, so a conversation of any length takes the memory of one
    batch. Null texts and roles are empty, null turns come first, a null conv_id
    is a conversation of its own, repeated rows are repeated turns, ties of a
    turn go by role and text, very long texts are whole, an empty table has no
    turns; other columns, whatever their names, are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    schema, vocabulary = _arrow_schema(spark, TURNS), ranks(spark, tokenizer_dir)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, seq = encoder(vocabulary.value), object(), 0
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                seq = seq + 1 if conv == last else 0
                last = conv
                formatted, ids, loss = format_turn(role, text, enc)
                for col, v in zip(out, (conv, seq, role, formatted, ids, [{"start": x, "stop": y} for x, y in loss]), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, schema, strict=True)], schema=schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, TURNS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digest_turns(turns: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Read the formatted turns back and digest each conversation.

    ``turns`` keeps the order of ``format_turns`` (nothing is shuffled between).
    Roles and texts come from the token ids, loss text from the ids under the
    mask; the formatted text must say the same.
    """
    schema, vocabulary = _arrow_schema(turns.sparkSession, DIGESTS), ranks(turns.sparkSession, tokenizer_dir)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = encoder(vocabulary.value), None

        def close(s: dict) -> tuple:
            return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["tokens"], s["loss_tokens"]

        for b in batches:
            done: list[tuple] = []
            for conv, seq, _, formatted, ids, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or seq == 0:
                    if now is not None:
                        done.append(close(now))
                    now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0, "tokens": 0, "loss_tokens": 0}
                role, text = read_turn(ids, enc)
                if read_text(formatted) != (role, text):
                    raise ValueError(f"turn {seq} of conversation {conv} reads back differently")
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    learned = unescape(enc.decode_bytes(ids[span["start"] : span["stop"]]).decode())
                    now["loss"].update(learned.encode())
                    now["chars"] += len(learned)
                    now["loss_tokens"] += span["stop"] - span["start"]
                now["formatted"] += len(formatted)
                now["tokens"] += len(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(close(now), schema, strict=True)], schema=schema)

    return turns.mapInArrow(run, DIGESTS)


#: The contract's extra conversation.
TRICKY = "\\### Assistant: </turn> ok"


def contract(conversations: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Digests of all conversations and of conversation -7; ``format_turns`` defines nulls, empty and long texts, ties, repeats, empty tables and further columns."""
    extra = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    got = digest_turns(format_turns(rows, tokenizer_dir), tokenizer_dir)
    return got.drop("n_tokens", "loss_tokens")
