"""Chat formatting on token ids.

A turn is <|im_start|>, role, newline, text, <|im_end|>, newline. The parts are encoded separately and joined by reserved
ids that no text can encode to; the loss mask comes from prefix sums over the parts' bounds. Control strings inside a
role or text are escaped: <|im_end|> becomes <|\\im_end|>, <|\\im_end|> becomes <|\\\\im_end|>, and so on, which reading
undoes. A role's backslashes and newlines are escaped too, so that the first newline ends the role.

Turns are encoded where they lie; then a conversation's turns are brought together and streamed in order, one turn at a time,
so that a conversation of any length needs the memory of its longest turn. The digests are sequential by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import textscan as ts
from leafmill.llm.arrowmap import arrow_schema, ship
from leafmill.llm.tokenstore import encoder

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
ROLE = re.compile(r"\\(.)", re.S)

FORMAT = "conv_id long, turn_no long, start long, ids array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    return CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<|\1\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


class Coder:
    """The tokenizer with two reserved ids behind its vocabulary."""

    def __init__(self, vocabulary: bytes):
        self.encoder = encoder(vocabulary, special_as_text=True)
        words = self.encoder.tokenizer.get_vocab()
        self.start = max(words.values()) + 1
        self.end = self.start + 1
        self.newline = self.encoder.tokenizer.encode("\n", add_special_tokens=False).ids
        byte = byte_of()
        self.text = [b""] * self.start
        for x, i in words.items():
            self.text[i] = bytes(byte[c] for c in x)
        self.roles: dict[str, list[int]] = {}

    def role(self, role: str) -> list[int]:
        if role not in self.roles:
            if len(self.roles) > 1000:
                self.roles.clear()
            self.roles[role] = self.encoder.tokenizer.encode(escape_role(role), add_special_tokens=False).ids
        return self.roles[role]

    def encode(self, roles: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        for b in ts.blocks(pa.array([escape(t) for t in texts], pa.large_string())):
            ids, bounds = self.encoder.encode(b)
            for i in range(len(bounds) - 1):
                role = roles[b.first + i]
                runs = [[self.start], self.role(role), self.newline, ids[bounds[i] : bounds[i + 1]], [self.end], self.newline]
                edges = np.cumsum([0, *map(len, runs)])
                step = np.zeros(edges[-1] + 1, dtype=np.int8)
                if role == "assistant":
                    step[edges[3]] += 1
                    step[edges[4]] -= 1
                yield np.concatenate(runs).astype(np.int32), np.cumsum(step)[:-1].astype(np.int8)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8")

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the loss mask, and characters of one turn's formatted form."""
        if ids[0] != self.start or np.count_nonzero(ids >= self.start) != 2:
            raise ValueError("a turn must hold its two reserved ids and no others")
        close = int(np.flatnonzero(ids == self.end)[0])
        body, tail = self.decode(ids[1:close]), self.decode(ids[close + 1 :])
        role, _, text = body.partition("\n")
        loss = self.decode(ids[mask > 0])
        return unescape_role(role), unescape(text), unescape(loss), len(START) + len(body) + len(END) + len(tail)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (conv_id, turn_no, start, ids, loss_mask) of turns (conv_id, turn, role, text), by conversation in order.

    Order is by turn (null first), then role, then a hash of the text. A null role or text counts as empty; rows that share
    a turn are all kept; a null conv_id is a conversation of its own. start is the turn's first place in its conversation's
    ids. The loss mask covers the texts of role assistant. Other columns are not read.
    """
    spark = turns.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(_vocabulary(tokenizer))  # a vocabulary file: a few megabytes
    ddl = "conv_id long, turn long, role string, text_hash long, ids array<int>, loss_mask array<tinyint>"
    schema, out_schema = arrow_schema(ddl), arrow_schema(FORMAT)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                roles = [r or "" for r in b.column(2).to_pylist()]
                ids, masks = zip(*coder.encode(roles, [t or "" for t in b.column(4).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles), b.column(3), pa.array(ids, schema.field("ids").type), pa.array(masks, schema.field("loss_mask").type)], schema=schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, start = object(), 0, 0
        for b in batches:
            numbers, starts = [], []
            for conv, n in zip(b.column(0).to_pylist(), np.diff(b.column(1).offsets.to_numpy()).tolist(), strict=True):
                if conv != now:
                    now, number, start = conv, 0, 0
                numbers.append(number)
                starts.append(start)
                number, start = number + 1, start + n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), b.column(1), b.column(2)], schema=out_schema)

    text = F.col("text").cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.xxhash64(text).alias("h"), text.alias("text"))
    done = rows.mapInArrow(encode, ddl)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = done.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_hash")
    return done.select("conv_id", "ids", "loss_mask").mapInArrow(place, FORMAT)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """n_turns, digests and sizes of each conversation, parsed from format_conversations' rows as they stand."""
    spark = formatted.sparkSession
    vocabulary = spark.sparkContext.broadcast(_vocabulary(tokenizer))
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary.value)
        state: list | None = None  # conv_id, turns, digest, loss characters, loss digest, characters
        for b in batches:
            done = []
            for conv, number, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4), strict=True):
                if number == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, chars = coder.parse(ids.values.to_numpy(), mask.values.to_numpy())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += chars
            yield _rows(done, schema)
        yield _rows([state] if state else [], schema)

    return formatted.mapInArrow(run, ddl)


def _rows(states: list, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(c, n, d.hexdigest(), k, e.hexdigest(), f) for c, n, d, k, e, f in states]
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
