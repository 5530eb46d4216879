"""Chat formatting by token-level assembly.

A conversation is `<s>`, then each turn as `[INST]` role `[/INST]` text `</s>`. Segments are encoded separately and
the control strings are spliced in as reserved ids that no text can encode to, right above the vocabulary. So that
the formatted string can be read back too, a control string inside a role or text gets a backslash after its first
character, and a backslash is doubled. The loss mask is the running sum of +1 where an assistant's text begins and -1
where it ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.wordcache import DEFAULT_BYTE, encoder

#: The control strings; their ids follow the vocabulary in this order.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, ROLE, TEXT, END = range(4)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def byte_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id. The vocabulary writes a byte that isn't printable as a letter from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(vocabulary, encoding="utf-8") as f:
        known = json.load(f)["model"]["vocab"]
    table = [b""] * (max(known.values()) + 1)
    for piece, i in known.items():
        table[i] = bytes(letters[c] for c in piece)
    return table


_TURNS = "conv_id long, turn long, role string, ids binary, mask binary"


def format_turns(turns: DataFrame, vocabulary: str = DEFAULT_BYTE, learnt_role: str = "assistant") -> DataFrame:
    """Each row of turns (conv_id, turn, role, text) as ids (uint32) and loss mask (a byte an id). Nulls of role and text are empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        base = words.library.get_vocab_size()
        mark = [np.array([base + i], "<u4").tobytes() for i in range(len(CONTROLS))]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                roles = [r or "" for r in part.column(2).to_pylist()]
                got_roles = words.encode([escaped(r) for r in roles])
                texts = words.encode([escaped(t or "") for t in part.column(3).to_pylist()])
                ids, masks = [], []
                for role, r, t in zip(roles, got_roles, texts, strict=True):
                    one = mark[ROLE] + r + mark[TEXT] + t + mark[END]
                    steps = np.zeros(len(one) // 4, np.int8)
                    if role == learnt_role and t:
                        steps[len(r) // 4 + 2] += 1
                        steps[-1] -= 1
                    ids.append(one)
                    masks.append(np.cumsum(steps, dtype=np.int8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(roles), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())], names=["conv_id", "turn", "role", "ids", "mask"])

    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(encode, _TURNS)


class _Reader:
    """Reads one conversation's ids and mask, turn by turn, and keeps running digests only."""

    def __init__(self, key: int | None):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, len(CONTROLS[BEGIN])
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, table: list[bytes], base: int) -> None:
        marks = np.flatnonzero(ids >= base)
        assert (ids[marks] - base).tolist() == [ROLE, TEXT, END], "not a turn"
        text_of = lambda part: b"".join([table[i] for i in part.tolist()]).decode()
        role, text = text_of(ids[1 : marks[1]]), text_of(ids[marks[1] + 1 : -1])
        self.turns += 1
        self.chars += sum(len(CONTROLS[i]) for i in (ROLE, TEXT, END)) + len(role) + len(text)
        self.said.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
        learnt = unescaped(text_of(ids[mask == 1]))
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_report(turns: DataFrame, vocabulary: str = DEFAULT_BYTE, learnt_role: str = "assistant") -> DataFrame:
    """One row per conversation, read back from its ids and mask: the columns of _REPORT.

    Turns stand in order of turn, a null one first; turns with the same number by role, then by their ids. Encoding
    is done before the shuffle; after it a task streams its conversations in order and keeps digests only, so a
    conversation of any length needs no more memory than a turn. Rows with a null conv_id form one conversation.
    An empty table gives no rows; extra columns are ignored.
    """
    formatted = format_turns(turns, vocabulary, learnt_role)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocabulary)
        base = encoder(vocabulary).library.get_vocab_size()
        now, kinds = None, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        rows: list[tuple] = []

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _REPORT.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for key, ids, mask in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.row())
                    now = _Reader(key)
                now.add(np.frombuffer(ids.as_buffer(), "<u4"), np.frombuffer(mask.as_buffer(), np.int8), table, base)
            if rows:
                yield taken()
        if now is not None:
            rows.append(now.row())
            yield taken()

    laid = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return laid.mapInArrow(read, _REPORT)
