"""Chat formatting by columnar byte assembly.

Rows are dealt by conversation and sorted by turn; each Arrow batch is assembled at once: segment lengths (header, role,
text, footer), their cumulative offsets, and the scatter indices of every byte are computed in numpy, and headers and
contents are copied into one preallocated buffer that becomes the text column.  A conversation longer than a batch goes
on in its next part, so memory is bounded however many turns one conversation has.

Template of a turn: `<|im_start|>` role newline text `<|im_end|>` newline.  Inside texts a `<` followed by any number of
backslashes and `|` gets one backslash more, so no control string can appear there, and taking one away restores the
text.  In roles, backslash and newline are written `\\\\` and `\\n` first.

Null roles and texts are empty ones; a null conv_id is a conversation of its own; null turns come first.  Rows of the
same turn follow each other by role and text; repeated rows are repeated turns.  Extra columns are left out.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices

START, END = b"<|im_start|>", b"<|im_end|>\n"
TRAINED = "assistant"
_SCHEMA = "conv_id long, part int, n_turns int, text string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def _to_escape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of each `<` that backslashes and `|` of the same text follow."""
    at = np.flatnonzero(data == 60)
    if not len(at):
        return at
    other = np.where(data != 92, np.arange(len(data)), len(data))
    after = np.append(np.minimum.accumulate(other[::-1])[::-1], len(data))[at + 1]
    inside = after < offsets[np.searchsorted(offsets, at, "right")]
    at, after = at[inside], after[inside]
    return at[data[after] == 124]


def assemble(conv: np.ndarray, roles: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """The formatted bytes of rows sorted by conversation, each row's end in them, and its content's start and end.

    conv only serves to keep the order; texts come as flat bytes with offsets.
    """
    n = len(offsets) - 1
    coded = roles.fill_null("").dictionary_encode()
    names = [b"".join((START, escape_role(r).encode(), b"\n")) for r in coded.dictionary.to_pylist()]
    which = coded.indices.to_numpy()
    header = np.array([len(x) for x in names], np.int64)[which]
    marks = _to_escape(data, offsets)
    extra = np.bincount(np.searchsorted(offsets, marks, "right") - 1, minlength=n)
    content = np.diff(offsets) + extra
    ends = np.cumsum(header + content + len(END))
    begin = ends - len(END) - content
    out = np.full(int(ends[-1]) if n else 0, 92, np.uint8)  # backslashes, where nothing else is put
    # Contents: each byte moves by its text's place and the backslashes put in before it.
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.bincount(marks + 1, minlength=len(data) + 1)[:len(data) + 1], out=before)
    first = before[offsets[:-1]] if len(data) else np.zeros(n, np.int64)
    out[np.arange(len(data)) + before[:len(data)] + np.repeat(begin - offsets[:-1] - first, np.diff(offsets))] = data
    # Headers of equal roles and all footers in one scatter each.
    for k, name in enumerate(names):
        rows = np.flatnonzero(which == k)
        out[(begin[rows] - header[rows])[:, None] + np.arange(len(name))] = np.frombuffer(name, np.uint8)
    out[(begin + content)[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    return out, ends, begin, begin + content


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, part, n_turns, text and loss of each conversation's parts, in order within a partition.

    loss holds the spans of the text, in code points, that are trained on: the contents of the trained role's turns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in slices(batch.column(2)):
                conv = ids.slice(first, end - first)
                number = conv.fill_null(0).to_numpy()
                null = conv.is_null().to_numpy(zero_copy_only=False)
                roles = batch.column(1).slice(first, end - first)
                out, ends, begin, stop = assemble(number, roles, data, offsets)
                change = np.flatnonzero((np.diff(number) != 0) | (np.diff(null) != 0)) + 1
                heads = np.concatenate(([0], change))
                tails = np.append(change, end - first)
                at = np.concatenate(([0], ends))
                points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
                wanted = np.flatnonzero(np.asarray(roles.fill_null("").to_pylist(), object) == trained)
                base = points[at[heads]][np.searchsorted(heads, wanted, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(points[begin[wanted]] - base), pa.array(points[stop[wanted]] - base)],
                                                   names=["start", "end"])
                keys = [conv[int(h)].as_py() for h in heads]
                parts = np.zeros(len(heads), np.int32)
                parts[0] = part + 1 if keys[0] == last and last is not object() else 0
                last, part = keys[-1], int(parts[-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(parts), pa.array((tails - heads).astype(np.int32)),
                    pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(at[np.append(heads, end - first)].astype(np.int64)),
                                                     pa.py_buffer(out)).cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(wanted, np.append(heads, end - first)), pa.int32()), spans)],
                    names=["conv_id", "part", "n_turns", "text", "loss"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, _SCHEMA)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n([^<]*(?:<(?!\|)[^<]*)*)<\|im_end\|>\n")


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a turn at {at}")
    return out


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the parts of format_chats, whose order it needs: digests of turns and of trained text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            cols = list(zip(*done, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, part, text, loss in zip(batch.column(0), batch.column(1), batch.column(3), batch.column(4), strict=True):
                conv, part, text = conv.as_py(), part.as_py(), text.as_py()
                if part == 0:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                for span in loss.as_py():
                    trained = unescape(text[span["start"]:span["end"]])
                    state[3] += len(trained)
                    state[4].update(trained.encode())
                state[5] += len(text)
            if len(done) > 5000:
                yield flush()
                done = []
        close()
        if done:
            yield flush()
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                     "formatted_chars long")
