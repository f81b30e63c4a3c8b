"""Fill-in-middle documents by rotating blocks of a text in place, and the exact way back.

A text is cut at two code points into prefix, middle and suffix. Sentinels are put before the three
blocks in one bytearray, and the order that a form asks for is reached by a rotation: reversing each
of two neighbouring blocks and then both together exchanges them without a second buffer of the text.
The same rotation with the blocks' sizes exchanged undoes it.
"""

from __future__ import annotations

import struct
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentimill.llm.arrow import raw_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
MARK = len(PREFIX)
#: Bytes exchanged at a time while a block is reversed.
STEP = 1 << 16


def reverse(buf: np.ndarray, start: int, end: int) -> None:
    """Reverse ``buf[start:end]`` in place, from both ends inwards."""
    while end - start > 1:
        n = min(STEP, (end - start) // 2)
        head = buf[start : start + n].copy()
        buf[start : start + n] = buf[end - n : end][::-1]
        buf[end - n : end] = head[::-1]
        start, end = start + n, end - n


def rotate(buf: np.ndarray, start: int, mid: int, end: int) -> None:
    """Exchange the neighbouring blocks ``[start, mid)`` and ``[mid, end)`` by three reversals."""
    reverse(buf, start, mid)
    reverse(buf, mid, end)
    reverse(buf, start, end)


def draws(doc_id: int | str | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that hang on the seed and the id alone (a null id: on the seed)."""
    return struct.unpack(">4I", sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def scan_cuts(raw: bytes, cuts: tuple[int, ...]) -> tuple[int, list[int]]:
    """The number of code points of UTF-8 bytes, and the byte offsets before which so many code points stand."""
    heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return len(heads), [int(heads[c]) if c < len(heads) else len(raw) for c in cuts]


def transform_text(raw: bytes, h: tuple[int, int, int, int], plain_percent: int = 10, spm_percent: int = 20) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, code points, prefix's, middle's); the last two are None for plain texts.

    Empty texts, texts that hold a sentinel already, and a share of all others stay as they are.
    """
    n, _ = scan_cuts(raw, ())
    if not raw or h[2] % 100 >= 100 - plain_percent or any(s in raw for s in SENTINELS):
        return raw, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    _, (x, y) = scan_cuts(raw, (a, b))
    out = bytearray(len(raw) + 3 * MARK)
    out[:MARK] = PREFIX
    out[MARK : MARK + x] = raw[:x]
    middle = MARK + x
    out[middle : middle + MARK] = MIDDLE
    out[middle + MARK : y + 2 * MARK] = raw[x:y]
    suffix = y + 2 * MARK
    out[suffix : suffix + MARK] = SUFFIX
    out[suffix + MARK :] = raw[y:]
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    rotate(np.frombuffer(out, np.uint8), 0 if form == "spm" else middle, suffix, len(out))
    return bytes(out), form, n, a, b - a


def restore_text(output: bytes, form: str) -> bytes:
    """The text that ``transform_text`` gave ``output`` of this form for."""
    if form == "plain":
        return output
    buf = bytearray(output)
    view = np.frombuffer(buf, np.uint8)
    # the suffix block was moved to the front, or before the middle one; its end is the other block's start
    start = 0 if form == "spm" else buf.index(SUFFIX)
    moved = buf.index(PREFIX if form == "spm" else MIDDLE, start) - start
    rotate(view, start, start + moved, len(buf))
    at = (0, buf.index(MIDDLE), len(buf) - moved)
    del view
    for k in reversed(at):
        del buf[k : k + MARK]
    return bytes(buf)


def _strings(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary()).view(pa.string())


NEW = {"output": "string", "form": "string", "n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint", "restored": "string"}


def fill_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, restored: bool = False) -> DataFrame:
    """``docs`` with the transformed text in place of ``text``: output, form, n, prefix_chars, middle_chars, and what ``restore`` gives for output and form if ``restored``.

    A map over the rows: no shuffle, memory of one run of about a megabyte of text or one longer text.
    Null texts count as empty; empty texts are plain with n 0. Repeated rows of an id get the same
    cuts (of their own lengths), rows with a null id those of the seed. Other columns are carried;
    own columns with a new one's name are replaced.
    """
    new = {k: v for k, v in NEW.items() if restored or k != "restored"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new and c not in (text, doc_id)])
    carried = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in carried]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + [f"{k} {v}" for k, v in new.items()])

    def task(batches):
        for batch in batches:
            for part, raws in raw_slices(batch, text):
                ids = part.column(doc_id).to_pylist()
                out, form, n, a, m = zip(*(transform_text(r, draws(i, seed), plain_percent, spm_percent) for r, i in zip(raws, ids, strict=True)), strict=True)
                arrays = [_strings(list(out)), pa.array(form, pa.string()), *(pa.array(x, pa.int64()) for x in (n, a, m))]
                if restored:
                    arrays.append(_strings([restore_text(o, f) for o, f in zip(out, form, strict=True)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], names=[*names, *new])

    return docs.mapInArrow(task, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """``df`` with column ``to``: the exact text of each output and form; a null output or form gives an empty text or the output itself."""
    df = df.drop(to)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{to}` string"])
    names = df.columns

    def task(batches):
        for batch in batches:
            for part, raws in raw_slices(batch, output):
                back = [restore_text(r, f or "plain") for r, f in zip(raws, part.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(back)], names=[*names, to])

    return df.mapInArrow(task, schema)
