"""Byte-level BPE by longest match and backtracking, exact and linear in the text.

A sequence of tokens is what the merges produce exactly when each token is what its own bytes merge
to and no two neighbours could have been merged across their seam. So the encoder takes, at each
position, the longest vocabulary string (an Aho-Corasick automaton over bytes mapped to Latin-1),
shortens or takes back tokens while the seam to the previous one is not compatible, and remembers
dead positions: each position is given up at most once, which bounds the work by the length.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sentimill.llm.arrow import map_texts

#: What the splitting pattern means for texts of Latin letters and common punctuation, for the standard ``re``;
#: texts with any character of UNLIKE, whose classes differ between the engines, take the pattern as given.
UNLIKE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\U0010ffff]")
LATIN = {"\\p{L}": "[^\\W\\d_]", "[^\\s\\p{L}\\p{N}]": "(?:[^\\s\\w]|_)", "\\p{N}": "\\d"}
#: Pieces and token pairs that a task remembers at most, in two generations: what wasn't met during one is forgotten.
MEMO_PIECES, MEMO_PAIRS = 500_000, 300_000
#: Ids decoded at a time (one longer text makes a run of its own).
DECODED_IDS = 2_000_000


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def plain_merges(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The merges as defined: join the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def token_halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token that its own bytes merge to: the two tokens of its last merge ((-1, -1) for a byte)."""
    halves = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            halves[rank] = (-1, -1)
            continue
        below = {t: r for i in range(len(token)) for j in range(i + 1, len(token) + 1) if (r := ranks.get(t := token[i:j])) is not None and t != token}
        parts = plain_merges(below, token)
        if len(parts) == 2 and all(ranks.get(p, rank) < rank or len(p) == 1 for p in parts) and plain_merges(ranks, token) == [token]:
            halves[rank] = (ranks[parts[0]], ranks[parts[1]])
    return halves


class Memo:
    """A dictionary of at most ``most`` entries; when its newer half is full, the older half goes and the newer takes its place."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codec:
    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.halves, self.findall = ranks, halves, regex.compile(pattern).findall
        latin = pattern
        for ours, theirs in sorted(LATIN.items(), key=lambda x: -len(x[0])):
            latin = latin.replace(ours, theirs)
        self.findall_latin = None if "\\p" in latin else re.compile(latin).findall
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for rank in halves:
            self.automaton.add_word(self.bytes_of[rank].decode("latin-1"), rank)
        self.shorter = {r: next((x for n in range(len(self.bytes_of[r]) - 1, 0, -1) if (x := ranks.get(self.bytes_of[r][:n])) in halves), None) for r in halves}
        self.automaton.make_automaton()
        self.pairs, self.pieces = Memo(MEMO_PAIRS), Memo(MEMO_PIECES)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave these neighbours apart; walks their merges back from the last, looking at the seam at each time."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before, ok = left, right, 1 << 40, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < before:
                ok = False
                break
            made_a = a if self.halves[a][0] >= 0 else -1
            made_b = b if self.halves[b][0] >= 0 else -1
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:  # the left token's last merge is the later one; a seam merge of that rank would come after it
                before, a = made_a, self.halves[a][1]
            else:  # of equal ranks the left goes first, so a seam merge of that rank would come before this one
                before, b = made_b + 1, self.halves[b][0]
        self.pairs.put((left, right), ok)
        return ok

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        n, size, known = len(raw), self.size, self.pairs.new
        longest = [0] * n
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size[rank] + 1] = rank
        token = longest[0]
        out, pos, last, alive = [token], size[token], token, None
        while pos < n:
            token = longest[pos]
            ok = known.get((last, token))
            if ok is None:
                ok = self.compatible(last, token)
                known = self.pairs.new
            if ok and (alive is None or alive[pos + size[token]]):
                out.append(token)
                pos += size[token]
                last = token
                continue
            if alive is None:
                alive = bytearray(b"\x01") * (n + 1)
            pos = self._step_back(out, pos, token, alive)
            last = out[-1]
        return tuple(out)

    def _step_back(self, out: list[int], pos: int, token: int | None, alive: bytearray) -> int:
        """Put the next token that fits at ``pos``, taking earlier ones back where none does; the position after it."""
        size, shorter, compatible, known = self.size, self.shorter, self.compatible, self.pairs.new
        while True:
            last = out[-1] if out else None
            while token is not None:
                if alive[pos + size[token]]:
                    ok = last is None or known.get((last, token))
                    if compatible(last, token) if ok is None else ok:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                return pos + size[token]
            alive[pos] = 0  # nothing fits here: give the position up and shorten the token before it
            token = out.pop()
            pos -= size[token]

    def encode(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of each piece of the text, in order."""
        pieces, out, text = self.pieces, [], text or ""
        known = pieces.new.get
        latin = self.findall_latin and not UNLIKE.search(text)
        for piece in self.findall_latin(text) if latin else self.findall(text):
            ids = known(piece)
            if ids is None:
                ids = pieces.get(piece)
                if ids is None:
                    ids = self.encode_piece(piece)
                    if len(piece) <= 64:
                        pieces.put(piece, ids)
                known = pieces.new.get
            out.append(ids)
        return out


def _load(spark, path: str) -> dict[bytes, int]:
    """The rank file's lines, read on the driver: a vocabulary is a fixed file of tens of thousands of lines."""
    with open(path) as f:
        return read_ranks(f.readlines())


def encode(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with column ``ids`` (array of int, empty for null or empty text) in place of ``text``.

    A map over the rows: no shuffle, memory of one Arrow batch and bounded memos. Rows with null ids
    or repeated rows are encoded row by row; other columns are carried, and an own column ``ids`` is replaced.
    """
    ranks = _load(docs.sparkSession, ranks_file)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, token_halves(ranks)))

    def start():
        codec = Codec(*shared.value, pattern)

        def f(texts):
            rows = [list(chain.from_iterable(codec.encode(t))) for t in texts]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1])
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

        return f

    return map_texts(docs.drop("ids"), text, "ids array<int>", start)


def decode(df: DataFrame, ranks_file: str, ids: str = "ids") -> DataFrame:
    """``df`` with column ``decoded`` (binary): the bytes of its ids joined; null or empty ids give no bytes. Unknown ids raise."""
    shared = df.sparkSession.sparkContext.broadcast(_load(df.sparkSession, ranks_file))
    df = df.drop("decoded")
    names = df.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["decoded binary"])

    def task(batches):
        ranks = shared.value
        top = max(ranks.values()) + 1
        table = [b""] * top
        for token, rank in ranks.items():
            table[rank] = token
        sizes = np.array([len(t) for t in table], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        heap = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            run = (np.cumsum(lengths, dtype=np.int64) - lengths) // DECODED_IDS  # rows by the ids before them
            edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(at, end - at)
                decoded = []
                for row in part.column(ids):
                    k = row.values.to_numpy(zero_copy_only=False).astype(np.int64) if row.is_valid else np.empty(0, np.int64)
                    if len(k) and (k.min() < 0 or k.max() >= top or not sizes[k].all()):
                        raise ValueError("id outside the vocabulary")
                    n = sizes[k]
                    first = np.cumsum(n) - n
                    decoded.append(heap[np.arange(n.sum()) + np.repeat(begins[k] - first, n)].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*names, "decoded"])

    return df.mapInArrow(task, out)


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of ``text``, and ``ids`` if asked for: encoded, decoded again and digested in one map.

    One Python worker a task holds the vocabulary, the memos and one slice of texts. Null and empty
    texts have no ids and the digests of nothing; own columns with a new one's name are replaced.
    """
    ranks = _load(docs.sparkSession, ranks_file)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, token_halves(ranks)))
    new = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if ids else {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}

    def start():
        codec = Codec(*shared.value, pattern)
        spelt = {r: str(r) for r in codec.bytes_of}

        def f(texts):
            flat, sizes, coded, decoded = [], [], [], []
            for t in texts:
                row = list(chain.from_iterable(codec.encode(t)))
                sizes.append(len(row))
                coded.append(sha256(",".join(map(spelt.__getitem__, row)).encode()).hexdigest())
                decoded.append(sha256(b"".join(map(codec.bytes_of.__getitem__, row))).hexdigest())
                if ids:
                    flat.append(np.array(row, np.int32))
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            out = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))} if ids else {}
            return out | {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return f

    taken = [c for c in docs.columns if c.lower() in new and c != text]
    return map_texts(docs.drop(*taken), text, ", ".join(f"{k} {v}" for k, v in new.items()), start)


def digests(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what a round trip gives for every row."""
    return round_trip(docs.select("doc_id", "text"), ranks_file, pattern, ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
