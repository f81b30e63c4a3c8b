"""Benchmark passages inside documents, by CGK embedding, bit-sampling LSH and exact edit distance.

A passage of a document leaks a benchmark item if its edit distance to the item is within a share of
the item's length. Item-sized windows of the documents are embedded by CGK random walks: a walk
copies the character under it at every step and moves on or stays by a random bit of step and
character, so that small edit distance becomes small Hamming distance. Bit-sampling LSH hashes some
places of an embedding; windows and items that agree in any of the repetitions are candidates, whose
edit distance is then worked out exactly. The repetitions are raised until altered copies of the
items themselves, at the full error share, are found with the target recall.

Long items. Walks drift apart with length, so items above MOST_PIECE bytes are embedded as pieces: the
edits of a passage within a share of the item are within that share of one piece at least, which is
found like a short item; the distance is that of the whole item. A class of lengths that misses the target
recall in MOST_REPETITIONS is cut into halves in the same way, and where pieces would become too short,
the windows that the bound below lets through go to the exact distance at once.

Which windows are embedded. A window within k edits of an item of n characters holds at least
n - 7 - 8 k of the item's runs of eight characters (each edit breaks eight at most). Windows below that
bound for every item length can't be within budget of any item, so they are passed over without an
embedding; the bound loses nothing. In the others every start is embedded that lies where a word begins,
and in stretches of more than GAP bytes without such a place (scripts without blanks, packed code) every
character. Exact copies are searched apart from that, wherever they stand, from the item's rarest run.

The benchmark is taken in blocks of bounded size, each of which is broadcast; a document is read once
a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sentimill.llm.arrow import fresh, slices

#: Edits allowed, as a share of the item's length; the recall wanted of the search, and when to stop raising repetitions.
ERROR_SHARE = 0.08
TARGET_RECALL = 0.98
MOST_REPETITIONS = 160
#: Places of an embedding that one repetition hashes, and embeddings (independent walks) the repetitions are dealt over.
SAMPLED, WALKS = 5, 6
#: Characters of the runs counted before the embedding; characters of a block's items; slots of the table of runs.
RUN = 8
#: Bytes of an item embedded as one piece, of the shortest half that a class is cut into, and between word starts before every character is one.
MOST_PIECE, LEAST_HALF, GAP = 400, 64, 16
BLOCK_CHARS = 400_000
TABLE_BITS = 22
JOINED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes | None) -> bytes:
    """ASCII letters lowered, white space runs one blank, none at the ends."""
    return b" ".join(text.lower().split()) if text else b""


def run_hashes(a: np.ndarray) -> np.ndarray:
    """Table slot of the run of RUN bytes that starts at each place."""
    if len(a) < RUN:
        return np.empty(0, np.uint32)
    two = a[:-1].astype(np.uint16) | (a[1:].astype(np.uint16) << 8)
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << 16)
    eight = four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))
    return ((eight * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)


class Walks:
    """CGK embeddings of equal-length byte rows: ``bits[walk, step]`` says for every byte whether the walk moves on."""

    def __init__(self, steps: int, seed: int):
        r = np.random.default_rng(seed)
        self.bits = r.integers(0, 2, (WALKS, steps, 256), np.uint8)
        self.steps = steps

    def embed(self, rows: np.ndarray, walk: int) -> np.ndarray:
        """Character at each step (0 after the end); rows: (m, width) bytes, 0 beyond a row's end."""
        m, width = rows.shape
        flat = np.concatenate([rows, np.zeros((m, 1), np.uint8)], axis=1).ravel()
        base = np.arange(m) * (width + 1)
        at, end = base.copy(), base + width
        out = np.empty((m, self.steps), np.uint8)
        for step in range(self.steps):
            c = flat[at]
            out[:, step] = c
            at = np.minimum(at + self.bits[walk, step][c], end)
        return out


def edit_within(item: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any stretch of the text, and where the first best stretch ends; None above k. Myers' bit vectors."""
    m = len(item)
    if not m:
        return None
    where = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    top, mask = 1 << (m - 1), (1 << m) - 1
    up, down, score, best, end = mask, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & mask)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        up = mh | (~(xv | ph) & mask)
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


class Block:
    """A block of items with all that a task needs to search for them."""

    def __init__(self, items: list[tuple[int, bytes]], error: float = ERROR_SHARE, recall: float = TARGET_RECALL, seed: int = 11):
        self.items = [(i, t) for i, t in items if t]
        self.error = error
        self.runs = [np.unique(run_hashes(np.frombuffer(t, np.uint8))) for _, t in self.items]
        #: (item, offset, length) of all that is embedded
        self.pieces = [(j, p, n) for j, (_, t) in enumerate(self.items) for p, n in _cut(t, 0, len(t), -(-len(t) // MOST_PIECE))]
        self.classes: list[dict] = []
        waiting = list(range(len(self.pieces)))
        while waiting:
            sizes = {e: self.pieces[e][2] for e in waiting}
            halves, edge = [], 0
            while edge <= max(sizes.values()):  # lengths by steps of a quarter: one window size a class
                low = min(n for n in sizes.values() if n >= edge)
                mine = [e for e, n in sizes.items() if low <= n <= low * 1.25]
                c = self._class(mine, low, recall, seed + len(self.classes))
                edge = int(low * 1.25) + 1
                if c["direct"] and low >= 2 * LEAST_HALF:
                    halves += [(j, p, n) for j, off, size in (self.pieces[e] for e in mine) for p, n in _cut(self.items[j][1], off, size, 2)]
                else:
                    self.classes.append(c)
            waiting = list(range(len(self.pieces), len(self.pieces) + len(halves)))
            self.pieces += halves
        self._anchor()
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(self.classes) <= 8 * np.dtype(k).itemsize)
        self.kind = kind
        self.flags: np.ndarray | None = None  # slot to the classes that have a run there; made where it is used

    def _anchor(self) -> None:
        """Slot to the (item, offset) whose rarest run falls there; items shorter than a run apart."""
        slots = [run_hashes(np.frombuffer(t, np.uint8)) for _, t in self.items]
        common = np.bincount(np.concatenate(slots), minlength=1) if slots else np.zeros(1, np.int64)
        self.anchors: dict[int, list[tuple[int, int]]] = {}
        self.tiny = [j for j, h in enumerate(slots) if not len(h)]
        for j, h in enumerate(slots):
            if len(h):
                at = int(common[h].argmin())
                self.anchors.setdefault(int(h[at]), []).append((j, at))
        self.anchored: np.ndarray | None = None

    def _exact(self, texts: list[bytes], first: int, begins: np.ndarray, slots: np.ndarray, hits: np.ndarray, out: dict) -> None:
        """Adds the first place of every item that stands unaltered in texts laid end to end, whose first is text ``first``."""
        if self.anchored is None:
            self.anchored = np.zeros(1 << TABLE_BITS, bool)
            self.anchored[list(self.anchors)] = True
        at = hits[self.anchored[slots[hits]]]
        row = np.searchsorted(begins, at, side="right") - 1
        for p, r, slot in zip((at - begins[row]).tolist(), (row + first).tolist(), slots[at].tolist(), strict=True):
            for j, offset in self.anchors[slot]:
                if (r, j) not in out and p >= offset and texts[r].startswith(self.items[j][1], p - offset):
                    out[r, j] = (0, p - offset + len(self.items[j][1]))
        for j in self.tiny:
            item = self.items[j][1]
            for r in range(first, first + len(begins)):
                if (p := texts[r].find(item)) >= 0:
                    out[r, j] = (0, p + len(item))

    def _flags(self) -> np.ndarray:
        if self.flags is None:
            self.flags = np.zeros(1 << TABLE_BITS, self.kind)
            for i, c in enumerate(self.classes):
                self.flags[c["slots"]] |= self.kind(1 << i)
        return self.flags

    def budget(self, n: int) -> int:
        return int(n * self.error)

    def _class(self, members: list[int], low: int, recall: float, seed: int) -> dict:
        """Window size, run table, least runs, walks, and the items' LSH keys of one class of lengths."""
        r = np.random.default_rng(seed)
        texts = [self.items[j][1][off : off + n] for j, off, n in (self.pieces[e] for e in members)]
        out = {"members": members, "size": low, "span": max(len(t) + self.budget(len(t)) for t in texts)}
        out["slots"] = np.unique(np.concatenate([run_hashes(np.frombuffer(t, np.uint8)) for t in texts]))
        out["least"] = min(len(t) - RUN + 1 - RUN * self.budget(len(t)) for t in texts)
        out["bounded"] = out["least"] >= 1  # very short items have no such bound: all their windows are embedded
        out["walks"] = Walks(2 * low, seed)
        own = self._rows(texts, low)
        altered = self._rows([_alter(t, self.budget(len(t)), r) for t in texts for _ in range(max(1, 200 // len(texts)))], low)
        source = np.repeat(np.arange(len(texts)), max(1, 200 // len(texts)))
        embedded = [(out["walks"].embed(own, w), out["walks"].embed(altered, w)) for w in range(WALKS)]
        found = np.zeros(len(altered), bool)
        out["places"] = []
        while len(out["places"]) < 4 or found.mean() < recall and len(out["places"]) < MOST_REPETITIONS:
            w = len(out["places"]) % WALKS
            places = np.sort(r.choice(out["walks"].steps, SAMPLED, replace=False))
            out["places"].append((w, places))
            a, b = embedded[w]
            found |= (a[source][:, places] == b[:, places]).all(axis=1)
        out["recall"] = float(found.mean())
        out["direct"] = out["recall"] < recall
        out["keys"] = []
        for w, places in out["places"]:
            keys: dict[bytes, list[int]] = {}
            for j, row in zip(members, embedded[w][0][:, places], strict=True):
                keys.setdefault(row.tobytes(), []).append(j)
            out["keys"].append(keys)
        return out

    @staticmethod
    def _rows(texts: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)

    def windows(self, texts: list[bytes], exact: dict) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """Class to (text index, start) of the windows of normalised texts that may be within budget of an item; unaltered items go to ``exact``.

        Texts are laid end to end, some JOINED characters at a time. A stretch over two texts can only
        let a window more in, never keep one out.
        """
        out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < JOINED):
                size += len(texts[last]) + 1
                last += 1
            sizes = np.array([len(t) + 1 for t in texts[first:last]])
            begins = np.cumsum(sizes) - sizes
            a = np.frombuffer(b" ".join(texts[first:last]), np.uint8)
            slots = run_hashes(a)
            flags = self._flags()[slots]
            hits = np.flatnonzero(flags)
            self._exact(texts, first, begins, slots, hits, exact)
            for i, starts in self._starts(a, hits, flags[hits]):
                row = np.searchsorted(begins, starts, side="right") - 1
                out.setdefault(i, []).append((row + first, starts - begins[row]))
            first = last
        return out

    def _starts(self, a: np.ndarray, hits: np.ndarray, kinds: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(class, starts) of the windows to embed in one stretch of text."""
        begins = np.concatenate([[0], np.flatnonzero(a == 32) + 1])  # where a word begins
        gaps = np.diff(begins, append=len(a))
        if (gaps > GAP).any():  # no word begins for long: every character is a start
            mark = np.repeat(gaps > GAP, np.maximum(gaps, 0))[: len(a)] & ((a & 0xC0) != 0x80)
            mark[begins[begins < len(a)]] = True
            begins = np.flatnonzero(mark)
        out = []
        for i, c in enumerate(self.classes):
            least, span = c["least"], c["span"]
            if c["bounded"]:
                at = hits[(kinds & self.kind(1 << i)) != 0]
                if len(at) < least:
                    continue
                head, tail = at[: len(at) - least + 1], at[least - 1 :]
                near = tail - head <= span  # so many runs within one window: it can start anywhere up to the first of them
                if not near.any():
                    continue
                high = head[near]
                low = np.minimum(np.maximum(tail[near] - span, 0), high)
                # intervals of starts, in order; joined where they meet
                new = np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1]])
                low, high = low[new], np.maximum.reduceat(high, np.flatnonzero(new))
                p, q = np.searchsorted(begins, low), np.searchsorted(begins, high, side="right")
                n = q - p
                starts = begins[np.arange(n.sum()) + np.repeat(p - (np.cumsum(n) - n), n)]
            else:
                starts = begins
            starts = starts[starts < len(a)]
            if len(starts):
                out.append((i, starts))
        return out

    def search(self, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) indices to (distance, end in the normalised text), for every item within its budget of some stretch of a text.

        Windows of all the texts are embedded together, some thousands at a time.
        """
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for i, found in self.windows(texts, out).items():
            row = np.concatenate([r for r, _ in found])
            start = np.concatenate([s for _, s in found])
            if self.classes[i]["direct"]:
                self._compare(texts, self.classes[i], row, start, out)
                continue
            for at in range(0, len(row), 8192):
                self._look(texts, self.classes[i], row[at : at + 8192], start[at : at + 8192], out)
        return out

    def _compare(self, texts: list[bytes], c: dict, row: np.ndarray, start: np.ndarray, out: dict) -> None:
        """The exact distance of every item of a class to the stretch of each text that its windows span."""
        for r in np.unique(row).tolist():
            s = start[row == r]
            for j, off, _ in (self.pieces[e] for e in c["members"]):
                item = self.items[j][1]
                k = self.budget(len(item))
                low = max(0, int(s.min()) - off - len(item))
                stretch = texts[r][low : int(s.max()) - off + 2 * len(item) + 2 * k]
                least = len(item) - RUN + 1 - RUN * k
                if out.get((r, j), (1,))[0] == 0 or least > 0 and self._shared_runs(stretch, j) < least:
                    continue
                got = edit_within(item, stretch, k)
                if got and ((r, j) not in out or got[0] < out[r, j][0]):
                    out[r, j] = (got[0], low + got[1])

    def _look(self, texts: list[bytes], c: dict, row: np.ndarray, start: np.ndarray, out: dict) -> None:
        size = c["size"]
        rows = self._rows([texts[r][s : s + size] for r, s in zip(row.tolist(), start.tolist(), strict=True)], size)
        embedded: dict[int, np.ndarray] = {}
        seen: set[tuple[int, int]] = set()
        covered: dict[tuple[int, int], tuple[int, int]] = {}
        for (w, places), keys in zip(c["places"], c["keys"], strict=True):
            if w not in embedded:
                embedded[w] = c["walks"].embed(rows, w)
            sampled = np.ascontiguousarray(embedded[w][:, places]).view(f"V{SAMPLED}").ravel().tolist()
            for i in (i for i, key in enumerate(sampled) if key in keys):
                r, s = int(row[i]), int(start[i])
                for e in keys[sampled[i]]:
                    j, off, _ = self.pieces[e]
                    if (i, e) in seen or out.get((r, j), (1,))[0] == 0:
                        continue
                    seen.add((i, e))
                    item = self.items[j][1]
                    k = self.budget(len(item))
                    low, high = max(0, s - off - k), s - off + len(item) + 2 * k
                    done = covered.get((r, j))
                    if done and done[0] <= low and high <= done[1]:
                        continue
                    low, high = max(0, low - len(item)), high + len(item)  # neighbouring windows too, so they need no look of their own
                    covered[r, j] = (low, high)
                    stretch = texts[r][low:high]
                    least = len(item) - RUN + 1 - RUN * k  # the same bound on runs, for this item alone, before the exact distance
                    if least > 0 and self._shared_runs(stretch, j) < least:
                        continue
                    got = edit_within(item, stretch, k)
                    if got and ((r, j) not in out or got[0] < out[r, j][0]):
                        out[r, j] = (got[0], low + got[1])

    def _shared_runs(self, stretch: bytes, j: int) -> int:
        """Runs of the stretch that item j has, or more where slots collide."""
        low = np.uint32(0xFFFF)
        mine = np.zeros(1 << 16, bool)
        mine[self.runs[j] & low] = True
        return int(np.count_nonzero(mine[run_hashes(np.frombuffer(stretch, np.uint8)) & low]))


def _cut(t: bytes, offset: int, size: int, parts: int) -> list[tuple[int, int]]:
    """(offset, length) of ``parts`` pieces of a stretch of t, cut where a word begins near the even places, or else at a character."""
    ends = [offset]
    for k in range(1, parts):
        even, reach = offset + size * k // parts, size // parts // 4
        near = [p for p in range(even - reach, even + reach + 1) if t[p - 1] == 32]
        at = min(near, key=lambda p: abs(p - even), default=even)
        while t[at] & 0xC0 == 0x80 and at > ends[-1] + 1:
            at -= 1
        ends.append(at)
    ends.append(offset + size)
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _alter(t: bytes, k: int, r: np.random.Generator) -> bytes:
    """A text with k random edits."""
    x = bytearray(t)
    for _ in range(k):
        at = int(r.integers(0, max(1, len(x))))
        kind = int(r.integers(3))
        c = 97 + int(r.integers(26))
        if kind == 0:
            x.insert(at, c)
        elif kind == 1 and len(x) > 1:
            del x[at]
        elif len(x):
            x[at] = c
    return bytes(x)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Block]:
    """The benchmark's items in blocks of at most BLOCK_CHARS characters (one longer item makes a block of its own).

    Items with null id or without a word are left out, as there is nothing to find or to name.
    """
    out, held, size = [], [], 0
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        t = normal(bytes(r["t"]))
        if not t:
            continue
        if held and size + len(t) > BLOCK_CHARS:
            out.append(Block(held))
            held, size = [], 0
        held.append((r["i"], t))
        size += len(t)
    return [*out, Block(held)] if held else out


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_chars, leak_end): one row for every row of ``docs`` and item that it leaks.

    ``distance`` is the least edit distance of the normalised item to a stretch of the normalised
    text, ``leak_end`` the place in the normalised text, in bytes, where the first best stretch ends.
    A map over the documents for each block of the benchmark: nothing is shuffled, so a passage that
    many documents share makes no hot key. Null and empty texts leak nothing; null ids and repeated
    rows are searched row by row; an empty benchmark or table gives no rows; other columns are ignored.
    """
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark):
        part = _searched(rows, block, item_kind, "text", ["doc_id"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("doc_id", F.array().cast(_found(item_kind)).alias("found"))
    return out.select("doc_id", F.explode("found").alias("z")).select("doc_id", "z.*")


def _found(item_kind: str) -> str:
    return f"array<struct<item_id:{item_kind},distance:int,item_chars:int,leak_end:bigint>>"


def flagged(docs: DataFrame, benchmark: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` with the number of benchmark items that each row's text leaks in ``column`` (a name of its own); 0 for null texts. No shuffle, all columns carried."""
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    out = docs.withColumn(column, F.lit(0))
    found = fresh(out, "found")
    for block in blocks(benchmark):
        part = _searched(out, block, item_kind, text, out.columns, found)
        out = part.withColumn(column, F.col(column) + F.size(found)).drop(found)
    return out


def _searched(rows: DataFrame, block: Block, item_kind: str, text: str, keep: list[str], into: str = "found") -> DataFrame:
    """Columns ``keep`` of ``rows``, and ``into``: what each text leaks of the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    item_type = to_arrow_type(rows.sparkSession.range(0).select(F.lit(None).cast(item_kind).alias("i")).schema["i"].dataType)
    kinds = pa.struct([("item_id", item_type), ("distance", pa.int32()), ("item_chars", pa.int32()), ("leak_end", pa.int64())])

    def task(batches):
        block = shared.value
        for batch in batches:
            for part, texts in slices(batch, text):
                found: list[list[dict]] = [[] for _ in texts]
                raw = [normal(t.encode("utf-8", "surrogatepass")) if t else b"" for t in texts]
                for (r, j), (d, end) in sorted(block.search(raw).items()):
                    found[r].append({"item_id": block.items[j][0], "distance": d, "item_chars": len(block.items[j][1]), "leak_end": end})
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(found, pa.list_(kinds))], names=[*keep, into])

    schema = ", ".join([f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep] + [f"`{into}` {_found(item_kind)}"])
    return rows.mapInArrow(task, schema)
