"""Token counts under a sentencepiece BPE vocabulary, most of them by whole-token shortcut.

A text becomes units that no merge can leave. A vocabulary string never holds a space mark after
another character, and never a newline, so a merge cannot cross from a word into the following space
or over a newline. ``prove`` checks both facts of the vocabulary, then encodes every vocabulary
string alone as the unit it stands for: those that give one token are counted by lookup, and only the
other units are merged. Unit counts add up to the whole text's count.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimill.llm.arrow import map_texts

SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+| +|\n")
#: Merged units that a task remembers before it starts afresh.
MEMO_UNITS = 300_000


def _alone(processor, unit: str) -> int:
    """Tokens of one unit, by the library. It puts a space mark before every text; a newline takes that mark for units that have none."""
    newline = len(processor.encode("a\n")) - len(processor.encode("a"))
    if unit == "\n":
        return newline
    if unit == " ":
        return len(processor.encode("\n")) - newline
    if unit[0] == " ":
        return len(processor.encode(unit[1:]))
    return len(processor.encode("\n" + unit)) - len(processor.encode("\n"))


def prove(model_file: str) -> frozenset[str]:
    """Units that are provably one token; raises if the vocabulary breaks what the unit cut relies on."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    single = set()
    for i in range(p.get_piece_size()):
        if p.is_byte(i) or p.is_control(i) or p.is_unknown(i):
            continue
        piece = p.id_to_piece(i).replace(SPACE, " ")
        if "\n" in piece or re.search("[^ ] ", piece):
            raise ValueError(f"vocabulary string {piece!r} crosses a unit's end")
        if _alone(p, piece) == 1:
            single.add(piece)
    if _alone(p, "\n") == 1:
        single.add("\n")
    return frozenset(single)


class _Counts(dict):
    """Unit to tokens: proven units from the start, others merged when first met."""

    def __init__(self, processor, single):
        super().__init__(dict.fromkeys(single, 1))
        self.processor, self.single = processor, single

    def __missing__(self, unit: str) -> int:
        n = _alone(self.processor, unit)
        if len(unit) <= 64:
            if len(self) > len(self.single) + MEMO_UNITS:
                self.clear()
                self.update(dict.fromkeys(self.single, 1))
            self[unit] = n
        return n


def count_text(counts: dict, text: str | None) -> int:
    """Tokens of a whole text; 0 for null or empty."""
    if not text:
        return 0
    return sum(map(counts.__getitem__, UNIT.findall(" " + text.replace(SPACE, " "))))


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A map over the rows: no shuffle, memory of one Arrow batch. Null and empty texts count 0 bytes
    and 0 tokens; repeated rows and null ids are counted row by row; other columns are ignored.
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), prove(model_file)))  # executors need not have the file

    def start():
        import sentencepiece

        model, single = shared.value
        counts = _Counts(sentencepiece.SentencePieceProcessor(model_proto=model), single)
        return lambda texts: {"n_tokens": pa.array([count_text(counts, t) for t in texts], pa.int64())}

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("text")
    )
    return map_texts(rows, "text", "n_tokens long", start).withColumn("over_limit", F.col("n_tokens") > limit)
