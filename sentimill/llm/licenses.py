"""License scans: TF-IDF cosine to licence templates, then inheritance from the nearest directory.

Templates are header statements, whole licence files, and the opening blocks of the long licences, as
sparse TF-IDF vectors. A stretch of a text as long as a template, laid so that a mark of the
template (a rarer term) stands at its place, states the licence if its cosine to the template is high enough; lines and
comment signs don't matter, so wrapped and embedded statements count. Where a template names a version,
the stretch must name it too. A text most of which is stated, that as a whole is like a licence's file,
or that opens like one, is a licence file and speaks for its directory. A file that states nothing
itself takes the licence of the nearest directory above it that a licence file speaks for, by joins on
path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentimill.llm.arrow import fresh, slices
from sentimill.operators.components import join_unique
from sentimill.llm.license_texts import FILES, HEADERS, OPENINGS
from sentimill.sources.shared import cut

#: A term is a run of letters or digits, dots and signs within allowed ("2.0", "by-nc").
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
_TERM = re.compile(TERM)
#: A stretch states a licence from this cosine; a file is a licence file from this share of stated terms, or if it opens like one within so many terms.
LEAST_COSINE, LICENCE_FILE_SHARE, OPENING_TERMS = 0.75, 0.5, 25


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower().replace("licence", "license"))


class Template:
    def __init__(self, licence: str, kind: str, text: str):
        self.licence, self.kind, self.terms = licence, kind, terms(text)
        self.tf = Counter(self.terms)
        self.needs: list[frozenset[str]] = []  # of each set a stretch holds a term
        number = licence.rsplit("-", 1)[-1]
        if self.terms[0] == "spdx-license-identifier":
            self.needs.append(frozenset(self.terms[1:]))
        elif number[:1].isdigit() and number[:1] in {t.lstrip("v")[:1] for t in self.terms if t.lstrip("v")[:1].isdigit()}:
            short = number.removesuffix(".0")
            self.needs.append(frozenset({number, short, f"v{number}", f"v{short}"}))
        if "license" in self.tf:
            self.needs.append(frozenset({"license", "licenses", "licensed"}))

    def weigh(self, idf: dict[str, float]) -> None:
        self.weight = unit({t: damped(n) * idf[t] for t, n in self.tf.items()})
        # a stretch at LEAST_COSINE shares terms of at least its square in squared weight; so of the marks it holds what the other
        # terms can't make up for, and at least so many of them. Long words and numbers are marks, as they are rare in other texts.
        mass = {t: w * w for t, w in self.weight.items()}
        rarity = lambda t: len(t) + 6 * (len(t) > 2 and any(c.isdigit() for c in t))
        self.marks: set[str] = set()
        held = 0.0
        for t in sorted(mass, key=lambda t: (-rarity(t), t)):
            if rarity(t) < 6 and held > 1 - LEAST_COSINE**2:
                break
            self.marks.add(t)
            held += mass[t]
        wanted, self.least = LEAST_COSINE**2 - (1 - held) - 1e-9, 0
        for m in sorted((mass[t] for t in self.marks), reverse=True):
            if wanted <= 0:
                break
            wanted -= m
            self.least += 1
        self.least = max(1, self.least)


def damped(n: int) -> float:
    return 1 + math.log(n)


def unit(weights: dict[str, float]) -> dict[str, float]:
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()}


def templates() -> tuple[list[Template], dict[str, float], float]:
    """All templates, weighed; the terms' idf over them; the idf of a term that none has."""
    out = [Template(lic, kind, t) for kind, group in (("header", HEADERS), ("opening", OPENINGS), ("file", FILES)) for lic, ts in group.items() for t in ts]
    df = Counter(t for x in out for t in x.tf)
    idf = {t: math.log((1 + len(out)) / (1 + d)) + 1 for t, d in df.items()}
    for x in out:
        x.weigh(idf)
    return out, idf, math.log(1 + len(out)) + 1


class Scanner:
    """Cosines of stretches of a text with all templates, for one task."""

    def __init__(self):
        self.templates, self.idf, self.rare = templates()
        self.marked: dict[str, list[int]] = {}  # mark to the templates that it marks
        for k, x in enumerate(self.templates):
            for t in sorted(x.marks):
                self.marked.setdefault(t, []).append(k)
        self.marks = frozenset(self.marked)

    def cosine(self, k: int, tf: Counter) -> float:
        """Of the stretch with these terms to a template; 0 if it lacks what the template needs."""
        x = self.templates[k]
        if not all(any(t in tf for t in need) for need in x.needs):
            return 0.0
        norm = dot = 0.0
        for t, n in tf.items():
            w = damped(n) * self.idf.get(t, self.rare)
            norm += w * w
            dot += w * x.weight.get(t, 0.0)
        return round(dot / math.sqrt(norm), 6) if norm else 0.0

    def text(self, text: str | None) -> tuple[str, float, int, int, bool] | None:
        """(licence, cosine, stated terms, terms, whether it is a licence file) of a text with a statement: that of its best stretch; ties go to the longer template, then the later name."""
        found = terms(text or "")
        near = Counter(k for t in self.marks.intersection(found) for k in self.marked[t])
        near = {k for k, n in near.items() if n >= self.templates[k].least}
        if not near:
            return None
        starts = self.starts(found, near)
        stated, best, opens = bytearray(len(found)), None, False
        for k, start in sorted(starts):
            x = self.templates[k]
            stretch = found[start : start + len(x.terms)]
            c = self.cosine(k, Counter(stretch))
            if c >= LEAST_COSINE:
                stated[start : start + len(stretch)] = b"\1" * len(stretch)
                best = max(best or (0.0,), (c, len(x.terms), x.licence))
                opens |= x.kind == "opening" and start <= OPENING_TERMS
        for k, x in enumerate(self.templates):  # whole files; one much longer than the template can't be like it
            if x.kind == "file" and k in near and len(found) <= 4 * len(x.terms):
                c = self.cosine(k, Counter(found))
                if c >= LEAST_COSINE:
                    opens, best = True, max(best or (0.0,), (c, len(x.terms), x.licence))
        if best is None:
            return None
        n = sum(stated)
        return best[2], best[0], n, len(found), opens or n >= LICENCE_FILE_SHARE * len(found)


    def starts(self, found: list[str], near: set[int]) -> set[tuple[int, int]]:
        """(template, start) of the stretches in which enough marks stand, laid so that one of them stands at its place."""
        at: dict[int, list[int]] = {}
        for q, t in enumerate(found):
            for k in self.marked.get(t, ()):
                if k in near:
                    at.setdefault(k, []).append(q)
        out = set()
        for k, places in at.items():
            x = self.templates[k]
            m, dense = x.least - 1, set()
            for i in range(len(places) - m):
                if places[i + m] - places[i] < len(x.terms):
                    dense.update(places[i : i + m + 1])
            for q in dense:
                out.update((k, max(0, q - p)) for p, t in enumerate(x.terms) if t == found[q])
        return out


def statements(files: DataFrame, text: str) -> DataFrame:
    """The columns of ``files`` but the text, and what each row's text states: licence, cosine, is_file (null, null, false where nothing).

    Stretches without enough of the terms that a statement must hold are passed over before anything is
    weighed; the bound behind it is exact. A map over the rows: no shuffle.
    """
    carried = [f for f in files.schema.fields if f.name != text]
    names = [f.name for f in carried]

    def task(batches):
        scanner = Scanner()
        for batch in batches:
            for part, texts in slices(batch, text):
                found = [scanner.text(t) for t in texts]
                new = [pa.array([z and z[i] for z in found], t) for i, t in ((0, pa.string()), (1, pa.float64()))] + [pa.array([bool(z and z[4]) for z in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + new, names=[*names, "licence", "cosine", "is_file"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return files.mapInArrow(task, f"{kinds}, licence string, cosine double, is_file boolean")


def ancestors(directory: Column) -> Column:
    """All directories from ``directory`` up to the top, as (depth, dir), the top being ''."""
    steps = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("dir")))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """path, licence, origin ('file', 'directory' or 'none'), origin_dir, cosine for every row of ``files``, and the columns to ``carry``.

    ``licence`` is that of the row's own best statement, else of the nearest directory at or above its path
    with a licence file (ties: the licence that most of its licence files state, then by name), else
    null. Files that state one licence and lie below another keep their own. Null and empty texts
    state nothing; rows with a null path may state a licence, but inherit none and hand none on. Rows that
    share a path (or are repeated) each keep their row and their own statement. Paths are first cut to
    distinct directories, so a directory that holds a third of all files is resolved once. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias(fresh(files, "_text")), *carry)
    placed = cut(statements(rows, fresh(files, "_text")).withColumn("dir", directory_of(F.col("path"))))
    owners = (
        placed.where(F.col("is_file") & F.col("dir").isNotNull())
        .groupBy("dir", "licence")
        .count()
        .groupBy("dir")
        .agg(F.max_by(F.col("licence"), F.struct(F.col("count"), F.col("licence"))).alias("dir_licence"))
    )
    dirs = placed.where(F.col("dir").isNotNull()).select("dir").distinct()
    up = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("a"))
    resolved = (
        up.join(owners.withColumnRenamed("dir", "owner"), up["a"]["dir"] == F.col("owner"))
        .groupBy("dir")
        .agg(F.max_by(F.struct(F.col("owner"), F.col("dir_licence")), F.col("a")["depth"]).alias("r"))
        .select("dir", F.col("r")["owner"].alias("origin_dir"), F.col("r")["dir_licence"].alias("dir_licence"))
    )
    return join_unique(placed, cut(resolved), "dir", "left").select(
        *carry,
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(F.col("licence").isNotNull(), "file").when(F.col("dir_licence").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("origin_dir")).alias("origin_dir"),
        "cosine",
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / a folder of a hundred ids / id; ids that are no numbers get one of 1,000 folders by their hash. Null parts are written as '_'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    numeric = isinstance(docs.schema["doc_id"].dataType, T.NumericType)
    folder = F.coalesce((F.floor(F.col("doc_id") / 100) if numeric else F.pmod(F.xxhash64("doc_id"), F.lit(1000))).cast("string"), F.lit("_"))
    folder = F.when(F.col("doc_id").isNotNull(), folder).otherwise("_")
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), folder, part("doc_id")).alias("path"), "text")


def document_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, origin, origin_dir, cosine for every document, placed as ``document_files`` says."""
    return scan(document_files(docs), carry=("doc_id",))
