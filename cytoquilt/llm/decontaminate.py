"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may stand in a document with up to e = rate * m edits. Cut into
e + 1 pieces, one piece at least must then stand there unchanged. One automaton finds all
pieces of all items in a pass over each text; around a hit, Myers' bit-parallel algorithm
gives the least edit distance between the item and any stretch of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import checkpoint, field, free_name, table, tune

#: Edits allowed per character of an item.
RATE = 0.08
#: Characters of items in one pass: the bound of what is broadcast. More items take more passes.
PASS_CHARS = 2_000_000
_SPACE = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def normal(text: str) -> str:
    """Lower case, ASCII punctuation and white space as single blanks, one blank at either end; '' if nothing is left."""
    words = text.lower().encode("utf-8", "replace").translate(_SPACE).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} " if words else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    m, n = len(item), min(budget, len(item) - 1) + 1
    return [(m * j // n, item[m * j // n : m * (j + 1) // n]) for j in range(n)]


class Myers:
    """Least edit distance of a pattern to any stretch of a text, one machine word (a Python integer) per column."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(least distance, end of the first stretch that has it)."""
        m, get = self.m, self.eq.get
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for j, c in enumerate(text):
            eq = get(c, 0)
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(h | plus))
            down = plus & h
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            up = (up << 1) & full
            plus = ((down << 1) & full) | (full & ~(v | up))
            minus = up & v
        return best, end


class Matcher:
    """All items of one pass: their automaton of pieces and their patterns."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items, self.budget = [(k, t) for k, t in ((k, normal(x or "")) for k, x in items) if t], []
        self.machines: dict[int, Myers] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            self.budget.append(int(rate * (len(text) - 2)))
            for at, piece in pieces(text, self.budget[n]):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, raw: str) -> list[tuple[object, int, int, str]]:
        """(item id, distance, end, stretch) of the best match of every item that the text holds within its budget."""
        if not self.items or not (text := normal(raw)):
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                starts.setdefault(n, set()).add(end - size + 1 - at)
        out = []
        for n, found in starts.items():
            key, item = self.items[n]
            e, m = self.budget[n], len(item)
            best, end = e + 1, 0
            windows: list[list[int]] = []
            for s in sorted(found):
                if text.startswith(item, max(s, 0)) and s >= 0:
                    best, end = 0, s + m
                    break
                a, b = max(0, s - e), min(len(text), s + m + e)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            if best:
                machine = self.machines.setdefault(n, Myers(item))
                for a, b in windows:
                    d, stop = machine.search(text[a:b])
                    if d < best:
                        best, end = d, a + stop
            if best <= e:
                out.append((key, best, end, text[max(0, end - m - best) : end].strip()))
        return out


_HELD: dict[str, Matcher] = {}


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The operator: (document id, item id, distance, end, stretch) of every item in every row of docs.

    A null or empty text or item matches nothing. Repeated rows of docs or items each give
    their rows; ids are of any type and may be null. Distances count characters of the normal
    form. Columns keep the names of the ids; another column of the same name gets underscores
    before it. Every text is read whole and once per PASS_CHARS of items; documents are not
    shuffled. Several passes follow one another: each is written to the shared folder, and its
    items leave the driver before the next ones come.
    """
    spark = tune(docs.sparkSession)
    names = [id_col]
    for name in (item_id, "distance", "end", "stretch"):
        while name.lower() in {n.lower() for n in names}:
            name = "_" + name
        names.append(name)
    kind = items.schema[item_id].dataType
    kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.string()]
    schema = StructType([field(docs, id_col), *(StructField(n, t) for n, t in zip(names[1:], (kind, IntegerType(), IntegerType(), StringType())))])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias(free_name(docs, "raw")))

    def found(matcher: Matcher, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, cols = [], ([], [], [], [])
        for i, raw in enumerate(batch.column(1)):
            for hit in matcher.find((raw.as_py() or b"").decode("utf-8", "replace")):
                at.append(i)
                for c, v in zip(cols, hit):
                    c.append(v)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, cols, kinds)], names=names) if at else None

    passes, out = _passes(items, item_text), None
    for n in range(passes):
        shared = _some(items, item_id, item_text, n, passes)
        part = rows.mapInArrow(_mapper(shared, rate, found), schema)
        if passes > 1:
            part = checkpoint(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def _passes(items: DataFrame, item_text: str) -> int:
    size = items.agg(F.sum(F.length(F.col(item_text)) + 40)).first()[0] or 0
    return int(-(-size // PASS_CHARS)) or 1


def _some(items: DataFrame, item_id: str, item_text: str, n: int, passes: int):
    """The items of one pass, broadcast: about PASS_CHARS characters."""
    some = items.where(F.pmod(F.xxhash64(F.col(item_text)), F.lit(passes)) == n).select(item_id, item_text).collect()
    return items.sparkSession.sparkContext.broadcast(sorted([(r[0], r[1]) for r in some], key=str))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item; several passes of the items follow one another as in find_leaks."""
    tune(docs.sparkSession)
    helper, schema = free_name(docs, "raw"), docs.schema

    def clean(matcher: Matcher, batch: pa.RecordBatch) -> pa.RecordBatch:
        last = batch.num_columns - 1
        keep = [not matcher.find((raw.as_py() or b"").decode("utf-8", "replace")) for raw in batch.column(last)]
        return batch.select(list(range(last))).filter(pa.array(keep, pa.bool_()))

    passes = _passes(items, item_text)
    for n in range(passes):
        shared = _some(items, item_id, item_text, n, passes)
        docs = docs.withColumn(helper, docs[text_col].cast("binary")).mapInArrow(_mapper(shared, rate, clean), schema)
        if passes > 1:
            docs = checkpoint(docs)
            shared.destroy()
    return docs


def _mapper(shared, rate: float, each):
    """each(matcher, batch) over the batches of a task; a worker builds a pass's matcher once."""
    key = os.urandom(8).hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Matcher(shared.value, rate)
        for batch in batches:
            if (out := each(_HELD[key], batch)) is not None:
                yield out

    return run


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE: dict[str, str] = {}
