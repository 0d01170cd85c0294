"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is split by the tokenizer's pattern; each match is encoded by halves: the two
halves are encoded recursively and joined by re-encoding a window around the seam, which
grows until the pairs at its two borders are stable. A pair of tokens is stable if the
merges leave the pair as it is when run on its bytes alone. A sequence whose neighbours
are all stable is what the merges make of the whole: were there a first merge over a
border, the same merges inside the two tokens would have led to it in the pair alone.
So the join is exact, and associative. Decoding concatenates bytes up a tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import field, table, tune

#: Bytes up to which a piece is encoded without being halved.
LEAF = 24
#: Distinct pieces whose ids a Python worker keeps.
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The merges run on all of piece: lowest rank first, leftmost among equals."""
        n, ranks = len(piece), self.ranks
        if n < 2:
            return [piece] if piece else []
        if n <= LEAF:
            parts = [piece[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ranks.get(piece[i : end[j]]) != r:
                continue
            alive[j], end[i], after[i] = 0, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := ranks.get(piece[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return [piece[i : end[i]] for i in range(n) if alive[i]]

    def stable(self, a: bytes, b: bytes) -> bool:
        found = self._stable.get((a, b))
        if found is None:
            if len(self._stable) >= CACHE:
                self._stable.clear()
            found = self._stable[a, b] = self.merge(a + b) == [a, b]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the concatenation, from the encodings of its halves."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            mid = self.merge(b"".join(left[len(left) - a :]) + b"".join(right[:b]))
            held = a == len(left) or self.stable(left[-a - 1], mid[0])
            kept = b == len(right) or self.stable(mid[-1], right[b])
            if held and kept:
                return left[: len(left) - a] + mid + right[b:]
            a, b = a * (1 if held else 2), b * (1 if kept else 2)

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, word: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is itself a token stays whole."""
        found = self._pieces.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            found = (whole,) if whole is not None else tuple(self.ranks[x] for x in self.tree(raw))
            if len(word) <= 64:
                if len(self._pieces) >= CACHE:
                    self._pieces.clear()
                self._pieces[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        get, piece = self._pieces.get, self.piece
        return list(chain.from_iterable([get(w) or piece(w) for w in self.pattern.findall(text)]))

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree of fixed fan-out."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 4096:
            level = [b"".join(level[i : i + 4096]) for i in range(0, len(level), 4096)]
        return b"".join(level)


_HELD: dict[tuple, TreeBPE] = {}


def _codec(key: tuple, ranks, pattern: str) -> TreeBPE:
    """One codec per Python worker, kept between tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = TreeBPE(ranks.value, pattern)
    return _HELD[key]


def map_encoded(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, each: Callable, schema: StructType) -> DataFrame:
    """Encode every text and decode it again; each(ids, decoded) gives the values of `schema` for a document.

    A null text counts as empty; bytes that are no UTF-8 become U+FFFD. Reads the two named
    columns only, needs no shuffle, and sends the ranks (about 1 MB, fixed) by broadcast.
    Repeated rows each give a row.
    """
    spark = tune(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key, names = (ranks_path, pattern), [f.name for f in schema.fields]
    arrow = pa.schema([(n, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[schema[n].dataType.simpleString()]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, ranks, pattern)
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                raw = raw.as_py()
                ids = codec.encode(raw.decode("utf-8", "replace")) if raw else []
                rows.append(each(ids, codec.decode(ids)))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, f.type) for c, f in zip(cols, arrow)], names=[id_name, *names])

    id_name = id_col
    out = StructType([field(docs, id_col), *schema.fields])
    return docs.select(id_col, docs[text_col].cast("binary").alias("raw")).mapInArrow(run, out)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: rows (id, ids array<int>, decoded binary) for every document."""
    from pyspark.sql.types import BinaryType

    schema = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return map_encoded(docs, id_col, text_col, ranks_path, pattern, lambda ids, raw: (ids, raw), schema)


def digest(ids: list[int], decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return map_encoded(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest, DIGEST)


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
