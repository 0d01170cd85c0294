"""Substring dedup with repeated-phrase automata.

Rounds over the block exchange:
1. Every window of WINDOW words has an anchor: the run of GRAM words in it with the least
   hash. Equal windows have equal anchors, so a window can recur only if its anchor does.
   Buckets send their distinct anchors (about 2 in WINDOW - GRAM + 2 positions).
2. For windows with a recurring anchor, buckets send 128-bit hashes; shards confirm those
   that start at two places at least.
3. Confirmed windows are joined to passages, each taken from the one place where a bucket
   has it first. Passages are sharded as documents are: a bucket's Aho-Corasick automaton
   holds the anchors of those that its documents can contain, so that no document meets a
   shard in vain. All its documents stream through; from every hit, text and passage are
   compared word by word to both sides, and what agrees for a window or more is covered.
   All further occurrences are found in this way alone, parts of a passage too.
A document's words become a few code points each by a dictionary of the bucket, so that the
automaton steps over words, not letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import KEY16, Buckets, Plain, distinct, places, texts, unpack_keys
from .common import table

WINDOW, GRAM = 35, 16
#: Distinct words whose hashes a worker keeps.
CACHE = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


HASH = WordHash()


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words; bytes.split() splits at 0x20 and 0x09 to 0x0D."""
    words = raw.split()
    return np.fromiter(map(HASH.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def rolling(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of every run of k words: doubling of ordered pairs, mixed at each step."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, out, part, size = 0, None, mix(h + np.uint64(salt)), 1
    while True:
        if k & size:  # append the run of `size` words that starts after the `done` so far
            if out is None:
                out = part
            else:
                n = len(part) - done
                out = mix(out[:n] * ODD + part[done : done + n])
            done += size
        if done == k:
            return out[: len(h) - k + 1]
        n = len(part) - size
        part = mix(part[:n] * ODD + part[size : size + n])
        size *= 2


def least_of(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of w values."""
    size, part = 1, g
    while size * 2 <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[: len(g) - w + 1], part[w - size : w - size + len(g) - w + 1])


class Words:
    """The words of a bucket's documents, end to end, so that numpy steps over all of them at once."""

    def __init__(self, raws: list[bytes], window: int, gram: int):
        parts = [word_hashes(r) for r in raws]
        self.h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.cut = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        self.window, self.gram = window, gram
        n = max(0, len(self.h) - window + 1)
        left = np.repeat(self.cut[1:], np.diff(self.cut)) - np.arange(len(self.h))
        #: whether a window starts here that ends within its document
        self.whole = left[:n] >= window

    def anchors(self) -> np.ndarray:
        """The anchor hash of every window, whole or not."""
        if not len(self.whole):
            return np.zeros(0, np.uint64)
        return mix(least_of(rolling(self.h, self.gram, 1), self.window - self.gram + 1))

    def anchor_places(self) -> np.ndarray:
        """Anchor hashes, once for each place at which a run of words is the anchor of some whole window."""
        if not self.whole.any():
            return np.zeros(0, np.uint64)
        g, w = rolling(self.h, self.gram, 1), self.window - self.gram + 1
        pad = np.zeros(w - 1, np.uint64)
        # of the windows over a place, the greatest least hash: the place's own if it is an anchor at all
        most = ~least_of(~np.concatenate([pad, np.where(self.whole, least_of(g, w), np.uint64(0)), pad]), w)
        return mix(g[most == g])  # least hashes are small; mixed ones spread evenly over shards

    def anchors_of(self, starts: np.ndarray) -> np.ndarray:
        """Places of the anchors (the first of equal ones) of the windows that start there."""
        g, w = rolling(self.h, self.gram, 1), self.window - self.gram + 1
        view, found = np.lib.stride_tricks.sliding_window_view(g, w), []
        for k in range(0, len(starts), 65_536):
            some = starts[k : k + 65_536]
            found.append(some + view[some].argmin(axis=1))
        return np.concatenate(found)

    def windows(self) -> np.ndarray:
        return window_hashes(self.h, self.window)


def window_hashes(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    out = np.empty(max(0, len(h) - window + 1), KEY16)
    out["lo"], out["hi"] = rolling(h, window, 2), rolling(h, window, 3)
    return out


#: A word is a few code points, each from a range of its own of 1 << SHIFT values: matches start at words only,
#: and no node of an automaton has more children than a range has values (they are searched one by one).
SHIFT = 7


def as_codes(rank: np.ndarray, digits: int) -> str:
    """Numbers below 1 << (digits * SHIFT) as a string of so many code points each."""
    low = (1 << SHIFT) - 1
    code = np.empty((len(rank), digits), "<u2")
    for d in range(digits):
        code[:, d] = ((rank >> (SHIFT * (digits - 1 - d))) & low) + 1 + (d << SHIFT)
    return code.tobytes().decode("utf-16-le")


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many first values of two arrays are equal."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        end = min(n, at + step)
        differ = x[at:end] != y[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 4 * step
    return n


class Passages:
    """A shard of the passages: an automaton of their anchors, and the words around each."""

    def __init__(self, words: Words, spans: list[tuple[int, int]]):
        """spans: word ranges of the passages. They may overlap: an anchor counts for each passage with a window that has it."""
        self.words, self.gram, self.side = words, words.gram, words.window - words.gram
        inside = np.zeros(len(words.h), bool)
        for a, b in spans:
            inside[a:b] = True
        vocabulary = np.unique(words.h[inside])
        self.rank = places(vocabulary, words.h) + 1  # 0: a word of no passage
        self.digits = max(1, -(-int(len(vocabulary)).bit_length() // SHIFT))
        self.text = as_codes(self.rank, self.digits)
        starts = np.concatenate([np.arange(a, b - words.window + 1) for a, b in spans])
        of = np.repeat(np.arange(len(spans)), [b - words.window + 1 - a for a, b in spans])
        seeds = np.unique(np.stack([of, words.anchors_of(starts)], axis=1), axis=0)
        self.seeds = [(s, *spans[k]) for k, s in seeds.tolist()]
        where: dict[str, list[tuple[int, int, int]]] = {}
        for seed in self.seeds:
            where.setdefault(self.text[self.digits * seed[0] : self.digits * (seed[0] + self.gram)], []).append(seed)
        self.automaton = ahocorasick.Automaton()
        for code, at in where.items():
            self.automaton.add_word(code, at)
        self.automaton.make_automaton()
        self.around: dict[tuple[int, int, int], np.ndarray] = {}

    def covered(self, a: int, b: int) -> np.ndarray | None:
        """Which words of the document at a to b any passage covers for a window or more (None: none)."""
        out, reach, d = None, {}, self.digits
        for end, seeds in self.automaton.iter(self.text[d * a : d * b]):
            p = a + (end + 1) // d - self.gram
            for s, low, high in seeds if len(seeds) <= 16 else self._likely(p, a, b, seeds):
                if p < reach.get((p - s, low), -1):
                    continue  # within what was compared already
                left = agree(self.rank[max(a, p - (s - low)) : p][::-1], self.rank[low:s][::-1])
                right = agree(self.rank[p + self.gram : b], self.rank[s + self.gram : high])
                reach[p - s, low] = p + self.gram + right
                if left + self.gram + right >= self.words.window:
                    if out is None:
                        out = np.zeros(b - a + 1, np.int32)
                    out[p - left - a] += 1
                    out[p + self.gram + right - a] -= 1
        return None if out is None else np.cumsum(out[:-1]) > 0

    def _window(self, p: int, low: int, high: int, pad: int) -> np.ndarray:
        """Words so far around an anchor at p that a window over it can reach."""
        out = np.full(2 * self.side + self.gram, pad)
        x, y = max(low, p - self.side), min(high, p + self.gram + self.side)
        out[x - (p - self.side) : y - (p - self.side)] = self.rank[x:y]
        return out

    def _likely(self, p: int, a: int, b: int, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of many passages with one anchor, those that agree with the text at p for a window at least: compared at once."""
        if seeds[0] not in self.around:
            self.around[seeds[0]] = np.stack([self._window(*s, -1) for s in seeds])
        same = self.around[seeds[0]] == self._window(p, a, b, -2)
        left, right = ~same[:, : self.side][:, ::-1], ~same[:, self.side + self.gram :]
        n = np.where(left.any(axis=1), left.argmax(axis=1), self.side) + np.where(right.any(axis=1), right.argmax(axis=1), self.side)
        return [seeds[i] for i in np.flatnonzero(n >= self.side)]


def locate(words: Words, confirmed: np.ndarray) -> list[np.ndarray | None]:
    """Covered words of each document (None: none)."""
    n_docs = len(words.cut) - 1
    out: list[np.ndarray | None] = [None] * n_docs
    if not len(confirmed) or not words.whole.any():
        return out
    at = np.where(words.whole, places(confirmed, words.windows()), -1)
    seen = np.flatnonzero(at >= 0)
    if not len(seen):
        return out
    first = np.zeros(len(at), bool)
    first[seen[np.unique(at[seen], return_index=True)[1]]] = True
    spans = [(a, b + words.window - 1) for a, b in runs(first)]
    shard = Passages(words, spans)
    return [shard.covered(int(words.cut[i]), int(words.cut[i + 1])) for i in range(n_docs)]


def dedup_passages(docs: DataFrame, each: Callable, schema: StructType, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The operator: each(words as bytes, covered flags or None) gives the values of `schema` for a document.

    A null or empty text has no words. Every occurrence of a recurring window counts, within
    one document too, and repeated rows are repeated texts like any others.
    """
    b = Buckets(docs, id_col, text_col, carry)

    def anchors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, n, _ = distinct(Words(list(texts(t)), window, gram).anchor_places())
        return keys, np.minimum(n, 2)

    def windows(t: pa.Table, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        if not answers:
            return np.zeros(0, KEY16), np.zeros(0, np.int64)
        hot = np.sort(np.concatenate([unpack_keys(x["keys"]) for x in answers]))
        words = Words(list(texts(t)), window, gram)
        mine = words.whole & (places(hot, words.anchors()) >= 0)
        keys, n, _ = distinct(words.windows()[mine])
        return keys, np.minimum(n, 2)

    def recur(keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, int]:
        return (total >= 2).astype(np.int64), 0

    def tell(t: pa.Table, answers: list[dict]) -> list:
        raws = list(texts(t))
        covered: list = [None] * len(raws)
        if answers:
            confirmed = np.concatenate([unpack_keys(x["keys"], KEY16) for x in answers])
            covered = locate(Words(raws, window, gram), confirmed[np.argsort(confirmed["lo"], kind="stable")])
        return list(zip(*(each(raw.split(), c) for raw, c in zip(raws, covered))))

    first = b.exchange(anchors, recur)
    return b.meet(b.exchange(windows, recur, Plain(KEY16), after=first), tell, schema)


DIGEST = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


def digest(words: list[bytes], covered: np.ndarray | None) -> tuple:
    gone = 0
    n = len(words)
    if covered is not None:
        gone = int(covered.sum())
        words = [w for w, c in zip(words, covered.tolist()) if not c]
    return n, gone, hashlib.sha256(b" ".join(words)).hexdigest()


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"), digest, DIGEST)


ORACLE = {
    "op3_substring_dedup": """
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
x as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as i from d),
s as (select doc_id, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
h as (select doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) as k from s),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as c from h) where c > 1),
e as (select doc_id, i, 1 as v from r union all select doc_id, i + 35, -1 from r),
ev as (select doc_id, i, sum(v) as v from e group by 1, 2),
c as (select x.doc_id, x.i, x.word, sum(coalesce(ev.v, 0)) over (partition by x.doc_id order by x.i) > 0 as gone
      from x left join ev on ev.doc_id = x.doc_id and ev.i = x.i)
select d.doc_id, coalesce(len(d.w), 0)::bigint as n_words, coalesce(g.n_removed, 0)::bigint as n_removed, sha256(coalesce(g.kept, '')) as kept_sha256
from d left join (select doc_id, sum(gone::int) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from c group by doc_id) g using (doc_id)"""
}
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
