"""Benchmark passages in documents, by q-gram counts in diagonal bands and banded alignment.

A passage matches a region of a document if at most a share ERRORS of its characters has to be
edited.  Such a region holds at least ``length - q + 1 - q * edits`` of the passage's q-grams
(the q-gram lemma), on diagonals that differ by no more than ``edits``.  So shared q-grams are
counted in diagonal bands that overlap by half: every such region fills one band.  Bands that
reach the count are aligned within their diagonals, which decides.

Texts are compared in lower case, with everything but letters and digits taken as one blank.
A benchmark item is looked for as a whole, in parts of half its length, and in parts of LONGEST_PART
characters (or half of a shorter item) that start at steps of half their edit budget, so that a
longer piece of it is found as well, wherever it is cut out.  An item of fewer than q characters has
to stand in the document exactly, as whole words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import rows_of
from punctual.llm.hashing import powers
from punctual.session import staged

Q = 8
ERRORS = 0.08
#: Parts are not cut shorter than this; a shorter item is one part.
SHORTEST_PART = 64
#: A piece of so many characters is enough of an item, however long.
LONGEST_PART = 200
#: Benchmark characters that travel to the tasks at once; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
#: Characters of a document that are compared at once, and how far pieces overlap (twice the longest item).
PIECE = 1 << 17

FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("share", T.DoubleType()),
])

_alnum: dict[str, np.ndarray] = {}


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text as it is compared, and where each stands in the text."""
    if "table" not in _alnum:
        # beyond these blocks every character counts as a letter
        _alnum["table"] = np.array([chr(c).isalnum() for c in range(0x3000)])
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.ones(len(codes), bool)
    known = codes < 0x3000
    word[known] = _alnum["table"][codes[known]]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first other character after a letter or digit is the blank
    at = np.flatnonzero(keep)
    return np.where(word[at], codes[at], np.uint32(32)), at


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each place on."""
    n = len(codes) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = powers(len(codes))
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up, out=prefix[1:])
    grams = prefix[q:] - prefix[:-q]
    grams *= down[:n]
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return grams


def budget(length: int) -> int:
    """Edits allowed, no more than leave one q-gram to count."""
    return max(0, min(math.floor(ERRORS * length), (length - Q) // Q))


@dataclass
class Index:
    """Benchmark items; their q-gram hashes, each with the first and the number of its (item, place)
    entries; a bit table that most other hashes fail; what a part of an item needs; and the items of
    fewer than q characters, by length and hash."""

    ids: list[int]
    codes: list[np.ndarray]
    hashes: np.ndarray
    first: np.ndarray
    many: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    stripe: np.ndarray
    need: np.ndarray
    longest: int
    short: dict[int, dict[int, list[int]]]


def index_of(items: list[tuple[int, str]]) -> Index:
    codes = [normalized(t)[0] for _, t in items]
    short: dict[int, dict[int, list[int]]] = {}
    for k, c in enumerate(codes):
        word = c[:-1] if len(c) and c[-1] == 32 else c
        if len(c) < Q and len(word):
            codes[k] = word
            short.setdefault(len(word), {}).setdefault(int(gram_hashes(word, len(word))[0]), []).append(k)
    grams = [gram_hashes(c) for c in codes]
    hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
    item = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)] + [np.empty(0, np.int64)]).astype(np.int64)
    place = np.concatenate([np.arange(len(g)) for g in grams] + [np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    seen = np.zeros(1 << 22, bool)
    seen[hashes >> np.uint64(42)] = True
    lengths = [len(c) for c in codes]
    stripe = np.array([budget(n) + 1 for n in lengths], np.int64)
    need = np.array([min([n, *(m - Q + 1 - Q * budget(m) for m in {b - a for a, b in parts_of(n)} if m >= Q)]) for n in lengths], np.int64)
    hashes, first, many = np.unique(hashes[order], return_index=True, return_counts=True)
    return Index([i for i, _ in items], codes, hashes, first, many, item[order], place[order], seen, stripe, need, max([0, *lengths]), short)


def parts_of(length: int) -> Iterator[tuple[int, int]]:
    """The whole item, its parts of half the length at every quarter, and its parts that are enough."""
    yield 0, length
    half = max(SHORTEST_PART, length // 2)
    if half < length:
        enough = min(half, LONGEST_PART)
        found = []
        for size, step in ((half, max(1, half // 2)), (enough, max(1, budget(enough) // 2))):
            found += [(s, s + size) for s in [*range(0, length - size, step), length - size]]
        yield from dict.fromkeys(found)


def align(part: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Best match of the part in the text on the diagonals low..high: (edits, start, end).

    Row by row over the part; column j of row i stands for text place i + low + j.  The match may
    start on any of the diagonals.  None if it takes more than ``edits``.
    """
    width = high - low + 1
    cost = np.zeros(width, np.int64)
    begin = np.arange(low, high + 1)
    far = edits + 1
    steps = np.arange(width)
    outside = np.iinfo(np.int32).max
    for i, c in enumerate(part):
        at = i + low + steps
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == c
        new = cost + ~same
        new[~inside] = outside
        came = begin.copy()
        # a character of the part that the text lacks: from the next diagonal of the row before
        skip = np.append(cost[1:] + 1, outside)
        better = skip < new
        new[better] = skip[better]
        came[better] = np.append(begin[1:], 0)[better]
        # characters of the text that the part lacks: along the row
        run = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == run, steps, 0))
        better = run + steps < new
        new[better] = (run + steps)[better]
        came[better] = came[source[better]]
        cost, begin = new, came
        if cost.min() >= far:
            return None
    best = int(np.argmin(cost))
    if cost[best] > edits:
        return None
    return int(cost[best]), max(0, int(begin[best])), min(len(text), len(part) + low + best)


def _bands(text: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """Matches (item, edits, start, end, matched length of the item) in one piece of normalised text."""
    if not len(index.hashes):
        return
    grams = gram_hashes(text)
    at = np.flatnonzero(index.seen[grams >> np.uint64(42)])
    grams = grams[at]
    found = np.minimum(np.searchsorted(index.hashes, grams), len(index.hashes) - 1)
    known = index.hashes[found] == grams
    at, found = at[known], found[known]
    if not len(at):
        return
    lo, many = index.first[found], index.many[found]
    entry = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    item, place, pos = index.item[entry], index.place[entry], np.repeat(at, many)
    # what no part of an item can do without: enough hits in two neighbouring stripes of diagonals
    stripe = item * (1 << 40) + np.floor_divide(pos - place, index.stripe[item]) + (1 << 39)
    keys, hits = np.unique(stripe, return_counts=True)
    beside = np.searchsorted(keys, keys + 1)
    beside_hits = np.where(keys[np.minimum(beside, len(keys) - 1)] == keys + 1, hits[np.minimum(beside, len(keys) - 1)], 0)
    for k in np.unique((keys >> 40)[hits + beside_hits >= index.need[keys >> 40]]):
        mine = item == k
        for since, upto in parts_of(len(index.codes[k])):
            got = list(_part_matches(text, index.codes[k], int(k), since, upto, place[mine], pos[mine]))
            yield from got
            if got and upto - since == len(index.codes[k]):
                break  # the whole item was found


def _part_matches(text, codes, k, since, upto, place, pos):
    length = upto - since
    edits = budget(length)
    need = length - Q + 1 - Q * edits
    here = (place >= since) & (place + Q <= upto)
    if length < Q or here.sum() < need:
        return
    diagonal = pos[here] - (place[here] - since)
    half = edits + 1
    first = np.floor_divide(diagonal, half)
    # a hit counts in the band that starts in its half and in the one before it
    band = np.concatenate((first, first - 1))
    gram = np.concatenate((place[here], place[here]))
    pairs = np.unique(band * (1 << 32) + gram) >> 32
    found, count = np.unique(pairs, return_counts=True)
    last = -1
    part = codes[since:upto]
    for start in found[count >= need]:
        low = int(start) * half
        inside = diagonal[(diagonal >= low) & (diagonal < low + 2 * half)]
        values, often = np.unique(inside, return_counts=True)
        at = int(values[np.argmax(often)])  # an exact copy stands on one diagonal
        if at >= 0 and np.array_equal(text[at : at + length], part):
            got = 0, at, at + length
        else:
            got = align(part, text, low, low + 2 * half - 1, edits)
        if got is not None and got[1] > last:
            last = got[1]
            yield k, got[0], got[1], got[2], length


def _exact(text: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """Matches (item, start, end) of the items of fewer than q characters, as whole words.

    Beyond the blocks that ``normalized`` knows words are not told apart, so an item may begin or end anywhere.
    """
    letter = (text != 32) & (text < 0x3000)
    for n, items in index.short.items():
        if len(text) < n:
            continue
        grams = gram_hashes(text, n)
        for at in np.flatnonzero(np.isin(grams, np.array(list(items), np.uint64))):
            end = at + n
            if at > 0 and letter[at - 1] and letter[at] or end < len(text) and letter[end] and letter[end - 1]:
                continue
            for k in items[int(grams[at])]:
                if np.array_equal(text[at:end], index.codes[k]):
                    yield k, int(at), int(end)


def document_matches(text: str | None, index: Index) -> list[tuple[int, int, int, int, float]]:
    """Rows (item_id, start, end, edits, share), one for each item found in a text.

    ``share`` is the largest part of the item that matched, ``start``, ``end`` (code points) and
    ``edits`` belong to that match; among equals the fewest edits, then the first place.
    """
    if not text or not index.codes:
        return []
    codes, at = normalized(text)
    overlap = 2 * index.longest + 64
    best: dict[int, tuple[int, int, int, int]] = {}
    step = max(PIECE, 2 * overlap)
    for lo in range(0, max(1, len(codes)), step):
        piece = codes[lo : lo + step + overlap]
        for k, edits, start, end, length in _bands(piece, index):
            row = (-length, edits, int(at[lo + start]), int(at[lo + max(start, end - 1)]) + 1)
            best[k] = min(row, best.get(k, row))
        if index.short:
            since = max(0, lo - 1)  # with the characters beside, which tell whole words
            for k, start, end in _exact(codes[since : lo + step + Q], index):
                if lo <= since + start < lo + step:
                    row = (start - end, 0, int(at[since + start]), int(at[since + end - 1]) + 1)
                    best[k] = min(row, best.get(k, row))
    return [(index.ids[k], s, e, d, -n / len(index.codes[k])) for k, (n, d, s, e) in sorted(best.items())]


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits, share) for every document and item that match.

    The benchmark goes to the tasks in blocks of at most about BLOCK_CHARS characters, one pass
    over the documents for each, so its size is no limit; a document is never shuffled.  What several
    passes find is staged one by one, so the driver holds one block.  Null and empty texts match
    nothing, nor do items without letters and digits.  Items without an id are
    left out; equal items are found under each of their ids.  Repeated rows are reported each.
    Empty tables give an empty result; other columns are not read.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(
        F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    result = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).distinct().orderBy("id", "text")
        index = index_of([(r["id"], r["text"]) for r in part.collect()])
        found = rows_of(source, ["doc_id", "text"], FIELDS, _finder(index))
        found = staged(found) if blocks > 1 else found
        result = found if result is None else result.union(found)
    return result


def _finder(index: Index):
    return lambda key, value: [(key, *row) for row in document_matches(value, index)]


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, in which no benchmark item was found.

    Decided row by row, so repeated rows and rows without an id are judged by their own text.
    """
    items = benchmark.where(F.length("text") > 0).select(F.lit(0).cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).distinct().orderBy("text")
        index = index_of([(r["item_id"], r["text"]) for r in part.collect()])
        docs = _without(docs, index, text)
        docs = staged(docs) if blocks > 1 else docs
    return docs


def _without(docs: DataFrame, index: Index, text: str) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            column = batch.column(text)
            keep = [not document_matches(column[i].as_py(), index) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
