"""Byte strings of a given length that occur twice: suffixes sorted no deeper than that length.

A radix sort of all suffixes by their first ``window`` bytes would leave equal windows in one
group.  The passes here go by digits of many bytes and look only at suffixes that can still meet:

1. Every window has one digit of ``window / 2.5`` bytes, the one of least hash, that is the same for
   equal windows wherever they stand.  Such a digit (an anchor) is shared by about a hundred
   windows.  Grouping anchors by their digit is the first pass; groups of one end there.
2. Anchors whose whole surroundings (all windows around the digit) are equal to others' are settled:
   all their windows are repeated.
3. The others split their group further.  A small group sorts its windows at once, per offset to the
   digit; a large one is divided again and again: the offsets in two halves, each half grouped by
   the bytes that its windows have in common, which is the next, longer digit.

Equal groups at full length are exactly the repeated windows.  Strings count as equal if their 64-bit
hashes (and, from the first pass, their digits) are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import per_row
from punctual.llm.hashing import PIECE, as_bytes, mix, prefix_hashes, span_hashes
from punctual.llm.prune import marked
from punctual.session import staged

#: Anchors that one task compares window by window; a larger group is divided by a longer digit.
#: Windows that it sorts at once, and anchors whose bytes it hashes at once.
GROUP = 65_536
WINDOWS = 1 << 21
ROWS = 2048


def digit_length(window: int) -> int:
    return max(1, window * 2 // 5)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a text, piece by piece: place, digit hash, hash of the surroundings, bytes of them
    before and from the place on."""
    digit = digit_length(window)
    width = window - digit + 1
    n, seen = len(data), -1
    for lo in range(0, n - window + 1, PIECE):
        hi = min(lo + PIECE, n - window + 1)  # windows that start in lo..hi
        base, top = max(0, lo - width), min(n, hi + width + window)
        prefix = prefix_hashes(data[base:top])
        start = np.arange(lo - base, hi - base + width - 1)
        hashes = span_hashes(prefix, start, start + digit)
        order = (mix(hashes, 9) & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        at = np.unique(least(order, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = at[lo + at > seen]
        if not len(at):
            continue
        x = lo + at
        seen = int(x[-1])
        left, right = np.minimum(x, width - 1), np.minimum(n - x, window)
        around = span_hashes(prefix, x - left - base, x + right - base) ^ mix((left * 65_536 + right).astype(np.uint64), 4)
        yield x, hashes[at].view(np.int64), around.view(np.int64), left, right


ANCHORS = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("x", T.LongType()),
    T.StructField("digit", T.LongType()), T.StructField("around", T.LongType()),
    T.StructField("lead", T.IntegerType()), T.StructField("trail", T.IntegerType()),
])


def _anchor_rows(window: int):
    names = ["k1", "k2", "x", "digit", "around", "lead", "trail"]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, text = (batch.column(c) for c in ("k1", "k2", "text"))
            parts: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                for x, digit, around, left, right in anchors(as_bytes(text[i].as_py()), window):
                    one = np.ones(len(x), np.int64)
                    parts.append((one * k1[i].as_py(), one * k2[i].as_py(), x, digit, around, left, right))
                    size += len(x)
                if parts and (size > 100_000 or i == batch.num_rows - 1):
                    columns = [pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    parts, size = [], 0

    return run


SURROUNDINGS = T.StructType([
    T.StructField("group", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
    T.StructField("x", T.LongType()), T.StructField("lead", T.IntegerType()), T.StructField("lone", T.BooleanType()),
    T.StructField("data", T.BinaryType()),
])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors that a text is asked for."""
    names = ["group", "k1", "k2", "x", "lead", "lone", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            data = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
            k1, k2 = batch.column("k1")[i].as_py(), batch.column("k2")[i].as_py()
            for w in batch.column("wanted")[i].as_py():
                x = w["x"]
                out.append((w["digit"], k1, k2, x, w["lead"], w["lone"], data[x - w["lead"] : x + w["trail"]]))
            if out and (len(out) > 20_000 or i == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)
                out = []


SPANS = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "since", "upto")])


def _window_hashes(data: list[np.ndarray], lead: np.ndarray, offset: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Row, column and hash of the windows that start ``offset`` bytes before the anchors."""
    size = np.array([len(d) for d in data])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    prefix = prefix_hashes(np.concatenate(data))
    start = lead[:, None].astype(np.int64) - offset[None, :]  # within the surroundings
    row, col = np.nonzero((start >= 0) & (start + window <= size[:, None]))
    at = start[row, col] + begin[row]
    return row, col, mix(span_hashes(prefix, at, at + window) ^ mix(offset[col].astype(np.uint64), 6))


def _sort_windows(window: int):
    """Task over one group: which windows of the lone anchors occur again at the same offset."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        lead, lone, x, k1, k2 = (table.column(c).to_numpy() for c in ("lead", "lone", "x", "k1", "k2"))
        data = [np.frombuffer(d.as_py(), np.uint8) for d in table.column("data")]
        again = np.zeros((len(x), high - low + 1), bool)
        step = max(1, WINDOWS // len(x))
        for k in range(0, again.shape[1], step):
            offset = np.arange(low, high + 1)[k : k + step]
            parts = [_window_hashes(data[r : r + ROWS], lead[r : r + ROWS], offset, window) for r in range(0, len(x), ROWS)]
            row = np.concatenate([r * ROWS + part[0] for r, part in enumerate(parts)])
            col = np.concatenate([part[1] for part in parts])
            hashes = np.concatenate([part[2] for part in parts])
            if len(hashes) < 2:
                continue
            order = np.argsort(hashes)
            same = hashes[order[1:]] == hashes[order[:-1]]
            hit = order[np.append(same, False) | np.append(False, same)]
            again[row[hit], k + col[hit]] = True
        again &= lone[:, None]
        rows = np.flatnonzero(again.any(axis=1))
        # all windows hold the digit, so those of one anchor cover a single span
        near = low + again[rows].argmax(axis=1)
        far = high - again[rows][:, ::-1].argmax(axis=1)
        return pa.table({"k1": k1[rows], "k2": k2[rows], "since": x[rows] - far, "upto": x[rows] - near + window},
                        schema=pa.schema([(n, pa.int64()) for n in ("k1", "k2", "since", "upto")]))

    return run


def spans(docs: DataFrame, window: int) -> DataFrame:
    """Spans (k1, k2, since, upto), some overlapping, that cover the repeated windows of texts with
    key (k1, k2), from rows (k1, k2, text)."""
    digit = digit_length(window)
    found = staged(docs.mapInArrow(_anchor_rows(window), ANCHORS))
    # counted by digit and surroundings first: a digit of a very long run of repeats has few of those
    kinds = staged(found.groupBy("digit", "around").agg(F.count("*").alias("times")))
    digits = kinds.groupBy("digit").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest"))
    # groups with anchors that stand alone so far
    torn = digits.where("kinds > 1 and fewest = 1").select("digit", F.lit(True).alias("torn"))
    kinds = kinds.join(torn, "digit", "left").where("times > 1 or torn")
    shared = staged(found.join(kinds, ["digit", "around"]))
    settled = shared.where("times > 1").select("k1", "k2", (F.col("x") - F.col("lead")).alias("since"), (F.col("x") + F.col("trail")).alias("upto"))
    result = staged(settled.distinct())
    # in those, one anchor of each kind to compare
    open_ = shared.where("torn").groupBy("digit", "around").agg(
        F.min(F.struct("k1", "k2", "x", "lead", "trail")).alias("first"), F.first("times").alias("times")
    ).select("digit", (F.col("times") == 1).alias("lone"), "first.*")
    wanted = staged(open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("digit", "x", "lead", "trail", "lone")).alias("wanted")))
    keys = wanted.select("k1", "k2")
    asked = marked(docs, [F.col("k1"), F.col("k2")], keys).where("__maybe").drop("__maybe")
    texts = asked.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])
    rows = staged(texts.mapInArrow(_surroundings, SURROUNDINGS)).withColumns({"low": F.lit(0), "high": F.lit(window - digit)})
    while True:
        sizes = staged(rows.groupBy("group", "low", "high").agg(F.count("*").alias("size"), F.max("lone").alias("any")).where("size > 1 and any"))
        small = rows.join(sizes.where(F.col("size") <= GROUP).select("group", "low", "high"), ["group", "low", "high"])
        sorted_ = small.groupBy("group", "low", "high").applyInArrow(_sort_windows(window), SPANS)
        large = rows.join(sizes.where(F.col("size") > GROUP).select("group", "low", "high"), ["group", "low", "high"])
        result = result.union(staged(sorted_))
        if not sizes.where(F.col("size") > GROUP).limit(1).count():
            return result
        # anchors that agree in all windows of these offsets are settled; one of them stays for the others
        whole = F.substring("data", F.col("lead") - F.col("high") + 1, F.lit(window) + F.col("high") - F.col("low"))
        full = (F.col("lead") >= F.col("high")) & (F.length("data") - F.col("lead") >= window - F.col("low"))
        large = staged(large.withColumn("all", F.when(full, F.xxhash64(whole))))
        keys = ["group", "low", "high", "all"]
        alike = large.where("all is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "x")).alias("stays")).where("n > 1")
        settled = large.join(alike.select(*keys, "stays"), keys)
        result = result.union(staged(settled.where("lone").select(
            "k1", "k2", (F.col("x") - F.col("high")).alias("since"), (F.col("x") + window - F.col("low")).alias("upto")
        ).distinct()))
        stays = settled.where(F.struct("k1", "k2", "x") == F.col("stays")).withColumn("lone", F.lit(False)).select(*large.columns)
        others = large.join(alike.select(*keys), keys, "left_anti").select(*large.columns)
        large = others.union(stays).drop("all")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high"))))
        part = large.where("low < high").withColumn("half", halves).drop("low", "high").select("*", "half.low", "half.high").drop("half")
        common = F.substring("data", F.col("lead") - F.col("low") + 1, F.lit(window) - F.col("high") + F.col("low"))
        fits = (F.col("lead") >= F.col("low")) & (F.length("data") - F.col("lead") >= window - F.col("high"))
        rows = staged(part.where(fits).withColumn("group", F.xxhash64("group", "low", "high", common)))


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("since", T.LongType()), T.StructField("upto", T.LongType())]))),
    T.StructField("kept_sha256", T.StringType()),
])


def _cut(text: str | None, covered):
    data = (text or "").encode("utf-8", "surrogatepass")
    merged: list[list[int]] = []
    for since, upto in sorted((s["since"], s["upto"]) for s in covered or ()):
        if merged and since <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], upto)
        else:
            merged.append([since, upto])
    kept, at = hashlib.sha256(), 0
    for since, upto in merged:
        kept.update(data[at:since])
        at = upto
    kept.update(data[at:])
    removed = [{"since": s, "upto": u} for s, u in merged]
    return len(data), sum(u - s for s, u in merged), len(merged), removed, kept.hexdigest()


def removed(docs: DataFrame, window: int = 400, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, ``removed`` (the byte spans) and kept_sha256.

    Removed is each byte covered by a string of ``window`` bytes that also starts anywhere else, in
    the same text or another; all strings are judged on the input.  Texts are whole UTF-8 texts and
    null is empty; texts shorter than the window lose nothing.  Repeated rows are copies of each
    other, so they lose all their windows.  An empty table gives an empty result; input columns of
    these names, or named k1, k2 or covered, are replaced or left out.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c not in ("k1", "k2", "covered", *RESULT.names)]
    keyed = docs.select(*keep, F.col(text).alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    covered = spans(keyed.select("k1", "k2", "text"), window).distinct().groupBy("k1", "k2").agg(
        F.collect_list(F.struct("since", "upto")).alias("covered")
    )
    covered = staged(covered)
    keyed = marked(keyed, [F.col("k1"), F.col("k2")], covered.select("k1", "k2"))
    hit = keyed.where("__maybe").join(covered, ["k1", "k2"], "left")
    rest = keyed.where("not __maybe").withColumn("covered", F.lit(None).cast(covered.schema["covered"].dataType))
    order = [*keep, "text", "covered"]
    return per_row(hit.select(*order).union(rest.select(*order)), ["text", "covered"], RESULT, _cut, keep)
