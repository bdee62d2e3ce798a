"""Quality score from compressed sizes under a good and a bad dictionary.

The whole UTF-8 text, in pieces, is compressed with a zstandard dictionary made of slices of good
and with one made of slices of bad labelled texts; the difference of the two total sizes over the
larger one is the text's size difference.  A second difference is taken in the same way of the text
written as three bytes a word: how it is cased, whether it repeats the word before and what it ends
with.  A logistic curve of both, fitted on labelled texts, is the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import per_row
from punctual.llm.hashing import as_bytes, edges, word_hashes
from punctual.session import staged

#: Bounds of the sample a model is fitted on: labelled texts of each class, bytes of a dictionary of
#: texts and of shapes, and bytes of one text in a dictionary (at most; and at least, if there are
#: many texts).
SAMPLE_ROWS = 4000
TEXT_BYTES = 500_000
SHAPE_BYTES = 120_000
SLICE = 6144
SHORT_SLICE = 384
LEVEL = 12
WORD_BYTES = 3
#: Bytes that are compressed at once, of a text and of its shape.
TEXT_PIECE = 512
SHAPE_PIECE = 32 * WORD_BYTES

_KIND = np.zeros(256, np.uint8)  # 0 letters and digits, 1 sentence marks, 2 other signs
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_KIND[list(b".,;:")] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def shape(text: str | None) -> bytes:
    """Three bytes for each word of the whole text; empty for null or a text without words."""
    data = as_bytes(text)
    words = word_hashes(data)
    if not len(words):
        return b""
    start, end = edges(data)
    repeats = np.zeros(len(words), np.int64)
    repeats[1:] = words[1:] == words[:-1]
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    cased = np.minimum(capitals[end] - capitals[start], 2)
    last, before = _KIND[data[end - 1]], _KIND[data[np.maximum(end - 2, start)]]
    ending = np.where(last == 0, 0, np.where(end - start == 1, 3, np.where((before > 0) | (last == 2), 2, 1)))
    return np.stack([0x40 + cased, 0x80 + repeats, 0xA0 + ending], axis=1).astype(np.uint8).tobytes()


class Sizes:
    """Compressed-size difference under two dictionaries, from -1 (like good text) to 1."""

    def __init__(self, good: bytes, bad: bytes, piece: int):
        self.of, self.piece = [], piece
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.of.append((c, len(c.compress(b""))))

    def difference(self, data: bytes) -> float:
        if not data:
            return 0.0
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        good, bad = (sum(len(c.compress(p)) - empty for p in pieces) for c, empty in self.of)
        return (good - bad) / max(good, bad, 1)


def forms(text: str | None) -> tuple[bytes, bytes]:
    """What is compressed: the bytes of the whole text and its shape; both empty without words."""
    shaped = shape(text)
    return (as_bytes(text).tobytes() if shaped else b""), shaped


@dataclass
class Model:
    """Dictionaries, good and bad, of texts and of shapes, and the logistic curve of both differences.
    Without labels of both classes the score is ``constant``."""

    texts: tuple[bytes, bytes] = (b"", b"")
    shapes: tuple[bytes, bytes] = (b"", b"")
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = 0.0
    constant: float | None = None

    def scorer(self):
        if self.constant is not None:
            return lambda text: (0.0, self.constant)
        by_text, by_shape = Sizes(*self.texts, TEXT_PIECE), Sizes(*self.shapes, SHAPE_PIECE)
        (a, b), offset = self.slopes, self.offset

        def score(text):
            whole, shaped = forms(text)
            d, e = by_text.difference(whole), by_shape.difference(shaped)
            return d, 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a * d + b * e + offset))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic curve of the columns of x by Newton steps, slightly held to zero; the offset is last."""
    z = np.column_stack([x, np.ones(len(x))])
    a = np.zeros(z.shape[1])
    hold = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        slope = z.T @ (weight * (y - p)) - hold @ a
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + hold
        step = np.linalg.solve(bend, slope)
        a += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return a.tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled documents; label 1 is good, 0 is bad, others and nulls are left out.

    At most SAMPLE_ROWS documents of each class, those with the smallest hash of their id, are
    read; class sizes of all labels weigh the curve.  Only their ids (broadcast, bounded), slices
    of at most SLICE bytes of text and of shape, and size differences leave the executors.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")
    )
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model(constant=(counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    order = F.xxhash64("id", F.lit("sample"))
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "id").limit(SAMPLE_ROWS)
        ids = part if ids is None else ids.union(part)
    fields = T.StructType([T.StructField("whole", T.BinaryType()), T.StructField("shape", T.BinaryType())])
    sample = staged(per_row(docs.join(F.broadcast(ids), F.col(doc_id) == F.col("id")), [text], fields, forms, ["id", "y"]))

    def part(column: str, unit: int):
        length = F.least(F.length(column), F.lit(SLICE))
        places = F.floor((F.length(column) - length) / unit) + 1
        return F.substring(column, (F.pmod(F.xxhash64("id"), places) * unit).cast("int") + 1, length).alias(column)

    slices = sample.select("y", _fold().alias("fold"), "id", part("whole", 1), part("shape", WORD_BYTES)).orderBy(
        F.xxhash64("id", F.lit("slice")), "id", "whole", "shape"
    ).collect()

    def content(column: str, most: int, y: int, fold: int | None) -> bytes:
        parts = [bytes(r[column]) for r in slices if r["y"] == y and r["fold"] != fold]
        each = max(SHORT_SLICE, most // max(1, len(parts)))
        return b"".join(p[:each] for p in parts)[:most]

    def dictionaries(column: str, most: int, fold: int | None) -> tuple[bytes, bytes]:
        good, bad = content(column, most, 1, fold), content(column, most, 0, fold)
        size = min(len(good), len(bad))  # equal sizes, so that neither side compresses better by size alone
        return good[:size], bad[:size]

    parts = {f: (dictionaries("whole", TEXT_BYTES, f), dictionaries("shape", SHAPE_BYTES, f)) for f in (0, 1, None)}
    if min(len(c) for both in parts.values() for pair in both for c in pair) < 8:
        return Model(constant=(counts[1] + 1) / (counts[0] + counts[1] + 2))
    aside = {f: parts[f] for f in (0, 1)}
    made = {}

    def differences(whole, shaped, fold):
        if fold not in made:
            texts, shapes = aside[fold]
            made[fold] = Sizes(*texts, TEXT_PIECE), Sizes(*shapes, SHAPE_PIECE)
        by_text, by_shape = made[fold]
        return by_text.difference(bytes(whole)), by_shape.difference(bytes(shaped))

    # the curve is fitted on texts that the dictionaries used for them don't hold:
    # two numbers for each sampled text, at most 2 * SAMPLE_ROWS
    fields = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("e", T.DoubleType())])
    got = per_row(sample.withColumn("fold", _fold()), ["whole", "shape", "fold"], fields, differences, ["y"]).toPandas()
    y = got["y"].to_numpy(float)
    share = {v: counts[v] / max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    a, b, offset = _logistic(got[["d", "e"]].to_numpy(float), y, weight * len(y) / weight.sum())
    return Model(*parts[None], (a, b), offset)


def _fold():
    return F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int")


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``size_difference`` (of the text) and ``score`` (0 to 1, higher: like texts labelled 1) to every row.

    Whole texts are scored.  Null texts and texts without words have differences 0 and the curve's
    value there.  Rows are independent: repeated rows get equal scores, an empty table stays
    empty, input columns of the two names are replaced.
    """
    fields = T.StructType([T.StructField("size_difference", T.DoubleType()), T.StructField("score", T.DoubleType())])
    made = {}

    def work(value):
        if "score" not in made:
            made["score"] = model.scorer()
        return made["score"](value)

    return per_row(docs, [text], fields, work, docs.columns if keep is None else keep)
