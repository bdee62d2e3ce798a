"""Language by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of bits.  One binary n-gram classifier predicts each bit; decoding
adds up, for every language, the logistic losses of its bits, each weighted by how well that bit
was predicted on a part of the sample that was kept aside, and takes the smallest total.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import per_row
from punctual.llm.hashing import as_bytes
from punctual.session import staged

#: Bound of the sample: documents of each language.
SAMPLE_ROWS = 1500
#: A sampled text counts for as many n-grams as it has, but for no more than this; counts are kept in
#: parts of PARTS, as whole numbers.
TEXT_GRAMS = 9000
PARTS = 1024
GRAMS = (2, 3, 4)
TABLE_BITS = 16

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)  # signs, digits and white space become blanks
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c
_FOLD[128:] = np.arange(128, 256)


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Table places of all n-grams of the folded bytes, runs of blanks taken as one."""
    low = _FOLD[data]
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    low[accent + 1] += 0x20  # capitals of the Latin-1 block
    low = np.concatenate(([32], low, [32])).astype(np.uint32)
    low = low[np.concatenate(([True], (low[1:] != 32) | (low[:-1] != 32)))]
    out = []
    for n in GRAMS:
        if len(low) < n:
            continue
        total = np.zeros(len(low) - n + 1, np.uint32)
        for i in range(n):
            total = total * np.uint32(0x9E3779B1) + low[i : len(low) - n + 1 + i] + np.uint32(n)
        total ^= total >> np.uint32(15)
        out.append((total * np.uint32(0x85EBCA77)) >> np.uint32(32 - TABLE_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 bits for each of n classes, each column splitting the classes differently.

    Up to five classes all splits are used; for more, of random splits those that keep the rows
    far apart.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1 if (k >> (n - 1 - i)) & 1 else -1 for i in range(n)] for k in range(1 << (n - 1), (1 << n) - 1)]
        return np.array(columns, float).T
    bits = max(15, math.ceil(6 * math.log2(n)))
    rng = np.random.default_rng(5)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        apart = (bits - (m @ m.T)[~np.eye(n, dtype=bool)].max()) / 2
        if apart > far and (np.abs(m.sum(axis=0)) < n).all():
            best, far = m, apart
    return best


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None
    weights: np.ndarray | None = None  # table place by bit
    scale: np.ndarray | None = None
    offset: np.ndarray | None = None
    trust: np.ndarray | None = None


def _margins(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    step = 1 << 18
    return sum(weights[ids[i : i + step]].sum(axis=0, dtype=np.float64) for i in range(0, len(ids), step)) / len(ids)


def _counted(sample: DataFrame) -> DataFrame:
    """Rows (lang, place, n): weighted n-grams of the sampled texts of a language in a place of the table.

    Each task adds up what it reads, so at most a row a language and place leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = gram_ids(as_bytes(text))
                if len(ids):
                    counts = np.bincount(ids, minlength=1 << TABLE_BITS)
                    weighted = np.rint(counts * (PARTS * min(1.0, TEXT_GRAMS / len(ids)))).astype(np.int64)
                    sums[lang] = sums[lang] + weighted if lang in sums else weighted
        for lang, counts in sums.items():
            places = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(places), pa.string()), "place": places, "n": counts[places]})

    return sample.select("lang", "text").mapInArrow(run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> Model:
    """Fit on a bounded sample of SAMPLE_ROWS whole documents a language, those of the smallest hashes of their id.

    Every language is learned.  Documents whose text or language is null take no part; a language without
    any n-gram is none.  No text reaches the driver: of each language at most a count for each place of
    the table, and of every fifth sampled document, kept aside, a number for each bit.
    """
    order = F.xxhash64(F.col(doc_id), F.lit("sample"))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), order.alias("place"), F.col(text).alias("text")
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    # rows thinned by their hash before they are ranked, so that no language gathers in one task
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * SAMPLE_ROWS / n)))])[F.col("lang")]
    known = known.where(F.pmod("place", F.lit(1_000_000)) < share * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    sample = staged(known.withColumn("n", rank).where(F.col("n") <= SAMPLE_ROWS).select("lang", "n", "text"))
    got = _counted(sample.where("n % 5 <> 0")).toArrow()
    if not got.num_rows:
        return Model()
    names, places, numbers = got.column("lang").to_pylist(), got.column("place").to_numpy(), got.column("n").to_numpy()
    languages = sorted(set(names))
    index = {k: i for i, k in enumerate(languages)}
    codes = codewords(len(languages))
    size = 1 << TABLE_BITS
    counted = np.zeros((len(languages), size))
    counted[[index[k] for k in names], places] = numbers / PARTS
    share_of = (counted + 0.5 / size) / (counted.sum(axis=1, keepdims=True) + 0.5)
    weights = np.zeros((size, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        plus, minus = codes[:, b] > 0, codes[:, b] < 0
        if plus.any() and minus.any():
            weights[:, b] = np.clip(np.log(share_of[plus].mean(axis=0) + 1e-9) - np.log(share_of[minus].mean(axis=0) + 1e-9), -6, 6)

    def margins(value):
        ids = gram_ids(as_bytes(value))
        return (_margins(ids, weights).tolist() if len(ids) else None,)

    fields = T.StructType([T.StructField("margins", T.ArrayType(T.DoubleType()))])
    # where no language has five documents, those learned from are measured
    for fold in ("n % 5 = 0", "n % 5 <> 0"):
        rows = per_row(sample.where(fold), ["text"], fields, margins, ["lang", "n"]).where("margins is not null")
        aside = [r for r in rows.orderBy("lang", "n").collect() if r["lang"] in index]
        if aside:
            break
    x, truth = np.array([r["margins"] for r in aside]), codes[[index[r["lang"]] for r in aside]]
    scale, offset, trust = np.ones(codes.shape[1]), np.zeros(codes.shape[1]), np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        scale[b], offset[b] = _curve(x[:, b], (truth[:, b] > 0).astype(float))
        right = ((x[:, b] * scale[b] + offset[b]) * truth[:, b] > 0).mean()
        trust[b] = max(1e-3, 2 * right - 1)
    return Model(languages, codes, weights, scale, offset, trust / trust.sum())


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of one variable by Newton steps, held to moderate slopes."""
    a, z, hold = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1), np.diag([2e-2, 2e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (y - p) - hold @ a)
        a += step / max(1.0, np.abs(step).max() / 5)
    return float(a[0]), float(a[1])


def decode(model: Model, margins: np.ndarray) -> tuple[str, float, bool]:
    """Language of the nearest codeword, its share of the decoded weight, and if it is ambiguous."""
    f = margins * model.scale + model.offset
    loss = (np.logaddexp(0.0, -model.codes * f) * model.trust).sum(axis=1) * model.codes.shape[1]
    p = np.exp(loss.min() - loss)
    best = int(np.argmin(loss))
    score = float(p[best] / p.sum())
    second = float(np.sort(loss)[1] - loss[best]) if len(loss) > 1 else math.inf
    return model.languages[best], score, second < 0.5


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to every row, from the whole text.

    A text that is null or has no letter is ``und`` with score 0, and ambiguous; so is every text
    if nothing could be learned.  Rows are independent; an empty table stays empty; input columns
    of the three names are replaced.
    """
    fields = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()),
    ])

    def work(value):
        if not value or not model.languages or not _LETTER.search(value):
            return "und", 0.0, True
        return decode(model, _margins(gram_ids(as_bytes(value)), model.weights))

    return per_row(docs, [text], fields, work, docs.columns if keep is None else keep)
