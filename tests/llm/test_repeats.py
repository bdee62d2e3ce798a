from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from punctual.llm import repeats


def plain(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                covered[i : i + window] = b"\x01" * window
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        out.append((len(d), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs_of, texts, window):
    got = repeats.removed(docs_of(list(enumerate(texts))), window=window).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == plain(texts, window)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, a="abcdefgh é": "".join(r.choice(a) for _ in range(n))
    shared = [text(r.randint(15, 60)) for _ in range(5)]
    out = [None, "", "a", "ab" * 100, "a" * 300, text(19), text(20), text(3000, "ab")]
    for _ in range(60):
        parts = [text(r.randint(0, 40)), r.choice(shared), text(r.randint(0, 40)), r.choice(shared)[r.randint(0, 9) :], text(5)]
        out.append("".join(parts))
    out += out[20:24] + [out[20]] * 7 + [out[30][:25] + "x" + out[30][25:]]
    return out


@pytest.mark.parametrize(("seed", "window", "group"), [(1, 20, 2048), (2, 20, 4), (3, 33, 3)])
def test_equals_plain_windows(docs_of, monkeypatch, seed, window, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    if seed > 1:
        monkeypatch.setattr(repeats, "ROWS", 3)
        monkeypatch.setattr(repeats, "WINDOWS", 40)
    check(docs_of, corpus(seed), window)


def test_long_texts_in_pieces(monkeypatch, prose):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    from punctual.llm.hashing import as_bytes

    data = as_bytes(prose(2000, 4))
    cut = [a for part in repeats.anchors(data, 50) for a in zip(*(x.tolist() for x in part), strict=True)]
    monkeypatch.setattr(repeats, "PIECE", 1 << 18)
    whole = [a for part in repeats.anchors(data, 50) for a in zip(*(x.tolist() for x in part), strict=True)]
    assert cut == whole and len(cut) < len(data) / 10


def test_empty_and_clashing(docs_of, spark):
    from pyspark.sql import functions as F

    df = docs_of([(None, "x" * 50), (None, "x" * 49 + "y"), (1, None)]).withColumns({c: F.lit("o") for c in ("k1", "covered", "n_bytes", "digit")})
    got = repeats.removed(df, window=10).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 49, 50]
    assert repeats.removed(df.limit(0), window=10).count() == 0
