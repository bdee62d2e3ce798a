from __future__ import annotations

import random
import re

import numpy as np
import pytest

from punctual.llm import overlap
from punctual.llm.hashing import as_bytes, shingles, word_hashes


def plain_set(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n, permille):
    sets = [(i, plain_set(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and len(x & y) * 1000 >= permille * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in sets}


def corpus(prose, seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (None, "one two three"), (5, "one two three")]
    for base in range(12):
        words = prose(r.randint(6, 160), seed * 100 + base).split()
        rows.append((len(rows) + 100, " ".join(words)))
        for _ in range(r.randint(0, 14)):  # near copies, some of copies
            new = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                k = r.randrange(len(new))
                new[k : k + r.randint(0, 1)] = ["x" + str(r.randint(0, 9))]
            rows.append((len(rows) + 100, "\t".join(new).upper() if r.random() < 0.3 else " ".join(new)))
            if r.random() < 0.5:
                words = new
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "ngram", "threshold", "points"), [(1, 3, 0.9, 1024), (2, 5, 0.8, 5)])
def test_equals_plain_join(docs_of, prose, monkeypatch, seed, ngram, threshold, points):
    monkeypatch.setattr(overlap, "TASK_POINTS", points)
    rows = corpus(prose, seed)
    got, links = overlap.join(docs_of(rows), ngram, threshold)
    want = plain_components(rows, ngram, round(threshold * 1000))
    out = got.collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want | {None: None}
    sizes = {i: len(plain_set(t, ngram)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out)
    texts = dict(rows)
    for r in links.collect():
        x, y = plain_set(texts[r["a"]], ngram), plain_set(texts[r["b"]], ngram)
        assert len(x & y) >= threshold * len(x | y) - 1e-9


def test_bound_and_trees_lose_nothing():
    """Linked sets share a tree, and their points reach the bound."""
    r = np.random.default_rng(4)
    for threshold in (0.9, 0.8):
        for n in [3, 8, 9, 10, 16, 17, 31, 33, 64, 100, 128, 129, 500, 3000]:
            for _ in range(30):
                both = r.integers(0, 2**63, n).astype(np.uint64)
                most = int(n / threshold + 1e-9) - n
                a_only = int(r.integers(0, most + 1))
                a = np.unique(np.concatenate([both, r.integers(0, 2**63, a_only).astype(np.uint64)]))
                b = np.unique(np.concatenate([both, r.integers(0, 2**63, most - a_only).astype(np.uint64)]))
                if len(np.intersect1d(a, b)) < threshold * len(np.union1d(a, b)) - 1e-9 or np.array_equal(a, b):
                    continue
                assert set(overlap.cells(a, threshold)) & set(overlap.cells(b, threshold)), n
                points = [np.frombuffer(overlap.point(x), np.uint8)[None, :] for x in (a, b)]
                pairs = list(overlap.tree_pairs(points[0], np.array([len(a)]), points[1], np.array([len(b)]), threshold))
                assert sum(len(p[0]) for p in pairs) == 1


def test_words_of_long_texts(monkeypatch):
    text = ("ab  Cd\té\x0b" * 300 + "x" * 5000 + " ") * 3
    whole = word_hashes(as_bytes(text))
    monkeypatch.setattr("punctual.llm.hashing.PIECE", 64)
    assert np.array_equal(word_hashes(as_bytes(text)), whole) and len(whole) == 3 * 901
    assert len(shingles(whole, 3)) < 20


def test_two_texts_under_one_id(docs_of, prose):
    a, b = prose(40, 1), prose(40, 2)
    got, _ = overlap.join(docs_of([(7, a), (7, b), (5, a), (9, b), (11, prose(40, 3))]), 3, 0.9)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(7, 5), (5, 5), (9, 5), (11, 11)}


def test_empty(docs_of):
    got, links = overlap.join(docs_of([(1, "a")]).limit(0))
    assert got.count() == 0 and links.count() == 0
