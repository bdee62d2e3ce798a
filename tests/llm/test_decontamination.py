from __future__ import annotations

import random

import numpy as np
import pytest

from punctual.llm import decontamination as dec

ITEMS = [(1, "Which of the following rivers flows through four capital cities on its way to the sea, and where does it rise?"),
         (2, "A train leaves the station at noon with a speed of sixty kilometres an hour; when will it reach the next town?"),
         (3, None), (4, ""), (5, "tiny"), (None, "An item that has no identity at all is left out of the search, whatever it says in here.")]


def distance(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        r.choice([lambda: out.__setitem__(k, "q"), lambda: out.insert(k, "z"), lambda: out.pop(k)])()
    return "".join(out)


def found(text, items=ITEMS[:2]):
    return {r[0] for r in dec.document_matches(text, dec.index_of(items))}


def test_copies_edits_case_and_marks(prose):
    r = random.Random(5)
    for k in range(60):
        i, item = ITEMS[k % 2]
        near = edited(item, int(0.06 * len(item)), r)
        text = prose(80, k) + " " + (near.upper() if k % 3 else near.replace(" ", " -- ")) + " " + prose(50, k + 99)
        assert found(text) == {i}
    assert found(prose(3000, 1)) == set()
    assert found(ITEMS[0][1][:30]) == set()  # a small part of an item is none
    assert found("x " + ITEMS[0][1][:90]) == {1}  # most of one is


def test_every_region_within_the_budget_is_found(prose):
    """Against plain edit distance, for the whole item, on both sides of the budget."""
    r = random.Random(8)
    item = "".join(chr(c) for c in dec.normalized(ITEMS[1][1])[0])
    for k in range(120):
        text = "".join(chr(c) for c in dec.normalized(prose(8, k) + " " + edited(item, r.randint(3, 16), r) + " " + prose(8, k + 1))[0])
        parts = [item[a:b] for a, b in dec.parts_of(len(item))]
        want = any(distance(p, text) <= dec.budget(len(p)) for p in parts)
        assert (found(text, [(2, item)]) == {2}) == want


def test_passages_of_long_items_are_found(prose):
    item = prose(700, 11)
    assert len(item) > 3000
    r = random.Random(4)
    for size in (210, 400, 1400):
        for k in range(6):
            at = r.randrange(len(item) - size)
            assert found(prose(40, k) + " " + item[at : at + size] + " " + prose(40, k + 50), [(1, item)]) == {1}
    assert found(prose(60, 1) + " " + item[500:600] + " " + prose(40, 2), [(1, item)]) == set()


def test_parts_between_the_quarters_are_found(prose):
    """Excerpts a little longer than half an item, wherever they are cut out."""
    item = prose(75, 12)[:360]
    for at in range(0, 170, 5):
        assert found("some words and " + item[at : at + 184] + " 123456789 987654321", [(1, item)]) == {1}


def test_short_items_are_compared_exactly(prose, monkeypatch):
    items = [(1, "tiny"), (2, "4 + 4?"), (3, "?!"), (4, "什么是水")]
    assert found("A TINY house", items) == {1} and found("so tiny", items) == {1}
    assert found("tinyness, 14 4 45", items) == set() == found("", items)
    assert found("is 4+4 right, 请问什么是水呢", items) == {2, 4}
    monkeypatch.setattr(dec, "PIECE", 70)
    text = prose(60, 3) + " tiny " + prose(60, 4)
    assert [(text[s:e], d) for _, s, e, d, _ in dec.document_matches(text, dec.index_of(items))] == [("tiny", 0)]


def test_align_equals_plain_distance():
    r = random.Random(3)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randint(5, 30)))
        b = "".join(r.choice("abc") for _ in range(r.randint(0, 5))) + edited(a, r.randint(0, 4), r) + "cab"
        code = lambda s: np.array([ord(c) for c in s], np.uint32)
        got = dec.align(code(a), code(b), -12, 20, 6)
        want = distance(a, b)
        assert got is not None and got[0] == want if want <= 6 else got is None or got[0] > 6


def test_pieces_and_positions(monkeypatch, prose):
    monkeypatch.setattr(dec, "PIECE", 500)
    text = prose(400, 2) + ". " + ITEMS[0][1] + " " + prose(300, 3)
    rows = dec.document_matches(text, dec.index_of(ITEMS[:2]))
    assert [(i, text[s:e].lower(), d) for i, s, e, d, _ in rows] == [(1, ITEMS[0][1].lower()[: rows[0][2] - rows[0][1]], 0)]
    assert rows[0][4] == 1.0


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_tables(spark, docs_of, monkeypatch, block_chars, prose):
    monkeypatch.setattr(dec, "BLOCK_CHARS", block_chars)
    bench = spark.createDataFrame(ITEMS + [(7, ITEMS[0][1])], "item_id long, text string")
    rows = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, None), (3, ""), (4, prose(20_000, 6)), (None, ITEMS[1][1]), (6, ITEMS[0][1] + " " + ITEMS[1][1])]
    docs = docs_of(rows)
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in dec.matches(docs, bench).collect())
    assert got == [(0, 2), (1, 1), (1, 1), (1, 7), (1, 7), (6, 1), (6, 2), (6, 7)]
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert dec.matches(docs.limit(0), bench).count() == 0 and dec.matches(docs, bench.limit(0)).count() == 0
    assert dec.clean(docs, bench.limit(0)).count() == len(rows)
