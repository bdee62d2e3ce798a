"""Quality and language: held-out accuracy and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from punctual.llm import language, quality


def good(seed):
    r = random.Random(seed)
    words = lambda n: [r.choice(["the", "of", "and", "then", "letter", "mountain", "to", "a", "winter", "river", "house"]) for _ in range(n)]
    return " ".join(" ".join(words(r.randint(4, 12))).capitalize() + "." for _ in range(r.randint(2, 9)))


def bad(seed):
    r = random.Random(seed)
    kind = seed % 3
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in good(seed).split())
    if kind == 1:
        return " ".join(w for w in good(seed).split() for _ in range(r.randint(6, 14)))
    return " | ".join(w for w in good(seed).split() if len(w) > 4)


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rows = [(i, good(i) if i % 4 else bad(i // 4)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(7, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs_of(rows), labels


def test_quality_on_texts_not_seen(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    got = quality.score(docs.where("doc_id >= 400"), model, keep=["doc_id"]).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 > 0) for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_quality_odd_rows(labelled, docs_of, spark):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    odd = docs_of([(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (None, good(5) * 500), (4, "x" * 300_000)])
    rows = quality.score(odd.withColumnRenamed("source", "score"), model).collect()
    assert len(rows) == 6 and rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert rows[3]["score"] == rows[5]["score"] and rows[4]["score"] > 0.9
    assert quality.score(odd.limit(0), model).count() == 0


def test_quality_without_labels_of_both_classes(labelled, spark):
    docs, labels = labelled
    assert quality.fit(docs, labels.limit(0)).constant == 0.5
    assert quality.fit(docs, labels.where("quality = 1")).constant > 0.9
    assert quality.fit(docs.limit(0), labels).constant is not None


def test_shape_tells_words_apart():
    assert len(quality.shape("one two\tthree")) == 9 and quality.shape(None) == b""
    words = quality.shape("word word WORD!!")
    a, b, c = words[:3], words[3:6], words[6:]
    assert a[1] != b[1] and a[0] == b[0] != c[0] and b[2] != c[2]


def test_quality_reads_the_words(docs_of, spark):
    """Equal casing, punctuation and lengths of words, so equal shapes: only the letters differ."""
    swap = str.maketrans("abcdefghijklmnopqrstuvwxyz", "qzxjkvbwpyfgcmuldrhsnioate", "")
    spoil = lambda t: t.lower().translate(swap).capitalize()
    rows = [(i, good(i) if i % 2 else ". ".join(spoil(p) for p in good(i).split(". "))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of(rows), labels)
    got = quality.score(docs_of(rows).where("doc_id >= 250"), model, keep=["doc_id"]).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 2 > 0) for r in got]) >= 0.95
    a, b = "Winter letter of the house.", "Zqxjkv bwpyfg cz dlr hsnio."
    assert quality.shape(a) == quality.shape(b)
    (_, x), (_, y) = (model.scorer()(t) for t in (a, b))
    assert x > y + 0.1


TONGUES = {"aa": "th er on an re he in", "bb": "sch ung ein er ich", "cc": "eau ou é ai qu ez", "dd": "ción os la el ñ ar", "ee": "ing ly wh sh oo",
           "ff": "ja ni ko ta mu", "gg": "лов ны ко ста"}


def corpus(prose, tongues, each=30):
    return [(k, prose(random.Random(k).randint(4, 60), k, TONGUES[t].split()), t) for k, t in enumerate(t for t in tongues for _ in range(each))]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_language_on_texts_not_seen(spark, prose, n):
    tongues = list(TONGUES)[:n]
    rows = corpus(prose, tongues, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 4 <> 2"))
    assert model.languages == tongues
    got = language.predict(df.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_counts_whole_texts_and_every_language(spark, prose):
    """The table of counts against a plain loop; one document a language is enough."""
    rows = [(i, f"w{i} " + prose(3000 if i == 3 else 20, i), f"l{i:03d}") for i in range(70)] + [(3, "qq", "l003")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["place"]): r["n"] for r in language._counted(df.repartition(5)).collect()}
    want: dict = {}
    for _, text, lang in rows:
        ids = language.gram_ids(np.frombuffer(text.encode(), np.uint8))
        for place, n in zip(*np.unique(ids, return_counts=True), strict=True):
            want[lang, place] = want.get((lang, place), 0) + int(np.rint(n * (language.PARTS * min(1.0, language.TEXT_GRAMS / len(ids)))))
    assert got == {k: n for k, n in want.items() if n}
    model = language.fit(df)
    assert model.languages == [f"l{i:03d}" for i in range(70)]
    assert language.fit(df).weights.tobytes() == model.weights.tobytes()


def test_codewords_are_far_apart():
    for n in (2, 3, 5, 12, 60):
        m = language.codewords(n)
        far = [(m[i] != m[j]).sum() for i in range(n) for j in range(i)]
        assert min(far) >= (1 if n == 2 else 2 if n == 3 else 3)
        assert all(len(set(c)) == 2 for c in m.T)


def test_language_odd_rows(spark, prose):
    rows = corpus(prose, ["aa", "cc"]) + [(900, None, "aa"), (901, "123 !?", "cc"), (902, prose(20, 5, TONGUES["aa"].split()), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    odd = spark.createDataFrame(
        [(1, None, "old"), (2, "", "o"), (3, "12 --", "o"), (4, prose(30_000, 3, TONGUES["cc"].split()), "o"), (None, "é", "o")],
        "doc_id long, text string, lang_pred string",
    )
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["ambiguous"]
    assert got[4]["lang_pred"] == "cc" and not got[4]["ambiguous"]
    half = " ".join(prose(300, 1, TONGUES["aa"].split()).split() + prose(300, 1, TONGUES["cc"].split()).split())
    assert language.predict(spark.createDataFrame([(half,)], "text string"), model).first()["lang_pred"] in ("aa", "cc")
    nothing = language.fit(df.limit(0))
    assert language.predict(odd, nothing).where("lang_pred <> 'und'").count() == 0
    assert language.predict(odd.limit(0), model).count() == 0
