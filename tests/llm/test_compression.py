"""Held-out accuracy of the two compression classifiers, and their defined corner cases."""

import random
import zlib

import numpy as np
import pytest

from trackhouse.llm import language, queries, toxicity
from trackhouse.llm.compression import FOLD, logistic, unlike, windows

SF = "/root/testdata/sf0.01"


def test_windows_hold_the_whole_text():
    rng = random.Random(1)
    for raw in (b"", b" ", b"a", b"x" * 1000, b"ab " * 300, bytes(rng.choice(b"ab  ") for _ in range(999))):
        parts = list(windows(raw, 40))
        joined = b"".join(p if raw[at : at + 1] == b" " else p[1:] for at, p in _placed(raw, parts))
        assert joined == raw
        assert all(len(p) <= 81 for p in parts)


def _placed(raw, parts):
    at = 0
    for p in parts:
        yield at, p
        at += len(p) if raw[at : at + 1] == b" " else len(p) - 1


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    w = logistic(x, (x[:, 0] > 1.5).astype(float))
    assert w[0] + w[1] < 0 < w[0] + 2 * w[1]


@pytest.fixture(scope="module")
def held(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return {r.doc_id: r for r in docs}


def test_language_held_out(spark, held):
    rows = queries.all_queries()["op5_language"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == held[r.doc_id].lang for r in own) / len(own) > 0.93
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_toxicity_held_out(spark, held):
    rows = {r.doc_id: r for r in queries.all_queries()["op3_toxicity"](spark, SF).collect()}
    assert sorted(rows) == sorted(held)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(rows[i].score, y) for i, y in truth.items() if rows[i].held_out]
    high = [s for s, y in own if y == 1]
    low = [s for s, y in own if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert auc > 0.85
    assert np.mean([s >= 0.7 for s in low]) < 0.03


def test_corner_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !!", "a"), (4, "wort " * 20000, "b"), (None, "zwei wort ein wort", "b"), (4, "zwei", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = language.Model(("a", "b"), (language.dictionary(["x y z"]), language.dictionary(["ein wort zwei"])))
    out = language.predict(docs, model).collect()
    assert len(out) == 6
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(r.lang_pred == "b" and not r.rejected for r in out if r.text == "zwei wort ein wort")
    assert all(r.lang_pred in ("a", "b") for r in out if r.doc_id == 4)
    assert language.predict(docs.limit(0), model).count() == 0
    bare = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scored = toxicity.score(docs, bare).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in scored)
    none = language.train(docs.limit(0).withColumnRenamed("score", "lang"))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def _word(rng):
    return "".join(rng.choice("abcdefg") for _ in range(6))


def test_dictionaries_part_at_toxic_words_alone():
    rng = random.Random(4)
    plain = [" ".join(_word(rng) for _ in range(30)) for _ in range(200)]
    toxic = [" ".join([_word(rng) for _ in range(30)] + ["zzbadzz"]) for _ in range(100)]
    one, two = toxicity.dictionaries(toxic, plain)[0]
    assert b"zzbadzz" in one and b"zzbadzz" not in two and len(one) == len(two)
    assert all(a == b or b == 0 or a == 0 for a, b in zip(one, two))
    raw = (plain[0] + " zzbadzz " + plain[1]).encode()
    assert toxicity.measure(raw, one, two)[0] > toxicity.measure(plain[0].encode(), one, two)[0]
    assert FOLD[ord("A")] == ord("a")


def test_many_rare_insults_are_learned():
    """60 insults, each in one of 60 toxic texts, beside as many ordinary texts of the same words."""
    rng = random.Random(5)
    words = [_word(rng) for _ in range(3000)]
    insults = ["zq" + _word(rng) for _ in range(60)]

    def text(bad):
        own = [rng.choice(words) for _ in range(79)]
        return " ".join(own[:40] + [rng.choice(insults)] * bad + own[40:]).encode()

    model = toxicity.fit([(i % 2, text(i % 2), (i // 2) % 5) for i in range(2000)])
    score = {y: [model.weights[0] + np.dot(model.weights[1:], toxicity.measure(text(y), model.toxic, model.ordinary)) for _ in range(300)] for y in (0, 1)}
    assert np.mean([(a > b) + 0.5 * (a == b) for a in score[1] for b in score[0]]) >= 0.8


def test_toxicity_of_repeated_null_and_long_rows(spark):
    rng = random.Random(8)
    bad, good = "du zzbadzz wort", "ein wort und noch eins"
    rows = [(i, " ".join([_word(rng) for _ in range(12)] + [bad if i % 2 else good])) for i in range(200)] + [(1, good), (1, good), (None, bad), (500, None), (501, ""), (502, "wort " * 50000 + bad), (503, "wort " * 50000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[500] == score[501] < 0.7 and score[502] > score[503]
    assert toxicity.train(docs.repartition(7), labels) == model
    assert toxicity.train(docs.limit(0), labels).toxic == b""
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_near_copies_count_once_and_others_all():
    rng = random.Random(6)
    texts = [" ".join(["der", "die", "das", "und"] + [_word(rng) for _ in range(60)]) for _ in range(300)]
    copies = [t.rsplit(" ", 1)[0] + " anders" for t in texts[:50]]
    assert len(list(unlike(texts + copies))) <= 305 and len(list(unlike(texts))) == 300


def test_one_more_byte_changes_little():
    rng = random.Random(7)
    words = {k: [_word(rng) for _ in range(400)] for k in "ab"}
    texts = {k: [" ".join(rng.choice(words[k]) for _ in range(80)) for _ in range(50)] for k in "ab"}
    model = language.Model(("a", "b"), tuple(language.dictionary(texts[k]) for k in "ab"))
    raw = " ".join(rng.choice(words["a"]) for _ in range(600)).encode()
    leads = []
    for n in range(1400, 1600):
        one, two = language.lengths(raw[:n], model)
        leads.append((two - one) / one)
    assert min(leads) > 0 and max(abs(a - b) for a, b in zip(leads, leads[1:])) < 0.1 * max(leads)


def test_language_takes_clashing_columns(spark):
    docs = spark.createDataFrame([("ein wort", 1, 2, 0.5)], "text string, __has_letter int, LANG int, margin double")
    model = language.Model(("b",), (language.dictionary(["ein wort zwei"]),))
    row = language.predict(docs, model).first()
    assert row["lang_pred"] == "b" and row["__has_letter"] == 1 and row["margin"] == 1.0
