"""Licence scans: automaton against substring search, base counts against a plain scan."""

import random

from trackhouse.llm import licenses, queries


def brute(text):
    words = licenses.tokens_of(text or "")
    hits, labels = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        hits += at
        if at:
            labels.add(label)
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_matching_statistics_equal_substring_search():
    rng = random.Random(9)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    automaton = licenses.Automaton(texts)
    words = [rng.randrange(5) for _ in range(400)]
    for i, (length, state) in enumerate(automaton.statistics(words), 1):
        def places(n):
            return {(t, j + n) for t, text in enumerate(texts) for j in range(len(text) - n + 1) if text[j : j + n] == words[i - n : i]}

        longest = max(n for n in range(min(i, 25) + 1) if n == 0 or places(n))
        assert length == longest
        if length:
            assert automaton.ends[state] == places(length)


MIT = licenses.TEMPLATES[1][1]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")


def test_labels_and_spans(spark):
    changed = MIT.replace("obtaining", "getting hold of").replace("merge,", "")
    texts = [None, "", "The MIT-License; mit LICENSE", "Mit license " * 3, "in the of and " + MIT + " of the", changed,
             "Licensed under CC BY-NC 4.0.", "All rights reserved.", "all rights are reserved", "général public license é", "x " * 50000 + "Apache License",
             " ".join(MIT.split()[:20]), "GNU General Public\nLicense", "mit", "license mit"]
    rows = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
    assert [rows[i].labels for i in (0, 1, 4, 5, 6, 7, 8, 11)] == ["", "", "mit", "mit", "cc-by-nc", "all-rights-reserved", "", ""]
    span = max(rows[4].spans, key=lambda s: s.end - s.start)
    assert span.share == 1.0 and licenses.tokens_of(texts[4])[span.start : span.start + 2] == ["permission", "is"]
    assert rows[2].score == 1.0 and rows[0].score == 0.0 and 0.6 <= rows[5].score <= 1


def test_empty(spark):
    assert licenses.scan(docs(spark, []).limit(0)).count() == 0


def test_query(spark, small_dir):
    rows = {r.doc_id: r for r in queries.all_queries()["op4_license_scan"](spark, small_dir).collect()}
    table = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    assert len(rows) == len(table)
    for d in table:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
