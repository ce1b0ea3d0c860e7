"""Near-duplicate components against all pairs of full sets."""

import random
import re
from itertools import combinations

import pyspark.sql.types as T

from trackhouse.llm import minhash
from trackhouse.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("keys", T.StringType())])


def shingle_set(text, length=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1)))


def brute(rows):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingle_set(text))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations([(i, s) for i, own in sets.items() for s in own if s], 2):
        n = len(a & b)
        if i != j and 100 * n >= 80 * (len(a) + len(b) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for i, own in sets.items() for s in own)


def sample():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += rows[:15] + ["A b C", "a B c", "one", "ONE", "one two", "É é", "é é", " \n", "", None, "a " * 500, "a " * 90]
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    return minhash.near_duplicates(docs).collect()


def test_equals_all_pairs(spark):
    rows = sample()
    assert sorted(tuple(r) for r in found(spark, rows)) == brute(rows)


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(4, text), (4, text), (9, text + " q"), (None, text), (None, None), (5, "x y z u v w s t"), (5, text)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in found(spark, rows)), key=str)
    expected = [(False, 4, 13, 4, True)] * 2 + [(False, 9, 14, 4, False), (False, 5, 5, 4, False), (False, 5, 13, 4, False),
                                               (True, 0, 13, None, True), (True, 0, 0, None, True)]
    assert got == sorted(expected, key=str)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_estimate_follows_similarity(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**6)}" for _ in range(2000)]
    other = [w if rng.random() > 0.02 else "changed" + str(i) for i, w in enumerate(base)]
    rows = [(0, " ".join(base)), (1, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    one, two = (minhash.sketches(docs, "doc_id", "text", 4).where(f"doc = {i}").select("sig") for i in (0, 1))
    pair = one.withColumnRenamed("sig", "p").join(two.withColumnRenamed("sig", "q"))
    from pyspark.sql import functions as F

    value = pair.select(minhash.estimate(minhash.matches(F.col("p"), F.col("q")))).first()[0]
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert abs(value - len(a & b) / len(a | b)) < 0.12


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_query(spark, small_dir):
    from trackhouse.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.all_queries()["op2_minhash_dedup"](spark, small_dir).collect()) == brute(rows)
