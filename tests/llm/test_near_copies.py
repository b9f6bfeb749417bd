import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD
from voxlog.llm import near_copies as nc


def words_of(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def jaccard(a, b):
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_partial_fingerprints_reach_the_similarity():
    """Of pairs just above the limit all are proposed (a miss has probability 0.00003)."""
    rng, tried = random.Random(4), 0
    while tried < 1000:
        a = words_of(rng, 200)
        b = list(a)
        for at in rng.sample(range(200), 4):
            b[at] = "other"
        if not 0.8 <= jaccard(" ".join(a), " ".join(b)) < 0.85:
            continue
        tried += 1
        x, y = (nc.partial_fingerprints(nc.shingles(" ".join(t).encode())) for t in (a, b))
        assert (x == y).any()


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    """Against brute force: all pairs by Jaccard similarity, chains and a hot group included."""
    rng, texts = random.Random(5), []
    for _ in range(40):
        t = words_of(rng, rng.randint(20, 200))
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 4)):
            t = list(t)
            for at in rng.sample(range(len(t)), rng.randint(1, max(1, len(t) // 40))):
                t[at] = f"w{rng.randrange(100_000)}"
            texts.append(" ".join(t))
    hot = words_of(rng, 100)
    texts += [" ".join([*hot, str(i)]) for i in range(60)]
    passage = words_of(rng, 90)  # shared by texts that aren't similar enough, some of which have near copies
    for i in range(40):
        own = words_of(rng, 35)
        texts.append(" ".join(passage + own))
        if i % 4 == 0:
            texts.append(" ".join([*passage, *own[:-2], "other"]))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(label) and len(got) < len(texts) - 60 - 10


def bits_of(text):
    """The SimHash fingerprint by plain counting."""
    w = text.split()
    h = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def joined(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_simhash_finds_all_within_its_radius(spark):
    """Without partial fingerprints: sets whose fingerprints reach each other by steps of 4 bits, then the shingles decide."""
    rng, texts = random.Random(6), []
    for _ in range(25):
        t = words_of(rng, rng.randint(8, 300))
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 8)):
            t = list(t)
            t[rng.randrange(len(t))] = f"w{rng.randrange(100_000)}"
            texts.append(" ".join(t))
    fps = list(map(bits_of, texts))
    assert [nc.simhash(nc.shingles(t.encode())) % 2**64 for t in texts] == fps
    group = joined(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    near = joined(len(texts), lambda i, j: group[i] == group[j] and jaccard(texts[i], texts[j]) >= 0.8)
    every = joined(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, nc.near_copies(df, "doc_id", partial=0).collect())) == dict(enumerate(near))
    assert dict(map(tuple, nc.near_copies(df, "doc_id").collect())) == dict(enumerate(every))
    assert len(set(every)) < len(set(near)) < len(texts)


def test_near_copies_of_odd_rows(docs, spark):
    rows = [(n, t) for n, (_, t) in enumerate(ODD)]
    got = dict(map(tuple, nc.near_copies(docs(rows), "doc_id").collect()))
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13}
    assert nc.near_copies(docs([]), "doc_id").count() == 0 and len(nc.shingles(b" \t")) == 0 and np.array_equal(nc.shingles(b"A b"), nc.shingles(b"a B"))


def test_quality_stage_judges_every_row(spark):
    """Rows that share an id, or have none, stand by their own text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").select(docs.columns).where("n_chars > 500").orderBy("doc_id").limit(60)
    other = docs.join(labels, "doc_id", "left_anti").first()["doc_id"]
    clean = good.limit(1).withColumn("doc_id", F.lit(other).cast("long"))
    junk = spark.createDataFrame([(i, "QZX#7Jw@" * 200, "en", "s", 1600) for i in (None, other, None)], docs.schema)
    got = corpus_pipeline.quality_classifier(spark, good.unionByName(clean).unionByName(junk), "/root/testdata/sf0.01")
    assert got.where("text like 'QZX%'").count() == 0 and got.count() >= 58 and got.where(F.col("doc_id") == other).count() == 1


def test_stage_decides_by_row(spark):
    """A repeated id keeps the text that is no copy, and rows without an id are copies like others."""
    a, b, c = (" ".join(words_of(random.Random(i), 50)) for i in range(3))
    rows = [(1, a), (2, a), (2, b), (None, b), (None, c), (None, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, c)], key=str)
