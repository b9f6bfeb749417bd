import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import ODD
from voxlog.llm import exact_dedup, line_dedup, simhash
from voxlog.llm.registry import oracle_sql, queries
from voxlog.llm.shared import Scratch, connected_components

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_its_sql(spark, same_as_sql, name):
    same_as_sql(queries()[name](spark, DATA), oracle_sql()[name])


def test_exact_dedup_of_odd_rows(docs):
    got = exact_dedup.exact_dedup(docs(ODD)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    for r in got:
        (members,) = [m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(members) and r["keep_id"] == max((m for m in members if m is not None), default=None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_exact_dedup_with_heavy_and_light_groups(docs):
    rows = [(i, "Hot" if i % 3 else f"pair {i // 6}") for i in range(3000)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(rows)).collect()}
    sizes = {}
    for i, t in rows:
        sizes.setdefault(t.lower(), []).append(i)
    assert all(got[i]["keep_id"] == max(sizes[t.lower()]) and got[i]["group_size"] == len(sizes[t.lower()]) and got[i]["kept"] == (i == max(sizes[t.lower()])) for i, t in rows)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{row: smallest row reachable} over links of at most 4 bits."""
    v = np.array(fps, np.uint64)
    label = list(range(len(v)))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    label = brute_components(fps)
    got = {r["doc_id"]: r for r in queries()["op6_simhash_near_dedup"](spark, DATA).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {r["doc_id"]: (f"{fps[i]:016x}", rows[label[i]]["doc_id"]) for i, r in enumerate(rows)}


def test_near_links_keep_all_that_is_reachable(spark, monkeypatch):
    """Chains, dense balls and far fingerprints, also when a prefix must be split."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(rng.randint(0, 12)):  # chains of steps of 1 to 5 bits
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << i) for i in range(64)} | {ball ^ (1 << i) ^ (1 << (i + 1) % 64) for i in range(64)}
    fps = sorted(fps)
    label = brute_components(fps)
    for at_once in (simhash.MADE_AT_ONCE, 5_000):
        monkeypatch.setattr(simhash, "MADE_AT_ONCE", at_once)
        out = []
        for prefix in range(16):
            near = np.array([f for f in fps if bin((f >> 60) ^ prefix).count("1") <= 2], np.uint64)
            simhash._links(near, prefix, 4, 2, out)
        links = np.concatenate(out)
        assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all()
        at = {f: i for i, f in enumerate(fps)}
        mine = list(range(len(fps)))
        for a, b in links.tolist():
            x, y = mine[at[a]], mine[at[b]]
            if x != y:
                mine = [min(x, y) if z in (x, y) else z for z in mine]
        assert mine == label


def test_simhash_of_odd_rows(docs):
    got = simhash.near_dedup(docs(ODD)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fp"] & (2**64 - 1)) for r in got) == sorted((i is not None, i or 0, brute_fingerprint(t)) for i, t in ODD)
    zero = {r["component_id"] for r in got if r["fp"] == 0}
    assert zero == {1} and simhash.near_dedup(docs([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(7, 7)]
    label = {n: n for e in edges for n in e}
    for a, b in edges * 3:
        x, y = label[a], label[b]
        if x != y:
            label = {n: min(x, y) if v in (x, y) else v for n, v in label.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    alone = {n for e in edges if e[0] == e[1] for n in e} - {n for e in edges if e[0] != e[1] for n in e}
    assert dict(map(tuple, got.collect())) == {n: v for n, v in label.items() if n not in alone}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_line_dedup(docs):
    long = "this passage stands in several documents and differs in one number only:"
    rows = [
        (1, f"first own line here\n{long} 17\n\nlast one"),
        (2, f"second own line here\n{long} 18\nthey said that anna knew the other people in the room\nsame same\nsame same"),
        (3, f"{long} 19\nthird own line\nthey said that berta knew the other people in the room"),
        (4, "the whole text is somewhere else\nfirst own line here"),
        (5, "first own line here\nlast one"),
    ]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_lines"] == 4 and got[1]["n_dropped"] == 0
    assert got[2]["text"] == "second own line here\nthey said that anna knew the other people in the room\nsame same\nsame same"
    assert got[3]["text"] == "third own line" and got[3]["n_dropped"] == 2
    assert got[4]["text"] == "the whole text is somewhere else" and got[5]["text"] == "last one"


def test_line_dedup_of_odd_rows(docs):
    df = docs(ODD)
    got = line_dedup.line_dedup(df).collect()
    assert len(got) == len(ODD) and set(df.columns) <= set(got[0].asDict())
    texts = [(r["doc_id"], r["text"]) for r in got]
    assert (None, None) in texts and (1, None) in texts and (3, " \t\n ") in texts and texts.count((4, "one")) == 3
    assert line_dedup.line_dedup(docs([])).collect() == []
