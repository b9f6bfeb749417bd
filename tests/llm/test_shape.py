import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from voxlog.llm import packing, pieces, sharding
from voxlog.llm.registry import queries
from voxlog.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_are_near_equal(spark, shards):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.kd_shard(df, shards=shards).collect()
    largest, total = max(r["size"] for r in got), sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(shards)) and len(got) == df.count()
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all(r["size"] == size(texts[r["doc_id"]]) and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    if shards != 5:
        return
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.kd_shard(df.repartition(3), shards=shards).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def brute_kd(rows, leaves):
    """{row: leaf} of rows ((dims), id, weight): cut at the boundary nearest to the wanted weight, along the widest dimension."""
    spread = [max(r[0][i] for r in rows) - min(r[0][i] for r in rows) for i in range(len(rows[0][0]))]

    def cut(own, first, k):
        if k == 1 or not own:
            return {i: first for i in own}
        width = [(max(rows[i][0][d] for i in own) - min(rows[i][0][d] for i in own)) / max(1, spread[d]) for d in range(len(spread))]
        d = width.index(max(width))
        own = sorted(own, key=lambda i: (rows[i][0][d], rows[i][1]))
        ends = np.cumsum([0] + [rows[i][2] for i in own])
        want = ends[-1] * (k // 2) / k
        at = int(np.abs(ends - want).argmin())
        return cut(own[:at], first, k // 2) | cut(own[at:], first + k // 2, k - k // 2)

    return cut(list(range(len(rows))), 0, leaves)


@pytest.mark.parametrize("driver_nodes", [1, 2, 1024])
def test_cuts_equal_brute_force(spark, monkeypatch, driver_nodes):
    monkeypatch.setattr(sharding, "DRIVER_NODES", driver_nodes)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 30)
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    code = lambda s: int.from_bytes((s or "").encode()[:6].ljust(6, b"\0"), "big")
    docs = df.collect()
    rows = [((r["n_chars"], code(r["lang"]), code(r["source"])), r["doc_id"], size(r["text"])) for r in docs]
    want = {docs[i]["doc_id"]: leaf for i, leaf in brute_kd(rows, 11).items()}
    got = sharding.kd_shard(df, shards=11).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want
    for s in range(11):  # slots follow ids, however many ranges they are numbered in
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        assert own == list(enumerate(sorted(i for _, i in own)))


def test_sharding_of_odd_and_equal_rows(docs):
    got = sharding.kd_shard(docs(ODD), shards=8).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is not None, i or 0, size(t)) for i, t in ODD)
    same = sharding.kd_shard(docs([(1, "same")] * 400), shards=8).collect()  # nothing but the row tells them apart
    counts = np.bincount([r["shard"] for r in same], minlength=8)
    assert counts.min() >= 49 and counts.max() <= 51
    assert sharding.kd_shard(docs([]), shards=8).collect() == []
    assert len({r["shard"] for r in sharding.kd_shard(docs([(i, "x" * 99) for i in range(64)]), target_bytes=1000).collect()}) == 7


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = Encoder()


def plain_ids(text):
    return b"".join(i.to_bytes(4, "little") for i in TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "I'm", "don't", "'s", "123", "é", "ß", "日本", " ", " ", "<|endoftext|>", ".", "!?", "\r", "\U0001f600", "́", "\x1c"]), max_size=12).map("".join))
def test_encoding_equals_the_tokenizer(text):
    assert ENCODER.ids(text) == plain_ids(text)


def test_encoding_of_documents(spark):
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert ENCODER.ids(r["text"]) == plain_ids(r["text"])


def check_packing(rows, texts, length=1024):
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, own in by.items():
        ids = plain_ids(texts[i]) + b"\2\0\0\0"
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == len(ids) // 4
        assert all(r["length"] == length for r in own[1:]) and all(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in own)
    for own in seq.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [r["length"] for r in own])
        assert [r["offset"] for r in own] == list(ends[:-1]) and ends[-1] <= length
    return len(seq), sum(r["length"] for r in rows)


def test_packing(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries()["op4_best_fit_packing"](spark, DATA).collect()
    sequences, tokens = check_packing(rows, texts)
    assert set(texts) == {r["doc_id"] for r in rows} and sequences <= tokens / 1024 * 1.02 + 1


def test_packing_of_odd_rows(docs):
    rows = packing.best_fit_pack(docs(ODD)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    lengths = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    want = {}
    for i, t in ODD:
        want[i] = want.get(i, 0) + len(plain_ids(t or "")) // 4 + 1
    assert lengths == want and packing.best_fit_pack(docs([])).collect() == []


def test_packing_does_not_depend_on_arrow_batches(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    monkeypatch.setattr(packing, "TASK_TOKENS", 60_000)
    packed = packing.best_fit_pack(df)
    first = sorted(map(tuple, packed.collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, packed.collect())) == first == sorted(map(tuple, packing.best_fit_pack(df).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    online = packing.best_fit_pack(df, look_ahead=0).collect()
    check_packing(online, {r["doc_id"]: r["text"] for r in df.collect()})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 5))
def test_best_fit_is_the_plain_rule(lengths, open_bins):
    bins, free, order = packing.BestFit(20, open_bins), {}, 0
    filled = {}
    for n in lengths:
        at, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[at] == min(fits)
        else:
            assert at == order
            if len(free) >= open_bins:
                least = min(free.values())
                free = _without_one(free, least, bins)
            free[at] = 20
            order += 1
        assert offset == 20 - free[at] == filled.get(at, 0)
        filled[at] = filled.get(at, 0) + n
        free[at] -= n
        if not free[at]:
            del free[at]
        assert len(free) <= open_bins and bins.open == len(free)


def _without_one(free, least, bins):
    """Of the fullest sequences, the one that the packer closed."""
    still = {x for own in bins.free for x in own}
    gone = [k for k, f in free.items() if f == least and k not in still]
    return {k: f for k, f in free.items() if k != gone[0]}


LATTICES = pieces.Lattices()


def decoded(ids):
    return b"".join(LATTICES.surface[i] for i in ids.tolist()).decode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from([" ", "  ", "\n", "▁", "a", "the", "there", "é", "日", "\U0001f600", "\t"]), max_size=15).map("".join))
def test_sampled_pieces_decode_to_the_text(text):
    ids, n = pieces.encode_texts(LATTICES, [text, text], [7, 7])
    assert decoded(ids[: n[0]]) == text and ids[: n[0]].tolist() == ids[n[0] :].tolist()


@pytest.mark.parametrize("word", [" there", "aaaa", " the", "éa"])
def test_sampling_follows_the_lattice(word):
    """Frequencies of the sampled segmentations against the weights of all of them."""
    text, all_of = word.replace(" ", pieces.SPACE), {}

    def walk(i, ids, w):
        if i == len(text):
            all_of[tuple(ids)] = w
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in LATTICES.pieces:
                piece, weight = LATTICES.pieces[text[i:j]]
                walk(j, [*ids, piece], w * weight)

    walk(0, [], 1.0)
    n = 40_000
    ids, lengths = LATTICES.sample([word] * n, np.full(n, 5, np.uint64), np.arange(n))
    cuts = np.split(ids, np.cumsum(lengths)[:-1])
    seen = {}
    for c in cuts:
        seen[tuple(c.tolist())] = seen.get(tuple(c.tolist()), 0) + 1
    total = sum(all_of.values())
    assert set(seen) <= set(all_of) and all(abs(seen.get(k, 0) / n - w / total) < 0.015 for k, w in all_of.items())


def test_long_words_and_the_bounded_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 10)
    texts = ["ab" * 3000, "é" * 100 + "\U0001f600" * 50, *(f"word{i} again" for i in range(60))]
    a, n = pieces.encode_texts(LATTICES, texts, list(range(len(texts))))
    assert decoded(a) == "".join(texts)
    b, _ = pieces.encode_texts(LATTICES, texts[5:9], [5, 6, 7, 8])
    assert b.tolist() == a[n[:5].sum() : n[:9].sum()].tolist()  # neither batch nor cache decides


def test_pieces_through_spark(spark, docs):
    got = queries()["op3_sentencepiece_sampling"](spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_chars"], r["text_crc32"]) for r in got} == {i: (len(t), zlib.crc32(t.encode())) for i, t in texts.items()}
    odd = pieces.decode(pieces.encode(docs(ODD))).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd) == sorted((i is not None, i or 0, t or "") for i, t in ODD)
    assert pieces.decode(pieces.encode(docs([]))).collect() == []
