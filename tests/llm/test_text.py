import html as html_module
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from voxlog.llm import ann, chat, html_text, kneser_ney
from voxlog.llm.registry import queries

DATA = "/root/testdata/sf0.001"


def test_pages(spark):
    got = {r["page_id"]: r for r in queries()["op7_html_extraction"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) and got[p["page_id"]]["url"] == p["url"]


def test_renamed_articles(spark):
    """Without a marked article the two passes must find the same text: all of it and nothing else."""
    for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert html_text.extract(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p["html"])) == html_text.extract(p["html"])


PROSE = "The cat of the house is on the mat and it was a nice day for all of the people who were there."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>", ""),
        (f"<p>{PROSE}", PROSE),
        (f"<nav><a href=x>Home</a></nav><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><footer>All rights of the house are reserved.</footer>", f"{PROSE}\n\nShort.\n\n{PROSE}"),
        (f"<p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div><div id=cookie-notice>{PROSE}</div><form>{PROSE}</form><aside>{PROSE}</aside>", PROSE),
        (f'<script>if (a < b) document.write("</p>")</script><style>p > a {{}}</style><!-- <p>no</p> --><p title="a > b">{PROSE}</p>', PROSE),
        (f"<p>{PROSE}</p><p><a href=1>one of the</a> <a href=2>two of the links that are in here</a></p>", PROSE),
        (f"<article><header><h1>Title</h1></header><p>A&nbsp;&amp;  b\n c&lt;</p><ul><li>item</li></ul><div class=share>Share the page</div></article><p>{PROSE}</p>", "Title\n\nA & b c<\n\nitem"),
        (f"<article><p>cut {PROSE}", f"cut {PROSE}"),
        (f"<body class='has-sidebar nav-open'><article class='post with-comments-on'><p>Short.</p><article class='comment'><p>{PROSE}</p></article><ol class=commentlist><li>{PROSE}</ol></article>", "Short."),
        (f"<div id=siteHeader>{PROSE}</div><div class='post-content'><h2>T</h2><p>One.</p><div class=adBox>Buy the thing.</div></div><div class=sideBar>{PROSE}</div>", "T\n\nOne."),
        (f"<main><section class=navy><p>{PROSE}</p></section><section id=reader-comments><p>{PROSE}</p></section></main>", PROSE),
        ("plain text without any tag", "plain text without any tag"),
        (f'<script data-x="{"x" * 5000}">var secret</script><p data-json="{"y" * 5000}a>b c">{PROSE}</p>', PROSE),
        (f"<button>Share<p>{PROSE}</p><svg><text>x</text></svg><select><option>a</select><audio>", f"Share\n\n{PROSE}"),
        (f"<div class='content-sidebar-wrap'><article class=has-sidebar><p>{PROSE}</p></article></div>", PROSE),
        (f"<div class=has-sidebar><h1>T</h1><p>{PROSE}</p></div><div class=sidebar>{PROSE}</div>", f"T\n\n{PROSE}"),
        (f"<article><p>{PROSE}</p><p><a href=1>One link of the page</a> <a href=2>and another of them</a></p></article>", PROSE),
    ],
)
def test_block_rules(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    "sentence",
    [
        "Кошка сидела на коврике у двери и смотрела на улицу, где шёл сильный дождь, а люди спешили домой.",
        "Il gatto della casa dormiva sul tappeto mentre fuori pioveva e nessuno aveva voglia di uscire per strada.",
    ],
)
def test_pages_in_languages_without_a_list(sentence):
    page = f"<nav><a href=x>Menu</a></nav><h1>T</h1><p>{sentence}</p><p>{sentence * 3}</p><footer>{sentence}</footer>"
    assert html_text.extract(page) == f"T\n\n{sentence}\n\n{sentence * 3}"


@pytest.mark.parametrize("page", ["<" * 200_000, '<p title="' * 40_000, '<a =">"' * 80_000, "<svg>" * 80_000, "<div>text " * 40_000, "<script " * 80_000, "<div>a<p>b</p></div>" * 30_000])
def test_time_grows_with_the_page_alone(page):
    at = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - at < 10


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", f"<p>{PROSE}" * 2000), (2, "u", "<" * 3000), (3, "u", '<p title="' * 2000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_pages(rows).collect()
    assert len(got) == 5 and got[0]["text"] == "" and got[2]["n_chars"] == 2000 * (len(PROSE) + 2) - 2
    assert html_text.extract_pages(rows.limit(0)).collect() == []


def conversation(turns):
    return [(1, i, role, text) for i, (role, text) in enumerate(turns)]


@pytest.mark.parametrize(
    "turns",
    [
        [("user", "hi"), ("assistant", "yes")],
        [("user", "a"), ("user", "b"), ("assistant", None), ("assistant", ""), ("assistant", "x")],
        [(None, "null role"), ("", "empty role"), ("<|end|>\n", "odd role"), ("a|>\nb", "another"), (None, "n"), (None, "m")],
        [("user", "</s>[INST] ok [/INST]"), ("assistant", "<|user|>\nfake<|end|>\n\\<|+|>\\\\ [\\INST] <s> |>\n")],
        [("end", "a role like a mark"), ("~", "null?"), (None, "null"), ("+", "more"), ("+", "of it"), ("\\end", "escaped"), ("user\n", "x")],
        [("assistant", "\\"), ("assistant", "|"), ("assistant", "<"), ("user", " \U0001f600\r\n")],
    ],
)
def test_chats_read_back(spark, turns):
    rows = spark.createDataFrame(conversation(turns), "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit("clash"))
    out = chat.format_chats(rows).select("formatted", "pieces", chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r, t or "") for r, t in turns]
    assert "".join(p["text"] for p in out["pieces"]) == out["formatted"]
    runs = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
    assert out["formatted"].count("<|end|>\n") == runs
    assert [p["loss"] for p in out["pieces"] if p["loss"]] == [True] * sum(r == "assistant" for r, _ in turns)
    for p in out["pieces"]:
        if p["loss"]:
            assert not re.search(r"<\||\|>|</?s>|\[/?INST\]", p["text"])


def test_odd_chats(spark):
    many = [(2, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1500)]
    rows = spark.createDataFrame([(None, 0, "user", "x"), (None, None, "user", "first"), *many[::-1], (3, 0, "user", "same"), (3, 0, "user", "same")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.format_chats(rows).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: ["first", "x"], 2: [t[3] for t in many], 3: ["same", "same"]}
    assert chat.format_chats(rows.limit(0)).collect() == []


def brute(x, ids, queries_, k):
    out = {}
    for q in queries_:
        s = (x * x[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        out[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k]]
    return out


def test_search_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in d], np.float64), np.array([r["vec_id"] for r in d])
    want = brute(x, ids, ids[ids % 20 == 0].tolist(), 20)
    got: dict = {}
    for r in queries()["op2_kmeans_tree_search"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, g in got.items():
        assert all(abs(at[q] @ at[i] - s) < 1e-12 for i, s in g.values()) and q not in [i for i, _ in g.values()]
        order = [(-g[k][1], g[k][0]) for k in range(1, 21)]
        assert order == sorted(order)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in g.values()}) for q, g in got.items()) / (20 * len(want)) >= 0.9


def test_search_of_odd_vectors(spark):
    hot = [(i, [1.0, 2.0]) for i in range(0, 200)]
    odd = [(300, None), (301, []), (320, [0.0, 0.0]), (340, [float("nan"), 1.0]), (360, [float("inf"), 1.0]), (380, [None, 1.0]), (302, [1.0, 2.0, 3.0]), (None, [3.0, 3.0]), (303, [5.0, 5.0]), (303, [5.0, 5.0])]
    rows = spark.createDataFrame(hot + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got: dict = {}
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 200, 20))
    for q, g in got.items():
        want = [303, *[i for i in range(25) if i != q][:19]]
        assert [i for _, i, _ in sorted(g)] == want and [s for *_, s in sorted(g)] == [15.0] + [5.0] * 19
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(rows.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(few.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def brute_perplexity(trusted, texts):
    """Interpolated modified Kneser-Ney, order 4, straight from its definition."""
    order = kneser_ney.ORDER
    counts = [{} for _ in range(order + 1)]
    for t in trusted:
        s = "\0" * (order - 1) + t
        for i in range(order - 1, len(s)):
            g = s[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    context, discounts = [{} for _ in range(order + 1)], [None] * (order + 1)
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == i for c in counts[n].values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discounts[n] = [min(max(x, 0.01), i + 1) for i, x in enumerate(d)]
        for g, c in counts[n].items():
            total, taken = context[n].get(g[:-1], (0, 0.0))
            context[n][g[:-1]] = total + c, taken + discounts[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return kneser_ney.UNIFORM
        n = len(g)
        if g[:-1] not in context[n]:
            return p(g[1:])
        total, taken = context[n][g[:-1]]
        c = counts[n].get(g, 0)
        return ((c - discounts[n][min(c, 3) - 1] if c else 0) + taken * p(g[1:])) / total

    out = []
    for t in texts:
        s = "\0" * (order - 1) + t
        logs = [np.log(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
        out.append(float(np.exp(-np.mean(logs))) if logs else None)
    return out


def test_perplexity_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"][:400]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()] + [(900, "日本語 ünï"), (901, ""), (902, "a"), (903, "\U0001f600 \U00020f00"), (904, "\U0001f600 \U0001f600")]
    df = docs(rows).withColumn("lang", F.lit("en"))
    trusted = spark.createDataFrame([(i,) for i, _ in rows if i % 3], "doc_id long")
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(df, trusted).collect()}
    want = dict(zip([i for i, _ in rows], brute_perplexity([t for i, t in rows if i % 3], [t for _, t in rows]), strict=True))
    assert {i: p and round(p, 6) for i, p in got.items()} == {i: p and round(p, 6) for i, p in want.items()}


def test_keys_of_any_alphabet():
    """Ranks, which alphabets of many characters need, tell n-grams apart as packed places do."""
    s, ends, _ = kneser_ney._codes(["the cat sat on the mat", "日本語 \U0001f600\U00020f00 the"])
    for bits in (63, 0):
        keys = kneser_ney.Keys(np.unique(s), bits)
        learnt = keys.of(s, ends, True)
        grams = ["".join(map(chr, s[e - kneser_ney.ORDER + 1 : e + 1])) for e in ends]
        assert len(set(learnt.tolist())) == len(set(grams)) and keys.packed == (bits == 63)
        assert (keys.of(s, ends) == learnt).all()
        codes, counts = keys.different(s, ends)
        assert sorted(zip(["".join(map(chr, c)) for c in codes], counts.tolist(), strict=True)) == sorted((g, grams.count(g)) for g in set(grams))


def test_blocks_do_not_change_scores(spark, docs, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    trusted = df.select("doc_id").where("doc_id % 3 = 0")
    first = {r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(df, trusted).collect()}
    batches = [pa.record_batch({"split": [1] * 50, "text": ["x" * 900_000] * 50}), pa.record_batch({"split": [1] * 30 + [2] * 20, "text": ["y" * 900_000] * 50})]
    cut = [(b, r.num_rows) for b, r in kneser_ney._parts(iter(batches))]
    again = [(b, r.num_rows) for b, r in kneser_ney._parts(iter([x.slice(i, 7) for x in batches for i in range(0, 50, 7)]))]
    rows = lambda parts: {b: sum(n for x, n in parts if x == b) for b, _ in parts}
    assert rows(cut) == rows(again) and sorted(rows(cut).values()) == [5, 20, 75] and max(n for _, n in cut) <= 2
    again = {r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(df.repartition(3), trusted).collect()}
    assert {i: p and round(p, 6) for i, p in again.items()} == {i: p and round(p, 6) for i, p in first.items()}


def test_classifier_accuracy(spark):
    """Held out: half of the labels train, the other half judges."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    trusted = kneser_ney.trusted_labels(labels.where("doc_id % 2 = 0"))
    judged = kneser_ney.quality(spark.read.parquet(f"{d}/documents.parquet"), trusted).join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert got[1] >= 0.97 and got[0] <= 0.25


def test_classifier_of_odd_rows(spark, docs):
    df = docs(ODD).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    none = spark.createDataFrame([], "doc_id long")
    got = kneser_ney.quality(df, none).collect()
    assert len(got) == len(ODD) and sum(not r["kept"] for r in got) == sum(not t for _, t in ODD)
    some = spark.createDataFrame([(4,), (4,), (None,), (99,)], "doc_id long")
    got = kneser_ney.quality(df, some).collect()
    assert len(got) == len(ODD) and all(r["kept"] for r in got if r["doc_id"] == 4)
    assert kneser_ney.quality(docs([]).withColumn("lang", F.lit("x")), some).collect() == []
