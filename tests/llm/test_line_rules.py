from pyspark.sql import functions as F

from voxlog.llm import line_dedup


def words(i):
    return " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("one", "two", "three", "four", "five"))


def test_short_lines_go_from_a_share_of_the_documents_on(docs):
    """Boilerplate of one token goes, a common word that stands alone now and then stays, a long line without spaces goes."""
    passage = "这一段话在每一篇文章里都会出现而且没有任何空格所以只算一个词"
    rows = [(i, f"the the the the {words(i)}\nShare.\n{'The.' if i % 3 == 0 else 'Own' + words(i)[:8]}" + (f"\n{passage}" if i < 2 else "")) for i in range(60)]
    rows += [(100, "Rare two"), (101, "Rare two\n---"), *((i, "---\n12") for i in range(200, 220))]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(docs(rows), short_share=0.3).collect()}
    assert sum("Share." in t for t in got.values()) == 1 and "Share." in got[0]
    assert sum("The." in t for t in got.values()) == 20
    assert passage in got[0] and passage not in got[1]
    assert got[101] == ["Rare two", "---"] and all(got[i] == ["---", "12"] for i in range(200, 220))
    got = [r["text"] for r in line_dedup.line_dedup(docs(rows), short_documents=3, short_share=0.0).collect()]
    assert sum("The." in t for t in got) == 1 and sum("Rare two" in t for t in got) == 2


def test_columns_of_clashing_names(docs):
    df = docs([(1, "a line of five tokens\nb"), (2, "a line of five tokens")])
    for name in ("_id", "_th", "_gone", "_lines", "_kept", "th", "gone", "row", "lines", "kept", "pos", "t", "short", "n_lines", "a.b"):
        df = df.withColumn(name, F.lit(name))
    got = {r["doc_id"]: r.asDict() for r in line_dedup.line_dedup(df).collect()}
    assert got[1]["n_lines"] == 2 and got[2]["text"] == "" and set(got[1]) == set(df.columns) | {"n_dropped"}
    assert all(got[1][c] == c for c in df.columns if c not in ("doc_id", "text", "n_lines"))


def test_a_leaf_of_many_templates(docs):
    """Five templates and unrelated lines of one lead and length: other lines of the leaf don't hide a template."""
    rows = []
    for k in range(5):
        c = "vwxyz"[k]
        rows += [(100 * k + i, f"in the first {c}a {c}b {c}c {c}d own{words(i)[3:5]}{k}") for i in range(20)]
    rows += [(1000 + i, f"in the first {words(i)}") for i in range(60)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs(rows)).collect()}
    assert all(n == (i < 1000 and i % 100 > 0) for i, n in got.items())


def test_small_tables_are_few_files(docs, spark, monkeypatch):
    """A table of few lines isn't written as a file for each of many shuffle partitions."""
    put, files = line_dedup.Scratch.put, []

    def counted(self, df):
        back = put(self, df)
        files.append(len(back.inputFiles()))
        return back

    monkeypatch.setattr(line_dedup.Scratch, "put", counted)
    rows = [(2 * i + k, f"lead of all {words(i)} own{words(i)[3:5]}{k}\nalone {words(i)}") for i in range(400) for k in range(2)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        got = line_dedup.line_dedup(docs(rows).coalesce(2)).agg({"n_dropped": "sum"}).first()[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got >= 400 and max(files) <= 2 * spark.sparkContext.defaultParallelism
