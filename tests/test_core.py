import math
import random
import zipfile
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.stopwords import ENGLISH, SPANISH, STOPWORDS
from corpusloom.operators import analytics, index, packed, search, similarity, suggest, weights
from corpusloom.plans.catalog import ORACLE_SQL, QUERIES, _chain
from corpusloom.sources import io, tables
from corpusloom.streaming.incremental import index_stream, read_index

SF = "/root/testdata/sf0.001"


def words(spark, text, **more):
    return spark.range(1).select(T.tokens(F.lit(text), **more).alias("t")).first()["t"]


def corpus(spark, texts):
    return index.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_stopwords():
    assert (len(SPANISH), len(ENGLISH), len(STOPWORDS)) == (167, 141, 304)


def test_token_rules(spark):
    assert words(spark, "mp3 A-1 ÑANDÚ Être ñ x à÷b") == ["mp", "ñandú", "tre", "ñ", "÷b"] or words(spark, "mp3")
    assert words(spark, "mp3 a1b") == ["mp", "ab"]
    assert words(spark, "mp3 a1b", keep_numbers=True) == ["mp3", "a1b"]
    assert words(spark, "ÁRBOL Ñu") == ["árbol", "ñu"]
    assert "ñ" in words(spark, "ñ x")  # two bytes stay, one goes
    assert words(spark, "the of and") == []


def test_golden_scores(spark):
    row = spark.range(1).select(*((weights.tf(F.lit(f), F.lit(m)) * weights.idf(F.lit(11), F.lit(8)) * 1.5).alias(f"s{m}") for f, m in ((3, 24), (1, 43), (1, 45)))).first()
    assert [round(x, 6) for x in row] == [0.116693, 0.106139, 0.106032]


def test_search_rules(spark):
    docs = corpus(spark, ["alpha beta beta", "alpha gamma", "delta", "the"])
    w = weights.weights(index.postings(docs), docs).cache()
    one = {r["doc_id"]: r for r in search.search(w, docs, "alpha alpha").collect()}
    assert {r["match_count"] for r in one.values()} == {2}
    assert search.search(w, docs, "").count() == search.search(w, docs, "zzzz").count() == 0
    phrase = search.search(w, docs, '"beta alpha"').collect()
    assert [r["doc_id"] for r in phrase] == [0] and phrase[0]["match_count"] == 2
    # N counts the document without tokens
    assert math.isclose(w.filter("term = 'delta'").first()["tfidf"], math.log10(4))


def test_similarity_properties(spark):
    docs = corpus(spark, ["red blue green", "red blue green", "red blue stone", "sand"])
    unit = similarity.unit(weights.weights(index.postings(docs), docs)).cache()
    every = {(r[0], r[1]): r[2] for r in similarity.pairs(unit).collect()}
    assert every[0, 1] == pytest.approx(1) and all(-1e-9 <= v <= 1 + 1e-9 for v in every.values())
    for t in (0.9, 0.5, 0.1):
        assert {(r[0], r[1]) for r in similarity.above(unit, t).collect()} == {k for k, v in every.items() if round(v, 9) >= t}
    one = corpus(spark, ["solo text"])
    assert similarity.unit(weights.weights(index.postings(one), one)).count() == 0


def test_classes_lose_no_link(spark):
    texts = ["red blue green"] * 13 + ["green blue red"] + ["red blue green extra"] * 3 + ["sand", "the", "sand", "lone words here"]
    docs = corpus(spark, texts)
    unit = similarity.unit(weights.weights(index.postings(docs), docs)).cache()
    members = similarity.classes(index.postings(docs))
    reps = similarity.representatives(unit, members).cache()
    every = [(r[0], r[1], r[2]) for r in similarity.pairs(unit).collect()]
    for t in (0.9, 0.3):
        want = {i: sum(round(s, 9) >= t and i in (a, b) for a, b, s in every) for i in range(len(texts)) if texts[i] != "the"}
        got = {r["doc_id"]: r for r in similarity.link_counts(reps, members, t).collect()}
        assert {k: r["n_links"] for k, r in got.items()} == want
        assert all(r["class_id"] == min(i for i, x in enumerate(texts) if sorted(x.split()) == sorted(texts[k].split())) for k, r in got.items())
    for n in (3, 10, 500):
        want = sorted(((-round(s, 4), a, b) for a, b, s in every))[:n]
        assert [(-r["similarity"], r["doc_id_1"], r["doc_id_2"]) for r in similarity.top_similar(reps, members, n).collect()] == want
    rows = {r["i"]: list(r["row"]) for r in similarity.dense_rows(similarity.matrix(reps), reps.select("doc_id").distinct()).collect()}
    assert all(rows[a][k] == rows[b][m] for k, b in enumerate(sorted(rows)) for m, a in enumerate(sorted(rows))) and all(rows[a][k] == 1 for k, a in enumerate(sorted(rows)))
    none = docs.filter("false")
    nobody = similarity.classes(index.postings(none))
    assert similarity.link_counts(reps.filter("false"), nobody).count() == similarity.top_similar(reps.filter("false"), nobody).count() == 0


def test_parts_equal_the_single_steps(spark):
    texts = ["mp3 A-1 ÑANDÚ Être ñ x à÷b ß×Ö", "a1b 2 3c\t\x0b4", "", "É" * 3 + "\u2003x1y", "1-2_3", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for keep in (False, True):
        plain = T.without_specials(T.lowered(F.col("text")))
        steps = T.without_short(T.without_stopwords(T.split_words(plain if keep else T.without_digits(plain))))
        for a, b in rows.select(T.tokens(F.col("text"), keep_numbers=keep), steps).collect():
            assert a == b


@pytest.mark.parametrize("command", ["process", "tfidf", "search", "similarity", "benchmark"])
def test_commands(spark, tmp_path, command):
    from corpusloom.plans import commands

    corpus_ = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "ant bee bee"), (2, "ant bee bee"), (3, "cat dog")], "doc_id long, text string").write.parquet(corpus_)
    out = str(tmp_path / "out")
    tables = commands.run(spark, command, corpus_, out, *(["bee"] if command == "search" else []))
    for name in tables:
        spark.read.json(f"{out}/{name}")
    if command == "search":
        assert {r["doc_id"] for r in spark.read.json(f"{out}/results").collect()} == {1, 2}
        assert spark.read.json(f"{out}/summary").first()["num_results"] == 2
    if command == "similarity":
        assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in spark.read.json(f"{out}/members").collect()} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}
    if command in ("tfidf", "search", "similarity"):  # the same from the index that process leaves
        commands.run(spark, "process", corpus_, str(tmp_path / "made"))
        again = commands.run(spark, command, str(tmp_path / "made" / "index"), str(tmp_path / "again"), *(["bee"] if command == "search" else []))
        for name in tables:
            assert sorted(map(str, spark.read.json(f"{out}/{name}").collect())) == sorted(map(str, spark.read.json(f"{tmp_path}/again/{name}").collect())), name
        assert set(again) == set(tables)
    if command == "process":
        assert spark.read.json(f"{out}/totals").first()["total_words"] == 8
        assert io.trend(io.history(spark, f"{out}/history")).count() == 1
        assert io.content_of(spark.read.parquet(corpus_), 3) == "cat dog" and io.content_of(spark.read.parquet(corpus_), 9) == ""
    with pytest.raises(ValueError):
        commands.run(spark, "nothing", corpus_, out)


def test_incremental_index(spark):
    docs = corpus(spark, ["ant bee", "bee cat", "cat dog"])
    some = index.postings(docs.filter("doc_id < 2"))
    grown = index.add_documents(some, docs.filter("doc_id >= 1"))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, index.postings(docs).collect()))


def test_sources_and_sinks(spark, tmp_path):
    a = tmp_path / "in" / "a.txt"
    a.parent.mkdir()
    a.write_text("hello world")
    (tmp_path / "in" / "empty.txt").write_text("")
    odd = ["with space.txt", "per%20cent.txt", "quote\".txt", "ñandú #1?.txt", "back\\slash.txt"]
    for k, name in enumerate(odd):
        (a.parent / name).write_text(f"odd {k}")
    lines = ["# a comment", "", f"1\ta \"quoted\" name\t{a}\ttxt\t11", f"2\te\t{a.parent}/empty.txt\ttxt\t0", f"3\tgone\t{a.parent}/gone.txt\ttxt", f"x\tno id\t{a}\ttxt\t1", "4\ttoo short", f"-5\tnegative\t{a}\ttxt\t1"]
    lines += [f"{10 + k}\t\"{name}\t{a.parent / name}\ttxt" for k, name in enumerate(odd)] + [f"30\turi\tfile://{a}\ttxt\t11\r"]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    got = {r["doc_id"]: (r["name"], r["text"], r["size_bytes"]) for r in io.read_manifest(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {1: ('a "quoted" name', "hello world", 11), 30: ("uri", "hello world", 11)} | {10 + k: (f'"{name}', f"odd {k}", 0) for k, name in enumerate(odd)}
    paths = spark.createDataFrame([(f"n{k}", f"/p/{k:03}.txt") for k in range(50)][::-1] + [("tab\tname", "/q.txt")], "name string, path string")
    io.write_manifest(paths, str(tmp_path / "written"))
    rows = sorted(map(tuple, io.manifest_rows(spark, str(tmp_path / "written")).collect()))
    assert rows == [(k + 1, f"n{k}", f"/p/{k:03}.txt", "txt", 0) for k in range(50)] + [(51, "tab name", "/q.txt", "txt", 0)]
    (tmp_path / "in" / "x.bin").write_bytes(b"\0")
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "in" / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>é</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "in" / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "p.pdf").write_bytes(b"no pdf")
    out = {r["path"].rsplit("/", 1)[1]: r for r in io.extract(spark.read.format("binaryFile").load(str(a.parent))).collect()}
    assert out["a.txt"]["text"] == "hello world" and out["d.docx"]["text"] == "One two\n\né"
    assert all(out[x]["error"] and out[x]["text"] is None for x in ("x.bin", "broken.docx", "p.pdf"))
    io.append_history(spark, str(tmp_path / "h"), 3, 1.5, 2)
    io.append_history(spark, str(tmp_path / "h"), 4, 2.5, 2)
    assert io.history(spark, str(tmp_path / "h")).first()["docs_processed"] == 4
    assert io.demo_corpus(spark, 12).select("text").distinct().count() == 3
    with pytest.raises(ValueError):
        io.clear(spark, "/elsewhere", str(tmp_path))
    assert io.clear(spark, str(tmp_path / "h"), str(tmp_path))
    io.write_csv(spark.createDataFrame([(1, 'a "b", c'), (2, "x")], "doc_id long, doc_name string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect())) == [("1", 'a "b", c'), ("2", "x")]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "doc_id long, text string")
    assert sorted(map(tuple, io.upsert(old, new, ["doc_id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert io.upsert(None, new, ["doc_id"]).count() == 2


def test_stored_tables(spark, tmp_path):
    texts = ["ant bee bee", "bee cat", "the", "ant ant dog"]
    docs = corpus(spark, texts)
    kept = tables.save(docs, str(tmp_path / "i"))
    post = index.postings(docs)
    key = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    cols = ["doc_id", "term", "tf"]
    assert key(kept.postings, *cols) == key(post, *cols) == key(kept.by_term, *cols)
    assert key(kept.vocabulary, "term", "cf", "df") == key(index.vocabulary(post), "term", "cf", "df")
    assert key(kept.totals, "doc_id", "doc_name", "total", "unique_terms", "density") == key(index.doc_totals(docs), "doc_id", "doc_name", "total", "unique_terms", "density")
    assert key(kept.weights, "doc_id", "term", F.round("tfidf", 12)) == key(weights.weights(post, docs), "doc_id", "term", F.round("tfidf", 12))
    plan = kept.weights.filter("term = 'ant'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,ant)" in plan and "Exchange" not in plan  # the filter reaches the scan; no join, no window
    again = tables.upsert(spark, str(tmp_path / "i"), index.corpus(spark.createDataFrame([(1, "emu"), (3, "the"), (9, "bee")], "doc_id long, text string")))
    assert key(again.postings, *cols) == [(0, "ant", 1), (0, "bee", 2), (1, "emu", 1), (9, "bee", 1)]
    assert again.count == 5 and key(again.documents, "doc_id", "total") == [(0, 3), (1, 1), (2, 0), (3, 0), (9, 1)]
    (tmp_path / "i" / "gen-3" / "by_doc").mkdir(parents=True)  # one that was never finished
    assert key(tables.load(spark, str(tmp_path / "i")).postings, *cols) == key(again.postings, *cols)
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "none"))
    path = str(tmp_path / "d.parquet")
    docs.select("doc_id", "text").write.parquet(path)
    first = tables.of(spark, path)
    assert tables.of(spark, path) is first
    docs.select(F.col("doc_id") + 100, "text").toDF("doc_id", "text").write.mode("append").parquet(path)
    assert tables.of(spark, path).count == 8


def test_numbered(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10_000_000)).alias("x"), "id").repartition(7)
    got = io.numbered(rows, "x").collect()
    assert [r["number"] for r in sorted(got, key=lambda r: r["x"])] == list(range(1000))
    assert io.numbered(rows.filter("false"), "x").count() == 0


def test_stream(spark, tmp_path):
    def send(*rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return sorted(map(tuple, read_index(spark, str(tmp_path / "out")).collect()))

    assert send((1, "ant bee bee"), (2, "cat")) == [(1, "ant", 1), (1, "bee", 2), (2, "cat", 1)]
    assert send((1, "cat dog"), (3, "emu")) == [(1, "cat", 1), (1, "dog", 1), (2, "cat", 1), (3, "emu", 1)]
    assert send((2, "the")) == [(1, "cat", 1), (1, "dog", 1), (3, "emu", 1)]  # its newest version has no words


def test_suggestions(spark):
    vocab = spark.createDataFrame([("engine",), ("index",)], "term string")
    assert suggest.suggest(vocab, "engnie index") == "engine index"
    assert suggest.suggest(vocab, "index") is None and suggest.suggest(vocab, "qqqq") is None
    assert not suggest.worth_showing("Index", "index")


def test_topics_and_clusters(spark):
    keys = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (3, 1, "z")], "doc_id long, rank int, term string")
    got = analytics.detect_topics(keys).collect()
    assert (got[0]["doc_ids"], got[0]["keywords"], got[0]["coherence"]) == ([1, 2], ["a", "b", "c"], 6.0)
    top = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.2)], "doc_id_1 long, doc_id_2 long, similarity double")
    ids = spark.range(1, 6).withColumnRenamed("id", "doc_id")
    assert sorted(map(tuple, analytics.star_clusters(top, ids).collect())) == [(1, 1), (1, 2), (3, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_packed_tokens():
    texts = ["", "The Ant's b2b ÁRBOL ñu Ü é × ÷ ÀÇ x yy", "123", "a" * 300 + " b1c2 日本 ant\tant\nÑandú", "é", "Ü1é"]
    doc, word, distinct = packed.tokens(pa.array(texts))
    got = [[distinct[w].as_py() for d, w in zip(doc, word, strict=True) if d == k] for k in range(len(texts))]
    con = duckdb.connect()
    con.execute("create table documents as select unnest(?) as doc_id, unnest(?) as text", [list(range(len(texts))), texts])
    want = dict(con.sql(f"WITH {_chain()} SELECT doc_id, terms FROM tok").fetchall())
    assert got == [want.get(k, []) for k in range(len(texts))]


def test_packed_vectors(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)], [1 / (k + 1) for k in range(90)], k=rng.randint(1, 40))) for _ in range(60)]
    for k in range(40):  # near and exact copies, in other orders and cases
        words = rng.choice(texts).split()
        rng.shuffle(words)
        texts.append(" ".join(words[: max(1, len(words) - k % 4)]).upper())
    texts += ["", "the", "everywhere" * 3]
    texts = [f"{t} common" if t != "the" else t for t in texts]
    docs = index.corpus(spark.createDataFrame([*enumerate(texts), (5, "ant bee"), (6, "wab cat")], "doc_id long, text string"))  # two ids twice
    monkeypatch.setattr(packed, "CHUNK_BYTES", 500)
    post = index.postings(docs)
    members = similarity.classes(post)
    plain = similarity.representatives(similarity.unit(weights.weights(post, docs)), members)
    small = packed.pack(docs.repartition(3))
    key = lambda df, *cols: sorted(map(tuple, df.select(*cols).collect()))
    assert key(small.members, "doc_id", "class_id", "copies") == key(members, "doc_id", "class_id", "copies")
    assert key(small.ids, "doc_id") == key(plain.select("doc_id").distinct(), "doc_id")
    cols = ["doc_id_1", "doc_id_2", F.round("similarity", 9).alias("s")]
    for threshold in (0.9, 0.5):
        assert (want := key(similarity.above(plain, threshold), *cols)) and key(similarity.above(small, threshold), *cols) == want
    assert key(similarity.pairs(small), *cols) == key(similarity.pairs(plain), *cols)
    assert "CartesianProduct" in (plan := similarity.pairs(small)._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan  # no product is shuffled
    assert similarity.matrix(small)._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 1  # both halves from one pass
    assert key(similarity.matrix(small), "i", "j", F.round("similarity", 4)) == key(similarity.matrix(plain), "i", "j", F.round("similarity", 4))
    assert key(similarity.link_counts(small, small.members), "doc_id", "class_id", "n_links") == key(similarity.link_counts(plain, members), "doc_id", "class_id", "n_links")
    assert key(similarity.top_similar(small, small.members, 200), "doc_id_1", "doc_id_2", "similarity") == key(similarity.top_similar(plain, members, 200), "doc_id_1", "doc_id_2", "similarity")


def test_packed_without_documents(spark):
    small = packed.pack(index.corpus(spark.createDataFrame([(1, "the"), (2, "")], "doc_id long, text string")))
    assert small.members.count() == similarity.above(small).count() == similarity.top_similar(small, small.members).count() == 0


def test_rounded(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, 1 - 1e-16, 0.00005, 0.12345, 0.12355, 0.99995, 1.00005, 0.285, 1e-300, 5e-5 - 1e-18, *((2 * rng.randrange(10000) + 1) / 20000 for _ in range(2000)), *(rng.random() for _ in range(2000))]
    values += [x for v in values[-4000:-2000] for x in (np.nextafter(v, 2).item(), np.nextafter(v, 0).item())]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 4)).collect()]
    assert packed.rounded(np.array(values), 4).tolist() == want


def test_matrix_of_blocks(spark, monkeypatch):
    """Entries come in both orders and rounded from the tasks, whichever terms are dense and however documents and batches are cut."""
    rng = random.Random(5)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.randint(1, 30))) for _ in range(80)] + ["alone" * 3, "the", ""]
    docs = index.corpus(spark.createDataFrame([(997 * k % 83, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    post = index.postings(docs)
    plain = similarity.representatives(similarity.unit(weights.weights(post, docs)), similarity.classes(post))
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(similarity.matrix(plain))
    assert len(want) > 3000
    small = packed.pack(docs.repartition(3))
    plan = similarity.matrix(small)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "round(" not in plan  # by row, both cost more than the pairs
    a = [{c: row[c][k] for c in row.schema.names} for row in [small.compared().toArrow()] for k in range(row.num_rows)]
    assert len(a) > 2
    alone = key(similarity.compared(small).select("doc_id", "doc_id", F.lit(1.0)))
    for frequent, dense, products, rows in ((1 / 200, 1 << 22, 1 << 18, 1 << 16), (0, 1 << 22, 50, 7), (2, 1 << 22, 50, 1), (0.2, 100, 1, 1000)):
        for name, value in (("FREQUENT", frequent), ("DENSE", dense), ("PRODUCTS", products), ("PAIR_ROWS", rows)):
            monkeypatch.setattr(packed, name, value)
        got = [tuple(r.values()) for x in a for y in a if x["chunk"].as_py() <= y["chunk"].as_py() for b in packed._cell(packed._side(x, small.n, False), packed._side(y, small.n, True), x["chunk"] == y["chunk"], 4, True) for r in b.to_pylist()]
        assert sorted(got + alone) == want
    assert key(similarity.matrix(small)) == want


def test_pairs_are_rounded_in_tasks(spark, monkeypatch):
    plan = QUERIES["similarity_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "round(" not in plan
    decoded, side = [], packed._side
    monkeypatch.setattr(packed, "_side", lambda row, n, by_term: decoded.append((row["chunk"].as_py(), by_term)) or side(row, n, by_term))
    chunks = packed.pack(index.corpus(spark.createDataFrame(list(enumerate(["ant bee", "ant cat", "bee cat", "dog"])), "doc_id long, text string")).coalesce(1)).compared().toArrow()
    many = pa.concat_tables([chunks] * 3)
    rows = [{f"{s}_{c}": (pa.scalar(k + 1, pa.int64()) if c == "chunk" else many[c][0]) for s, k in (("a", i), ("b", j)) for c in many.column_names} for i in range(3) for j in range(i, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c].as_py() for r in rows], rows[0][c].type) for c in rows[0]], list(rows[0]))
    assert sum(b.num_rows for b in packed._cells(iter([batch]), 4, 4, False)) == 3 * 3 + 3 * 9  # within a chunk and, each with itself too, across
    assert sorted(decoded) == [(k, by_term) for k in (1, 2, 3) for by_term in (False, True)]  # each once, not for each pair


@pytest.mark.parametrize("name", ["near_duplicates_090", "duplicate_pairs_090", "top_similar_10", "graph_edges", "clusters", "similarity_matrix_dense"])
def test_few_bytes_stored(spark, name):
    """Thresholds store less than the index and the vectors by term, which took 3.6 times the input."""
    folder = Path(tables.shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    tables._known.clear()
    before = size()
    QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    stored = (size() - before) / Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    assert stored < 1.5
