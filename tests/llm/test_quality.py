from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from palletwatch.llm.quality import CLASSES, SENTENCE, SYMBOLS, WORDS, judged, measured
from palletwatch.llm.queries import QUERIES
from tests.llm import brute, odd


def slow(text):
    text = text or ""
    w = brute.words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [line for line in text.split("\n") if brute.words(line)]
    kinds, common = [0] * CLASSES, [0] * (len(WORDS) + 1)
    for c in text:
        kinds[
            0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\r\x0b\x0c"
            else 4 if c in SENTENCE else 5 if ord(c) < 128 else 6
        ] += 1
    for word in brute.words(brute.lower(text)):
        common[WORDS.index(word.decode()) if word.decode() in WORDS else -1] += 1
    return [
        len(w), sum(len(x.decode()) for x in w), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(repeated),
        kinds, common,
    ]


def test_counts_of_odd_texts():
    texts = [*odd.TEXTS, "a\na\n \n \nb a\na", "The THE für más x#*$%&|<>", "x " * 8 + "x"]
    made = measured([t.encode() if t is not None else None for t in texts])
    got = list(zip(*[m.to_pylist() if hasattr(m, "to_pylist") else map(int, m) for m in made], strict=True))
    assert [list(g) for g in got] == [slow(t) for t in texts]


def test_verdicts(spark):
    rows = [(100, "en", " ".join(f"{j}%%%$" for j in range(300))), (101, None, "the " * 30), (102, "xx", "one two " * 3), (103, "en", None), (104, "en", "")]
    got = {r["doc_id"]: r for r in judged(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert not got[100]["base_failed"] and not got[100]["kept"]
    assert got[101]["base_failed"] and got[102]["base_failed"] and got[103]["base_failed"] and not got[104]["kept"]
    assert got[102]["char_distance"] is None and got[102]["word_distance"] is None


def test_odd_documents_and_empty_table(spark):
    got = judged(odd.documents(spark, "lang string, kept string, n_words string"))
    assert got.count() == len(odd.TEXTS) + 3 and got.filter("kept is null").count() == 0
    assert "text" not in got.columns and "lang" in got.columns
    assert judged(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_copies_and_small_tables_do_not_move_the_registered_verdict(spark, tmp_path):
    junk = " ".join(f"zork{j} #{j * 37 % 1009}" for j in range(200))
    query = next(query for name, query in QUERIES.items() if name.startswith("op2_"))
    for n in (1, 300):
        rows = [(i, "en", junk) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        assert {(r["base_failed"], r["kept"]) for r in query(spark, f"{tmp_path}/{n}").collect()} == {(False, False)}


NONSENSE = " ".join("".join(random.Random(j).choices("aeioulnrstzkvbm", k=6)) for j in range(200))


def test_a_verdict_depends_on_the_document_alone(spark):
    tags = ["en", "EN", "en-US", " En_gb", None, "", "xx", "xx-YY"]
    verdicts = []
    for copies in (1, 40):
        rows = [(i, tag, NONSENSE) for i, tag in enumerate(tags)] + [(100 + i, "xx", f"{NONSENSE} and{i}") for i in range(copies)]
        got = judged(spark.createDataFrame(rows, "doc_id long, lang string, text string")).filter("doc_id < 100")
        verdicts.append([(r["kept"], r["char_distance"] is None, r["word_distance"] is None) for r in got.orderBy("doc_id").collect()])
    assert verdicts[0] == verdicts[1] == [(False, False, False)] * 6 + [(True, False, True)] * 2


def test_a_text_without_a_tag_is_compared_with_the_nearest_reference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    tagged = {r["doc_id"]: r for r in judged(docs).collect()}
    for r in judged(docs.withColumn("lang", F.lit(None).cast("string"))).collect():
        for name in ("char_distance", "word_distance"):
            assert r[name] is None if tagged[r["doc_id"]][name] is None else r[name] <= tagged[r["doc_id"]][name]


def test_clashing_columns_and_no_shuffle(spark):
    names = "ref_lang string, ref_chars string, ref_common string, char_counts string, word_distance string, tag string, lang string"
    got = judged(odd.documents(spark, names))
    assert got.filter("ref_lang = '7' and ref_chars = '7' and ref_common = '7' and tag = '7'").count() == len(odd.TEXTS) + 3
    assert dict(got.dtypes)["word_distance"] == "double"
    plan = judged(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_registered_verdict_against_labels_not_fitted(spark):
    path = "/root/testdata/sf0.1"
    query = next(query for name, query in QUERIES.items() if name.startswith("op2_"))
    labels = spark.read.parquet(f"{path}/labels.parquet").filter("doc_id % 2 = 1")
    rows = query(spark, path).join(labels, "doc_id").filter("not base_failed").collect()
    kept = lambda quality, least, most: [r["kept"] for r in rows if r["quality"] == quality and least <= r["n_words"] < most]
    assert not any(kept(0, 200, 10**9)) and sum(kept(0, 100, 200)) <= 2 and sum(kept(0, 20, 100)) <= 10
    good = kept(1, 20, 10**9)
    assert len(good) > 1600 and sum(good) >= 0.998 * len(good)
