from __future__ import annotations

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from palletwatch.llm import toxicity
from tests.llm import brute, odd

WHOLE = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))


def cut_items(text, items):
    n, places, _ = brute.hits(text, items)
    if not places:
        return text
    if len(places) == n:
        return None
    found = [m.span() for m in brute.TEST_WORD.finditer(brute.lower(text).encode())]
    data, out, at = text.encode(), [], 0
    for first in sorted(p for p in places if p - 1 not in places):
        last = first
        while last + 1 in places:
            last += 1
        out.append(data[at : found[first][0]])
        at = found[last][1]
    return b"".join([*out, data[at:]]).decode()


def slow(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fitted(docs, labels)
    rows = [r for r in docs.collect() if model.score([r["text"].encode()])[0] < toxicity.THRESHOLD]
    rows = sorted(rows, key=lambda r: r["doc_id"])
    label = brute.components([brute.fingerprint(r["text"]) for r in rows])
    rows = [r for i, r in enumerate(rows) if label.index(label[i]) == i]
    left = {}
    for r, (words, stay) in zip(rows, brute.kept_words([(r["doc_id"], r["text"]) for r in rows]), strict=True):
        if all(stay):
            left[r["doc_id"]] = r["text"]
        elif any(stay):
            left[r["doc_id"]] = b" ".join(w for w, s in zip(words, stay, strict=True) if s).decode()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    out = {doc: cut_items(text, items) for doc, text in left.items()}
    return {doc: WHOLE.encode(text) for doc, text in out.items() if text is not None}


def test_run_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, path)
    want = slow(spark, path)
    rows = got.collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == want and len(rows) == len(want)
    assert all(r["decoded"] == WHOLE.decode(r["ids"]) and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_on_odd_documents(spark, tmp_path):
    own = ["score", "fingerprint", "kept", "hits", "_chunk", "items", "ids"]
    names = ["doc_id", "text", "lang", "source", "n_chars", *own]
    docs = odd.documents(spark, ", ".join(f"{name} string" for name in ("lang", "source", *own))).withColumn("n_chars", F.char_length("text").cast("long")).select(*names)
    for empty in (False, True):
        current = docs.limit(0) if empty else docs
        folder = f"{tmp_path}/{empty}"
        spark.createDataFrame([(i, int(i == 7), 0) for i in range(9)] + [(4, None, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, odd.TEXTS[0]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, current, folder).write.parquet(f"{folder}/{name}")
            current = spark.read.parquet(f"{folder}/{name}")
            assert current.columns == names
            assert empty or current.count() > 1 and current.filter(" or ".join(f"`{name}` <> '7'" for name in own)).isEmpty()
        assert (corpus_pipeline.STAGES[-1][1](spark, current, folder).count() == 0) == empty
