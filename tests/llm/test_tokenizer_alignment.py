from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palletwatch.llm import tokenizer_alignment
from palletwatch.llm.queries import op11_pointer_jumping
from palletwatch.llm.tokenizer_alignment import FIGURES, AlignmentTable, aligned, encoded, last_tokens, link_counts, most_pairs
from tests.llm import odd

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
with open(A_PATH, encoding="utf-8") as file:
    DEFINITION = file.read()
with open(B_PATH, "rb") as file:
    MODEL = file.read()
TABLE = AlignmentTable(DEFINITION, MODEL)


def letters():
    """Byte-level letters, from their definition: bytes that print stand for themselves, others are moved behind Latin-1."""
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


LETTERS = letters()


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def groups(text):
    """Groups of a whole text, each a list of A ids and one of B ids, and the links; None without tokens."""
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_parts = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_parts = [b_bytes(i) for i in b]
    data = (" " + text).encode()
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    out, links, i, j, a_end, b_end = [([], [])], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if a_end <= b_end:
            out[-1][0].append(a[i])
            a_end += len(a_parts[i])
            i += 1
        else:
            out[-1][1].append(b[j])
            b_end += len(b_parts[j])
            j += 1
        if a_end == b_end:
            links.append((a[i - 1], b[j - 1]))
            out.append(([], []))
    return out[:-1], links


def brute(texts):
    found = [groups(t) for t in texts]
    counts = Counter(link for one in found if one for link in one[1])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    rows = []
    for one in found:
        if not one:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        parts, links = one
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in parts)
        rows.append((
            sum(len(a) for a, _ in parts), sum(len(b) for _, b in parts), len(parts), len(links),
            sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return rows, counts


def check(df, got):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want, counts = brute([t for _, t in rows])
    assert sorted(map(repr, map(tuple, got.select("doc_id", *FIGURES, "groups_sha256").collect()))) == sorted(
        repr((doc, *row)) for (doc, _), row in zip(rows, want, strict=True))
    return counts


ODD = [
    " ", "  ", "a ", " a", "a  b", "a\n  b", "a \n b", "\n", "x  y", "x  y  ", "a\t b\r\n  c", "it's we'll 'S", "▁", "a▁b", "<|endoftext|> </s> <s> <unk> <0x41>",
    "日本語 テキスト", "\U0001f642\U0001f642 é é", "\x00\x01 \x1c b\x1c  c", "  x ", "\x85 \x85x", "١٢٣ 123456 x1y2", "tab\tin\tside", "...!!! ?? (a)",
]


def same(texts):
    table = TABLE
    table.clear()
    places, whole = table.found(texts)
    for text, at, good in zip(texts, places, whole, strict=True):
        want = groups(text)
        assert bool(good) == (want is not None)
        if want:
            assert ";".join(table.groups[i] for i in at) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want[0])
            pairs = [divmod(int(p), len(table.b_bytes)) for i in at for p in table.pairs[table.ends[i] : table.ends[i + 1]]]
            assert pairs == want[1]


def test_new_chunks_together_are_as_each_by_itself(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    assert TABLE.ranks
    TABLE.clear()
    places, _ = TABLE.found(texts)
    have = {chunk: (TABLE.groups[i], TABLE.counts[i].tolist()) for chunk, i in TABLE.place.items()}
    assert len(have) > 20_000
    for (chunk, (found, counts)), ids in zip(have.items(), A.encode_batch(list(have), add_special_tokens=False), strict=True):
        assert [int(i) for part in found.split(";") for i in part.split("|")[0].split(",")] == ids.ids and counts[0] == len(ids.ids), chunk


def test_odd_texts():
    same(ODD + [t or "" for t in odd.TEXTS])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\t ab's1.▁é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_any_text(texts):
    same(texts)


def test_every_token_reaches_the_last_of_its_group():
    # groups end at 3, 4 and 12; in the last one the tokens overlap in turn
    a, b = np.array([1, 3, 4, 6, 9, 12]), np.array([2, 3, 4, 5, 8, 11, 12])
    assert last_tokens(a, b).tolist() == [1, 1, 2, 5, 5, 5, 1, 1, 2, 5, 5, 5, 5]
    assert last_tokens(np.array([], np.int64), np.array([], np.int64)).tolist() == []
    n = 5000  # one group: ends that never meet but at the last byte
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n + 1), np.append(np.arange(3, 2 * n, 2), 2 * n + 1)
    assert set(last_tokens(a, b).tolist()) == {len(a) - 1}


def test_odd_documents(spark, monkeypatch):
    docs = odd.documents(spark, "n_a string, groups_sha256 string, links string")
    more = spark.createDataFrame([(100 + i, t, "1", "2", "3") for i, t in enumerate(ODD)], docs.schema)
    docs = docs.unionByName(more)
    for entries, links in ((tokenizer_alignment.TABLE_ENTRIES, tokenizer_alignment.SLICE_LINKS), (4, 3)):
        monkeypatch.setattr(tokenizer_alignment, "TABLE_ENTRIES", entries)
        monkeypatch.setattr(tokenizer_alignment, "SLICE_LINKS", links)
        got = aligned(docs, A_PATH, B_PATH)
        assert got.columns == ["doc_id", "text", "links", *FIGURES, "groups_sha256"]
        counts = check(docs, got)
    linked = {(r["a"], r["b"]): r["count"] for r in link_counts(encoded(docs, DEFINITION, MODEL, "links"), "links", len(TABLE.b_bytes)).collect()}
    assert linked == dict(counts)
    assert len(linked) <= most_pairs(TABLE.a_bytes, TABLE.b_bytes) < 1_000_000


def test_empty_table(spark):
    assert aligned(odd.empty(spark), A_PATH, B_PATH).count() == 0


def test_a_model_that_may_cross_marks_is_applied_to_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "splits_at_marks", lambda model: False)
    docs = odd.documents(spark)
    check(docs, aligned(docs, A_PATH, B_PATH))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{path}/documents.parquet"), op11_pointer_jumping(spark, path))
