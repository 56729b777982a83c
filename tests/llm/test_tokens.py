import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from splatframe.llm import packing, tokenfile
from splatframe.llm.common import new_folder
from splatframe.llm.tokens import Encoder, tokenizer_path

from . import cases


@lru_cache
def tokenizer(name):
    return Tokenizer.from_file(tokenizer_path(name))


def ids_of(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c\td", "x.\nY z", "it's  'll", " a   b", "e ́x", "a\x1cb \x1c c", "<|endoftext|> <|startoftext|>", "漢字 ß İ Σ ς 😀", "\r\n a \r\n", "\n", "\n\n a"]


TEXTS += ["hi <|endoftext|> there", "a<|endoftext|>b", " <|startoftext|>x <|ENDOFTEXT|>", "<|endoftext", "x\n<|endoftext|>\ny  z"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(spark, name):
    texts = TEXTS + [r.text or "" for r in cases.documents(spark).collect()]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = Encoder(tokenizer_path(name)).encode(texts)
    for text, data in zip(texts, got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(name, text), text[:60]


def test_differencing():
    rng = np.random.default_rng(1)
    for n, m in ((0, 3), (1, 1), (1, 4), (5, 2), (200, 7)):
        sizes = rng.integers(1, 300, n).tolist()
        window = packing.difference(sizes, m)
        assert len(window) == n and (n == 0 or (window.min() >= 0 and window.max() < m))
        if n == 200:
            fill = np.bincount(window, sizes, minlength=m)
            assert fill.max() - fill.min() <= 3
    # 4, 5, 6, 7, 8 in two windows: differencing gives 14 and 16.
    assert sorted(np.bincount(packing.difference([4, 5, 6, 7, 8], 2), [4, 5, 6, 7, 8]).tolist()) == [14, 16]


def test_window_count_rises():
    window = packing.pack([6] * 5, 10)
    assert Counter(window.tolist()) == Counter(range(5))
    assert packing.pack([], 10).tolist() == []
    with pytest.raises(ValueError):
        packing.pack([11], 10)


def check_packing(docs, rows, capacity=2048):
    want = Counter()
    for r in docs:
        want[r.doc_id, len(ids_of(packing.TOKENIZER, r.text)) + 1, r.text] += 1
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {(d, n) for d, n, _ in want} == set(by_doc)
    for (d, n, text), count in want.items():
        ids = np.array([*ids_of(packing.TOKENIZER, text), 1], "<u4")
        at = 0
        for r in sorted(by_doc[d, n], key=lambda r: r.start)[::count]:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == n
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(n * c for (_, n, _), c in want.items()) / (len(by_seq) * capacity)


def test_packing_query(spark):
    docs = cases.documents(spark)
    rows = packing.packed_documents(docs).collect()
    assert check_packing(docs.collect(), rows) > 0.95
    again = packing.packed_documents(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert packing.packed_documents(cases.empty(spark)).count() == 0


def test_groups_and_sequences(spark):
    docs = cases.documents(spark, extra=False)
    packed = packing.pack_pieces(packing.pieces(docs, 256, 64, keep_ids=True), 256, group_windows=64)
    seqs = packing.sequences(packed, 256, pad=7).collect()
    assert sorted(s.sequence_id for s in seqs) == list(range(len(seqs)))
    assert all(len(s.ids) == 256 and s.ids[s.n_ids :] == [7] * (256 - s.n_ids) for s in seqs)
    used = sum(s.n_ids for s in seqs)
    assert used == sum(len(ids_of(packing.TOKENIZER, r.text)) + 1 for r in docs.collect()) and used / len(seqs) > 245


def test_token_file_query(spark):
    docs = cases.documents(spark)
    rows = tokenfile.token_ids(docs).collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at, want = 0, Counter()
    for r in order:
        ids = np.array([*ids_of(tokenfile.TOKENIZER, r.text), 0], "<u4")
        want[r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, rows)) == want
    assert tokenfile.token_ids(cases.empty(spark)).count() == 0


def test_random_access(spark):
    docs = cases.documents(spark, extra=False).where("doc_id is not null")
    folder = new_folder(spark, "t")
    files = tokenfile.write_token_files(docs, folder, length=64).orderBy("part").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    stream = [i for r in order for i in (*ids_of(tokenfile.TOKENIZER, r.text), 0)]
    at = 0
    for f in files:
        path = f.file.removeprefix("file://") + ".tokens"
        for row in range(-(-f.n_tokens // 64)):
            ids, mask = tokenfile.sequence(path, row)
            n = int(mask.sum())
            assert len(ids) == 64 and not ids.flags.owndata and ids[:n].tolist() == stream[at : at + n] and not mask[n:].any()
            at += n
        with pytest.raises(IndexError):
            tokenfile.sequence(path, -(-f.n_tokens // 64) + 256)
    assert at == len(stream) and sum(f.n_docs for f in files) == len(order)


def test_other_files_go_through_the_whole_pipeline(tmp_path):
    import json

    settings = json.load(open(tokenizer_path("byte_bpe_50k.json")))
    settings["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(settings))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    for text, data in zip(TEXTS, Encoder(str(tmp_path / "other.json")).encode(TEXTS), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(monkeypatch):
    from splatframe.llm import tokens

    memory = tokens._Remembered(lambda k: k.encode() * 4, 40_000)
    for i in range(5000):
        assert memory[f"word{i % 700}"] == f"word{i % 700}".encode() * 4
        assert len(memory) + len(memory._before) < 40_000 / 150
    memory["x" * 1000]
    assert "x" * 1000 not in memory


def test_differencing_keeps_filled_windows_only():
    import tracemalloc

    tracemalloc.start()
    window = packing.difference([1] * 100_000, 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fill = np.bincount(window, minlength=300)
    assert fill.max() - fill.min() <= 1 and peak < 120e6


def test_differencing_is_the_dense_one():
    def dense(sizes, m):
        parts = [(max(s, 0), i, [[0, []] for _ in range(m - 1)] + [[s, [i]]]) for i, s in enumerate(sizes)]
        node = len(sizes)
        while len(parts) > 1:
            parts.sort(key=lambda p: (-p[0], p[1]))
            (_, _, x), (_, _, y), *parts = parts
            made = sorted(([a + b, p + q] for (a, p), (b, q) in zip(x, y[::-1], strict=True)), key=lambda w: w[0])
            made = [[s - made[0][0], p] for s, p in made]
            parts.append((made[-1][0], node, made))
            node += 1
        return sorted(sum(sizes[i] for i in p) for _, p in parts[0][2])

    rng = np.random.default_rng(5)
    for n, m in ((1, 3), (2, 2), (7, 3), (30, 4), (80, 9)):
        sizes = rng.choice(100_000, n, replace=False).tolist()  # sums that differ, so that ties don't matter
        assert sorted(np.bincount(packing.difference(sizes, m), sizes, minlength=m).tolist()) == dense(sizes, m)


def test_one_row_very_often_is_dealt_out(spark):
    rows = spark.range(100_000).selectExpr("7L doc_id", "0L start", "1L length", "5L ids_crc32", "1L doc_tokens")
    packed = packing.pack_pieces(rows, 256, 8, group_pieces=4096).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed))) and sum(r[1] for r in packed) == 100_000 and max(r[1] for r in packed) <= 256
    assert len(packed) <= 1.1 * 100_000 / 256 + 60


def test_files_by_size_and_wide_ids(spark):
    docs = cases.documents(spark)
    folder = new_folder(spark, "t")
    files = tokenfile.write_token_files(docs, folder, file_bytes=20_000, end=70_000)
    assert files.count() > 3
    rows = tokenfile.read_token_files(files).orderBy("start").collect()
    assert rows[0].doc_id is None and sum(r.n_tokens for r in rows) == sum(len(ids_of(tokenfile.TOKENIZER, r.text)) + 1 for r in docs.collect())
    one = next(r for r in rows if r.doc_id == 64)
    assert one.ids_crc32 == zlib.crc32(np.array([*ids_of(tokenfile.TOKENIZER, "one"), 70_000], "<u4").tobytes())
    again = docs.where("doc_id = 64").crossJoin(spark.range(3000)).select("doc_id", "text")
    assert tokenfile.token_ids(again).agg({"n_tokens": "sum"}).first()[0] == 3000 * one.n_tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_distinct_word_is_encoded_once_a_call(monkeypatch, name):
    from splatframe.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", dict.fromkeys(tokens.REMEMBERED, 1))  # nothing is remembered
    encoder, asked = Encoder(tokenizer_path(name)), []
    tokenize = encoder._tokenize
    encoder._tokenize = lambda word: asked.append(word) or tokenize(word)
    words = ["".join(p) for p in zip("abcdefghij" * 10, "klmnopqrst" * 5 + "uvwxyzabcd" * 5, "e" * 100, strict=True)]
    texts = ["_ " + " ".join(w + mark for w in words for mark in ("", ",", "!")) for _ in range(40)]
    got = encoder.encode(texts)
    assert len(asked) <= len(set(words)) and got == [got[0]] * 40
    assert np.frombuffer(got[0], "<u4").tolist() == ids_of(name, texts[0])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_mixed_texts(name):
    rng = np.random.default_rng(3)
    pieces = ["a", "Über", "ÿª", "ß", "µ", "it's", "x1", "9", ".", ",", "!?", " ", " ", " ", "  ", "\n", "\n", "\t", "\x02", " ", "　", "é", "é", "漢", "😀", "|", "\x1c", "İ", "ſ", "×", "<|endoftext|>"]
    texts = ["".join(rng.choice(pieces, n)) for n in rng.integers(0, 30, 3000)]
    texts += ["".join(c for c in map(chr, range(1, 0x180))), " ".join(map(chr, range(0x21, 0x250))), "\x02", "\x02a b", "a \x02b", "x \x02"]
    got = Encoder(tokenizer_path(name)).encode(texts)
    for text, data in zip(texts, got, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(name, text), repr(text)


def test_slices_by_size():
    import pyarrow as pa

    from splatframe.llm.common import by_size

    texts = [None, "", "a" * 900, "b" * 5000, "", "c", "d" * 100] * 20
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[at : at + 50], pa.string())}) for at in (0, 50, 100)] + [pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    got = [b.column("text").to_pylist() for b in by_size(iter(batches), "text", 2000)]
    assert sum(got, []) == texts and all(sum(len(t or "") + 256 for t in g[1:]) <= 2000 for g in got) and max(map(len, got)) > 1
