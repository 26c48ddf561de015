"""Wavelet shards and packing against plain encoding."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import packing, wavelet_store
from tablewright.llm.common import by_size, texts_of
from tablewright.llm.queries import vocabulary
from tablewright.llm.tokens import RunEncoder, run_starts


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memo_gives_the_library_ids(plain):
    rng = random.Random(1)
    letters = "ab'é ßЖ中\n\t\r.,1²½  　\x1c\x85​<|>_-A\0́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    enc = RunEncoder(vocabulary(), memo=300)
    for k in range(0, len(texts), 500):
        for t, raw in zip(texts[k : k + 500], enc.encode(texts[k : k + 500])):
            assert np.frombuffer(raw, enc.dtype).tolist() == plain(t), repr(t)


def test_long_texts_are_cut_into_slices(plain, monkeypatch):
    from tablewright.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_CHARS", 50)
    text = "some words,  two blanks\n and more of them " * 20
    (raw,) = RunEncoder(vocabulary()).encode([text])
    assert np.frombuffer(raw, "<u2").tolist() == plain(text)


def test_shard_answers():
    ids = np.array([5, 3, 5, 9, 9, 5, 1, 0, 3, 60_000] * 150)
    s = wavelet_store.Shard(wavelet_store.build([1, None, 3], np.array([500, 500, 500]), ids))
    assert s.decode().tolist() == ids.tolist() and s.doc_ids == [1, None, 3]
    assert [s.access(i) for i in range(1000, 1100)] == ids[1000:1100].tolist()
    assert s.count(5) == 450 and s.count(5, 3, 13) == 3 and s.count(7) == 0
    assert s.occurrences(9) == np.flatnonzero(ids == 9).tolist() and s.select(60_000, 149) == 1499
    for wrong in (lambda: s.access(1500), lambda: s.select(7, 0), lambda: wavelet_store.Shard(b"no")):
        with pytest.raises((IndexError, ValueError)):
            wrong()


@pytest.mark.parametrize("size", [1, 2, 511, 512, 513, 4096])
def test_shard_of_any_length(size):
    ids = np.random.default_rng(size).integers(0, 1 + size // 3, size)
    s = wavelet_store.Shard(wavelet_store.build([0], np.array([size]), ids))
    assert s.decode().tolist() == ids.tolist() and s.access(size - 1) == ids[-1] and s.count(int(ids[0])) == int((ids == ids[0]).sum())


@pytest.mark.parametrize("shard_tokens", [1 << 20, 700])
def test_shards_of_documents(spark, edge, plain, shard_tokens):
    rows = wavelet_store.read_shards(wavelet_store.write_shards(edge, vocabulary(), 0, shard_tokens)).orderBy("start").collect()
    docs = [(r["doc_id"], r["text"]) for r in edge.selectExpr("doc_id", "text", "xxhash64(text) AS __order").orderBy("doc_id", "__order").collect()]
    at = 0
    for got, (key, text) in zip(rows, docs, strict=True):
        ids = [*plain(text), 0]
        assert (got["doc_id"], got["start"], got["n_tokens"]) == (key, at, len(ids)) and got["ids_crc32"] == crc(ids)
        at += len(ids)


def test_counts_and_places_in_stored_shards(spark, edge, empty, plain):
    shards = wavelet_store.write_shards(edge, vocabulary(), 0, 700)
    rows = {r["start"]: r for r in wavelet_store.read_shards(shards).collect()}
    texts = {}
    for r in edge.collect():
        ids = [*plain(r["text"]), 0]
        texts[r["doc_id"], len(ids), crc(ids)] = ids
    stream = [(d["doc_id"], i, s + i, t) for s, d in sorted(rows.items()) for i, t in enumerate(texts[d["doc_id"], d["n_tokens"], d["ids_crc32"]])]
    usual = [0, stream[0][3], stream[40][3], 49_999]
    got = dict(tuple(r) for r in wavelet_store.token_counts(shards, usual).collect())
    assert got == {t: sum(x[3] == t for x in stream) for t in usual} and got[0] == len(rows)
    token = stream[40][3]
    assert sorted(map(tuple, wavelet_store.token_places(shards, token).collect()), key=repr) == sorted([x[:3] for x in stream if x[3] == token], key=repr)
    none = wavelet_store.write_shards(empty, vocabulary())
    assert wavelet_store.token_counts(none, [5]).collect()[0]["n"] == 0 and wavelet_store.token_places(none, 5).count() == 0


def test_packing(spark, edge, plain):
    rows = packing.pack(edge.repartition(3), vocabulary()).collect()
    want = sorted((str(r["doc_id"]), crc([*plain(r["text"]), 1])) for r in edge.collect())
    total = sum(r["length"] for r in rows)
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in stream:  # sequences are full and without gaps, the last one alone is short
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["length"] > 0 and r["cut_before"] == (r["start"] > 0)
        at += r["length"]
    assert at == total
    # Each document's pieces follow each other in the stream; their ids are the document's.
    texts = {}
    for r in edge.collect():
        texts.setdefault(r["doc_id"], []).append([*plain(r["text"]), 1])
    got, current = [], []
    for r in stream:
        current.append(r)
        if not r["cut_after"]:
            ids = next(x for x in texts[r["doc_id"]] if len(x) == r["doc_tokens"])
            assert [p["start"] for p in current] == [sum(q["length"] for q in current[:k]) for k in range(len(current))]
            assert all(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in current)
            got.append((str(r["doc_id"]), crc(ids)))
            current = []
    assert sorted(got) == want


def test_empty_tables(spark, empty):
    assert packing.pack(empty, vocabulary()).count() == 0
    assert wavelet_store.read_shards(wavelet_store.write_shards(empty, vocabulary())).count() == 0


def test_encoding_costs_less_than_a_string_for_each_word():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(600)]
    enc, split = RunEncoder(vocabulary()), re.compile(r"\s*\S+")
    enc.encode(texts)  # the words are known from here on

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert min(seconds(lambda: enc.encode(texts)) for _ in range(5)) < min(seconds(lambda: [split.findall(t) for t in texts]) for _ in range(5))


def test_runs():
    texts = ["", "It's  two, 3x\nno!yes", " \n\né×ɏɐ Жд я　 b— c", "", "a"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    data = b"".join(raw)
    cuts = run_starts(np.frombuffer(data, np.uint8), ends).tolist()
    runs = [data[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(data)])]
    assert runs == ["It", "'s", "  two", ",", " 3", "x", "\n", "no", "!", "yes", " \n\né×ɏɐ", " Жд", " я　 b—", " c", "a"]


@pytest.mark.parametrize("letters", ["ab ", "ab' \n", "é×ɏɐ \n'a1.", "Жя 　\xa0 \x85—​a\n", "ab1 \t\r\n\x1c\x7f,'", "日本 ́🙂a\n"])
def test_texts_of_any_alphabet_give_the_library_ids(plain, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(500)]
    enc = RunEncoder(vocabulary(), memo=100)
    for k in range(0, len(texts), 100):
        assert [np.frombuffer(raw, enc.dtype).tolist() for raw in enc.encode(texts[k : k + 100])] == [plain(t) for t in texts[k : k + 100]]


def test_cells_between_tabs_are_runs():
    line = b"12\t3.5\t\ta!\tb\r\n7\t\r\n"
    cuts = run_starts(np.frombuffer(line, np.uint8), np.array([0, len(line)])).tolist()
    assert [line[a:b] for a, b in zip(cuts, [*cuts[1:], len(line)])] == [b"12", b"\t3.5", b"\t\ta", b"!", b"\tb", b"\r\n7", b"\t\r\n"]


def test_another_pre_tokenisation_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(vocabulary())
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    t.save(str(tmp_path / "other.json"))
    texts = ["in the end, of the\n\nthe", "", "x" * 50 + " of  the"]
    enc = RunEncoder(str(tmp_path / "other.json"))
    assert [np.frombuffer(raw, enc.dtype).tolist() for raw in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_looks_a_run_up_once_a_slice(monkeypatch, plain):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(1000)]
    texts = ["".join(f" {w}" for w in rng.choices(words, k=1000)) for _ in range(900)]
    seen, look_up = [], RunEncoder._look_up
    monkeypatch.setattr(RunEncoder, "_look_up", lambda self, runs: seen.append(len(runs)) or look_up(self, runs))
    enc, ids = RunEncoder(vocabulary()), []
    for batch in by_size(iter([pa.RecordBatch.from_pydict({"text": texts})]), packing.ENCODE_BYTES):
        ids += enc.encode(texts_of(batch))
    assert sum(seen) <= 2 * len(set(words)) and len(seen) == 2
    assert all(np.frombuffer(ids[k], enc.dtype).tolist() == plain(texts[k]) for k in range(0, 900, 50))
