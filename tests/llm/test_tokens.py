import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from coppice.llm import bpe, packing
from tests.llm.fixtures import DOCS, SF, frame, prose

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n\n b\tc", "don't 'll 's x's", "日本語 テキスト mixed 123,456", "\x1c a\x1c b", "a  b  c", "é" * 3000, "<|endoftext|> x", "🙂🙂 🙂", "x" * 5000, "aAbB" * 50, "\r\n \r\n", "'  '", " 's a 'S"]


def reference(name=bpe.MULTI):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(name)), special_tokens={})


def random_texts():
    r = random.Random(0)
    return ["".join(r.choice(" \n\t'abcXYZ09éß.,!_日 ") for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_bpe_equals_the_library(spark):
    t = reference()
    for texts in (ODD, random_texts(), [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]):
        got = {r.doc_id: r for r in bpe.encode(frame(spark, texts)).collect()}
        for i, x in enumerate(texts):
            ids = t.encode_ordinary(x or "")
            assert bytes(got[i].ids) == b"".join(k.to_bytes(4, "little") for k in ids), x
            assert bytes(got[i].decoded) == (x or "").encode()


def test_perfect_hash_is_minimal_and_exact():
    ranks = {b"%d" % i: i for i in range(5000)}
    h = bpe.PerfectHash(ranks)
    assert sorted(h.ids) == list(range(5000)) and all(h.get(k) == v for k, v in ranks.items())
    assert h.get(b"5001") is None and bpe.PerfectHash({}).get(b"x") is None


def test_bpe_query(spark):
    t = reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op9_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = t.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), bpe.sha(b"".join(i.to_bytes(4, "little") for i in ids)), bpe.sha(texts[r.doc_id].encode()))
    assert bpe.digest(spark.createDataFrame([], DOCS)).collect() == []


def test_plan_equals_best_fit_by_item():
    r = random.Random(2)
    for trial in range(40):
        counts = Counter(r.randint(1, 64 if trial % 2 else 20) for _ in range(r.randint(1, 1500)))
        groups = packing.plan(dict(counts), 64)
        got = Counter()
        for n, held in groups:
            at = 0
            for size, fit, offset in held:
                assert offset == at
                at += size * fit
                got[size] += n * fit
            assert at <= 64
        assert got == counts
        assert sum(n for n, _ in groups) == best_fit_decreasing(counts.elements(), 64)


def best_fit_decreasing(sizes, length):
    """The number of sequences that best-fit needs when it takes item by item."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= size
        else:
            rooms.append(length - size)
    return len(rooms)


def verify(docs, placed, length=2048):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.cut_points(len(ids), length)):
            want[d, k, s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    room = defaultdict(list)
    for r in placed:
        room[r.sequence_id].append((r.offset, r.length))
    for v in room.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= length
    return len(room), -(-sum(r.length for r in placed) // length)


def test_cut_points():
    assert packing.cut_points(5, 4) == [(0, 1), (1, 4)] and packing.cut_points(8, 4) == [(0, 4), (4, 4)] and packing.cut_points(3, 4) == [(0, 3)]


def test_packing(spark):
    texts = ODD + [prose(i, 40) for i in range(60)] + [prose(1, 30)] * 100 + [prose(3, 4000)] + random_texts()[:200]
    used, least = verify(list(enumerate(texts)), packing.pack_documents(frame(spark, texts).repartition(5)).collect())
    assert used <= least + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    verify([(1, "a b"), (1, "a b"), (None, "c")], packing.pack_documents(twice, length=3).collect(), 3)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = verify(docs, packing.op8_best_fit_packing(spark, SF).collect())
    assert used <= least * 1.01 + 1


def test_packing_takes_added_tokens_as_the_library_does_by_default(spark, tmp_path):
    t, mark, r = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>", random.Random(7)
    texts = [f"a {mark} b", mark, f"x{mark}{mark}y  {mark}\n {mark} ", f"<|endoftext{mark}|>", f"a\t{mark} 's", mark * 3000, "<|endoftext", *ODD]
    texts += ["".join(r.choice([mark, mark[:-1], " ", "\n", "ab", "'s", "é", " 12"]) for _ in range(r.randint(1, 25))) for _ in range(300)]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for d, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        assert d > 5 or 50256 in ids
        for k, (s, n) in enumerate(packing.cut_points(len(ids), packing.LENGTH)):
            want[d, k, s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + n]))] += 1
    for placed in (packing.op8_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, frame(spark, texts), SF)):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed.collect()) == want


def test_added_tokens_of_other_kinds_are_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"added_tokens": [{"id": 9, "content": "<x>", "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}]}')
    with pytest.raises(ValueError):
        packing.added_tokens(str(tmp_path / "t.json"))
