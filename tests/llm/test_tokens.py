import hashlib
import random
import tempfile
import time
import zlib

import numpy as np
import pytest

from runscope.llm import pieces, rans
from runscope.llm.queries import vocabulary
from runscope.llm.wordtokens import tokenizer

SCHEMA = "doc_id long, text string, piece_ids string, start int, ids string"


def odd_texts(n=1500, seed=1):
    r = random.Random(seed)
    alpha = list("ab ▁\n.,é漢👍'\"()=<>/\\0123\tİΣẞßǅ\x1c\x00Å￿") + ["the", "ing", "  ", "<s>", "<|endoftext|>", "er", "th", "\r\n", "é"]
    made = ["".join(r.choice(alpha) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return ["", " ", "  a b  ", "don't it's we'll", "a" * 3000, " " * 3000, "<unk><0x41>", "naïve 漢字 𝔘", "#" * 1000, *made]


def test_pieces_equal_the_library():
    enc = pieces.encoder(vocabulary("piece_bpe_32k.model"))
    for t in odd_texts():
        assert np.frombuffer(enc.encode(t), "<i4").tolist() == enc.processor.encode(t), t


def test_backtracking_is_used_and_right():
    enc = pieces.encoder(vocabulary("piece_bpe_32k.model"))
    r = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "tion", "ing"]
    words = {"▁" + "".join(r.choice(syllables) for _ in range(r.randint(2, 6))) for _ in range(3000)}
    greedy = 0
    for w in words:
        longest = [m[1] for _, m in enc.automaton.iter_long(w)]
        got = enc.encode_part(w)
        greedy += longest != got
        assert [enc.piece_of[i] for i in got] == enc.merge(w)
    assert greedy > 100


def test_piece_columns(spark):
    rows = [(1, "two words"), (1, "two words"), (2, None), (3, ""), (None, "no id"), (4, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "clash", 0, "") for i, t in rows], SCHEMA)
    model = vocabulary("piece_bpe_32k.model")
    sp = pieces.encoder(model).processor
    out = pieces.encode_documents(docs, model)
    assert out.columns == ["doc_id", "text", "start", "ids", "piece_ids", "decoded"]
    for r in out.collect():
        assert r["piece_ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["piece_ids"])
    for r in pieces.digests(pieces.encode_documents(docs, model, keep=["doc_id"])).collect():
        if r["doc_id"] == 1:
            ids = sp.encode("two words")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(b"two words").hexdigest()
        if r["doc_id"] == 2:
            assert r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pieces.encode_documents(docs.limit(0), model).count() == 0


def test_words_equal_the_library():
    tok = tokenizer(vocabulary("word_bpe_49k.json"))
    for t in odd_texts(seed=2):
        assert np.frombuffer(tok.encode(t), "<u4").tolist() == tok.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 70_000, 200_001])
def test_coder_round_trip_and_stretches(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 60_000).astype(np.uint32)
    table = rans.Table(rans.scale(np.bincount(ids, minlength=70_000)))
    block = table.encode(ids, every=16)
    assert np.array_equal(table.decode(block), ids)
    if n > 20_000:
        per = 16 * block["lanes"]
        assert np.array_equal(table.decode(block, 1, 3), ids[per : 3 * per])
        assert len(block["words"]) < n * 2.5
        broken = block | {"words": block["words"][:-1] + bytes([block["words"][-1] ^ 1])}
        with pytest.raises(rans.CorruptBlock):
            table.decode(broken)


def test_scaling_keeps_every_id():
    counts = np.array([10**9, 1, 0, 1, 1])
    freq = rans.scale(counts, 4)
    assert freq.sum() == 16 and (freq[counts > 0] > 0).all() and freq[2] == 0
    assert rans.scale(np.zeros(3, int)).sum() == 0


def test_files_hold_what_was_encoded(spark):
    texts = [None, "", *odd_texts(40, 9)]
    rows = [(k * 3 % 101 - 5, t) for k, t in enumerate(texts)] + [(7, "twice"), (7, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "", 5, "clash") for i, t in rows], SCHEMA)
    path = vocabulary("word_bpe_49k.json")
    out = tempfile.mkdtemp() + "/files"
    got = rans.token_files(docs, lambda: tokenizer(path).encode, out).collect()
    whole = tokenizer(path).whole
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    first = [r["start"] for r in spark.read.parquet(f"{out}/blocks").orderBy("shard", "start").collect()]
    assert first == sorted(first)
    assert rans.token_files(docs.limit(0), lambda: tokenizer(path).encode, out + "2").count() == 0


def test_a_hot_id_is_dealt_to_several_shards(spark):
    r = random.Random(2)
    rows = [(None, " ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(1, 40)))) for _ in range(400)] + [(5, "same")] * 400
    tokens = rans.tokenize_in_order(spark.createDataFrame(rows, "doc_id long, text string"), lambda: lambda t: b"".join(ord(c).to_bytes(4, "little") for c in t), shards=8).collect()
    assert len({t["shard"] for t in tokens if t["doc_id"] is None}) > 2 and len({t["shard"] for t in tokens if t["doc_id"] == 5}) > 2
    texts = ["".join(map(chr, np.frombuffer(t["ids"], "<u2")[:-1].tolist())) for t in sorted(tokens, key=lambda t: (t["shard"], t["offset"]))]
    assert texts == sorted(t for i, t in rows if i is None) + ["same"] * 400


def test_long_unspaced_text_is_encoded_in_linear_time():
    enc = pieces.encoder(vocabulary("piece_bpe_32k.model"))
    r = random.Random(8)
    times = []
    for n in (56_000, 224_000):
        text = "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "X", "9", "é"]) for _ in range(n // 2))
        began = time.perf_counter()
        ids = enc.encode(text)
        times.append(time.perf_counter() - began)
        assert np.frombuffer(ids, "<i4").tolist() == enc.processor.encode(text)
    assert times[1] < 10 * times[0] + 0.1
