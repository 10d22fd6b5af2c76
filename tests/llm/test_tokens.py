import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from lexloom.llm import byte_bpe, token_store

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_same_ids_as_tiktoken():
    own, ref, rng = byte_bpe.load(PATH, PATTERN), _reference(), random.Random(1)
    letters = list(" \n\t\r\x1c\x85\u3000aB1é'sß日本😀_-.") + ["  ", "\n\n", " a", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, " " * 999, "ab " * 500, ""]
    assert all(own.encode(t) == ref.encode_ordinary(t) for t in texts)
    assert all(own.decode(p) == t.encode() for t, p in zip(texts, own.pack_all(texts)))


def test_round_trip_operator(docs, rows, no_docs):
    ref = _reference()
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, PATH, PATTERN).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = []
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        expected.append((i or -1, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert got == sorted(expected)
    assert byte_bpe.round_trip(no_docs, PATH, PATTERN).count() == 0


def test_round_trip_gives_memory_back():
    """A reused worker stays beside the executor's next stages: what it holds after a pass is the model and the cache."""
    code = """
import random, re
from pathlib import Path
from types import SimpleNamespace
import public_tokenizers, pyarrow as pa
from lexloom.llm import byte_bpe

anon = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
byte_bpe.only = lambda *_, **__: SimpleNamespace(mapInArrow=lambda run, schema: run)
run = byte_bpe.round_trip(None, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
rng = random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(20_000)]
texts = [" ".join(rng.choices(words, k=300)) for _ in range(4_500)]
batch = lambda t: pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"])
few, many = batch([" ".join(words)]), batch(texts)
del texts, words
list(run(iter([few])))
before = anon()
assert sum(b.num_rows for b in run(iter([many]))) == 4_500
print(anon() - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, timeout=300).stdout)
    assert grown < 30, f"{grown} MB more than before the pass"


def test_encode_then_decode(docs, rows):
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted((i or -1, (t or "").encode()) for i, t in rows)


def test_same_ids_as_tokenizers():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    letters = list(" \n\t\r\x0b\x1c\x85\u3000\u200baB1é'sß\u01c5\u0138\u0149ªº日本😀_-.,|*\x00") + ["  ", "\n\n", " a", "'ll", "<|endoftext|>", "word ", "Übung, "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, " " * 999, "ab " * 500, "", ". ".join(["one, two"] * 300)]
    t, own = Tokenizer.from_file(path), token_store.packer(path, 2)
    for _ in range(2):  # the second time from the cache
        assert own.pack_all(texts) == [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_store(spark, docs, rows, no_docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, f"{tmp_path}/a", path)
    got = token_store.read_store(spark, f"{tmp_path}/a").orderBy("start").collect()
    t, start = Tokenizer.from_file(path), 0
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in expected]
    for r, (_, text) in zip(got, expected):
        raw = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(raw) // 4, zlib.crc32(raw), raw)
        start += r.n_tokens
    assert {r.doc_id for r in token_store.read_store(spark, f"{tmp_path}/a", [7, 10]).collect()} == {7, 10}
    token_store.write_store(no_docs, f"{tmp_path}/b", path)
    assert token_store.read_store(spark, f"{tmp_path}/b").count() == 0
