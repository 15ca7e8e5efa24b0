import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from scoreline.llm import tokens

ODD = ["a  b", "a \n b", "\n\nx  \n", "it's don't  I'll", "foo's baŕ ́x", "ΣΑΣ ΣΑΣ.", "", "  ", " a", "a ",
       "<|endoftext|> hi <|endoftext|>", "x\ty", "中文 字 字", "a\x1cb", "İstanbul ǅ", "1234 56 7", "...!!! ???", "a b c",
       "é ‍ x", "😀 👍🏽 a", "foo \nbar", "foo\n bar", "foo\n\n bar", "foo\n ", "a\t \tb", "a   b", "​ x", "Á B",
       "a\x85b᠎c", " \n", "x   y", "word " * 3000, None]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_encode_like_whole_texts(spark, name, spaced, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    monkeypatch.setattr(tokens, "MOST", 2000)  # the cache starts anew many times
    monkeypatch.setattr(tokens, "SLICE", 20000)
    enc = tokens.Encoder(public_tokenizers.path(name), spaced)
    want = [e.ids for e in enc.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(pa.array(texts, pa.string())).to_pylist()]
    assert got == want
    assert len(enc.encode(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_are_kept_apart_from_what_follows(name, spaced):
    """Punctuation and line breaks after a word cost no new pieces, and the ids are those of the whole text."""
    words = ["alpha", "Été", "ǅungla", "straße", "İzmir", "ŉa", "o̸", "x'", "don't", "a1", "ꙮ"]
    texts = [f"{a}{p}{b} {a}{p} {b}" for a in words for b in words[::-1] for p in (",", ".\n", "&&&", "\n", "\n\n", "'s,", ".'", "=", "")]
    enc = tokens.Encoder(public_tokenizers.path(name), spaced)
    want = [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(pa.array(texts)).to_pylist()] == want
    kept = len(enc.seen)
    enc.encode(pa.array([f"{a}{p} alpha{p}\nstraße{p} end" for a in ("alpha", "straße") for p in ("!", "!?", "%%", "---", "[]")]))
    assert len(enc.seen) <= kept + 10


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_each_part_is_looked_up_once_a_slice(name, spaced, monkeypatch):
    """What is looked up in Python follows words and marks, not their combinations; ids are those of the whole text."""
    words = [f"{a}{b}e" for a in "bcdfgklmnp" for b in "aiou"]
    marks = [",", ".", ";", ":", "!", "?", ").", "...", ",\n", ".\n", "\n"]
    texts = [f"{w}{m}{words[0]} {w}{m} {w}" for w in words for m in marks]
    enc = tokens.Encoder(public_tokenizers.path(name), spaced)
    asked, ids = [], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda parts: asked.extend(parts) or ids(parts))
    want = [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(pa.array(texts)).to_pylist()] == want
    assert len(asked) <= 4 * (len(words) + len(marks))


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cuts_amid_odd_characters(name, spaced):
    rng = random.Random(3)
    odd = [*"aZ\u00e9\u00df\u0130\u0149\u01c5\u03a3\u4e2d\ua64f1\u0661'.,=<>|!~\0\t\r\n\n\n   \u00a0\u0301\u0338\u200d\u3000", "<|endoftext|>", "'s", "'ll", ".\n", " \n"]
    texts = ["".join(rng.choices(odd, k=rng.randrange(1, 12))) for _ in range(20_000)]
    enc = tokens.Encoder(public_tokenizers.path(name), spaced)
    want = [e.ids for e in enc.lib.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(b, dtype=enc.dtype).tolist() for b in enc.encode(pa.array(texts)).to_pylist()]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


GROWTH = r"""
import random, re, threading, time
import pyarrow as pa, public_tokenizers
from scoreline.llm.tokens import Encoder

def used():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(1)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200_000)]
texts = pa.array([" ".join(rng.choices(words, k=600)) for _ in range(10_000)])  # 42 MB, as in one Arrow batch
del words
enc = Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
pa.default_memory_pool().release_unused()
before, most, on = used(), [0], [True]
def watch():
    while on[0]:
        most[0] = max(most[0], used())
        time.sleep(0.01)
thread = threading.Thread(target=watch)
thread.start()
enc.encode(texts)
on[0] = False
thread.join()
print(most[0] - before)
"""


def test_batches_are_encoded_in_bounded_memory():
    """A worker's memory follows the slice and the cache, not the batch: two workers share what the executor's heap leaves."""
    grown = float(subprocess.run([sys.executable, "-c", GROWTH], capture_output=True, text=True, check=True, timeout=300).stdout)
    assert grown < 140


def test_slices_name_their_first_text(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 64)
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = pa.array([None, "", "one two", "word " * 100, "x", None, "three " * 9, "a b"], pa.string())
    whole, parts = enc.encode(texts).to_pylist(), list(enc.encoded(texts))
    assert len(parts) > 2 and [x for _, ids in parts for x in ids.to_pylist()] == whole
    assert [first for first, _ in parts] == [sum(len(ids) for _, ids in parts[:i]) for i in range(len(parts))]
    assert list(enc.encoded(texts.slice(0, 0))) == []


def test_full_cache_keeps_the_first_pieces(monkeypatch):
    """Frequent pieces stay when the cache is full; words that never come again don't push them out, a change of the texts does."""
    monkeypatch.setattr(tokens, "MOST", 320)
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    often = [f"often{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rare = [f"rare{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(900)]
    enc.encode(pa.array([" ".join(often)]))
    for i in range(0, 300, 20):
        enc.encode(pa.array([" ".join(rare[i:i + 20] + often)]))
        assert all(w in enc.seen for w in often) and len(enc.seen) <= 320 + 20
    for i in range(300, 900, 20):
        enc.encode(pa.array([" ".join(rare[i:i + 20])]))
    assert not any(w in enc.seen for w in often)
