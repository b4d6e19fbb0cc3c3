"""Ids of texts by chunks: a word is learnt once whatever mark follows it, cuts change no id, the table is bounded."""
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cadenza.llm import pack
from cadenza.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_file())


def agrees(enc, tok, texts):
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    ids, n = enc.encode(texts)
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_a_word_is_learnt_once_whatever_follows(tok):
    words, marks = ["maison", "Straße", "año", "x", "river"], [",", ".", "!", "?", ";", ":", ")", "...", "\n", "7"]
    texts = [" ".join(w + m for w in words for m in marks), "".join(f" {w}{m}" for w in words for m in marks)]
    enc = pack.ChunkEncoder(tokenizer_file())
    agrees(enc, tok, texts)
    # with a blank before it, at a text's start, behind a line's end: not once for each mark
    assert len(enc.known) <= 2 * len(words) + len(marks) + 2
    before = len(enc.known)
    agrees(enc, tok, [" river; maison: x."])
    assert len(enc.known) == before


def test_cuts_change_no_id(tok):
    parts = [*"abzAZéßñ×÷019²½Ⅷ'’.,!?-_()<>|$/ ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​",
             "'s", "'ll", "'S", "don't", "日本", "ж", "Жук", "ͅ", "é", "ǅ", "ʰ", "٣", "\U0001F600", "\U0001D400", "<|endoftext|>", "<|endof", "text|>", "word", " word"]
    rng = random.Random(5)
    enc = pack.ChunkEncoder(tokenizer_file())
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 3, 8, 40]))) for _ in range(rng.choice([1, 5, 60]))]
        agrees(enc, tok, texts)


def test_another_splitting_rule(tok, tmp_path):
    from tokenizers import pre_tokenizers
    for rule in (pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])):
        other = Tokenizer.from_file(tokenizer_file())
        other.pre_tokenizer = rule
        other.save(path := str(tmp_path / "other.json"))
        enc = pack.ChunkEncoder(path)
        assert not enc.fine
        agrees(enc, other, ["a,b", "n't;", "", "3x"])


def test_the_table_is_bounded(tok, monkeypatch):
    monkeypatch.setattr(pack, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(pack, "CACHE_BYTES", 4000)
    rng = random.Random(9)
    enc = pack.ChunkEncoder(tokenizer_file())
    for _ in range(20):
        agrees(enc, tok, [" ".join("".join(rng.choices("aeinrst", k=rng.choice([1, 2, 5]))) for _ in range(30)) + "日本語の文" * rng.choice([1, 90])])
        if len(enc.known) > 50 or enc.known.nbytes > 4000:
            enc._trim()
        assert len(enc.known) <= 50 and enc.known.nbytes <= 4000
        assert len(enc.known) == len(enc.off) == len(enc.len) == len(enc.hits)


def test_pieces_of_documents(tok):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, None, 3, 3, 5], pa.int64()),
                                        "text": pa.array([None, "", "été, one two; 3x!", "été, one two; 3x!", "a b " * 30])})
    got = pa.Table.from_batches(pack._piece_rows(tokenizer_file(), 16, True)(iter([batch]))).to_pylist()
    want = []
    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, s, ids[s:s + 16], len(ids)) for s in range(0, len(ids), 16)]
    assert [(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in got] == want
    assert [r["length"] for r in got] == [len(w[2]) for w in want] and np.all([r["ids_crc32"] >= 0 for r in got])
