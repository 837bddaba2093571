"""Pieces that texts are cut into for encoding, and the table that numbers them."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyflow.llm.token_files import Encoder, Numbers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    ids, sizes = encoder(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_a_word_is_encoded_once_whatever_mark_follows():
    encoder = Encoder(Tokenizer.from_file(BYTE_BPE), 2)
    encoded(encoder, ["so word word, word. word; word! word... word%%% word"])
    assert encoder.number.count == 8  # 'so', ' word' and six runs of marks


def test_cuts_at_marks_equal_the_library():
    rnd = random.Random(3)
    odd = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "a", "Bc", "é", "ß", "×", "÷", "ñ", "ɏ", "ʼ", "。", "²", "中", "́", "😀", "7", " ", "\n", "'s", "'ll", "<|endoftext|>"]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 25))) for _ in range(6000)]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(Encoder(tokenizer, 2), texts) == want


def test_numbers_of_hashes():
    rnd = np.random.default_rng(5)
    hashes = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 5000, np.uint64), np.arange(3000, dtype=np.uint64), np.arange(500, dtype=np.uint64) << np.uint64(60)]))
    hashes = rnd.permutation(hashes)
    table, known = Numbers(4), {}
    for some in np.array_split(hashes, 7):
        assert not table.find(some).any()
        numbers = np.arange(len(known) + 1, len(known) + 1 + len(some))
        table.add(some, numbers)
        known.update(zip(some.tolist(), numbers.tolist(), strict=True))
        asked = rnd.choice(hashes, 4000)
        assert table.find(asked).tolist() == [known.get(h, 0) for h in asked.tolist()]
    assert table.count == len(known) == len(hashes) and 2 * table.count <= len(table.hashes)


def test_kept_pieces_are_bounded(monkeypatch):
    from tallyflow.llm import token_files

    monkeypatch.setattr(token_files, "KEPT_PIECES", 40)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    encoder = Encoder(tokenizer, 2)
    for lo in range(0, 300, 20):
        texts = [f"word{chr(97 + i % 26)}{'x' * (i // 26)} the, end." for i in range(lo, lo + 20)]
        assert encoded(encoder, texts) == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert encoder.number.count <= 60
