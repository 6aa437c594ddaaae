"""The encoder hands the library few units at a time, whose results hold far more than the ids."""

from __future__ import annotations

import public_tokenizers

from tallywright.llm.common import BYTE_BPE, CachedEncoder


class Counting:
    def __init__(self, inner):
        self.inner, self.most = inner, 0

    def encode_batch_fast(self, texts, **how):
        self.most = max(self.most, sum(map(len, texts)))
        return self.inner.encode_batch_fast(texts, **how)


def test_few_units_are_encoded_at_once():
    encoder = CachedEncoder(public_tokenizers.path(BYTE_BPE))
    plain = encoder.tokenizer
    encoder.tokenizer = counting = Counting(plain)
    text = "".join(f" word{k}x" for k in range(20_000)) + "\n" * 3
    ids, counts = encoder.encode([text])
    assert counting.most < 100_000 < len(text)
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
