"""The trie's ids and texts against the tokenizers library's, and its parts against plain merging."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallywright.llm import bpe_trie, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe_trie.TrieEncoder(PATH)


@pytest.fixture(scope="module")
def decoder():
    return bpe_trie.Decoder(PATH)


def merged(word, rank):
    """Plain merging: the lowest-ranked pair, the leftmost first, until none is left."""
    parts = list(word)
    while True:
        found = [(rank[a, b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def random_merges(rng, letters, n):
    merges, tokens = [], list(letters)
    while len(merges) < n:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    return merges, {t: i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("seed", range(12))
def test_trie_equals_plain_merging_for_any_merges(seed):
    """Merges drawn at random, so that many tokens are never reached and equal letters meet."""
    rng = random.Random(seed)
    merges, vocab = random_merges(rng, "ab" if seed % 2 else "abcd", 25)
    rank = {m: k for k, m in enumerate(merges)}
    m = bpe_trie.Merges(vocab, merges)
    assert set(m.usable) == {t for t in vocab if merged(t, rank) == [t]}
    words = {"".join(rng.choices("ab" if seed % 2 else "abcd", k=rng.randint(1, 14))) for _ in range(600)}
    got = bpe_trie.WordTrie(m).encode(words)
    assert got == {w: [vocab[t] for t in merged(w, rank)] for w in words}


def test_other_vocabularies_are_refused():
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    with pytest.raises(ValueError, match="UNSUPPORTED_MERGES"):
        bpe_trie.Merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_shared_beginnings_are_computed_once(monkeypatch, encoder):
    trie = bpe_trie.WordTrie(encoder.tokenizer.trie.merges)
    count = []
    plain = trie._last_token
    monkeypatch.setattr(trie, "_last_token", lambda *a: (count.append(1), plain(*a))[1])
    words = {"inter", "internal", "international", "internet", "intern"}
    trie.encode(words)
    assert len(count) == len({w[: k + 1] for w in words for k in range(len(w))})
    trie.encode({"internationally"})
    assert len(count) == len({w[: k + 1] for w in words | {"internationally"} for k in range(len(w))})


def test_a_full_trie_starts_anew(monkeypatch, library, encoder):
    monkeypatch.setattr(bpe_trie, "MOST_NODES", 50)
    monkeypatch.setattr(bpe_trie, "LONG_WORD", 20)
    trie = bpe_trie.WordTrie(encoder.tokenizer.trie.merges)
    words = {f"word{k}ness" for k in range(200)} | {"x" * 500, "abc" * 300}
    assert trie.encode(words) == {w: library.encode(w).ids for w in words}
    assert len(trie.last) <= 50 + 20


pieces = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "  ", "\n\n", "'s", " the", "aaaa", "====", " ", "\x85", "\x1c"])), max_size=12)


@settings(max_examples=120, deadline=None)
@given(st.lists(pieces.map("".join), min_size=1, max_size=5))
def test_any_text(library, encoder, decoder, texts):
    ids, counts = encoder.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert decoder.decode(ids, counts) == texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50256), max_size=20), min_size=1, max_size=5))
def test_any_ids_decode_as_the_library_has_it(library, decoder, ids):
    flat, counts = np.array([i for x in ids for i in x], np.uint32), np.array(list(map(len, ids)))
    assert decoder.decode(flat, counts) == library.decode_batch(ids, skip_special_tokens=False)


def test_tables(spark, library):
    texts = [None, "", " ", "a<|endoftext|> b", "word " * 5000, "z" * 200_000, "zz" * 3000 + " zz", "same", "same", "漢字 　 x y"]
    rows = [(k // 2, t, "left", b"old") for k, t in enumerate(texts)] + [(None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__value` string, decoded binary").coalesce(2)
    done = bpe_trie.encode(df, PATH, decoded_col="decoded")
    assert done.columns == ["doc_id", "text", "__value", "token_ids", "decoded"]
    got = sorted((r.doc_id is None, r.doc_id, r.text or "", list(np.frombuffer(r.token_ids, "<u4")), r.decoded, r["__value"]) for r in done.collect())
    want = sorted((i is None, i, t or "", library.encode(t or "", add_special_tokens=False).ids, t or "", v) for i, t, v, _ in rows)
    assert got == want
    again = bpe_trie.decode(done.drop("decoded"), PATH)
    assert sorted(r.decoded for r in again.collect()) == sorted(t or "" for _, t, *_ in rows)
    odd = spark.createDataFrame([(None,), (b"",), (b"\xff\xff\xff\xff" + (64).to_bytes(4, "little"),)], "token_ids binary")
    assert sorted(r.decoded for r in bpe_trie.decode(odd, PATH).collect()) == ["", "", library.decode([64])]
    assert bpe_trie.encode(df.limit(0), PATH).collect() == []


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = queries.op11_bpe_trie(spark, SMALL)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string"] and set(map(tuple, got.collect())) == want


def test_unsupported_files_are_refused(tmp_path, library):
    document = json.loads(open(PATH, encoding="utf-8").read())
    document["model"]["dropout"] = 0.1
    (tmp_path / "t.json").write_text(json.dumps(document))
    with pytest.raises(ValueError, match="UNSUPPORTED_TOKENIZER"):
        bpe_trie.TrieTokenizer(str(tmp_path / "t.json"), library)
