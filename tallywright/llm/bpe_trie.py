"""Byte-level BPE encoding by a trie of words, and decoding.

Two facts make a traversal possible. The encoding of a word without its last token is the encoding of the word's beginning; so the last
token of every beginning tells everything. And a token t ends the encoding of a beginning exactly if t is a suffix of it and the last
token of what is before t stays apart from t when both are encoded together; one such t exists. So words are inserted into a trie, each
of whose nodes is a beginning and holds its last token, found from the states on the path to it. Beginnings that words share are
computed once. New words are taken in sorted order, which is the trie's depth-first order.

Tokens that are suffixes of a beginning come from an automaton over the vocabulary (Aho-Corasick), longest first. Whether two tokens stay
apart is read off the merges that made them: along the boundary, the right edge of the one and the left edge of the other grow by merges
of known ranks, and they stay apart if no merge across the boundary comes first. That asks for a vocabulary in which each token has one
merge, of a higher rank than those of its parts; others are refused. Words are parted by the tokenizer file's own rule.

Defined results: null and empty texts have no ids; texts are taken whole; the string of a special token is that token, as the library
has it by default; a string of ids is decoded as its bytes, what is no UTF-8 becoming U+FFFD; ids that the file lacks decode to nothing;
repeated rows stay; existing columns named like the outputs are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import CachedEncoder, kept, narrow, text_or_empty

MOST_NODES, MOST_PAIRS = 300_000, 500_000  # what a worker's trie and its memory of pairs hold
LONG_WORD = 1024  # a longer word is walked without being inserted
NEVER = 1 << 60


class Merges:
    """A vocabulary with the merge that makes each token, and which tokens stay apart."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}  # rank of the merge that makes a token
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.parts or self.made.get(x, -1) >= rank or self.made.get(y, -1) >= rank or (len(a) > 1 and x not in self.parts) or (len(b) > 1 and y not in self.parts):
                raise ValueError("UNSUPPORTED_MERGES: a token has several merges, or one before its parts'")
            self.rank_of_pair[x, y] = self.made[t] = rank
            self.parts[t] = (x, y)
        self._apart: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        # tokens that their own text is encoded as
        self.usable = {s: t for s, t in vocab.items() if len(s) == 1}
        good = set(self.usable.values())
        for a, b in merges:
            t = vocab[a + b]
            if good.issuperset(self.parts[t]) and self._first_crossing(*self.parts[t]) == self.made[t]:
                self.usable[a + b] = t
                good.add(t)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that takes it in) at the left (0) or right (1) end of a token, from the single character up."""
        known = self.edges[side]
        if token not in known:
            steps, t, until = [], token, NEVER
            while True:
                steps.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.made[t], self.parts[t][side]
            known[token] = steps[::-1]
        return known[token]

    def _first_crossing(self, left: int, right: int) -> int:
        """Rank of the merge that joins two tokens across their boundary, NEVER if none does."""
        xs, ys, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            rank = self.rank_of_pair.get((x, y), NEVER)
            # of equal pairs the leftmost is merged first: x goes left before it can go right, the pair (x, y) comes before y goes right
            if rank < x_until and rank <= y_until:
                return rank
            if x_until == y_until == NEVER:
                return NEVER
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text is encoded as these two."""
        pair = (left, right)
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) >= MOST_PAIRS:
                self._apart.clear()
            known = self._apart[pair] = self._first_crossing(left, right) == NEVER
        return known


class Suffixes:
    """An automaton that reads characters and knows the tokens that end at each, longest first."""

    def __init__(self, tokens: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fall, ends = [0], [-1]
        for s, t in tokens.items():
            at = 0
            for c in s:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fall.append(0)
                    ends.append(-1)
                at = to
            ends[at] = t
        self.found: list[tuple] = [()] * len(ends)  # (token, length), ...
        todo = deque((to, c, 0, 1) for c, to in self.next[0].items())
        while todo:
            at, c, parent, depth = todo.popleft()
            if parent or depth > 1:
                self.fall[at] = self.step(self.fall[parent], c)
            longer = self.found[self.fall[at]]
            self.found[at] = ((ends[at], depth), *longer) if ends[at] >= 0 else longer
            todo.extend((to, x, at, depth + 1) for x, to in self.next[at].items())

    def step(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.fall[state]
        return self.next[state].get(c, 0)


class WordTrie:
    """Distinct words → their ids. A node: the automaton's state and the last token of the beginning it stands for."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.suffixes = merges, Suffixes(merges.usable)
        self.width = {t: len(s) for s, t in merges.vocab.items()}
        self._clear()

    def _clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.state, self.last = [0], [-1]

    def _last_token(self, state: int, depth: int, lasts: list[int]) -> int:
        for token, n in self.suffixes.found[state]:
            if n == depth or self.merges.apart(lasts[depth - n], token):
                return token
        raise ValueError("UNSUPPORTED_MERGES: a character has no token")

    def _ids(self, lasts: list[int]) -> list[int]:
        out, at = [], len(lasts) - 1
        while at:
            out.append(lasts[at])
            at -= self.width[lasts[at]]
        return out[::-1]

    def _walked(self, word: str) -> list[int]:
        state, lasts = 0, [-1]
        for c in word:
            state = self.suffixes.step(state, c)
            lasts.append(self._last_token(state, len(lasts), lasts))
        return self._ids(lasts)

    def encode(self, words: set[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        before, path, lasts = "", [0], [-1]  # of the word before: its nodes, and their last tokens
        for word in sorted(words):
            if len(word) > LONG_WORD:
                out[word] = self._walked(word)
                continue
            if len(self.last) > MOST_NODES:
                self._clear()
                before, path, lasts = "", [0], [-1]
            n, most = 0, min(len(word), len(before))
            while n < most and word[n] == before[n]:
                n += 1
            del path[n + 1 :], lasts[n + 1 :]
            for c in word[n:]:
                at = path[-1]
                to = self.child[at].get(c)
                if to is None:
                    to = self.child[at][c] = len(self.last)
                    state = self.suffixes.step(self.state[at], c)
                    self.child.append({})
                    self.state.append(state)
                    self.last.append(self._last_token(state, len(lasts), lasts))
                path.append(to)
                lasts.append(self.last[to])
            out[word] = self._ids(lasts)
            before = word
        return out


class _Encoded(NamedTuple):
    ids: list[int]


class TrieTokenizer:
    """Encodes as the tokenizers library does; the library only parts texts into words."""

    def __init__(self, path: str, library) -> None:
        with open(path, encoding="utf-8") as f:
            document = json.load(f)
        model, kind = document["model"], document["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or document["normalizer"] or odd:
            raise ValueError(f"UNSUPPORTED_TOKENIZER: byte-level BPE without options is needed, not {odd or kind.get('type')}")
        self.words_of = library.pre_tokenizer.pre_tokenize_str
        self.trie = WordTrie(Merges(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]))
        added = document["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("UNSUPPORTED_TOKENIZER: added tokens that look around")
        self.special = {t["content"]: t["id"] for t in added}
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None

    def _parts(self, text: str) -> list[str]:
        return [p for p in self.parted.split(text) if p] if self.parted and any(s in text for s in self.special) else [text]

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[_Encoded]:
        parted: list[list[int | str]] = []
        for t in texts:
            words: list[int | str] = []
            for p in self._parts(t):
                if p in self.special:
                    words.append(self.special[p])
                else:
                    words += [w for w, _ in self.words_of(p)]
            parted.append(words)
        known = self.trie.encode({w for words in parted for w in words if isinstance(w, str)})
        return [_Encoded([i for w in words for i in (known[w] if isinstance(w, str) else (w,))]) for words in parted]

    def encode(self, text: str, add_special_tokens: bool = False) -> _Encoded:
        return self.encode_batch_fast([text])[0]


class TrieEncoder(CachedEncoder):
    """Ids of whole texts: each distinct unit of a text is looked up, new ones go through the trie."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer = TrieTokenizer(path, self.tokenizer)


class Decoder:
    """Bytes of each id, one after the other."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            document = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255 in order
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        strings = {i: s for s, i in document["model"]["vocab"].items()} | {t["id"]: t["content"] for t in document["added_tokens"]}
        pieces = [b""] * (max(strings) + 1)
        for i, s in strings.items():
            pieces[i] = bytes(map(byte_of.__getitem__, s)) if all(c in byte_of for c in s) else s.encode()
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([*map(len, pieces), 0], np.int64)  # a last entry for ids that are unknown
        self.begin = np.concatenate([[0], np.cumsum(self.size[:-1])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of strings of ids that stand one after the other."""
        ids = np.minimum(ids.astype(np.int64), len(self.size) - 1)
        sizes = self.size[ids]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.bytes[np.arange(stop[-1]) + np.repeat(self.begin[ids] - stop[:-1], sizes)].tobytes()
        edges = stop[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _codec(path: str) -> tuple[TrieEncoder, Decoder]:
    return kept(("trie", path), lambda: (TrieEncoder(path), Decoder(path)))


def _applied(df: DataFrame, column, out: dict[str, pa.DataType], work) -> DataFrame:
    """``df`` with new columns that ``work`` makes of the values of one, a slice at a time. Columns of the new names are replaced."""
    others = [f for f in df.schema if f.name not in out]
    kinds = {pa.binary(): "binary", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in narrow(batches):
            made = work(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(m, kind) for m, kind in zip(made, out.values(), strict=True))], names=[*[f.name for f in others], *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"`{c}` {kinds[k]}" for c, k in out.items())])
    # columns go in under numbers: their names may be those used here
    return df.select(*[F.col(f"`{f.name}`").alias(f"k{n}") for n, f in enumerate(others)], column.alias("value")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of each text as little-endian unsigned 32-bit integers in ``ids_col``; with ``decoded_col``, what those ids
    decode to besides, in the same step."""

    def work(texts: list[str]) -> list[list]:
        encoder, decoder = _codec(path)
        ids, counts = encoder.encode(texts)
        edges, raw = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist(), ids.astype("<u4").tobytes()
        strings = [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [strings, decoder.decode(np.frombuffer(raw, "<u4"), counts)] if decoded_col else [strings]

    return _applied(df, text_or_empty(text_col), {ids_col: pa.binary()} | ({decoded_col: pa.string()} if decoded_col else {}), work)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``ids_col``, a null counting as no ids."""

    def work(strings: list[bytes]) -> list[list]:
        decoder = _codec(path)[1]
        counts = np.array([len(s) // 4 for s in strings], np.int64)
        return [decoder.decode(np.frombuffer(b"".join(s[: 4 * n] for s, n in zip(strings, counts.tolist(), strict=True)), "<u4"), counts)]

    return _applied(df, F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")), {out: pa.string()}, work)
