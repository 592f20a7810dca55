"""Byte-pair encoding of distinct words by a prefix-sharing trie traversal.

A byte sequence's encoding is fixed by the last token of each of its
prefixes: the last token of a prefix is the one vocabulary suffix that may
follow the last token of the shorter prefix before it, and two tokens may be
neighbours only if merging their bytes leaves exactly these two. Walking the
distinct words in byte order visits their trie depth first, so states of a
shared prefix are computed once and dropped when the walk leaves its subtree.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import regex

DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the published pre-tokenizer pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACE = regex.compile(r" \s|[^\S ] ").search
PLAIN_SPACE = regex.compile(r"(?<=\S) (?=\S)").finditer


class TrieEncoder:
    """Encodes texts with one vocabulary; keeps the encodings of words seen (up to ``max_words``, then starts over)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, max_words: int = 400_000):
        self.ranks = ranks
        self.tails = {t[i:] for t in ranks for i in range(len(t))}
        self.split = regex.compile(pattern).findall
        self.max_words = max_words
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.may_meet: dict[tuple[int, int], bool] = {}

    def _half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; none for a single byte."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            while len(parts) > 2:
                found = [(self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)]
                rank, i = min(found)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether ``left right`` is what merging their joint bytes leaves."""
        key = (left, right)
        known = self.may_meet.get(key)
        if known is None:
            known = self.may_meet[key] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _walk(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Encodings of ``words`` (byte order) by one depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        ranks, meet, tails = self.ranks, self._neighbours, self.tails
        last: list[int] = [-1]  # last[d]: last token of the prefix of d bytes
        size: list[int] = [0]  # its length
        before = b""
        for word in words:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                start = end - 1
                while start and word[start - 1 : end] in tails:
                    start -= 1
                while True:
                    token = ranks.get(word[start:end])
                    if token is not None and (start == 0 or meet(last[start], token)):
                        break
                    start += 1
                last.append(token)
                size.append(end - start)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            out[word] = ids[::-1]
            before = word
        return out

    def _learn(self, words: set[str]) -> None:
        fresh: dict[bytes, str] = {}
        for w in words:
            raw = w.encode("utf-8", "replace")
            token = self.ranks.get(raw)
            if token is not None:
                self.known[w] = [token]
            else:
                fresh[raw] = w
        for raw, ids in self._walk(sorted(fresh)).items():
            self.known[fresh[raw]] = ids

    def _cut(self, text: str) -> list[str]:
        """Pieces that begin at a single space between two other characters.

        No match of the pattern crosses such a place, so a piece's encoding does
        not depend on its neighbours and can be kept.
        """
        if ODD_SPACE(text):
            at, pieces = 0, []
            for m in PLAIN_SPACE(text):
                pieces.append(text[at : m.start()])
                at = m.start()
            pieces.append(text[at:])
            return pieces
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; 0 for a null or empty one."""
        cut = self._prepare(texts)
        sizes = {p: len(self.pieces[p]) for p in set(chain.from_iterable(cut))}
        return [sum(map(sizes.__getitem__, c)) for c in cut]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; the empty list for a null or empty one."""
        keep = self.pieces
        return [list(chain.from_iterable(map(keep.__getitem__, c))) for c in self._prepare(texts)]

    def _prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, all of them encoded in ``self.pieces`` by then."""
        cut = [self._cut(t) if t else [] for t in texts]
        pieces = set(chain.from_iterable(cut))
        if len(self.pieces) + len(pieces) > self.max_words:
            self.pieces.clear()
        if len(self.known) > self.max_words:
            self.known.clear()
        split, known, keep = self.split, self.known, self.pieces
        words = {p: split(p) for p in pieces if p not in keep}
        self._learn(set(chain.from_iterable(words.values())) - known.keys())
        for p, own in words.items():
            keep[p] = known[own[0]] if len(own) == 1 else list(chain.from_iterable(map(known.__getitem__, own)))
        return cut


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken") -> TrieEncoder:
    """One encoder a worker process and vocabulary file."""
    return TrieEncoder(load_ranks(path))
