"""Problem 7: encoding of the whole corpus with a public byte-level BPE vocabulary.

Distinct words of a batch are visited in byte order, which is a depth-first walk over their trie: the state of a
prefix is its last token, and only the bytes behind the prefix shared with the word before are computed. The last
token of a prefix is the one vocabulary entry that ends there and may stand behind the last token of what is left
("may stand": merging would not have crossed that boundary), so a state needs no re-encoding of what precedes it.

Defined results: null and empty texts give an empty list. Blank texts, control characters and very long words are
ordinary text. One row comes out for each row that goes in, repeated rows included.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TOKENIZER_DIR

#: Split of a text into words; belongs to the vocabulary (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 400_000  # words a worker remembers between batches; more are computed again, never dropped


class TrieEncoder:
    """Exact byte-pair encoding of words with prefix sharing."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.ends: dict = {}  # trie of the reversed entries; -1 holds the id
        for token, i in ranks.items():
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        # the two parts each entry was merged from: the split whose parts have the lowest larger rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            if len(token) == 1:
                self.parts[i] = (i, i)
                continue
            parts = self._merged(token, i)
            self.parts[i] = (ranks[parts[0]], ranks[parts[1]])
            self.pair[self.parts[i]] = i
        self.ok: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        import regex

        self.words = regex.compile(WORDS)

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError("the vocabulary has an entry that no merges make")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text followed by b's text is a, b."""
        parts, pair = self.parts, self.pair
        limit = 1 << 30
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                return False
            if a > b:  # undo the later of the two merges, keep what touches the boundary
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def learn(self, words: list[str]) -> None:
        """Encode distinct words into self.known."""
        ends, ok, known = self.ends, self.ok, self.known
        last: list[int] = [-1]  # last[k]: last token of the first k bytes
        begin: list[int] = [0]  # where that token begins
        before = b""
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, k, found = ends, end, []
                while k:
                    node = node.get(word[k - 1])
                    if node is None:
                        break
                    k -= 1
                    t = node.get(-1)
                    if t is not None:
                        found.append((k, t))
                for k, t in reversed(found):
                    if k == 0:
                        break
                    p = last[k]
                    key = p << 20 | t
                    good = ok.get(key)
                    if good is None:
                        good = ok[key] = self._may_follow(p, t)
                    if good:
                        break
                last.append(t)
                begin.append(k)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end = begin[end]
            known[text] = tuple(reversed(ids))
            before = word
        if len(ok) > 4_000_000:
            ok.clear()

    def split(self, texts: list[str | None]) -> list[list[str]]:
        found = [self.words.findall(t) if t else [] for t in texts]
        fresh = {w for ws in found for w in ws} - self.known.keys()
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
            fresh = {w for ws in found for w in ws}
        self.learn(list(fresh))
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in self.split(texts)]

    def lengths(self, texts: list[str | None]) -> list[int]:
        known = self.known
        return [sum(len(known[w]) for w in ws) for ws in self.split(texts)]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


BLOCK = 512  # rows whose words share one trie


def token_ids(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): every row's token ids, without special tokens. Narrow: no shuffle, one pass over the text."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = pa.array(enc.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens): the length of every row's encoding."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = pa.array(enc.lengths(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n], names=[key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")
