"""Encoding of a whole corpus with a byte-level BPE vocabulary, by prefix-sharing trie traversal.

A text is cut into words by the tokenizer's public pattern. Distinct words are inserted into a byte trie. In
byte-pair encoding by merge ranks, the encoding of a word's prefix is determined by its *last token* and the
prefix before that token; so every trie node needs one state, the last token of its path, and a depth-first
pass over the trie computes the encodings of shared prefixes once. A token can be a node's last token if it
is a suffix of the path and forms a *stable pair* with the last token of the node it starts from: the merges
applied to the two tokens' bytes give these two tokens again. Exactly one token qualifies.

The trie lives in the Python worker and grows over the batches of its partition; encoding is a narrow
transformation without any shuffle.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.session import ship_package

TOKENIZER_DIR = "/opt/tokenizers"
WORD_CACHE = 1 << 18  # distinct words (and a quarter of the trie nodes) kept by a worker before it starts afresh
# fixed value: the public pattern of this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder:
    """Word encodings of one vocabulary of (bytes, rank) pairs; ranks are ids and merge priorities."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cache: int = WORD_CACHE) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.cache = cache
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.first = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.first) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        # the vocabulary's own trie over reversed tokens: finds the tokens that are suffixes of a path
        self.endings: dict = {}
        for token, rank in ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.stable: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.unreachable: set[int] = set()
        self.reset()

    def reset(self) -> None:
        """Forget all words. Node 0 is the root; a node has a parent, a byte, its last token and where that starts.
        ``children`` leads from node * 256 + byte to the child."""
        self.children: dict[int, int] = {}
        self.parent, self.byte, self.last, self.start = [0], [0], [-1], [0]
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def merge(self, text: bytes) -> list[int]:
        """Plain byte-pair encoding of a short text: the lowest-ranked adjacent pair is merged first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes."""
        if token not in self.halves:
            text = self.bytes_of[token]
            found = None
            if len(text) > 1:
                parts = [text[i : i + 1] for i in range(len(text))]
                while len(parts) > 2:
                    options = [(self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.ranks]
                    if not options:
                        break
                    at = min(options)[1]
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    found = self.ranks[parts[0]], self.ranks[parts[1]]
                else:
                    self.unreachable.add(token)
            self.halves[token] = found
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's left (0) or right (1) edge while it is being merged, shortest first,
        each with the rank of the merge that ends it. Ranks rise, as a merge's parts have lower ranks."""
        edge = self.edges[side].get(token)
        if edge is None:
            edge, at = [(self.bytes_of[token], float("inf"))], token
            while (halves := self._halves(at)) is not None:
                edge.append((self.bytes_of[halves[side]], at))
                at = halves[side]
            edge.reverse()
            self.edges[side][token] = edge
        return edge

    def is_stable(self, left: int, right: int) -> bool:
        """Whether no merge across the seam comes before the merges inside the two tokens."""
        pair = (left, right)
        known = self.stable.get(pair)
        if known is None:
            a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
            known = True
            while known:
                (x, until_x), (y, until_y) = a[i], b[j]
                seam = self.ranks.get(x + y)
                if seam is not None and seam < until_x and seam <= until_y:
                    known = False
                elif until_x == until_y == float("inf"):
                    break
                elif until_x <= until_y:  # of equal merges the left one comes first
                    i += 1
                else:
                    j += 1
            self.stable[pair] = known
        return known

    def _settle(self, node: int) -> None:
        """Find a node's last token; its ancestors have theirs."""
        parent, byte, last, stable, is_stable = self.parent, self.byte, self.last, self.stable, self.is_stable
        ending, at = self.endings, node
        while at:
            ending = ending.get(byte[at])
            if ending is None:
                break
            at = parent[at]
            token = ending.get(-1)
            if token is None:
                continue
            if at:
                known = stable.get((last[at], token))
                if known or (known is None and is_stable(last[at], token)):
                    last[node], self.start[node] = token, at
                    return
            else:
                self._halves(token)
                if token not in self.unreachable:
                    last[node], self.start[node] = token, 0
                    return
        raise ValueError("no encoding found")

    def insert(self, words: Iterable[str]) -> None:
        """Insert new words and settle their new nodes, depth first, shared prefixes once."""
        children, parent, byte, last, start = self.children, self.parent, self.byte, self.last, self.start
        for word in words:
            node = 0
            for b in word.encode("utf-8", "replace"):
                child = children.get(node << 8 | b)
                if child is None:
                    child = children[node << 8 | b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    last.append(-1)
                    start.append(0)
                    self._settle(child)
                node = child
            ids = []
            while node:
                ids.append(last[node])
                node = start[node]
            ids.reverse()
            self.known[word] = ids
            self.sizes[word] = len(ids)

    def words(self, text: str) -> list[str]:
        """The text's words, all of them encoded."""
        words = self.split(text)
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) > self.cache or len(self.parent) > 4 * self.cache:
                self.reset()
                fresh = set(words)
            self.insert(sorted(fresh))
        return words

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def count(self, text: str) -> int:
        words = self.words(text)
        return sum(map(self.sizes.__getitem__, words))


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_ENCODERS: dict = {}
ENDINGS = ("tiktoken", "json", "model")


def ship_vocabulary(spark: SparkSession, name: str, folder: str = TOKENIZER_DIR) -> None:
    """Send a tokenizer's file from the driver to the executors, once per application."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_spanlight_vocabularies", set())
    for end in ENDINGS:
        path = f"{folder}/{name}.{end}"
        if path not in sent and os.path.exists(path):
            context.addFile(path)
            sent.add(path)


def _vocabulary_folder(name: str, folder: str) -> str:
    """Where a tokenizer's file lies: among the files sent with the application, else in ``folder``."""
    try:
        own = SparkFiles.getRootDirectory()
    except Exception:  # noqa: BLE001 - outside of an application
        return folder
    return own if any(os.path.exists(f"{own}/{name}.{end}") for end in ENDINGS) else folder


def encoder(name: str, folder: str = TOKENIZER_DIR):
    """Two functions of a named public tokenizer, text -> ids and text -> number of ids; one pair per process."""
    made = _ENCODERS.get((name, folder))
    if made is None:
        at = _vocabulary_folder(name, folder)
        ranks, plain, pieces = (f"{at}/{name}.{end}" for end in ENDINGS)
        if os.path.exists(ranks):
            trie = TrieEncoder(load_ranks(ranks))
            made = trie.encode, trie.count
        elif os.path.exists(plain):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(plain)
            tokenizer.encode_special_tokens = True
            ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            made = ids, lambda text: len(ids(text))
        elif os.path.exists(pieces):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=pieces)
            made = model.encode, lambda text: len(model.encode(text))
        else:
            raise FileNotFoundError(f"no tokenizer {name} in {folder}")
        _ENCODERS[name, folder] = made
    return made


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key, ids`` of every row: the token ids of its text without special tokens.

    Null and empty texts have an empty list; blank texts are encoded as they are. The vocabulary is sent to the executors
    from the driver's ``folder``.
    """
    ship_package(df.sparkSession)
    ship_vocabulary(df.sparkSession, tokenizer, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = pa.array([encode(t) if t else [] for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key, n_tokens`` of every row; 0 for null and empty texts."""
    ship_package(df.sparkSession)
    ship_vocabulary(df.sparkSession, tokenizer, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count = encoder(tokenizer, folder)
        for batch in batches:
            sizes = pa.array([count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "n_tokens"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
