"""Encoding with a public byte-level BPE tokenizer.

Text is split as the tokenizer splits it, and each piece is encoded without replaying merges: an
Aho-Corasick automaton over the vocabulary (bytes mapped to Latin-1 characters) gives the longest
token at every position, and a walk from left to right takes it if it is compatible with the token
before it, else the next shorter one, going back where none is. Two tokens are compatible if the
merges would leave them side by side; that is memoised. Positions that failed once are not tried
again, so the walk is linear in the length of the piece. Pieces recur, so their ids are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the public rank files are, unless a path is given.
FOLDER = "/opt/tokenizers"
#: Fixed value: how the public byte-level tokenizers split text before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kept pieces of a worker; beyond it the memory starts anew.
KEEP = 1_000_000


def rank_file(name: str, folder: str = FOLDER) -> str:
    return name if "/" in name else f"{folder}/{name}.tiktoken"


class ByteBPE:
    """Exact encoder for a rank file: ``base64(token) rank`` in each line, ranks in merge order."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.id_of = ranks
        self.text_of = dict(sorted((i, t) for t, i in ranks.items()))
        self.length = {i: len(t) for i, t in self.text_of.items()}
        self.split_at = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for t, i in ranks.items():
            self.shorter[i] = next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i, t in self.text_of.items():  # in merge order: a token's halves are known before it
            self.halves[i] = None
            left = self.shorter[i]
            while left is not None:
                right = ranks.get(t[self.length[left] :])
                if right is not None and max(left, right) < i and self.compatible(left, right):
                    self.halves[i] = left, right
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]
        self.fits.clear()  # judged before all merges were known
        self.first: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, tuple[int, ...] | None] = {}
        self.sizes: dict[str, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart when one follows the other. The later of
        the two to arise is undone again and again; were a pair across the border to merge before
        the part just undone arose, the merges would have crossed the border."""
        key = a, b
        known = self.fits.get(key)
        if known is not None:
            return known
        before = 1 << 62
        fits = None
        while fits is None:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                fits = False
                break
            ha, hb = self.halves.get(a), self.halves.get(b)
            if ha is None and hb is None:
                fits = True
            elif hb is None or ha is not None and a > b:
                before, a = a, ha[1]
            else:
                before, b = b + 1, hb[0]  # of equal ranks the left one merges first
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.id_of.get(s)
        if whole is not None:
            return (whole,)
        longest: list[int | None] = [None] * (len(s) + 1)
        length = self.length
        for end, t in self.automaton.iter(s):
            longest[end + 1 - length[t]] = t  # later ends are longer
        out: list[int] = []
        failed, at, token = set(), 0, longest[0]
        while at < len(s):
            if token is not None:
                end = at + length[token]
                if end not in failed and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at]
                else:
                    token = self.shorter[token]
                continue
            failed.add(at)
            token = out.pop()
            at -= length[token]
        return tuple(out)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.split_at(chunk):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) >= KEEP:
                    self.pieces.clear()
                got = self.pieces[piece] = self.encode_piece(piece)
            ids += got
        return tuple(ids)

    def _miss(self, chunk: str) -> tuple[int, ...] | None:
        if len(self.spaced) >= KEEP:
            self.spaced.clear()
        got = None if not chunk or chunk[0].isspace() else self._chunk(" " + chunk)
        self.spaced[chunk] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; none for a null or empty text. A piece of text always begins
        at a space before other characters, so chunks between spaces are encoded and kept apart."""
        if not text:
            return []
        chunks = text.split(" ")
        out = list(self._chunk(chunks[0])) if chunks[0] else []
        known = self.spaced
        for c in chunks[1:]:
            ids = known[c] if c in known else self._miss(c)
            if ids is None:  # runs of white space: pieces may cross the chunks
                return list(self._chunk(text))
            out += ids
        return out

    def count(self, text: str | None) -> int:
        """Length of :meth:`encode`'s result, from kept lengths of the chunks between spaces."""
        if not text:
            return 0
        chunks = text.split(" ")
        sizes, first = self.sizes, len(self._chunk(chunks[0])) if chunks[0] else 0
        del chunks[0]
        while True:
            try:
                return first + sum(map(sizes.__getitem__, chunks))
            except KeyError as e:
                ids = self._miss(e.args[0])
                if ids is None:
                    return len(self._chunk(text))
                if len(sizes) >= KEEP:
                    sizes.clear()
                sizes[e.args[0]] = len(ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(text: Column, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """Array of the ids of the text; empty for null and empty texts. The file must be on every executor."""
    path = rank_file(tokenizer, folder)

    @F.arrow_udf("array<int>")
    def ids(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(path)
        for texts in it:
            flat: list[int] = []
            ends = [0]
            for t in texts.to_pylist():
                flat += bpe.encode(t)
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def count_tokens(text: Column, tokenizers: list[str], folder: str = FOLDER) -> Column:
    """Struct of the number of ids by each tokenizer, in a field of its name; 0 for null and empty texts."""
    fields = ", ".join(f"`{t}` int" for t in tokenizers)

    @F.arrow_udf(f"struct<{fields}>")
    def count(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = [encoder(rank_file(t, folder)) for t in tokenizers]
        for texts in it:
            texts = texts.to_pylist()
            yield pa.StructArray.from_arrays([pa.array([b.count(t) for t in texts], pa.int32()) for b in each], names=tokenizers)

    return count(text)
