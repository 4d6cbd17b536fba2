"""Byte-level BPE by backtracking over the longest vocabulary matches.

Bytes are mapped to Latin-1 characters, so that one pyahocorasick automaton finds every vocabulary
token inside a piece of text in a single pass. Encoding then walks left to right: it takes the
longest token at each position whose pairing with the token before is one that the merges could have
left standing, tries shorter ones if not, and steps back where none fits. A position that failed is
never entered again, so the walk is linear in the piece's length for tokens of bounded length.

Defined results: null and empty texts have no ids; repeated rows give repeated results; a null id is
kept; an empty table gives an empty result. Every text is processed whole. Texts of any length stream
through piece by piece. Columns of docs that have an added column's name are replaced.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskloom.llm.common import prepare

#: Pieces whose ids are remembered in a worker, and their longest length; a full memo is emptied.
MEMO_PIECES, MEMO_CHARS = 300_000, 40


#: Pieces of over so many bytes are matched in one pass over all their tokens.
LONG_PIECE = 64
#: Patterns of which a match begins at every space behind other than white space; texts are cut there first.
SPACED_PATTERNS = frozenset({public_tokenizers.PATTERN})
#: White space, as these patterns take it.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens with the tables that tell which neighbours the merges leave standing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        #: The last merge that makes a token; a token that no merge makes stands for itself.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        reached = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = (rank, rank)
            if len(token) == 1:
                reached.append((token, rank))
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._stands(a, b):
                    self.halves[rank] = (a, b)
                    self.merged[a, b] = rank
                    reached.append((token, rank))
                    break
        self.automaton = ahocorasick.Automaton()
        usable = dict(reached)
        #: The longest other token that a token begins with; -1 for none.
        self.shorter: dict[int, int] = {}
        for token, rank in reached:
            self.automaton.add_word(token.decode("latin-1"), rank)
            starts = (usable.get(token[:k], -1) for k in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in starts if r >= 0), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two adjacent tokens would come before their own."""
        bound = 1 << 62
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < bound:
                return False
            # undo the younger of the two tokens' merges, and look at what then meets at the border
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    part = self.halves[left][1]
                    if part != left:
                        bound, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        bound, right = right + 1, part
                        break
                undo_left = not undo_left
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """_stands(), remembered."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._stands(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        sizes, shorter, pairs, matches = self.sizes, self.shorter, self.pairs, self.automaton.iter_long
        longest: dict[int, int] = {}
        if n <= LONG_PIECE:  # where the longest tokens, one after the other, lead
            at = 0
            for end, rank in matches(text):
                longest[at] = rank
                at = end + 1
        else:  # the longest token from every byte; the last that is found is the longest
            for end, rank in self.automaton.iter(text):
                longest[end + 1 - sizes[rank]] = rank
        ids: list[int] = []
        dead: set[int] = set()
        at, rank = 0, longest[0]
        while at < n:
            while rank >= 0:
                end = at + sizes[rank]
                if end not in dead:
                    if not ids:
                        break
                    pair = ids[-1], rank
                    stands = pairs.get(pair)
                    if self.fits(*pair) if stands is None else stands:
                        break
                rank = shorter[rank]
            if rank >= 0:
                ids.append(rank)
                at = end
                if at < n:
                    rank = longest.get(at, -1)
                    if rank < 0:
                        rank = longest[at] = next(matches(text, at))[1]
            elif ids:
                dead.add(at)
                rank = ids.pop()
                at -= sizes[rank]
                rank = shorter[rank]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return ids


class Memo(dict):
    """What make() gives for a text, made when first asked for; that of long ones isn't kept."""

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> str:
        made = self.make(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[text] = made
        return made


class Encoder:
    """Encodes texts to ids, written in decimal and joined by one space, and decodes them.

    spaced: the pattern starts a new match at every space that follows other than white space, and
    takes that space and the ASCII letters behind it as one, so that what stands between such spaces can be
    encoded, and remembered, on its own; by default only of patterns that are known to do so.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, spaced: bool | None = None):
        self.vocabulary = vocabulary
        spaced = pattern in SPACED_PATTERNS if spaced is None else spaced
        self.findall = regex.compile(pattern).findall
        self.digits = {i: str(i) for i in vocabulary.tokens}
        self.bytes_of = {str(i): b for i, b in vocabulary.tokens.items()}
        self.pieces = Memo(self._piece)
        self.words = Memo(self._word)
        self.spaced = spaced

    def _piece(self, piece: str) -> str:
        return " ".join([self.digits[i] for i in self.vocabulary.encode_piece(piece.encode())])

    def _word(self, word: str) -> str:
        if word.isascii() and word.isalpha():  # a single match of the pattern
            return self._piece(" " + word)
        return self._plain(" " + word)

    def _plain(self, text: str) -> str:
        return " ".join(map(self.pieces.__getitem__, self.findall(text)))

    def encode(self, text: str) -> str:
        if not self.spaced or any(c + " " in text for c in SPACES) or text[:1] == " ":
            return self._plain(text)
        first, *others = text.split(" ")
        ids = " ".join(map(self.words.__getitem__, others))
        return self._plain(first) + " " + ids if others else self._plain(first)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_encoders: dict[tuple, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, key: str) -> Encoder:
    """One encoder for each vocabulary and pattern in a Python process."""
    if (key, pattern) not in _encoders:
        _encoders.clear()
        _encoders[key, pattern] = Encoder(Vocabulary(ranks), pattern)
    return _encoders[key, pattern]


def tokenized(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.

    The driver reads the vocabulary file and sends it as a broadcast: its size is that of the
    vocabulary, whatever the input's. Columns of docs that have an added column's name are replaced.
    """
    spark = prepare(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        blob = f.read()
    key = hashlib.sha256(blob).hexdigest()
    shared = spark.sparkContext.broadcast(blob)
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kept = docs.select(*[c for c in docs.columns if c == text or c not in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + added
    columns = kept.columns
    where = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key, pattern) in _encoders:
            own = _encoders[key, pattern]
        else:
            lines = map(bytes.split, shared.value.splitlines())
            was = gc.isenabled()
            gc.disable()
            try:
                own = encoder({base64.b64decode(a): int(b) for a, b in lines}, pattern, key)
                gc.freeze()  # the vocabulary's millions of small objects, without circles, need not be looked through
            finally:
                if was:
                    gc.enable()
        for batch in batches:
            counts, hashes, back, lists = [], [], [], []
            for t in batch.column(where).to_pylist():
                ids = own.encode(t or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append([int(i) for i in ids.split()])
            new = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                new.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, *names])

    return kept.mapInArrow(run, schema)
