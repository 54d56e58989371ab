"""Byte-level BPE encoding and decoding in linear time.

Each byte becomes the Latin-1 character of the same number, so that pyahocorasick finds every token that
occurs in a piece of text. A piece is then covered from the left by the longest token that may follow the
one before; where none may, the search goes back to a shorter token, and a position once left is not
entered again. Two tokens may follow each other if merging their joint bytes gives the two back; a memo
remembers that. A cover whose neighbours all may follow each other is the one that the merges make, so
the ids are those of merging by rank.

Cases: null and empty texts have no ids; texts of any length are taken whole; special tokens' strings are
ordinary text; repeated rows each get a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker remembers (twice that many for a while), and characters of the longest of them.
CACHE_WORDS, CACHE_CHARS = 150_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
MEMO_PAIRS = 250_000
#: White space other than single blanks and line feeds between other characters.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z").search


class Encoder:
    """blanks_part: the pattern begins a piece at every single blank and line feed between other characters and joins letters to
    the blank before them, so that texts can be looked up word by word. Of other patterns every piece is found by the pattern."""

    def __init__(self, rank_lines: bytes, pattern: str, blanks_part: bool = False) -> None:
        import ahocorasick
        import regex

        pairs = (line.split() for line in rank_lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.find = regex.compile(pattern).findall
        self.blanks_part = blanks_part
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        self.joined: dict[tuple[int, int], int] = {}  # and its inverse
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) != 2:  # no merge makes it: it can only be a whole piece
                    continue
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest token that a token begins with
        for rank in self.halves:
            token = self.bytes_of[rank]
            heads = (self.ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next(r for r in heads if r is not None and (r in self.halves or len(self.bytes_of[r]) == 1))
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.memo: dict[tuple[int, int], bool] = {}
        self.sizes = [len(t) for t in self.bytes_of]
        self.packed = [int(r).to_bytes(4, "little") for r in range(len(self.bytes_of))]
        self.words = _Kept(CACHE_WORDS, self._word)
        self.mixed = _Kept(CACHE_WORDS // 4, lambda w: self.piece(" " + w))
        self.others = _Kept(CACHE_WORDS // 8, lambda p: b"".join([self.packed[i] for i in self.cover(p.encode())]))
        self.newline = self.piece("\n")

    def _merge(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """Merging by rank, one pair at a time, with tokens under a rank only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens that stand at a token's right (0) or left (1) edge while it is made, last first, each with
        the ranks at which it comes up and goes."""
        found = self.edges[side].get(token)
        if found is None:
            found, end, at = [], float("inf"), token
            while at in self.halves:
                found.append((at, at, end))
                end, at = at, self.halves[at][1 - side]
            found.append((at, -1, end))
            self.edges[side][token] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary comes up while both its sides stand (of equal ranks the left one comes first)."""
        lefts, rights, i, j, fits = self._edge(left, 0), self._edge(right, 1), 0, 0, True
        while True:  # back in time over the pairs that stand together
            (a, from_a, to_a), (b, from_b, to_b) = lefts[i], rights[j]
            rank = self.joined.get((a, b))
            if rank is not None and rank < to_a and rank <= to_b:
                fits = False
                break
            if from_a < 0 and from_b < 0:
                break
            if from_a > from_b:
                i += 1
            else:
                j += 1
        if len(self.memo) >= MEMO_PAIRS:
            self.memo.clear()
        self.memo[left, right] = fits
        return fits

    def cover(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, memo = len(piece), self.sizes, self.memo
        longest = [0] * n
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # of the tokens from one place, longer ones end later
        dead: set[int] = set()
        token = longest[0]
        ids, at, last = [], 0, None
        while True:
            end = at + sizes[token]
            fits = last is None or memo.get((last, token))
            if fits is None:
                fits = self.may_follow(last, token)
            if fits and end not in dead:
                ids.append(token)
                if end == n:
                    return ids
                last, at, token = token, end, longest[end]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                dead.add(at)
                token = ids.pop()
                at -= sizes[token]
                last = ids[-1] if ids else None

    def piece(self, text: str) -> bytes:
        """The packed ids of a text, piece by piece."""
        words, others = self.words, self.others
        return b"".join([words[p[1:]] if p[0] == " " and p[1:].isalpha() else others[p] for p in self.find(text)])

    def _word(self, word: str) -> bytes:
        """A word behind a blank: letters are one piece."""
        if word.isalpha():
            packed = self.packed
            return b"".join([packed[i] for i in self.cover((" " + word).encode())])
        return self.mixed[word]

    def encode(self, text: str) -> bytes:
        """The packed ids (little-endian, 32 bits). Where single blanks and line feeds stand between other
        characters and the pattern parts the text there, words are looked up one by one."""
        if not text:
            return b""
        if not self.blanks_part or _UNEVEN(text):
            return self.piece(text)
        words, lines = self.words.__getitem__, []
        for line in text.split("\n"):
            first, _, rest = line.partition(" ")
            lines.append(self.others[first] if first.isalpha() else self.piece(first))
            if rest:
                lines[-1] += b"".join(map(words, rest.split(" ")))
        return self.newline.join(lines)

    def forget(self) -> None:
        """Empties what was remembered, so that a worker between tasks holds the vocabulary alone."""
        for kept in (self.words, self.mixed, self.others):
            kept.clear()
            kept.old = {}
        self.memo.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Kept(dict):
    """What a function gave for short strings. When full, it becomes the old half, and what is asked for again comes back."""

    def __init__(self, most: int, make) -> None:
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.pop(key, None)
        if made is None:
            made = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(rank_lines: bytes, pattern: str, blanks_part: bool = False) -> Encoder:
    """One encoder for each worker process: the automaton is built once."""
    key = (hashlib.sha256(rank_lines).digest(), pattern, blanks_part)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(rank_lines, pattern, blanks_part)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, column: str = "text", blanks_part: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text); with_ids: also the packed ids.

    The rank file is read on the driver and sent along (under 1 MB), so executors need no copy of it.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern, blanks_part))

    def run(batches):
        import pyarrow as pa

        own = encoder(*sent.value)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                    columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids])]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        columns.append(pa.array(ids, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            own.forget()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col(column)).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text: the texts of packed ids (invalid UTF-8 is replaced)."""
    with open(ranks_path, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def run(batches):
        import pyarrow as pa

        own = encoder(*sent.value)
        for batch in batches:
            texts = [own.decode(x or b"").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def public(docs: DataFrame, **more) -> DataFrame:
    """With the public multilingual vocabulary."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, blanks_part=True, **more)


QUERIES = {"op10_byte_bpe": lambda spark, sf_dir: public(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
ORACLES: dict[str, str] = {}
