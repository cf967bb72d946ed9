"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a piece has one encoding that merges would give, and it is fixed by its last token: for each
prefix, the last token is the one token that ends there, whose own start is a prefix's end, and that may stand
next to that prefix's last token. Storing last tokens makes appends exact (only new prefixes are worked out) and
lets an edit re-encode from it to where the old last tokens return. Two tokens may stand side by side if no merge of less rank crosses
their border while each is built, which is read off the order of merges inside both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import _common as C

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose tokens a worker keeps.
CACHE = 500_000
OUTPUTS = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


class Vocabulary:
    """Ranks of byte strings, with what prefix dynamic programming needs; parts are worked out on first use."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.sizes = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens of whose merge a token is made; None for a token that no merge makes."""
        if token not in self.halves:
            word, made = self.tokens[token], None
            parts = [word[k : k + 1] for k in range(len(word))]
            while len(parts) > 2:  # merge as training did, by ranks below the token's own
                best = min(((self.ranks.get(parts[k] + parts[k + 1], token), k) for k in range(len(parts) - 1)))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2:
                made = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[token] = made
        return self.halves[token]

    def may_join(self, left: int, right: int) -> bool:
        """Whether merges leave the border between two tokens that stand side by side.

        Undoes the merges inside both from the last to the first and asks at each state whether a merge
        across the border would have come before the one undone.
        """
        key = (left, right)
        if (known := self.beside.get(key)) is not None:
            return known
        ranks, tokens, undone, a, b, ok = self.ranks, self.tokens, 1 << 60, left, right, True
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            # equal ranks go left to right: a merge across the border comes before an equal one on its right
            if across is not None and across < undone:
                ok = False
                break
            over, under = self.half(a), self.half(b)
            if over is None and under is None:
                break
            if under is None or (over is not None and a > b):
                undone, a = a, over[1]
            else:
                undone, b = b + 1, under[0]
        if len(self.beside) > 2_000_000:
            self.beside.clear()
        self.beside[key] = ok
        return ok


class Prefixes:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: what is known of the prefixes so far stays true."""
        v, known = self.vocabulary, len(self.data)
        self.data += more
        last, join, sizes = self.last, v.may_join, v.sizes
        last += [None] * (len(self.data) - known)
        base = max(0, known - v.longest)
        # all tokens of the vocabulary that end at each new prefix
        for at, token in v.automaton.iter(self.data[base:].decode("latin-1")):
            end = base + at + 1
            if end > known and last[end] is None:
                before = last[end - sizes[token]] if end - sizes[token] >= base else None
                if before is not None and (before < 0 or join(before, token)):
                    last[end] = token

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Puts `new` in place of bytes start to end. Prefixes before the edit are kept; those after it are worked out
        until as many in a row as the longest token has bytes end in the tokens that they ended in before: what comes
        later looks no further back, so it is as it was."""
        tail, known = self.data[end:], self.last[end + 1 :]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        step, done = self.vocabulary.longest, 0
        while done < len(tail):
            self.append(tail[done : done + step])
            same = self.last[-min(step, len(tail) - done) :] == known[done : done + step]
            done += step
            if same and done < len(tail):
                self.data += tail[done:]
                self.last += known[done:]
                break

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            if token is None:
                raise ValueError("the vocabulary lacks a byte of this text")
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder(dict):
    """Packed ids of pieces; the cache empties itself when full."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, limit: int = CACHE):
        import regex

        super().__init__()
        self.vocabulary, self.limit, self.cut = vocabulary, limit, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()
        packed = np.array(ids, "<u4").tobytes()
        if len(data) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.cut(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.load(path), pattern)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _coder(path: str | None, pattern: str, names: list[str], ids: bool, text_name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path or vocabulary_path(), pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(batch.schema.get_field_index(text_name)):
                packed = code.encode(text.as_py() or "")
                if ids:
                    out[0].append(np.frombuffer(packed, "<u4").astype(np.int32))
                out[1].append(len(packed) // 4)
                out[2].append(hashlib.sha256(packed).hexdigest())
                out[3].append(hashlib.sha256(code.decode(packed)).hexdigest())
            made = [pa.array(out[0], pa.list_(pa.int32()))] if ids else []
            made += [pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *made], names=[*names, *OUTPUTS[0 if ids else 1 :]])

    return run


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The columns `keep` of df (all if None) with ids (array of int, unless ids is False), n_tokens, ids_sha256 and
    decoded_sha256 of text_col.

    Each match of the pattern is encoded by itself, without special tokens. A null or empty text has no tokens.
    Texts of any length take time in proportion. Repeated rows get equal ids; an empty table gives an empty result.
    Input columns named like an output are replaced; other columns stay, however named. path None means the public vocabulary of 50,256 ranks, found where the task runs.
    """
    df = C.without(df, [x for x in OUTPUTS if x != text_col])
    names = keep if keep is not None else df.columns
    fields = [df.schema[n] for n in names]
    added = [C.field("ids", T.ArrayType(T.IntegerType()))] if ids else []
    added += [C.field("n_tokens", T.LongType()), C.field("ids_sha256", T.StringType()), C.field("decoded_sha256", T.StringType())]
    slim = df.select(*dict.fromkeys([*names, text_col]))
    return slim.mapInArrow(_coder(path, pattern or default_pattern(), names, ids, text_col), T.StructType([*fields, *added]))


def _decoder(path: str | None, pattern: str, ids_name: str, names: list[str], out_name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path or vocabulary_path(), pattern)
        for batch in batches:
            texts = [code.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids_name))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(texts)], names=[*names, out_name])

    return run


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """df with out_col, the text of ids_col; null or empty ids give an empty text, bytes that are no UTF-8 become
    replacement characters."""
    df = C.without(df, [out_col])
    out = T.StructType([*df.schema.fields, C.field(out_col, T.StringType())])
    return df.mapInArrow(_decoder(path, default_pattern(), ids_col, df.columns, out_col), out)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], ids=False)
