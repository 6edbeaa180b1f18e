"""Token counts with a public tokenizer, and cutting of texts into pieces of at most so many tokens."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.session import ship

# Fixed value: the split pattern published with the byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at once when a text is cut; a token has at least a byte, so a slice holds a piece or is doubled.
SLICE_CHARS = 8


#: Blanks in a row that are encoded at once.
BLANKS = 10_000
LONG_RUN = re.compile(r"(?<!\s)\s{%d,}" % (BLANKS + 1))


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary of ranks, one ``base64 rank`` pair a line, and its split pattern."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = field(default=SPLIT_PATTERN)


@lru_cache(maxsize=4)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Encodes texts in a worker; the vocabulary comes from the driver, so executors need no file."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.coding = _encoding(vocabulary, pattern)

    def encode(self, text: str) -> np.ndarray:
        """The tokens of a whole text. Runs of more than BLANKS blanks are encoded in parts of that length, as the
        library's pattern matcher fails on them otherwise."""
        if len(text) <= BLANKS:
            return np.asarray(self.coding.encode_ordinary(text), dtype=np.int64)
        cuts = [0, *(c for m in LONG_RUN.finditer(text) for c in range(m.start() + BLANKS, m.end(), BLANKS)), len(text)]
        parts = [self.coding.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate([np.asarray(p, dtype=np.int64) for p in parts])

    def pieces(self, text: str, capacity: int) -> list[tuple[int, int, np.ndarray]]:
        """(start, characters, tokens) of consecutive pieces that make up the text.

        One piece where the text has at most ``capacity`` tokens. Otherwise each piece is the longest start of
        the rest that ends at a token and a character and has at most ``capacity`` tokens when encoded alone.
        """
        out, start = [], 0
        while True:
            slice_chars = max(64, SLICE_CHARS * capacity)
            while True:
                part = text[start : start + slice_chars]
                tokens = self.encode(part)
                if len(tokens) > capacity or start + len(part) >= len(text):
                    break
                slice_chars *= 2
            if len(tokens) <= capacity:
                out.append((start, len(part), tokens))
                return out
            keep = capacity
            while True:
                piece = self.coding.decode_bytes(tokens[:keep].tolist()).decode("utf-8", errors="ignore")
                piece = part[: len(piece)]
                own = self.encode(piece)
                if len(own) <= capacity and piece:
                    break
                if not piece or keep <= 1:
                    raise ValueError("capacity is less than the tokens of one character")
                keep -= max(1, len(own) - capacity)
            out.append((start, len(piece), own))
            start += len(piece)


def vocabulary(spark, tokenizer: Tokenizer):
    """The vocabulary file, read on the driver and broadcast: a file of fixed size (under 2 MB), not data."""
    with open(tokenizer.path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def counted(df: DataFrame, text_col: str = "text", tokenizer: Tokenizer = Tokenizer(), name: str = "tokens") -> DataFrame:
    """``df`` without ``text_col`` but with the number of tokens of the whole text; a null text has 0.

    Other columns are kept as they are, except one already called ``name``, which is replaced.
    """
    spark = df.sparkSession
    ship(spark)
    words = vocabulary(spark, tokenizer)
    kept = [c for c in df.columns if c not in (text_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(words.value, tokenizer.pattern)
        for batch in batches:
            n = [len(coder.encode(t)) if t else 0 for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, name])

    fields = [df.schema[c] for c in kept]
    from pyspark.sql import types as T

    return df.select(*kept, text_col).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))
