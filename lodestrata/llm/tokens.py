"""Exact token counts without moving pre-tokens between tasks.

Tier one is a broadcast table from pre-token to its number of tokens. It holds the strings of the tokenizer's own
vocabulary, which are the frequent pre-tokens of the text it was made for, so its size is that of the vocabulary and
doesn't grow with the corpus. Tier two is a cache in each Python worker: a pre-token that isn't in the table is encoded
once by the library and then remembered; a full cache is emptied. Texts where cutting into pre-tokens by our own pattern
might differ from the library (special strings, characters outside a plain set) are encoded whole by the library.

Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows give repeated results, and an empty
table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import column_of, empty_where_null, keyed_text, text_chunks

#: Pre-tokens that a worker remembers besides the broadcast table.
CACHE_ENTRIES = 1_000_000
TOKEN_LIMIT = 2048

#: The tokenizer's own pre-token pattern.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class, case and normal form are the same in every Unicode version and library.
PLAIN = regex.compile("[\t-\r -~¡-¬®-įı-ſ‐-‧‰-⁞€]*")

_worker: dict = {}


class Lengths(dict):
    """Pre-token to number of tokens; encodes what it doesn't hold."""

    def __init__(self, table: dict[str, int], tokenizer: Tokenizer):
        super().__init__(table)
        self.table, self.tokenizer = table, tokenizer

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.table) + CACHE_ENTRIES:
            self.clear()
            self.update(self.table)
        self[word] = found = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return found


def frequent_lengths(path: str) -> dict[str, int]:
    """The broadcast tier: every vocabulary string that is a pre-token by itself, with its number of tokens."""
    tokenizer, pattern = Tokenizer.from_file(path), regex.compile(PRE_TOKENS)
    words = {x.removesuffix("</w>") for x in tokenizer.get_vocab()}
    words = sorted(w for w in words if w and w.isascii() and pattern.fullmatch(w) and w == w.lower() and pattern.findall(w) == [w])
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f)["added_tokens"]]


def counts_in(texts: list[str], lengths: Lengths, pattern, specials: list[str]) -> list[int]:
    out = []
    for text in texts:
        if any(s in text for s in specials) or not PLAIN.fullmatch(text):
            out.append(len(lengths.tokenizer.encode(text, add_special_tokens=False).ids))
        else:
            out.append(sum(map(lengths.__getitem__, pattern.findall(text.lower()))))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    specials = special_strings(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("path") != path:
            _worker.update(path=path, lengths=Lengths(held.value, Tokenizer.from_file(path)), pattern=regex.compile(PRE_TOKENS))
        for batch in batches:
            for part in text_chunks(batch):
                texts = empty_where_null(column_of(part, "text"))
                counts = np.array(counts_in(texts.to_pylist(), _worker["lengths"], _worker["pattern"], specials), np.int64)
                yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
