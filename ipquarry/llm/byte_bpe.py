"""Byte-level BPE encoding and decoding of Arrow batches with the tokenizers library.

Encoding gives ids and, where asked for, the span of every token in bytes and in characters of the
text. A byte-level token may begin or end inside a character; its character span then covers the
characters it has a part of, and its byte span stays exact. Decoding reverses the byte table: every
token is a string of stand-in characters, each of which is one byte, so that a character that several
tokens share comes back when their bytes are joined.

Defined results: null texts count as empty and give no tokens; special tokens' strings in a text are
ordinary text; lone halves of characters can't occur in Spark strings; unknown ids make decoding raise.
Rows repeat as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ipquarry.llm.common import table, texts, trim

VOCABULARY = "byte_bpe_50k.json"
#: Texts go to the library in groups of about so many characters, which bounds what is held at once.
GROUP_CHARS = 1 << 20


def byte_table() -> dict[str, int]:
    """Stand-in character -> byte: printable Latin-1 stands for itself, the rest for U+0100 onwards, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@functools.lru_cache(4)
def token_bytes(path: str) -> list[bytes | None]:
    """The bytes of each id, by the reversed byte table."""
    table, vocabulary = byte_table(), tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def grouped(items: list[str]):
    """Slices of items of about GROUP_CHARS characters."""
    at = chars = 0
    for i, text in enumerate(items):
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield items[at : i + 1]
            at, chars = i + 1, 0
    if at < len(items):
        yield items[at:]


def encode_lists(path: str, items: list[str]):
    """The ids of each text, as lists."""
    tk = tokenizer(path)
    for part in grouped(items):
        for got in tk.encode_batch_fast(part, add_special_tokens=False):
            yield got.ids


def encode(path: str, items: list[str]):
    """The ids of each text, as numpy arrays."""
    for ids in encode_lists(path, items):
        yield np.array(ids, np.uint32)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def counts(path: str, items: list[str]):
    """The number of ids of each text; the ids themselves stay in the library."""
    tk = tokenizer(path)
    for part in grouped(items):
        yield from map(len, tk.encode_batch_fast(part, add_special_tokens=False))


def spans(path: str, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
    """Byte and character spans [n, 2] of the tokens of a text, ends exclusive."""
    lengths = np.array([len(token_bytes(path)[i]) for i in ids], np.int64)
    ends = np.cumsum(lengths)
    at = np.stack([ends - lengths, ends], 1)
    raw = np.frombuffer(text.encode(), np.uint8)
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
    begins = np.concatenate([(raw & 0xC0) != 0x80, [True]])
    first = upto[at[:, 0]] - ~begins[at[:, 0]]
    return at, np.stack([first, upto[at[:, 1]]], 1)


def decode(path: str, ids) -> bytes:
    table = token_bytes(path)
    return b"".join([table[i] for i in ids])


def encode_documents(docs: DataFrame, path: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int> and, with offsets, byte_start, byte_end, char_start, char_end array<int> of each document."""
    path = path or vocabulary_path()
    names = ["doc_id", "ids", *["byte_start", "byte_end", "char_start", "char_end"] * offsets]

    def run(batches):
        for batch in batches:
            ids_of, items = batch.column("doc_id"), batch.column("text").to_pylist()
            for at in range(0, len(items), 256):
                part = items[at : at + 256]
                ids = list(encode(path, part))
                columns = [ids_of.slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))]
                if offsets:
                    both = [spans(path, t, x) for t, x in zip(part, ids, strict=True)]
                    columns += [pa.array([both[r][k][:, e] for r in range(len(part))], pa.list_(pa.int32())) for k in (0, 1) for e in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} array<int>" for n in names[1:])]))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text binary (the bytes) and valid boolean (they are UTF-8) of (doc_id, ids) rows."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            out = [decode(path, x or ()) for x in batch.column("ids").to_pylist()]
            valid = []
            for x in out:
                try:
                    x.decode()
                    valid.append(True)
                except UnicodeDecodeError:
                    valid.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), pa.array(valid)], ["doc_id", "text", "valid"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary, valid boolean")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of each document: encoded, then decoded from the ids."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            trim()
            n, ids_sha, text_sha, n_bytes = [], [], [], []
            for ids in encode_lists(path, batch.column("text").to_pylist()):
                back = decode(path, ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed(ids)).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                n_bytes.append(len(back))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(n_bytes, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


QUERIES = {"op2_byte_bpe": lambda spark, sf_dir: round_trip(table(spark, sf_dir, "documents"))}
ORACLE_SQL: dict[str, str] = {}
