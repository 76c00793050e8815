"""Encoding of a corpus with a public tokenizer, with character offsets, and decoding back to bytes and text.

A byte-level tokenizer works on a table from bytes to printable characters. `encode` runs the tokenizers library over Arrow batches.
The offsets it gives are those of characters; where a character is split over several tokens, each of them has that character's span.
`decode` maps the tokens' characters back to bytes through the reversed table and reads the bytes of all tokens together, so
split characters come out whole; bytes that make no character (a cut list of ids) become U+FFFD.

Defined results: the ids of null, and of the empty text, are the empty list; strings of special tokens in a text are ordinary text
and no special token is added; blank, very long and repeated texts are encoded whole; an empty table gives no rows. The path of
the tokenizer file is a parameter. Other columns stay out of the result unless they are named in `keep`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("PUBLIC_TOKENIZERS", DEFAULT_FOLDER), name)


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def byte_table() -> dict[int, str]:
    """The printable character of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encode(df: DataFrame, text: str, path: str, keep: tuple[str, ...] = (), offsets: bool = False, out: str = "ids", chunk: int = 64) -> DataFrame:
    """The columns `keep`, the ids of each text and, if asked for, the offsets: array<struct<start, end>> in characters."""
    types = dict(df.dtypes)
    fields = [f"`{c}` {types[c]}" for c in keep] + [f"`{out}` array<int>"] + (["offsets array<struct<start:int,end:int>>"] if offsets else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, chunk):  # few texts at once, as one may be very long
                s = b.slice(at, chunk)
                enc = t.encode_batch([x or "" for x in s.column("__text").to_pylist()], add_special_tokens=False)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(e.ids) for e in enc])]).astype(np.int32))
                cols = [s.column(c) for c in keep] + [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(e.ids, np.int32) for e in enc]), pa.int32()))]
                names = [*keep, out]
                if offsets:
                    flat = np.concatenate([np.asarray(e.offsets, np.int32).reshape(-1, 2) for e in enc])
                    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "end"])
                    cols.append(pa.ListArray.from_arrays(ends, pairs))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join(fields))


def decode(ids: Column, path: str) -> Column:
    """The text of a list of ids; null ids give null."""

    @F.pandas_udf("string")
    def run(s):
        import pandas as pd

        return pd.Series([None if x is None else decode_ids(x, path) for x in s])

    return run(ids)


_vocabularies: dict[str, list[bytes]] = {}


def _token_bytes(path: str) -> list[bytes]:
    if path not in _vocabularies:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_table().items()}
        names = spec["model"]["vocab"] | {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        out = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            out[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        _vocabularies[path] = out
    return _vocabularies[path]


def decode_ids(ids, path: str) -> str:
    table = _token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def count_tokens(df: DataFrame, text: str, path: str, keep: tuple[str, ...], out: str = "tokens") -> DataFrame:
    """The columns `keep` and the number of tokens of each text."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            n = [len(e.ids) for at in range(0, b.num_rows, 64) for e in t.encode_batch([x or "" for x in b.column("__text").slice(at, 64).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64())], [*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` bigint"]))
