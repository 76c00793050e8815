"""Deduplication of new batches against all accepted history.

A text is reduced to its own words (lower case, no accents, no ready-made tags, no "more" marker). Windows of
`SHINGLE` words are hashed with the text's key and winnowed: the least hash of every `WINDOW` windows in a row is a
fingerprint, so two texts that share SHINGLE + WINDOW - 1 words in a row share one. A persistent store in a
shared folder holds, for each hash partition and each segment, a Bloom filter, the sorted fingerprints of the first
rows of reviews, and the own words of all rows; a manifest names the segments, so that any later process opens the store and goes on.
A batch is screened with the Bloom filters; positives are looked up by binary search in the blocks of sorted files that may hold them
(memory-mapped where the folder is mounted, read by block elsewhere), so the cost follows the batch, not the history.
Sets of bits rule out candidates that cannot have enough words in common before a pair is written; the others are verified by the share
of words that they have in common in order, where a head of the longer text has enough of them in any order. Rows that repeat no earlier row are accepted into the store. When `FANOUT`
segments of about one size have gathered they are merged, so a fingerprint is sought in few files after any number of batches.

Defined results: null, empty and tag-only texts, and texts with fewer than `MIN_CHARS` characters of own words, are neither kept
nor repeated; null keys form a key of their own; rows with a null batch are the last batch; equal ids must not occur; a null or stand-in name fits any name; a
text repeated any number of times links to its first row; a row that fits a repeated row of another name but not that row's first row
is itself a first row unless another row fits; texts of any length are used whole; an empty batch adds an empty segment;
extra columns are ignored. Tasks write their files under a temporary name and rename them, so a repeated task is harmless; a batch that
failed on its way is not in the manifest and may be added again.
"""

from __future__ import annotations

import io
import json
import math
import os
import re
import shutil
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banyan.session import STAND_INS, shared_dir, shuffles_dropped, stored

SHINGLE, WINDOW, MIN_CHARS = 8, 5, 40
#: Segments of about one size that are merged, and rows of a block of a sorted file.
FANOUT, ROWS = 8, 1 << 15
#: The ready-made tags of the app, and words that mark a copy without telling more.
TAGS = ("gọn gàng sạch", "sẽ đặt lại", "giao nhanh gọn", "hơi nguội", "phần đầy đặn", "hợp túi tiền", "nhạt vị", "gói hàng kỹ", "thiếu món", "ngon tuyệt")
ADDED = ("review", "p/s", "cập nhật", "đã sửa", "nhé mọi người")


_MARKS = re.compile("[\u0300-\u036f]+")


def fold(t: str) -> str:
    """Lower case without accents; as many characters as the composed text."""
    return _MARKS.sub("", unicodedata.normalize("NFD", t.lower())).replace("đ", "d")


def fold_ascii(t: str) -> str:
    """Like fold, without what is not ASCII."""
    return unicodedata.normalize("NFD", t.lower().replace("đ", "d").replace("…", "...")).encode("ascii", "ignore").decode()


def _tree(words: list[str]) -> str:
    """An alternation of words that branches at the first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(x)})" for c, x in by.items())


TAG = re.compile(rf"\b(?:{_tree([fold(x) for x in TAGS])})\b")
_prefixes = tuple(fold(x) + ":" for x in ADDED[:-1])
_suffix = fold(ADDED[-1])
MORE = "xem them"
THOUSANDS = re.compile(r"(?<=\d)[.,](?=\d)")
WORD = re.compile(r"[a-z0-9]+")
_EDGE = " ,.;!\n\r\t"
_NONE = {fold(x) for x in STAND_INS}


def own_words(text: str | None) -> list[str]:
    """The folded own words; none where they have fewer than MIN_CHARS characters."""
    if not text or len(text) < MIN_CHARS:
        return []
    return WORD.findall(THOUSANDS.sub("", _own(TAG.sub("", fold_ascii(text)))))


def _own(t: str) -> str:
    """What is left of a folded text without tags; nothing where that has fewer than MIN_CHARS characters."""
    t = t.strip(_EDGE)
    if len(t) < MIN_CHARS:
        return ""
    if t.endswith(MORE):
        t = t[: -len(MORE)].rstrip()
    if t.endswith("..."):
        cut = t.rstrip(".")
        t = cut if cut[-1:].isspace() else cut.rpartition(" ")[0]  # the word at the cut may be a part
    if _suffix in t:
        t = t.replace(_suffix, " ")
    t = t.lstrip()
    for x in _prefixes:
        if t.startswith(x):
            t = t[len(x) :]
    t = t.strip(_EDGE)
    return t if len(t) >= MIN_CHARS else ""


@cache
def _folded() -> np.ndarray:
    """The ASCII character of each code point by fold_ascii, 255 for none; beyond the first plane no character has one."""
    out = np.full(0x110000, 255, np.uint8)
    for c in range(0x10000):
        if len(f := fold_ascii(chr(c))) == 1:
            out[c] = ord(f)
    return out


_TAGS = [fold(x) for x in TAGS]
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def own_texts(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """(positions, own words with single spaces) of the texts that have own words; own_words of many texts at once."""
    take = [i for i, x in enumerate(texts) if x and len(x) >= MIN_CHARS]
    if not take:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    long = [texts[i].replace("…", "...") for i in take]
    n = np.array([len(x) for x in long], dtype=np.int64)
    c = _folded()[np.frombuffer("".join(long).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum(np.add.reduceat(c != 255, np.cumsum(n) - n, dtype=np.int64))
    flat = c[c != 255].tobytes().decode("ascii")
    tagged = np.zeros(len(long) + 1, bool)
    for x in _TAGS:
        at, hits = flat.find(x), []
        while at >= 0:
            hits.append(at)
            at = flat.find(x, at + 1)
        tagged[np.searchsorted(ends, hits, side="right")] = True
    own, i = [], 0
    for j, tag in zip(ends.tolist(), tagged.tolist()):
        own.append(_own(TAG.sub("", flat[i:j]) if tag else flat[i:j]))
        i = j
    # each text ends in a sign, so that words never run on into the next text
    c = np.frombuffer(("\n".join(own) + "\n").encode(), np.uint8)
    n = np.array([len(x) + 1 for x in own], dtype=np.int64)
    digit, sign = (c >= 48) & (c <= 57), (c == 44) | (c == 46)
    sign[0] = False
    sign[1:-1] &= digit[:-2] & digit[2:]
    word = _IN_WORD[c]
    starts = np.cumsum(n) - n
    n -= np.add.reduceat(sign, starts, dtype=np.int64)
    c, word = c[~sign], word[~sign]
    keep = word.copy()  # the words, and the first sign after each
    keep[1:] |= word[:-1]
    n = np.add.reduceat(keep, np.cumsum(n) - n, dtype=np.int64)
    c = np.where(word, c, 32)[keep]
    some = n > 0
    c = np.delete(c, np.cumsum(n)[some] - 1)
    offsets = np.concatenate([[0], np.cumsum(n[some] - 1)]).astype(np.int32)
    return np.array(take, dtype=np.int64)[some], pa.Array.from_buffers(pa.string(), int(some.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(c.astype(np.uint8).tobytes())])


def folded_name(name: str | None) -> str:
    n = " ".join(fold_ascii(name).split()) if name else ""
    return "" if n in _NONE else n


def names_fit(a: str, b: str) -> bool:
    if not a or not b or a == b:
        return True
    if "*" in a or "*" in b:
        (x, y), (u, v) = ((s.partition("*")[0], s.rpartition("*")[2]) for s in (a, b))
        return (x.startswith(u) or u.startswith(x)) and (y.endswith(v) or v.endswith(y))
    return False


_hashes: dict[str, int] = {}


def _hash(w: str) -> int:
    h = _hashes.get(w)
    if h is None:
        if len(_hashes) > 1_000_000:
            _hashes.clear()
        b = w.encode()
        h = _hashes[w] = (zlib.crc32(b) << 32 | zlib.crc32(b, 0x9E3779B9)) & 0xFFFFFFFFFFFFFFFF
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def fingerprints(words: list[list[str]], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, their number a text): the winnowed fingerprints of texts that have words; all texts are hashed at once."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    if not len(n):
        return np.zeros(0, np.int64), n
    return _prints(np.fromiter((_hash(x) for w in words for x in w), np.uint64, int(n.sum())), n, keys)


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, hash of each code, number of words a text) of texts of words with single spaces."""
    lists = pc.split_pattern(words, " ")
    d = lists.flatten().dictionary_encode()
    return d.indices.to_numpy(), np.fromiter(map(_hash, d.dictionary.to_pylist()), np.uint64, len(d.dictionary)), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _prints(flat: np.ndarray, n: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """fingerprints of the texts with these hashes of words, n a text."""
    if not len(n):
        return np.zeros(0, np.int64), n
    salt = np.fromiter((_hash(k) for k in keys), np.uint64, len(keys))
    # short texts have one window over all their words; others k words a window and the least of WINDOW windows
    starts = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        h = _mix(flat)
        sums = np.zeros(len(flat), np.uint64)
        for i in range(SHINGLE):
            sums[: len(flat) - i] = sums[: len(flat) - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:]
        sums = _mix(sums)
        least = sums.copy()
        for i in range(1, WINDOW):
            least[: len(flat) - i] = np.minimum(least[: len(flat) - i], sums[i:])
        for r in np.flatnonzero(n < SHINGLE + WINDOW - 1):
            a, b = starts[r], starts[r] + n[r]
            if n[r] >= SHINGLE:
                least[a] = sums[a : b - SHINGLE + 1].min()
            else:
                x = np.uint64(0)
                for y in h[a:b]:
                    x = x * np.uint64(0x9E3779B97F4A7C15) + y
                least[a] = _mix(x)
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(flat)) - starts[row]
        take = (offset == 0) | (offset <= n[row] - SHINGLE - WINDOW + 1)
        take[1:] &= (offset[1:] == 0) | (least[1:] != least[:-1])
        return _mix(least[take] ^ salt[row[take]]).view(np.int64), np.bincount(row[take], minlength=len(n))


#: Words of 64 bits in a text's set of word bits.
LANES = 8


def word_bits(words: list[list[str]]) -> np.ndarray:
    """Of each text with words, a set of 64 * LANES bits with the bit of each word: (texts, LANES)."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    if not len(n):
        return np.zeros((0, LANES), np.uint64)
    return _set_bits(_bit(np.fromiter((_hash(x) for w in words for x in w), np.uint64, int(n.sum()))), n)


def _bit(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(hashes) % np.uint64(64 * LANES)).astype(np.int64)


def _set_bits(bit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sets of n bits a text."""
    out = np.zeros((len(n), 64 * LANES), bool)
    out[np.repeat(np.arange(len(n)), n), bit] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def word_sets(words: pa.Array, most: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, number, number of different ones) of the words of each text of words with single spaces, `most` texts at a time."""
    out = [(np.zeros((0, LANES), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(0, len(words), most):
        codes, hashes, n = _coded(words.slice(i, most))
        in_row = np.sort(np.repeat(np.arange(len(n)) << 32, n) | codes)
        again = in_row[1:][in_row[1:] == in_row[:-1]] >> 32
        out.append((_set_bits(_bit(hashes)[codes], n), n, n - np.bincount(again, minlength=len(n))))
    return tuple(np.concatenate(x) for x in zip(*out))


def may_be_same(new: dict[str, np.ndarray], old: dict[str, np.ndarray]) -> np.ndarray:
    """False only where same_account is false: bits that the other text lacks are words of the shorter one that it lacks, at most two fifths."""
    shorter = old["n"] <= new["n"]
    a, b = new["bits"], old["bits"]
    missing = np.bitwise_count(np.where(shorter[:, None], b & ~a, a & ~b)).sum(1, dtype=np.int64)
    return missing <= 0.4 * np.where(shorter, old["u"], new["u"]) + 1e-9


def _may_cover(a: list[str], b: list[str], least: float) -> bool:
    """False only where words of a in order can't cover a and any head of b: a head has no more of them in order than in any order."""
    left, shared = Counter(a), 0
    of = left.get
    for head, x in enumerate(b, 1):
        if n := of(x):
            left[x] = n - 1
            shared += 1
            if 2 * shared >= least * (len(a) + (len(b) if len(b) - head <= 0.1 * len(b) else head)):
                return True
    return False


def same_account(a: list[str], b: list[str], least: float = 0.8) -> bool:
    """True where the words shared in order cover both texts, or the shorter and the head of the longer where one was cut."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    own = set(a)
    if len(own.intersection(b)) < 0.6 * len(own):  # cheap, and implied by what follows
        return False
    if not _may_cover(a, b, least):
        return False
    m = SequenceMatcher(None, a, b, False)
    blocks = m.get_matching_blocks()
    shared = sum(x.size for x in blocks)
    head = max((x.b + x.size for x in blocks if x.size), default=0)
    if len(b) - head <= 0.1 * len(b):
        head = len(b)
    if 2 * shared < least * (len(a) + head) or head < 0.4 * len(b):
        return False
    clashes = 0
    for op, i, j, k, l in m.get_opcodes():
        if op == "replace" and j < len(a) and l < len(b):
            clashes += bool([x for x in a[i:j] if x.rstrip("kd").isdigit()]) and bool([x for x in b[k:l] if x.rstrip("kd").isdigit()])
    return clashes < 2


# --- files of the store ---


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _write(path: str, data: bytes) -> None:
    temp = f"{path}.{uuid.uuid4().hex}"
    if p := _local(path):
        t = _local(temp)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(t, "wb") as f:
            f.write(data)
        os.replace(t, p)
        return
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(p + temp[len(path) :]) as f:
        f.write(data)
    fs.move(p + temp[len(path) :], p)


def _source(path: str):
    if p := _local(path):
        return pa.memory_map(p)
    fs, q = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(q)


def _read(path: str) -> bytes | None:
    try:
        if p := _local(path):
            with open(p, "rb") as f:
                return f.read()
        fs, q = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(q) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _remove(path: str) -> None:
    if p := _local(path):
        shutil.rmtree(p, ignore_errors=True)
        return
    fs, q = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(q).type != pafs.FileType.NotFound:
        fs.delete_dir(q)


def _ipc(t: pa.Table, key: str) -> bytes:
    """A sorted table in blocks, whose first keys are in the schema."""
    sink = io.BytesIO()
    t = t.combine_chunks()
    first = t[key].to_numpy()[::ROWS].astype(np.int64)
    with pa.ipc.new_file(sink, t.schema.with_metadata({"first": first.tobytes()})) as w:
        w.write_table(t, max_chunksize=ROWS)
    return sink.getvalue()


def _values(a: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The values of these rows; fixed bytes as rows of 64-bit words."""
    if pa.types.is_string(a.type):
        return a.take(pa.array(rows)).to_numpy(zero_copy_only=False)
    if not pa.types.is_fixed_size_binary(a.type):
        return a.to_numpy()[rows]
    width = a.type.byte_width // 8
    return np.frombuffer(a.buffers()[1], np.uint64).reshape(-1, width)[a.offset : a.offset + len(a)][rows]


class Sorted:
    """A sorted file, of which only the blocks that are asked for are read; `most` of them are kept."""

    def __init__(self, path: str, key: str, most: int = 64):
        self.reader, self.key, self.most = pa.ipc.open_file(_source(path)), key, most
        self.first = np.frombuffer(self.reader.schema.metadata[b"first"], np.int64)
        self.blocks: dict[int, tuple[np.ndarray, pa.RecordBatch]] = {}

    @classmethod
    def open(cls, path: str, key: str) -> Sorted | None:
        try:
            return cls(path, key)
        except FileNotFoundError:
            return None

    def block(self, i: int) -> tuple[np.ndarray, pa.RecordBatch]:
        if i not in self.blocks:
            if len(self.blocks) >= self.most:
                self.blocks.pop(next(iter(self.blocks)))
            b = self.reader.get_batch(i)
            self.blocks[i] = b.column(self.key).to_numpy(), b
        return self.blocks[i]

    def hits(self, keys: np.ndarray, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
        """(positions in the keys, values of each column) of all rows with one of the keys, block by block."""
        lo, hi = np.maximum(np.searchsorted(self.first, keys) - 1, 0), np.searchsorted(self.first, keys, side="right")
        wide = np.flatnonzero(hi - lo > 1)
        for i in np.unique(np.concatenate([lo[hi > lo], *(np.arange(lo[x], hi[x]) for x in wide)])):
            at = np.flatnonzero((lo <= i) & (i < hi))
            k, b = self.block(int(i))
            q, rows = _ranges(np.searchsorted(k, keys[at]), np.searchsorted(k, keys[at], side="right"))
            if len(q):
                yield at[q], *(_values(b.column(c), rows) for c in columns)

    def table(self) -> pa.Table:
        return self.reader.read_all()


PROBES = 6


def _bits(fp: np.ndarray, size: int) -> np.ndarray:
    u = fp.view(np.uint64)
    with np.errstate(over="ignore"):
        a, b = _mix(u), _mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)[None, :]) % np.uint64(size)).astype(np.int64)


def bloom(fp: np.ndarray) -> np.ndarray:
    size = max(64, 10 * len(fp))
    bits = np.zeros(size, bool)
    bits[_bits(fp, size).ravel()] = True
    return np.packbits(bits)


def bloom_file(fp: np.ndarray) -> bytes:
    return max(64, 10 * len(fp)).to_bytes(8, "little") + bloom(fp).tobytes()


def bloom_has(packed: np.ndarray, size: int, fp: np.ndarray) -> np.ndarray:
    at = _bits(fp, size)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of a partition that is sorted by key."""
    held: list[pa.Table] = []
    at: int | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        k = t[key].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            if at is not None and k[i] != at:
                yield at, pa.concat_tables(held).combine_chunks()
                held = []
            at = int(k[i])
            held.append(t.slice(i, j - i))
    if held:
        yield at, pa.concat_tables(held).combine_chunks()


def _chunks(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of several batches together, of `least` rows or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            yield tuple(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(b.num_columns))
            held = []
    if held:
        yield tuple(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(held[0].num_columns))


def _ranges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the queries and of the hits of [left, right)."""
    n = right - left
    q = np.repeat(np.arange(len(n)), n)
    return q, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)


def _fitting(ids: np.ndarray, who: np.ndarray, cells: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(new, old) of all rows of a posting list, in order, with each earlier row whose name may fit; 0 in who fits any. At most `cells` pairs, or a row's, at once."""
    step = max(1, cells // len(ids))
    for j in range(0, len(ids), step):
        k = min(j + step, len(ids))
        w = who[j:k, None]
        a, b = np.nonzero(((who[None, :k] == w) | (who[None, :k] == 0) | (w == 0)) & (np.arange(k)[None, :] < np.arange(j, k)[:, None]))
        yield ids[j + a], ids[b]


def _docs(folder: str) -> Callable[[str, int], Sorted | None]:
    """Opens the file of a segment and part once."""
    files: dict[tuple[str, int], Sorted | None] = {}

    def opened(s: str, part: int) -> Sorted | None:
        if (s, part) not in files:
            files[s, part] = Sorted.open(f"{folder}/docs/{s}/{part}.arrow", "id")
        return files[s, part]

    return opened


def _doc_bits(opened: Callable[[str, int], Sorted | None], ids: np.ndarray, where: tuple[str, ...], parts: int) -> dict[str, np.ndarray]:
    """The bits, the number and the number of different ones of the words of each id."""
    keys, back = np.unique(ids, return_inverse=True)
    out = {"bits": np.zeros((len(keys), LANES), np.uint64), "n": np.zeros(len(keys), np.int64), "u": np.zeros(len(keys), np.int64)}
    for part in np.unique(keys % parts):
        at = np.flatnonzero(keys % parts == part)
        for s in where:
            f = opened(s, int(part)) if len(at) else None
            for q, *values in f.hits(keys[at], *out) if f else ():
                for c, v in zip(out, values):
                    out[c][at[q]] = v
            at = at[out["n"][at] == 0]
    return {c: v[back] for c, v in out.items()}


def _doc_texts(opened: Callable[[str, int], Sorted | None], keys: np.ndarray, where: tuple[str, ...], parts: int) -> tuple[np.ndarray, ...]:
    """(name, words, key, the place in `where` of its segment) of each of the different ids."""
    out = np.empty(len(keys), object), np.empty(len(keys), object), np.zeros(len(keys), np.int64), np.full(len(keys), -1)
    for part in np.unique(keys % parts):
        at = np.flatnonzero(keys % parts == part)
        for i, s in enumerate(where):
            f = opened(s, int(part)) if len(at) else None
            for q, *values in f.hits(keys[at], "name", "words", "key") if f else ():
                for o, v in zip(out, (*values, i)):
                    o[at[q]] = v
            at = at[out[3][at] < 0]
    if (out[3] < 0).any():
        raise KeyError(int(keys[out[3] < 0][0]))
    return out


def allowed_pairs(opened: Callable[[str, int], Sorted | None], new: np.ndarray, old: np.ndarray, segment: str, everywhere: tuple[str, ...], parts: int, most: int = 1 << 17) -> Iterator[np.ndarray]:
    """The distinct (new, old) of a later and an earlier row whose bits allow that they are the same, `most` pairs at a time; nearly all others are never written."""
    later = new > old
    new, old = new[later], old[later]
    for i in range(0, len(new), most):
        a, b = new[i : i + most], old[i : i + most]
        ok = may_be_same(_doc_bits(opened, a, (segment,), parts), _doc_bits(opened, b, everywhere, parts))
        if ok.any():
            yield np.unique(np.stack([a[ok], b[ok]], 1), axis=0)


#: What the store holds of a text, besides the bits, the number and the number of different ones of its words.
DOC = ("id", "name", "words", "key")


class FingerprintStore:
    """Accepted fingerprints and words in a shared folder, in `parts` hash partitions and segments; see the manifest for what is in it."""

    def __init__(self, folder: str, parts: int = 32, piece: int = 64):
        """Opens the store in the folder, or makes one; `parts` is fixed when it is made. Posting lists longer than `piece` are paired in pieces."""
        self.folder, self.parts, self.piece = folder.rstrip("/"), parts, piece
        self.segments: dict[str, int] = {}  # name -> rows
        self.batches: list[str] = []
        if (have := _read(f"{self.folder}/manifest.json")) is not None:
            m = json.loads(have)
            self.parts, self.segments, self.batches = m["parts"], m["segments"], m["batches"]

    def _commit(self) -> None:
        _write(f"{self.folder}/manifest.json", json.dumps({"parts": self.parts, "segments": self.segments, "batches": self.batches}).encode())

    def compact(self, spark: SparkSession) -> None:
        """Merges segments where FANOUT of about one size have gathered; the files of others are not touched."""
        size = lambda n: int(math.log(n + 1, FANOUT))
        levels: dict[int, list[str]] = {}
        for s, n in self.segments.items():
            levels.setdefault(size(n), []).append(s)
        for old in levels.values():
            if len(old) < FANOUT:
                continue
            folder, parts, name = self.folder, self.parts, f"merged-{uuid.uuid4().hex}"

            def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for part in b.column("id").to_pylist():
                        for kind, key in (("docs", "id"), ("prints", "fp")):
                            files = [x for s in old if (x := Sorted.open(f"{folder}/{kind}/{s}/{part}.arrow", key))]
                            if not files:
                                continue
                            t = pa.concat_tables([x.table().replace_schema_metadata(None) for x in files])
                            t = t.take(pa.array(np.argsort(t[key].to_numpy(), kind="stable")))
                            _write(f"{folder}/{kind}/{name}/{part}.arrow", _ipc(t, key))
                            if kind == "prints":
                                _write(f"{folder}/prints/{name}/{part}.bloom", bloom_file(t["fp"].to_numpy()))
                        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

            spark.range(parts).repartition(parts).mapInArrow(merge, "n bigint").agg(F.sum("n")).collect()
            self.segments = {s: n for s, n in self.segments.items() if s not in old} | {name: sum(self.segments[s] for s in old)}
            self._commit()
            for s in old:
                _remove(f"{folder}/docs/{s}")
                _remove(f"{folder}/prints/{s}")

    def sketch(self, df: DataFrame, row: str, key: str, name: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
        """(id, name, words, prints, store key's hash, *extra) of each row whose own words are long enough."""
        types = dict(df.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                take, words = own_texts(b.column("__text").to_pylist())
                s = b.take(pa.array(take))
                codes, hashes, n = _coded(words)
                flat, sizes = _prints(hashes[codes], n, [x or "" for x in s.column("__key").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cols = [s.column("id"), pa.array([folded_name(x) for x in s.column("__name").to_pylist()], pa.string()), words, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), s.column("key")]
                yield pa.RecordBatch.from_arrays(cols + [s.column(c) for c in extra], ["id", "name", "words", "prints", "key", *extra])

        src = df.select(F.col(row).cast("bigint").alias("id"), F.col(key).cast("string").alias("__key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key"), F.col(name).alias("__name"), F.col(text).alias("__text"), *extra)
        return src.mapInArrow(run, ", ".join(["id bigint, name string, words string, prints array<bigint>, key bigint", *(f"{c} {types[c]}" for c in extra)]))

    def add(self, sketch: DataFrame, segment: str) -> DataFrame:
        """(new, root) of the rows of a batch that repeat an earlier one of history or of the batch; the batch is then part of the store.

        root is the first row of the review.
        """
        spark = sketch.sparkSession
        folder, parts, old_segments, piece = self.folder, self.parts, tuple(self.segments), self.piece
        docs = sketch.select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), *DOC)

        def write_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, t in _groups(batches, "part"):
                t = t.take(pa.array(np.argsort(t["id"].to_numpy()))).combine_chunks()
                bits, n, u = word_sets(t["words"].combine_chunks())
                t = t.select(list(DOC)).append_column("bits", pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * LANES), len(n), [None, pa.py_buffer(bits.tobytes())]))
                t = t.append_column("n", pa.array(n)).append_column("u", pa.array(u))
                _write(f"{folder}/docs/{segment}/{part}.arrow", _ipc(t, "id"))
                yield pa.RecordBatch.from_pydict({"n": pa.array([t.num_rows], pa.int64())})

        tasks = min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        with shuffles_dropped(spark):
            count = docs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(write_docs, "n bigint").agg(F.sum("n")).first()[0]

        # equal texts of one name link to the first of them by aggregation, so that a group of copies of any size sends one row on
        ids = sketch.select("id", "name", F.xxhash64("prints", "words").alias("h"))
        groups = ids.groupBy("h", "name").agg(F.min("id").alias("old"), F.count("*").alias("n")).filter("n > 1")
        copies = ids.join(groups, ["h", "name"]).filter("id <> old").select(F.col("id").alias("new"), "old")
        copies = stored(copies, f"copies-{segment}")
        firsts = sketch.select("id", "name", "prints").join(copies.select(F.col("new").alias("id")), "id", "left_anti")
        who = F.when((F.col("name") == "") | F.col("name").contains("*"), 0).otherwise(F.hash("name"))
        prints = firsts.select("id", who.alias("who"), F.explode("prints").alias("fp")).withColumn("part", F.pmod("fp", F.lit(parts)).cast("int"))

        everywhere = (segment, *reversed(old_segments))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = _docs(folder)

            def hits(new: list[np.ndarray], old: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
                for pair in allowed_pairs(opened, np.concatenate(new), np.concatenate(old), segment, everywhere, parts) if new else ():
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["new", "old"])

            for part, t in _groups(batches, "part"):
                order = np.lexsort((t["id"].to_numpy(), t["fp"].to_numpy()))
                fp, ids, who = (t[c].to_numpy()[order] for c in ("fp", "id", "who"))
                _write(f"{folder}/prints/{segment}/{part}.arrow", _ipc(pa.table({"fp": fp, "id": ids}), "fp"))  # accept takes out the rows that repeat others
                new, old = [], []
                starts = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                sizes = np.diff(np.concatenate([starts, [len(fp)]]))
                small = np.repeat(sizes, sizes) <= piece
                for d in range(1, min(piece, int(sizes.max()))):  # within the batch: ids of a fingerprint are in order
                    ok = np.flatnonzero((fp[d:] == fp[:-d]) & small[d:])
                    new.append(ids[d:][ok])
                    old.append(ids[:-d][ok])
                for i in np.flatnonzero(sizes > piece):  # of a frequent fingerprint only the pairs that a name allows, in pieces
                    at = slice(starts[i], starts[i] + sizes[i])
                    for a, b in _fitting(ids[at], who[at]):
                        new.append(a)
                        old.append(b)
                        if sum(map(len, new)) >= 1 << 20:
                            yield from hits(new, old)
                            new, old = [], []
                for s in old_segments:
                    filt = _read(f"{folder}/prints/{s}/{part}.bloom")
                    if filt is None:
                        continue
                    hit = np.flatnonzero(bloom_has(np.frombuffer(filt, np.uint8, offset=8), int.from_bytes(filt[:8], "little"), fp))
                    if len(hit):
                        for q, at in Sorted.open(f"{folder}/prints/{s}/{part}.arrow", "fp").hits(fp[hit], "id"):
                            new.append(ids[hit[q]])
                            old.append(at)
                yield from hits(new, old)

        _remove(f"{folder}/prints/{segment}")  # what a failed attempt left
        by_print = prints.repartition(tasks, "part").sortWithinPartitions("part")  # one whole number is sorted faster than three columns
        pairs = by_print.mapInArrow(look_up, "new bigint, old bigint").distinct()

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = _docs(folder)

            done = last = None
            for a, o in _chunks(batches):
                keys, at = np.unique(np.concatenate([a, o]), return_inverse=True)
                names, words, ks, place = (x.tolist() for x in _doc_texts(opened, keys, everywhere, parts))
                out: list[tuple[int, int, int, str, str]] = []
                for new, old, i, j in zip(a.tolist(), o.tolist(), at[: len(a)].tolist(), at[len(a) :].tolist()):
                    if new == done:
                        continue
                    n, m = names[i], names[j]
                    if not names_fit(n, m):
                        continue
                    if last != new:
                        last, w = new, words[i].split(" ")
                    if same_account(words[j].split(" "), w):
                        out.append((ks[i], new, old, n, m))
                        if not n or n == m or place[j]:  # whatever old turns out to repeat then fits new; else the next ones are tried too
                            done = new
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["key", "new", "old", "new_name", "old_name"])

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each row's first candidate whose own first row fits it by name; rows without one are first rows. A key's rows come in order."""
            at, first = None, {}
            for b in batches:
                out: list[tuple[int, int]] = []
                for key, new, old, n, m in zip(*(c.to_pylist() for c in b.columns)):
                    if key != at:
                        at, first = key, {}
                    if new in first:
                        continue
                    root, name = first.get(old, (old, m))
                    if names_fit(n, name):
                        first[new] = (root, name)
                        out.append((new, root))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["new", "root"])

        fits = pairs.repartition(tasks, "new").sortWithinPartitions("new", "old").mapInArrow(verify, "key bigint, new bigint, old bigint, new_name string, old_name string")
        links = fits.repartition(tasks, "key").sortWithinPartitions("key", "new", "old").mapInArrow(resolve, "new bigint, root bigint")
        links = stored(links, f"links-{segment}")

        def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, gone in _groups(batches, "part"):
                f = Sorted.open(f"{folder}/prints/{segment}/{part}.arrow", "fp")
                if f is None:
                    continue
                t = f.table()
                gone = gone["id"].drop_null().to_numpy()
                if len(gone):
                    t = t.filter(pa.array(~np.isin(t["id"].to_numpy(), gone)))
                    _write(f"{folder}/prints/{segment}/{part}.arrow", _ipc(t, "fp"))
                _write(f"{folder}/prints/{segment}/{part}.bloom", bloom_file(t["fp"].to_numpy()))
                yield pa.RecordBatch.from_pydict({"n": pa.array([t.num_rows], pa.int64())})

        # the files have the fingerprints of all rows: only those of rows that repeat others are sent, and a row without id for each part
        gone = sketch.select("id", "prints").join(links.select(F.col("new").alias("id")), "id", "left_semi")
        gone = gone.select(F.explode("prints").alias("fp"), "id").select(F.pmod("fp", F.lit(parts)).cast("int").alias("part"), "id")
        gone = gone.unionByName(spark.range(0, parts, 1, 1).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("bigint").alias("id")))
        with shuffles_dropped(spark):
            gone.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(accept, "n bigint").agg(F.sum("n")).collect()
        self.segments[segment] = count or 0
        self.batches.append(segment)
        self._commit()
        self.compact(spark)
        # a copy has the name of the first of its copies, so it fits that row's first row as well
        return links.unionByName(copies.join(links.select(F.col("new").alias("old"), "root"), "old", "left").select("new", F.coalesce("root", "old").alias("root")))


def repeated_rows(df: DataFrame, row: str, batch: str, key: str, name: str, text: str, parts: int | None = None, folder: str | None = None) -> DataFrame:
    """(kept_id, dup_id) over the batches of df, taken one after the other in the order of `batch`.

    `folder` holds the store; batches that are in it already are left out. Without it the store is made anew.
    `parts` is fixed for the life of a store; by default a part gets about 200,000 texts.
    """
    spark = df.sparkSession
    store = FingerprintStore(folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}", parts or 32)
    label = F.coalesce(F.concat(F.lit("batch-"), F.col(batch).cast("string")), F.lit("batch-none"))
    numbers = sorted((r[0] for r in df.select(batch).distinct().collect()), key=lambda x: (x is None, x))  # one value a batch
    numbers = [n for n in numbers if f"batch-{'none' if n is None else n}" not in store.batches]
    sketch = stored(store.sketch(df.withColumn("__batch", label), row, key, name, text, ("__batch",)), "sketch", ["__batch"])
    if parts is None and not store.batches:
        store.parts = max(32, -(-sketch.count() // 200_000))
    links = None
    for n in numbers:
        label = f"batch-{'none' if n is None else n}"
        out = store.add(sketch.filter(F.col("__batch") == label), label)
        links = out if links is None else links.unionByName(out)
    if links is None:
        return spark.createDataFrame([], "kept_id bigint, dup_id bigint")
    return links.select(F.col("root").alias("kept_id"), F.col("new").alias("dup_id"))
