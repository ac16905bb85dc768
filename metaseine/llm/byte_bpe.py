"""BPE encoding and decoding with a byte-level vocabulary, by a pair occurrence index.

The distinct pre-tokens that a batch adds are laid out in one array of symbols. An index maps each adjacent pair with a
merge rank to all its positions; active ranks are applied in ascending order, each to all its positions, and the lists of
the neighbouring pairs get the new positions. Stale positions are told by the symbols that stand there. Pre-tokens
already encoded in the task come from a bounded memo.

Nulls encode as the empty text. The text of the special token becomes its id, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, give_back, slices

#: The published pre-token pattern of this family of vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points on whose class every Unicode version in use agrees; other texts take the library's own splitter.
SETTLED = "\\u0000-\\u0557\\u0600-\\u06ff\\u0900-\\u0977\\u2000-\\u2064\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fcc\\uac00-\\ud7a3\\uff01-\\uff5e"
#: Texts of these code points alone take a splitter with its classes written out, several times as fast.
LATIN = "\u0000-\u024f\u2010-\u2027"
#: Pre-tokens that a task remembers, and symbols that one occurrence index covers.
MEMO, SYMBOLS = 200_000, 500_000
#: Documents that a batch takes at most, and MB of their texts: a worker's memory follows them, and so do the engine's buffers.
ROWS, MB = 512, 8


def byte_symbols() -> dict[int, str]:
    """byte -> printable character of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        back = {c: b for b, c in symbol.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.first = np.array([vocab[symbol[b]] for b in range(256)], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = self.left << 32 | self.right
        self.rank_at = np.argsort(key)
        self.keys = key[self.rank_at]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PRETOKEN).findall
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        latin = {c: "".join(re.escape(chr(i)) for i in range(0x2028) if (i < 0x250 or i >= 0x2010) and regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}
        pattern = PRETOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(latin.values())}]")
        for c, members in latin.items():
            pattern = pattern.replace(c, f"[{members}]")
        self.find_latin = re.compile(pattern.replace(r"\S", f"[^{latin[chr(92) + 's']}]")).findall
        self.not_latin = re.compile(f"[^{LATIN}]").search
        self._library = None
        self.forget()

    def forget(self) -> None:
        self.memo = _Numbers()
        self.flat, self.start, self.length = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pretokens(self, text: str) -> list[str]:
        if not self.not_latin(text):
            return self.find_latin(text)
        if not self.unsettled(text):
            return self.find(text)
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where it has none."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the ``words`` end to end, and how many each has: one pair occurrence index over all of them."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        # all words, each followed by a -1 that no pair crosses
        body = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
        sym = self.first[body]
        sym[np.cumsum(size + 1) - 1] = -1
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size + 1)
        n = len(sym)  # about SYMBOLS, or one pre-token's bytes: positions fit 32 bits
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def post(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> int:
            """Enter the positions of the pairs that have a rank; the lowest rank met."""
            rank = self.ranked(x, y)
            keep = rank >= 0
            if not keep.any():
                return n
            rank, at = rank[keep], at[keep]
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                rank, at = rank[order], at[order]
                edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                lists, heads = np.split(at, edge), rank[np.concatenate(([0], edge))].tolist()
            else:
                lists, heads = [at], rank.tolist()
            for r, where in zip(heads, lists):
                if (found := index.get(r)) is None:
                    index[r] = [where]
                    heapq.heappush(active, r)
                else:
                    found.append(where)
            return heads[0]

        post(sym[:-1], sym[1:], np.arange(n - 1, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = self.left[r], self.right[r], self.made[r]
            end = nxt[at]
            good = (sym[at] == a) & (sym[end] == b)
            at, end = at[good], end[good]
            if a == b and len(at) > 1:  # of overlapping pairs in a run the leftmost go first
                run = np.concatenate(([True], at[1:] != end[:-1]))
                step = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at, end = at[step % 2 == 0], end[step % 2 == 0]
            if not len(at):
                continue
            after = nxt[end]
            sym[at], sym[end] = c, -2
            nxt[at], prv[after] = after, at
            before = prv[at]
            inner = before >= 0
            post(np.concatenate((sym[at], sym[before[inner]])), np.concatenate((sym[after], sym[at[inner]])), np.concatenate((at, before[inner])))
        left = sym >= 0
        return sym[left], np.bincount(word[left], minlength=len(raw))

    def learn(self, new: list) -> None:
        """Put the ids of ``new`` keys of the memo, in its order, at the end of the store."""
        at = 0
        flat, length = [self.flat], [self.length]
        while at < len(new):
            if isinstance(new[at], int):  # a special token stands for itself
                flat.append(np.array([new[at]], np.int32))
                length.append(np.ones(1, np.int64))
                at += 1
                continue
            to, total = at, 0
            while to < len(new) and not isinstance(new[to], int) and total < SYMBOLS:
                total += len(new[to]) + 1
                to += 1
            ids, size = self.merge_all(new[at:to])
            flat.append(ids)
            length.append(size)
            at = to
        self.flat, self.length = np.concatenate(flat), np.concatenate(length)
        self.start = np.cumsum(self.length) - self.length

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; what the memo lacks is merged over the whole batch at once."""
        if len(self.memo) > MEMO:
            self.forget()
        memo, had = self.memo, len(self.memo)
        rows = []
        for text in texts:
            text = text or ""
            found: list[int] = []
            for p in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
                found.extend([memo[self.special[p]]] if p in self.special else map(memo.__getitem__, self.pretokens(p)))
            rows.append(np.array(found, np.int32))
        if len(memo) > had:
            self.learn(list(islice(reversed(memo), len(memo) - had))[::-1])
        out = []
        for row in rows:
            size = self.length[row]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(self.flat[np.repeat(self.start[row], size) + offset])
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of ``documents``; an id for each token of the whole text.

    Null texts give an empty array; null and repeated ids stay as they are, a row for each row.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, ROWS, MB):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
        bpe.forget()
        give_back()

    return bounded(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for every row of ``encoded``; null ids give null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches):
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]): encodes, decodes and digests each whole text in one pass."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, ROWS, MB):
            n, left, right = [], [], []
            encoded = bpe.encode_batch(b.column(1).to_pylist())
            for ids in encoded:
                n.append(len(ids))
                left.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                right.append(hashlib.sha256(bpe.decode(ids.tolist()).encode("utf-8")).hexdigest())
            more = [pa.array(encoded, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string()), *more], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])
        bpe.forget()  # the memo serves one task, for the worker goes on to other stages
        give_back()

    return bounded(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids).withColumnRenamed("id", id_col)
