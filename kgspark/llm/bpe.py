"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is split into words and each distinct word is held once.
An inverted index maps every token pair, by its rank, to the positions where
it stands in those words.  The ranks are then replayed in order: a merge takes
all its positions at once, and only the pairs left and right of a merged
position enter the index anew.  A merge can only create pairs of later rank,
so one pass over the ranks encodes the block.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import map_blocks, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text of one replayed block, in bytes.
REPLAY_BYTES = 10 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class MergeReplay:
    """Encoder for one vocabulary of ranked tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token_bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(values, np.int32)[order]
        self.pair_key_end = np.append(self.pair_key, np.int64(-1))
        a, b = np.meshgrid(self.byte_id, self.byte_id, indexing="ij")
        self.first = self.rank_of(a.ravel(), b.ravel())

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge takes it."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key_end[at] == key, self.pair_rank[np.minimum(at, len(self.pair_rank) - 1)], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word starts (with the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.zeros(len(words) + 1, np.int64)
        np.cumsum(sizes, out=start[1:])
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), start
        token = self.byte_id[raw]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        full = sizes > 0
        after[start[1:][full] - 1] = n
        before[start[:-1][full]] = -1
        pair = np.full(n + 1, -1, np.int32)  # rank of the pair that starts here
        inner = np.flatnonzero(after < n)
        pair[inner] = self.first[raw[inner].astype(np.int32) * 256 + raw[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}
        self._post(index, inner.astype(np.int32), pair[inner])
        alive = np.ones(n, bool)
        for rank in range(self.size):
            posted = index.pop(rank, None)
            if posted is None:
                continue
            at = posted[0] if len(posted) == 1 else np.unique(np.concatenate(posted))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if (pair[right] == rank).any():
                at = self._leftmost(at, right, pair, rank)
                right = after[at]
            beyond = after[right]
            token[at] = rank
            alive[right] = False
            pair[right] = -1
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            pair[at[~inside]] = -1
            left = before[at]
            touched = np.concatenate([left[left >= 0], at[inside]])
            if len(touched):
                ranks = self.rank_of(token[touched], token[after[touched]])
                pair[touched] = ranks
                self._post(index, touched, ranks)
        count = np.zeros(len(words) + 1, np.int64)
        np.cumsum(alive, out=(total := np.zeros(n + 1, np.int64))[1:])
        count[:] = total[start]
        return token[alive], count

    @staticmethod
    def _post(index: dict[int, list[np.ndarray]], at: np.ndarray, ranks: np.ndarray) -> None:
        known = ranks >= 0
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *edges.tolist(), len(at)]
        for a, b in zip(bounds, bounds[1:]):
            index.setdefault(int(ranks[a]), []).append(at[a:b])

    @staticmethod
    def _leftmost(at: np.ndarray, right: np.ndarray, pair: np.ndarray, rank: int) -> np.ndarray:
        """Of overlapping pairs (a run of one token) every second one, from the left."""
        taken, blocked = [], -1
        for p, q in sorted(zip(at.tolist(), right.tolist())):
            if p != blocked:
                taken.append(p)
                blocked = q
        return np.array(taken, at.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@functools.cache
def replayer(path: str) -> MergeReplay:
    return MergeReplay(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token ids of each text: (id, token_ids array<int>).

    Texts are split by the public pattern and no special tokens are made.  A
    null or empty text has no ids.  Ids of rows (null and repeated ones too)
    pass through; each input row gives one row.
    """
    path = path or tokenizer_path(VOCABULARY)

    def step(block: pa.RecordBatch) -> dict[str, list]:
        ids = encode_block(block.column(1).to_pylist(), replayer(path))
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        flat = pa.py_buffer(b"".join(ids))
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, flat])
        return {"id": block.column(0), "token_ids": pa.ListArray.from_arrays(pa.array(offsets), values)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_blocks(df.select(id_col, text_col), step, f"id {kind}, token_ids array<int>", limit=REPLAY_BYTES).withColumnRenamed("id", id_col)


def encode_block(texts: list[str | None], coder) -> list[bytes]:
    """The little-endian 32-bit ids of each text; ``coder`` encodes the distinct words."""
    lexicon = pretokens.Lexicon()
    numbered = lexicon.numbers(texts)
    flat, start = coder.encode_words([w.encode() for w in lexicon.number])
    raw, at = flat.astype("<u4").tobytes(), (start * 4).tolist()
    word = [raw[a:b] for a, b in zip(at, at[1:])]
    return [b"".join([word[k] for k in doc.tolist()]) for doc in numbered]


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """Bytes that each list of token ids stands for: (id, decoded binary); null lists give no bytes."""
    path = path or tokenizer_path(VOCABULARY)

    def step(block: pa.RecordBatch) -> dict[str, list]:
        coder = replayer(path)
        lists = block.column(1)
        out = []
        for k in range(len(lists)):
            value = lists[k].values
            out.append(coder.decode(value.to_numpy(zero_copy_only=False)) if value is not None else b"")
        return {"id": block.column(0), "decoded": out}

    kind = df.schema[id_col].dataType.simpleString()
    sized = df.select(id_col, ids_col)
    arrow = f"id {kind}, decoded binary"
    return _map_lists(sized, step, arrow).withColumnRenamed("id", id_col)


def _map_lists(df: DataFrame, step, schema: str) -> DataFrame:
    from .common import _arrow_schema

    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                columns = step(batch.slice(k, 512))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def op7_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path(VOCABULARY)
    return digests(encode(docs, path=path), path)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""

    def step(block: pa.RecordBatch) -> dict[str, list]:
        coder = replayer(path)
        names = decimal_names(path)
        counts, listed, back = [], [], []
        lists = block.column(1)
        for k in range(len(lists)):
            ids = lists[k].values.to_numpy(zero_copy_only=False).tolist() if lists[k].values is not None else []
            counts.append(len(ids))
            listed.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            back.append(hashlib.sha256(b"".join([coder.token_bytes[i] for i in ids])).hexdigest())
        return {"doc_id": block.column(0), "n_tokens": counts, "ids_sha256": listed, "decoded_sha256": back}

    return _map_lists(encoded.select("doc_id", F.col("token_ids")), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@functools.cache
def decimal_names(path: str) -> list[str]:
    return [str(i) for i in range(replayer(path).size)]
