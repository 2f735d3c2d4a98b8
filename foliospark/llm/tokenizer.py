"""Problem 6: every text as ids of a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern into pieces; each piece is merged on its own. The pair
ranks of a piece lie in a segment tree over its byte positions whose nodes keep the leftmost
minimum, so the root names the next merge and one merge costs three point updates of
logarithmic length (the merged position, its live left neighbour, the position that died).

Two forms of the same tree are used: ``merge_many`` runs thousands of short pieces at once, one
tree per row of a matrix; ``merge_one`` runs one long piece. Which one runs depends on the piece,
never on the size of the data, and both give the same ids.

Defined cases: a null or empty text gives an empty list; blanks, lone surrogates (as U+FFFD) and
runs of any length are encoded whole; special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Where the public vocabulary files lie; a parameter of every function here.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pre-tokenisation pattern published with these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per worker. A full memory is emptied; no piece is left out.
REMEMBERED = 1 << 18
#: A group of fewer pieces than this, or of longer ones, is merged piece by piece.
FEW_PIECES, LONG_PIECE = 24, 512
_SHIFT = 20
_NONE = np.int64(1) << 60


@dataclass(frozen=True)
class Vocabulary:
    """The merge table: sorted pair keys ``left << 17 | right`` and the id each pair becomes.

    Its size is that of the vocabulary file (about 50,000 tokens), whatever the corpus.
    """

    keys: np.ndarray
    made: np.ndarray
    bytes_to_id: np.ndarray
    whole: dict[bytes, int]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str = VOCABULARY, directory: str = VOCABULARY_DIR) -> Vocabulary:
    """Read a rank file and derive every mergeable pair from it."""
    path = str(Path(directory) / f"{name}.tiktoken")
    if path in _loaded:
        return _loaded[path]
    whole = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            whole[base64.b64decode(token)] = int(rank)
    keys, made = [], []
    for token, rank in whole.items():
        for cut in range(1, len(token)):
            left, right = whole.get(token[:cut]), whole.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 17 | right)
                made.append(rank)
    order = np.argsort(np.array(keys, dtype=np.int64))
    _loaded[path] = Vocabulary(
        np.array(keys, dtype=np.int64)[order],
        np.array(made, dtype=np.int64)[order],
        np.array([whole[bytes([b])] for b in range(256)], dtype=np.int64),
        whole,
    )
    return _loaded[path]


class Merger:
    """Encodes pieces with one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._pairs: dict[int, int] | None = None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 17) | right
        at = np.searchsorted(self.vocab.keys, key)
        at[at == len(self.vocab.keys)] = 0
        return np.where(self.vocab.keys[at] == key, self.vocab.made[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as packed 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        whole = self.vocab.whole
        for i, piece in enumerate(pieces):
            known = whole.get(piece)
            if known is not None:  # a token of the vocabulary merges into itself
                out[i] = known.to_bytes(4, "little")
            elif piece:
                groups.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            if width > LONG_PIECE or len(members) < FEW_PIECES:
                for i in members:
                    out[i] = np.array(self.merge_one(pieces[i]), dtype="<i4").tobytes()
            else:
                for start in range(0, len(members), 4096):
                    part = members[start : start + 4096]
                    for i, ids in zip(part, self.merge_many([pieces[j] for j in part], width)):
                        out[i] = ids
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece, with a tree kept in a list: node k is the smaller of nodes 2k and 2k+1."""
        if self._pairs is None:
            self._pairs = dict(zip(self.vocab.keys.tolist(), self.vocab.made.tolist()))
        pairs, first = self._pairs, self.vocab.bytes_to_id
        ids = first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        width = max(2, 1 << (n - 1).bit_length())
        none = 1 << 60
        shift = max(_SHIFT, width.bit_length())  # the position of any byte fits below the rank
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 17 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while tree[1] != none:
            i = tree[1] & ((1 << shift) - 1)
            ids[i] = tree[1] >> shift
            gone = after[i]
            right = after[i] = after[gone]
            ids[gone] = -1
            update(gone, none)
            if right < n:
                before[right] = i
                rank = pairs.get(ids[i] << 17 | ids[right])
                update(i, none if rank is None else rank << shift | i)
            else:
                update(i, none)
            left = before[i]
            if left >= 0:
                rank = pairs.get(ids[left] << 17 | ids[i])
                update(left, none if rank is None else rank << shift | left)
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most ``width`` bytes, a tree per row; every round merges once in each row."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(count, width)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.vocab.bytes_to_id[raw], -1)
        after = np.broadcast_to(columns + 1, (count, width)).copy()
        before = np.broadcast_to(columns - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), _NONE)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        live = (ranks >= 0) & (ids[:, 1:] >= 0)
        tree[:, width : 2 * width - 1] = np.where(live, (ranks << _SHIFT) | columns[:-1], _NONE)
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        flat, flat_ids, flat_after, flat_before = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.nonzero(tree[:, 1] != _NONE)[0]
        last = lengths

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base = row * (2 * width)
            node = at + width
            flat[base + node] = value
            node = node >> 1
            while node[0]:
                down = base + 2 * node
                flat[base + node] = np.minimum(flat[down], flat[down + 1])
                node = node >> 1

        while len(rows):
            root = flat[rows * (2 * width) + 1]
            at = root & ((1 << _SHIFT) - 1)
            base = rows * width
            made = root >> _SHIFT
            flat_ids[base + at] = made
            gone = flat_after[base + at]
            right = flat_after[base + gone]
            flat_after[base + at] = right
            flat_ids[base + gone] = -1
            update(rows, gone, np.full(len(rows), _NONE))
            inside = right < last[rows]
            there = np.where(inside, right, at)
            flat_before[(base + there)[inside]] = at[inside]
            rank = self._ranks(made, flat_ids[base + there])
            update(rows, at, np.where(inside & (rank >= 0), (rank << _SHIFT) | at, _NONE))
            left = flat_before[base + at]
            has = left >= 0
            if has.any():
                row, at_left = rows[has], left[has]
                rank = self._ranks(flat_ids[row * width + at_left], made[has])
                update(row, at_left, np.where(rank >= 0, (rank << _SHIFT) | at_left, _NONE))
            rows = rows[flat[rows * (2 * width) + 1] != _NONE]
        kept = ids >= 0
        packed = ids[kept].astype("<i4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Texts to ids, remembering the pieces seen in this worker."""

    def __init__(self, vocab: Vocabulary):
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.merger = Merger(vocab)
        self.memory: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null or empty text gives no bytes."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        unseen = list({p for pieces in cut for p in pieces if p not in memory})
        memory.update(zip(unseen, self.merger.encode([p.encode("utf-8", "replace") for p in unseen])))
        look = memory.__getitem__
        return [b"".join(map(look, pieces)) for pieces in cut]


def _arrow_encode(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, bytes]:
    packed = encoder.encode(texts.to_pylist())
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    return offsets, b"".join(packed)


def encode_ids(
    df: DataFrame, text: str, keep: list[str], out: str = "ids", name: str = VOCABULARY, directory: str = VOCABULARY_DIR, counts_only: bool = False
) -> DataFrame:
    """``keep`` and the ids of ``text`` (or, with ``counts_only``, how many ids it has).

    One narrow pass: no shuffle, no row dropped. ``keep`` may not contain ``out``.
    """
    if out in keep:
        raise ValueError(f"column {out} would occur twice")
    source = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    kind = IntegerType() if counts_only else ArrayType(IntegerType(), containsNull=False)
    schema = StructType([*source.schema.fields[:-1], StructField(out, kind, False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(name, directory))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                offsets, packed = _arrow_encode(part.column(part.num_columns - 1), encoder)
                if counts_only:
                    made = pa.array(np.diff(offsets), type=pa.int32())
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(packed, dtype="<i4")))
                columns = [*part.columns[:-1], made]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return source.mapInArrow(run, schema)
