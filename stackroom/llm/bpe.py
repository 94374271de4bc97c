"""Byte-pair encoding and decoding with a public vocabulary; long unsplit text by tree concatenation.

Text is cut where every vocabulary of this kind cuts, before a single space between two
other characters, and each distinct piece of a batch is encoded once. A pre-token beyond
``LEAF`` has no such cut: its halves are encoded apart and in parallel, by threads (the library
works outside the interpreter's lock), and around each join a window is encoded anew and
grown until both sides agree exactly; the joins of a level run in parallel as well.

Agreement is exact because a token sequence is the encoding of its text when each
neighbouring pair is the encoding of its own text; the window's two seams are tested so.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.common import bounded_batches

#: Longest pre-token, in bytes, that is encoded whole.
LEAF = 2048
#: Threads that encode the halves of one long pre-token; others of a text wait, so more aren't needed.
THREADS = 4
#: Characters of pieces that a worker remembers; beyond it the memory starts afresh.
CACHE_CHARS = 4_000_000
#: Distinct pieces encoded by one call.
RUN = 1024
#: Bytes of text encoded at once: bounds a worker's memory whatever the size of Arrow's batches.
BATCH_CHARS = 2_000_000

FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; every node has the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Cut before single spaces between two characters that aren't white space; joined they give ``text``."""
    parts = text.split(" ")
    out = [parts[0]]
    for a, b in zip(parts, parts[1:]):
        if a and b and not a[-1].isspace() and not b[0].isspace():
            out.append(" " + b)
        else:
            out[-1] += " " + b
    return out


class TreeEncoder:
    """``encode`` gives ids as little-endian unsigned 32-bit bytes."""

    pieces = staticmethod(pieces)

    def __init__(self, path: str, leaf: int = LEAF):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.leaf = leaf
        self.bare = Tokenizer(self.tok.model)  # takes text that is already mapped to the vocabulary's byte letters
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _leaf(self, mapped: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(mapped, add_special_tokens=False)]

    def _fits(self, a: int, b: int) -> bool:
        name = self.tok.id_to_token
        return self._leaf([name(a) + name(b)])[0] == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined text from the encodings of its two parts."""
        if not left or not right:
            return left + right
        name = self.tok.id_to_token
        a, b = min(4, len(left)), min(4, len(right))
        while True:
            window = self._leaf(["".join(map(name, left[len(left) - a :] + right[:b]))])[0]
            whole_a, whole_b = a == len(left), b == len(right)
            ok_a = whole_a or window[0] == left[-a] and self._fits(left[-a - 1], window[0])
            ok_b = whole_b or window[-1] == right[b - 1] and self._fits(window[-1], right[b])
            if ok_a and ok_b:
                return left[: len(left) - a] + window + right[b:]
            if not ok_a:
                a = min(2 * a, len(left))
            if not ok_b:
                b = min(2 * b, len(right))

    def tree(self, mapped: str) -> list[int]:
        """Encode one long pre-token: halves down to leaves, then joins upward."""
        parts = [mapped]
        while len(parts[0]) > self.leaf:
            parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
        with ThreadPoolExecutor(THREADS) as threads:
            each = -(-len(parts) // THREADS)
            runs = threads.map(self._leaf, [parts[i : i + each] for i in range(0, len(parts), each)])
            level = [ids for run in runs for ids in run]
            while len(level) > 1:
                level = list(threads.map(self._joined, [level[i : i + 2] for i in range(0, len(level), 2)]))
        return level[0]

    def _joined(self, some: list[list[int]]) -> list[int]:
        return self.join(*some) if len(some) == 2 else some[0]

    def _long(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                ids.append(self.tok.token_to_id(part))
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    ids += self._leaf([mapped])[0] if len(mapped) <= self.leaf else self.tree(mapped)
        return ids

    def _learn(self, wanted: set[str]) -> None:
        odd = [p for p in wanted if len(p) > self.leaf or self.cut and self.cut.search(p)]
        for p in odd:
            self.known[p] = np.array(self._long(p), "<u4").tobytes()
        plain = list(wanted.difference(odd))
        if not self.special:  # nothing to stand between pieces
            for p, e in zip(plain, self.tok.encode_batch_fast(plain, add_special_tokens=False)):
                self.known[p] = np.array(e.ids, "<u4").tobytes()
            plain = []
        for i in range(0, len(plain), RUN):
            # A special token stands between the pieces of a run: it cuts like the ends of a text.
            some = plain[i : i + RUN]
            ids = np.array(self.tok.encode(self.special[0].join(some), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(ids == self.tok.token_to_id(self.special[0]))
            for p, lo, hi in zip(some, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]):
                self.known[p] = ids[lo:hi].tobytes()
        self.chars += sum(map(len, wanted))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        cut = [self.pieces(t) for t in texts]
        if new := set().union(*cut).difference(self.known):
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        return self.tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


class WholeEncoder(TreeEncoder):
    """For vocabularies whose cuts aren't known here: the library encodes each text whole."""

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def text_slices(column: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[slice, list[str]]]:
    """Runs of a text column of about ``most`` bytes (a longer text is a run of its own), nulls as empty texts.

    Only one run at a time is turned into Python strings, whatever the size of Arrow's batch.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield slice(start, stop), [t or "" for t in column[start:stop].to_pylist()]
        start = stop


#: This worker's encoders: loaded once, shared by its tasks.
ENCODERS: dict[tuple, TreeEncoder] = {}


def encoder(path: str, leaf: int = LEAF, kind: type[TreeEncoder] | None = None) -> TreeEncoder:
    key = (kind, path, leaf)
    if key not in ENCODERS:
        ENCODERS[key] = kind(path) if kind else TreeEncoder(path, leaf)
    return ENCODERS[key]


def release_encoders() -> None:
    """Free vocabularies and remembered pieces, which a worker keeps between tasks, before other work."""
    ENCODERS.clear()


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids array<int>`` for every row; null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, texts in text_slices(b.column(1)):
                ids = [np.frombuffer(x, "<u4").astype("i4") for x in encoder(path, leaf).encode(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; special tokens appear as their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [encoder(path).tok.decode(x or [], skip_special_tokens=False) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, encoded and decoded in one pass.

    Null text counts as empty, which has no ids; repeated rows repeat; a text of any length is
    encoded whole; an empty table gives an empty result; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in text_slices(b.column(1)):
                for ids in enc.encode(texts):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FIELDS)
