"""Token packing by reciprocal-capacity classes (harmonic packing).

Every document becomes token ids plus one end id and is cut into pieces whose lengths
are ``capacity / 1, capacity / 2, capacity / 4 ...`` down to one id, which are classes
of reciprocal capacity: a bin of class ``k`` holds exactly ``k`` pieces and is then
full.  A worker fills the bins of its own rows; no bin waits for another worker.  What
is left at the end of a partition is less than one bin per class; these pieces are laid
one after another, longest first, which fills further bins exactly, and the last one is
closed at powers of two.  No sequence therefore needs padding.

A task keeps at most ``capacity / length`` open pieces of each class, whatever the
number of documents, and nothing is shuffled.  Sequence ids are
``partition * 2**40 + number``; a repeated task reads the same rows in the same order
and gives the same ids.

Cases: a null or empty text is the end id alone; repeated rows and repeated or null
``doc_id`` are packed each for itself; columns other than ``doc_id`` and ``text`` are
ignored; an empty table gives no rows; a very long text is one array in memory.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame

from skillweft.llm.worker import bound_batches, process_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


class Encoder:
    """Token ids by a file of the ``tokenizers`` library, as little-endian 32-bit bytes.

    ``tokenizers`` defines the ids.  A byte-level BPE file whose ids follow its merges
    gives the same ids through ``tiktoken``, which merges by rank, several times as fast
    and without objects per token; texts that hold an added token of the file, and files of
    any other form, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.added = [token["content"] for token in form.get("added_tokens") or []]
        self.ranked = _ranked(form)

    def encode(self, text: str) -> bytes:
        if self.ranked is not None and not any(token in text for token in self.added):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


#: How a byte-level pre-tokenizer cuts a text (fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level files write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _ranked(form: dict):
    """An encoder by ranks if the file's ids follow its merges and nothing else changes them, else nothing."""
    model, cut = form["model"], form.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and form.get("normalizer") is None and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True) and not cut.get("add_prefix_space") and form.get("truncation") is None
        and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )
    if not plain:
        return None
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    letters = byte_letters()
    if any(a >= b for a, b in zip(ids, ids[1:])) or not set(letters) <= set(model["vocab"]):
        return None
    import tiktoken

    ranks = {bytes([b]): model["vocab"][c] for c, b in letters.items()}
    ranks |= {bytes(letters[c] for c in m): i for m, i in zip(merges, ids)}
    return tiktoken.Encoding("by ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _encoder(path: str) -> Encoder:
    cache = process_cache("packing")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


class _Bins:
    """Open bins of one task; ``full`` lists finished rows."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity = capacity
        self.next_id = first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            self.close([(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)])
            start += self.capacity
        size = self.capacity // 2
        while start < total:
            if total - start >= size:
                pieces = self.open.setdefault(size, [])
                pieces.append((doc, start, ids[4 * start : 4 * (start + size)], total))
                start += size
                if len(pieces) * size == self.capacity:
                    self.close(self.open.pop(size))
            size //= 2

    def finish(self) -> None:
        line: list[tuple] = []
        filled, limit = 0, 0
        left = sum(size * len(pieces) for size, pieces in self.open.items())
        for size in sorted(self.open, reverse=True):
            for piece in self.open[size]:
                if not line:  # the largest power of two that the rest still fills
                    limit = min(self.capacity, 1 << (left.bit_length() - 1))
                line.append(piece)
                filled += size
                if filled == limit:
                    self.close(line)
                    left -= filled
                    line, filled = [], 0
        self.open = {}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``capacity`` ids.

    ``capacity`` is a power of two.  Ids are those of
    ``Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False)``.
    Columns: ``doc_id``, ``start`` and ``length`` of the piece in its document, ``ids``
    (little-endian 32-bit), ``doc_tokens`` with the end id, ``sequence_id``, ``offset``.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer_path)
        bins = _Bins(capacity, TaskContext.get().partitionId() << 40)

        def flush():
            columns = list(zip(*bins.rows))
            bins.rows = []
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                bins.add(doc, (encoder.encode(text) if text else b"") + end)
                if len(bins.rows) >= 4096:
                    yield flush()
        bins.finish()
        if bins.rows:
            yield flush()

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)
