"""Token ids in flat binary files.

Layout of a folder, one set of files per part:

* `tokens-PPPPP.bin`   ids of the part's documents one after the other, little-endian unsigned
  integers, 16 bits wide if the vocabulary allows it and 32 otherwise;
* `offsets-PPPPP.bin`  64-bit little-endian: where each document starts, then the part's end,
  counted in ids from the part's start;
* `docs-PPPPP.bin`     64-bit little-endian ids of the documents; the smallest 64-bit number stands
  for a missing id;
* `manifest/`          Parquet: part, n_docs, n_tokens.

Parts and the documents in them are in the requested order. A part's base is the prefix sum of the
parts before it, so a document's global start is base + offset; no file has to be rewritten for it.
Every file is written under another name and renamed, so a repeated task leaves the same files.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgauge.llm.common import open_folder, ship_code
from pressgauge.session import shared_dir

# --- fixed values: how byte-level BPE vocabularies of this family cut a text into pieces --------
#: Letters and numbers among the characters up to U+024F. Beyond these, character tables of two
#: libraries might differ, so texts with other characters are encoded whole.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
PIECES = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
OTHER = "[^\x00-\x1b\x20-ɏ]"
NO_ID = -(2**63)
# -----------------------------------------------------------------------------------------------

CACHED_PIECES = 1_000_000
CACHED_LENGTH = 40

_encoders: dict[str, "Encoder"] = {}


class _Known(dict):
    """Ids by piece. A piece that is not known stands for itself and is noted."""

    def __init__(self):
        self.wanted: dict[str, None] = {}

    def __missing__(self, piece: str) -> str:
        self.wanted[piece] = None
        return piece


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Its byte-level pre-tokenizer cuts a text into pieces whose ids do not depend on each other. Most
    pieces are frequent words, so their ids are kept (a bounded number of them), and the library is
    asked for the others only, many in one call. Texts with characters beyond U+024F, texts that hold
    the string of a special token and vocabularies of another kind go through the library as a whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        pre = self.library.pre_tokenizer
        self.by_piece = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.library.normalizer is None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # in a byte-level vocabulary a token's string has one character for each byte
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)
        self.pieces, self.other = re.compile(PIECES), re.compile(OTHER)
        self.known = _Known()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.width).tobytes() for x in found]

    def _apart(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces. They are put on lines of one text, which leaves each a piece of its own."""
        lines = [p for p in pieces if not p.isspace()]
        alone = [p for p in pieces if p.isspace()]
        found = dict(zip(alone, self._whole(alone))) if alone else {}
        if lines:
            ids = np.array(self.library.encode_batch_fast(["\n".join(lines) + "\n"], add_special_tokens=False)[0].ids)
            ends = np.cumsum(self.n_bytes[ids])
            cuts = np.cumsum([len(p.encode()) + 1 for p in lines])
            after, before = np.searchsorted(ends, cuts), np.searchsorted(ends, cuts - 1)
            starts = np.r_[0, after[:-1] + 1]
            if not (np.array_equal(ends[after], cuts) and np.array_equal(ends[before], cuts - 1)):
                return found | dict(zip(lines, self._whole(lines)))
            packed, size = ids.astype(self.width).tobytes(), self.width.itemsize
            slices = zip((starts * size).tolist(), ((before + 1) * size).tolist())
            found.update((p, packed[a:b]) for p, (a, b) in zip(lines, slices))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        odd, special, known, cut = self.other.search, self.special, self.known, self.pieces.findall
        found: list[list | None] = [
            None if odd(t) or any(s in t for s in special) else list(map(known.__getitem__, cut(t))) for t in texts
        ]
        fresh = self._apart(list(known.wanted)) if known.wanted else {}
        known.wanted.clear()
        if len(known) < CACHED_PIECES:  # frequent pieces come early
            known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHED_LENGTH)
        return [
            self._whole([t])[0] if ids is None else b"".join([x if x.__class__ is bytes else fresh[x] for x in ids])
            for t, ids in zip(texts, found)
        ]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _name(root: str, kind: str, part: int) -> str:
    return f"{root}/{kind}-{part:05d}.bin"


class _Writer:
    def __init__(self, folder: str, part: int):
        self.files, root = open_folder(folder)
        self.names = [_name(root, kind, part) for kind in ("tokens", "offsets", "docs")]
        self.attempt = uuid.uuid4().hex
        self.out = [self.files.open_output_stream(f"{n}.{self.attempt}") for n in self.names]
        self.at = self.docs = 0

    def write(self, doc_ids: list[int | None], tokens: list[bytes], width: int) -> None:
        self.out[0].write(b"".join(tokens))
        sizes = np.fromiter((len(t) // width for t in tokens), np.int64, len(tokens))
        ends = self.at + np.cumsum(sizes)
        self.out[1].write((ends - sizes).astype("<u8").tobytes())
        self.out[2].write(np.array([NO_ID if x is None else x for x in doc_ids], "<i8").tobytes())
        self.at, self.docs = int(ends[-1]), self.docs + len(tokens)

    def close(self) -> None:
        self.out[1].write(np.array([self.at], "<u8").tobytes())
        for stream, name in zip(self.out, self.names):
            stream.close()
            self.files.move(f"{name}.{self.attempt}", name)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, order: Sequence[Column], doc_id: str = "doc_id", text: str = "text"
) -> int:
    """Encodes every whole text of `docs`, appends `end_id`, writes the files; gives the number of parts.

    `order` sorts the documents over all parts by a range shuffle; equal rows may come in any order.
    A null text counts as empty and still gets the end id. An empty table gives no files. `folder`
    must be reachable from every executor.
    """
    ship_code(docs.sparkSession)
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    keys = [f"_o{i}" for i in range(len(order))]
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *named)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encode = TaskContext.get().partitionId(), None, encoder(tokenizer)
        last = np.array([end_id], encode.width).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 128):
                writer = writer or _Writer(folder, part)
                found = encode.encode([x or "" for x in texts.slice(at, 128).to_pylist()])
                writer.write(ids.slice(at, 128).to_pylist(), [x + last for x in found], encode.width.itemsize)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([writer.docs]), pa.array([writer.at])],
                ["part", "n_docs", "n_tokens"],
            )

    rows.mapInArrow(run, "part int, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest").count()


def part_bases(spark: SparkSession, folder: str) -> list[tuple[int, int, int, int]]:
    """(part, first id, documents, ids) per part; the first id is the sum over the parts before it.

    One small row per written part reaches the driver, none per document.
    """
    rows = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    before = accumulate((r.n_tokens for r in rows), initial=0)
    return [(r.part, base, r.n_docs, r.n_tokens) for r, base in zip(rows, before)]


def map_part(folder: str, part: int, width: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc ids) of a part: memory-mapped where the folder is mounted, read otherwise."""
    files, root = open_folder(folder)
    local = isinstance(files, pafs.LocalFileSystem)

    def load(kind: str, dtype: np.dtype) -> np.ndarray:
        name = _name(root, kind, part)
        if local:
            return np.memmap(name, dtype, "r")
        with files.open_input_file(name) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    return load("tokens", width), load("offsets", np.dtype("<u8")), load("docs", np.dtype("<i8"))


def read_documents(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    parts = part_bases(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).width
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, offsets, doc_ids = map_part(folder, part, width)
                bounds = offsets.astype(np.int64)
                for at in range(0, len(doc_ids), 10_000):
                    ids, cut = np.array(doc_ids[at : at + 10_000]), bounds[at : at + 10_001]
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=ids == NO_ID), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame([x[:2] for x in parts], "part int, base long")
    return table.repartition(len(parts), "part").mapInArrow(run, schema)


def token_table(
    docs: DataFrame, tokenizer: str, end_id: int, order: Sequence[Column], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes `docs` to a new folder in the shared one and reads the files back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end_id, order, doc_id, text)
    return read_documents(spark, folder, tokenizer)
