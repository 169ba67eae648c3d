"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file holds the ids of its documents one after another, 2 bytes an id where the vocabulary allows it and 4 otherwise,
then the documents' ids, then the end positions as an Elias-Fano sequence: the low bits of every position packed, the high
bits as a unary bitmap with a sample of select positions. ``select1`` finds the bounds of document k without a table of
64-bit offsets. Shards are cut by ranges of doc_id, so shard order and order inside a shard are the order of the ids.

Every task writes under a name of its own in the shared folder and renames at the end; the manifest lists the files of the
tasks that Spark counts as done, so a repeated task leaves nothing but an unlisted file.

Defined results: a null text counts as empty and yields the end id alone; a null doc_id sorts first and is kept as null;
rows repeated with one id are separate documents; an empty table gives no documents; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Recent, coded, materialise, memory, shared_dir, slices

MAGIC = b"TOKEF001"
#: Marks that the tokenizer cuts off the end of a word together.
MARKS = ".,;:!?"
#: Every so many ones of the bitmap, select keeps the position of one.
SELECT_EVERY = 256
#: Bytes of each generation of a worker's chunks; pieces of lines and marks have a sixteenth of it.
REMEMBERED = 128 << 20
HEADER = "<8sBBxxxxxxQQQQQ"  # magic, id bytes, low bits, documents, ids, bytes of low, bytes of high, samples

MANIFEST = "path string, shard int, documents long, ids long"
DOCUMENTS = "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones.astype(np.int64)] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SELECT_EVERY].copy())

    def select(self, k: int) -> int:
        """Value k: the place of the k-th one, looked for from the sample before it, with its low bits."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SELECT_EVERY])
        left = k % SELECT_EVERY
        while left:
            byte = at // 8
            # the sample's own one is behind us: look at the bits after it
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            window[: at % 8 + 1] = 0
            found = np.flatnonzero(window)
            if len(found) >= left:
                at, left = byte * 8 + int(found[left - 1]), 0
            else:
                left -= len(found)
                at = byte * 8 + len(window) - 1
        low = 0
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << j
        return (at - k) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _open(path: str, mode: str):
    """A file of the shared folder: a mounted folder, or a store that pyarrow reaches by the path's scheme."""
    if "://" not in path or path.startswith("file:"):
        os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
        return open(_local(path), mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def _move(old: str, new: str) -> None:
    if "://" not in old or old.startswith("file:"):
        os.replace(_local(old), _local(new))
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(old)
    store.move(inner, fs.FileSystem.from_uri(new)[1])


class Encoder:
    """The tokenizer's own pieces and merges, looked up once for each new chunk of a worker.

    Texts are cut at single spaces. The tokenizer never joins characters across a space between two characters that are no
    white space, so such chunks are encoded one by one and remembered; a text where white space meets a space is encoded
    whole. This holds for byte-level tokenizers with the usual cutting pattern and no normalizer; with any other file every
    text is encoded whole.
    """

    #: White space besides the space itself.
    SPACES = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self.special = tuple(str(t) for t in self.whole.get_added_tokens_decoder().values())
        with open(path) as f:
            held = json.load(f)
        model, cut = held["model"], held.get("pre_tokenizer") or {}
        #: Whether texts are cut as said above; other tokenizers encode every text whole.
        self.cuts = (
            model.get("type") == "BPE" and not held.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        if not self.cuts:
            return
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pieces_of = BPE(model["vocab"], merges, cache_capacity=0).tokenize
        # The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the rest follow from code point 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}
        self.pieces = Recent(self._piece, 220, REMEMBERED // 16)
        self.chunks = Recent(self._chunk, 220, REMEMBERED)

    def _whole(self, text: str) -> bytes:
        return array("H" if self.width == 2 else "I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("H" if self.width == 2 else "I", [t.id for t in self.pieces_of(shown)]).tobytes()

    def _line(self, line: str) -> bytes | None:
        """A word, after a space or not, with marks after it; None if it is anything else."""
        word = line.rstrip(MARKS)
        if (word[1:] if word[:1] == " " else word).isalpha():
            return self.pieces[word] + self.pieces[line[len(word) :]] if len(word) < len(line) else self.pieces[word]
        return None

    def _chunk(self, chunk: str) -> bytes:
        """A chunk with the space before it: a word with marks after it, lines of such words, or whatever else."""
        word = chunk.rstrip(MARKS)
        if word.isalpha():
            return self._piece(" " + word) if len(word) == len(chunk) else self.chunks[word] + self.pieces[chunk[len(word) :]]
        if "\n" in chunk:  # one line end between two others that are no white space is a piece of its own
            lines = [x and self._line(x) for x in f" {chunk}".split("\n")]
            if all(lines):
                return self.pieces["\n"].join(lines)
        return self._whole(" " + chunk)

    def apart(self, text: str) -> bool:
        """White space meets a space, or a special token's string occurs: to be encoded whole."""
        return "  " in text or any(w in text and (w + " " in text or " " + w in text) for w in self.SPACES) or any(t in text for t in self.special)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        if not self.cuts:
            return [np.frombuffer(self._whole(t.as_py()), self.kind) for t in texts]
        chunks, codes, starts = coded(pc.split_pattern(texts, " "))
        packed = list(map(self.chunks.__getitem__, chunks))
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        flat = np.frombuffer(b"".join(packed), self.kind)
        begins = np.cumsum(lengths) - lengths
        n = lengths[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((begins[codes] - ends + n).astype(np.int32), n)]
        bounds = np.concatenate([[0], ends])[starts]
        out = []
        for k, text in enumerate(texts):
            if self.apart(text := text.as_py()):
                out.append(np.frombuffer(self._whole(text), self.kind))
            else:  # the first chunk has no space before it
                first = self._whole(chunks[codes[starts[k]]])
                out.append(np.concatenate([np.frombuffer(first, self.kind), ids[bounds[k] + n[starts[k]] : bounds[k + 1]]]))
        return out


def encoder(path: str) -> Encoder:
    return memory("token_files", path, make=lambda: Encoder(path))


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        final = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        with _open(final + ".part", "wb") as out:
            for batch in (part for whole in rows for part in slices(whole)):
                doc_ids += batch.column("doc_id").to_pylist()
                for ids in enc.encode_all(pc.fill_null(batch.column("text"), "")):
                    lengths.append(len(ids) + 1)
                    out.write(ids.tobytes() + end)
            if not doc_ids:
                return
            ends = EliasFano.of(np.cumsum(np.array(lengths, np.int64)))
            null = np.array([d is None for d in doc_ids], np.uint8)
            out.write(np.array([d or 0 for d in doc_ids], np.int64).tobytes() + np.packbits(null).tobytes())
            out.write(ends.low.tobytes() + ends.high.tobytes() + ends.samples.tobytes())
            out.write(struct.pack(HEADER, MAGIC, enc.width, ends.low_bits, len(doc_ids), sum(lengths), len(ends.low), len(ends.high), len(ends.samples)))
        _move(final + ".part", final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=["path", "shard", "documents", "ids"])

    return write


class Shard:
    """A shard file opened for reading: its documents' ids and bounds, and the ids of any document."""

    def __init__(self, path: str):
        self.file = _open(path, "rb")
        self.file.seek(0, 2)
        size = self.file.tell()
        self.file.seek(size - struct.calcsize(HEADER))
        magic, self.width, low_bits, self.n, self.ids, low, high, samples = struct.unpack(HEADER, self.file.read(struct.calcsize(HEADER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.file.seek(self.ids * self.width)
        self.doc_ids = np.frombuffer(self.file.read(8 * self.n), "<i8")
        self.null = np.unpackbits(np.frombuffer(self.file.read((self.n + 7) // 8), np.uint8), count=self.n).astype(bool)
        read = lambda n, kind: np.frombuffer(self.file.read(n), kind)
        self.ends = EliasFano(self.n, low_bits, read(low, np.uint8), read(high, np.uint8), read(8 * samples, np.uint64))
        self.file.seek(0)

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def tokens(self, k: int) -> np.ndarray:
        """Ids of document k, by select."""
        a, b = self.bounds(k)
        self.file.seek(a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), self.kind)

    def scan(self) -> Iterator[np.ndarray]:
        """Ids of every document in order, read once through."""
        return (ids for _, ids in self.placed())

    def placed(self) -> Iterator[tuple[int, np.ndarray]]:
        """Begin and ids of every document in order, read once through; each end by select."""
        self.file.seek(0)
        a = 0
        for k in range(self.n):
            b = self.ends.select(k)
            yield a, np.frombuffer(self.file.read((b - a) * self.width), self.kind)
            a = b


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Tokenise whole texts into shard files in ascending id order; returns the manifest (one row a shard)."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The hash keeps one id that holds very many rows from landing in a single shard, and fixes the order of such rows.
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return materialise(ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "token-manifest")


def _reader(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
    for batch in rows:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            found = [(a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for a, ids in shard.placed()]
            starts, lengths, crc = np.array(found, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64(), mask=shard.null), pa.array(np.full(shard.n, row["shard"], np.int32)), pa.array(starts + row["before"]), pa.array(lengths), pa.array(crc)], names=names
            )


def read_shards(manifest: DataFrame) -> DataFrame:
    """Each document of the listed shards, read from the files: doc_id, shard, start, n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("ids").over(W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("path", "shard", before.alias("before"))  # one row a shard
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(n, "shard").mapInArrow(_reader, DOCUMENTS)


def token_table(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write shards to the shared folder and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_shards(write_shards(docs, tokenizer, folder, **options))


def default_tokenizer(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get("dcbspark.tokenizer.bpe", None) or public_tokenizers.path("byte_bpe_50k.json")
