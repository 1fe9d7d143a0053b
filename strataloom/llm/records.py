"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

Data file: one record after another, each
    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload
with payload = i64 row id | u8 flags (1: the id is null) | u8 bytes of an id (2 or 4) | token ids, all little-endian. A
checksum is masked by rotating it right by 15 bits and adding 0xA282EAD8, so that data which holds checksums stays safe.
Index file: framed in the same way, first the number of records n (u64), then the n + 1 entries (u64 offset in the data file,
u64 tokens of all records before) in blocks of INDEXED, each block one frame. All blocks but the last have one size, so a
reader fetches any record, in any order, by a seek in the index and one in the data, and checks what it reads.

Writing: rows are range-partitioned by id, sorted, encoded and written by the task that holds them, one file pair a task;
there are as many tasks as the input's estimated size asks for. A file's name is unique to the attempt and only files named by
finished tasks enter the manifest, so lost executors and repeated attempts leave no wrong data. Files go to the shared folder
through pyarrow's file systems.

Defined cases: null and empty texts are the end id alone; null ids come first; rows with equal ids are in the order of
their texts; very long texts are one record; an empty table has no files and gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.common import file_system, fresh_dir, partitions_for, pick, table

MASK_DELTA = 0xA282EAD8
_LENGTH = struct.Struct("<Q")
_CRC = struct.Struct("<I")
_HEAD = struct.Struct("<qBB")
_FRAME = 16  # bytes that a frame adds to its payload
END_ID = 1
INDEXED = 4096  # index entries in a block
FILE_BYTES = 64 << 20  # estimated input of a task, and so of a file pair

# The steps before the vocabulary for which pieces of Latin-1 texts are known beforehand.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# Lower-case letters, numbers and white space of Latin-1, and white space beyond it.
_LETTERS, _NUMBERS, _SPACES, _FAR_SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0", "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}{_NUMBERS}{_SPACES}]+")
_WORDS = re.compile(f"[^{_SPACES}{_FAR_SPACES}]+")
_STRETCH = re.compile(f"(?s).{{1,1000000}}(?![^{_SPACES}])|.+")  # of a long text, between white space where there is some


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CRC.pack(masked(length)), payload, _CRC.pack(masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of the record that data begins with; ValueError if a checksum is wrong or data ends too early."""
    if len(data) < 12 or masked(data[:8]) != _CRC.unpack_from(data, 8)[0]:
        raise ValueError("record: wrong length checksum")
    size = _LENGTH.unpack_from(data)[0]
    body = data[12 : 12 + size]
    if len(data) < 16 + size or masked(body) != _CRC.unpack_from(data, 12 + size)[0]:
        raise ValueError("record: wrong payload checksum")
    return body


def payload(row: int | None, ids: bytes, width: int, end_id: int) -> bytes:
    return b"".join((_HEAD.pack(row or 0, row is None, width), ids, int(end_id).to_bytes(width, "little")))


def index_bytes(offsets: list[int], tokens: list[int]) -> bytes:
    """offsets: of the records and the end of the data; tokens: before each record, and of all."""
    entries = np.array([offsets, tokens], "<u8").T
    return frame(_LENGTH.pack(len(offsets) - 1)) + b"".join(frame(entries[lo : lo + INDEXED].tobytes()) for lo in range(0, len(entries), INDEXED))


def read_index(data: Callable[[int, int], bytes], first: int = 0, last: int | None = None) -> np.ndarray:
    """[last - first + 1, 2]: offset and tokens before, of the records first..last and of what follows them; data(offset, size) reads."""
    at = _LENGTH.size + _FRAME
    n = _LENGTH.unpack(unframe(memoryview(data(0, at))))[0]
    last = n if last is None else min(last, n)
    step = 16 * INDEXED + _FRAME
    lo, hi = first // INDEXED, last // INDEXED + 1
    held, blocks = memoryview(data(at + lo * step, (hi - lo) * step)), []
    for k in range(lo, hi):
        blocks.append(np.frombuffer(unframe(held[(k - lo) * step :]), "<u8").reshape(-1, 2))
    found = np.concatenate(blocks)[first - lo * INDEXED : last + 1 - lo * INDEXED]
    if len(found) != last + 1 - first:
        raise ValueError("index: too short")
    return found


class Kept(dict):
    """Results by key. Beyond `most` a new generation begins; of the one before, what is asked for again moves over."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Token ids of whole texts, as little-endian bytes of `width` an id; pieces seen before aren't looked up again.

    With the known steps before the vocabulary, white space parts words for sure, and in Latin-1 words, which NFC leaves as
    they are and lower case changes letter by letter, the pieces are those of the tokenizer's own pattern: each goes to the
    tokenizer's model by itself. Words with other characters go to the library whole. Texts that hold a special token's
    string, and all texts of tokenizers with other steps, go to the library as they are.
    """

    def __init__(self, path: str, kept: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.known = steps["normalizer"] == KNOWN_NORMALIZER and steps["pre_tokenizer"] == KNOWN_PRE_TOKENIZER and steps["post_processor"] is None and steps["model"]["type"] == "BPE" and not steps["model"]["dropout"] and not steps["truncation"] and not steps["padding"]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.known = self.known and not any(t.normalized for t in added)
        self.special = tuple(t.content for t in added)
        if self.known:  # letters as the model sees them
            spelled = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)) for c in range(256)}
            self.spelling = {c: x[0][0] for c, x in spelled.items() if x}
        self.pieces, self.words = Kept(self._piece, kept), Kept(self._whole, kept // 4)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(piece.translate(self.spelling))], self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or any(s in text for s in self.special):
            return self._whole(text)
        if len(text) > 1_000_000:
            return b"".join(self._words(part[0]) for part in _STRETCH.finditer(text))
        return self._words(text)

    def _words(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(self._pieces(w) if w.isascii() else self.words[w] for w in _WORDS.findall(text))
        return self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> list[dict]:
    """Writes docs in ascending order of ids under folder (a URI); the manifest, one entry a file pair, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of = encoder(tokenizer)
        part, out, name = TaskContext.get().partitionId(), None, ""
        offsets, tokens = [0], [0]
        files, root = file_system(folder)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20)
                ids = of.encode(text.as_py())
                record = frame(payload(row, ids, of.width, end_id))
                out.write(record)
                offsets.append(offsets[-1] + len(record))
                tokens.append(tokens[-1] + len(ids) // of.width + 1)
        if out is not None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(index_bytes(offsets, tokens))
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "records": len(tokens) - 1, "tokens": tokens[-1], "bytes": offsets[-1]}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = pick(docs, id=id_col, text=text_col)
    rows = rows.repartitionByRange(partitions_for(rows, FILE_BYTES), "id").sortWithinPartitions("id", "text")
    made = rows.mapInArrow(run, "part int, name string, records long, tokens long, bytes long").collect()  # one row a file
    return [r.asDict() for r in sorted(made, key=lambda r: r["part"])]


def _entries(files, path: str, first: int, last: int | None) -> np.ndarray:
    with files.open_input_file(path) as index:

        def data(offset: int, size: int) -> bytes:
            index.seek(offset)
            return index.read(size)

        return read_index(data, first, last)


def read(folder: str, name: str, order: np.ndarray | None = None, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of the records first..last of a file, or of those in `order`, by the index."""
    files, root = file_system(folder)
    entries = _entries(files, f"{root}/{name}.idx", first, last)
    wanted = np.arange(len(entries) - 1) if order is None else np.asarray(order) - first
    with files.open_input_file(f"{root}/{name}.rec") as data:
        at, held = 0, memoryview(b"")
        for k in wanted:
            offset, end = int(entries[k, 0]), int(entries[k + 1, 0])
            if not (at <= offset and end <= at + len(held)):  # in file order several MB at a time
                data.seek(offset)
                at, held = offset, memoryview(data.read(max(end - offset, 4_000_000 if order is None else 0)))
            body = unframe(held[offset - at : end - at])
            row, null, width = _HEAD.unpack_from(body)
            yield (None if null else row), np.frombuffer(body[_HEAD.size :], f"<u{width}")


def read_back(spark, folder: str, manifest: list[dict], span: int = 200_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files alone; start counts the tokens of all records before."""
    jobs, before = [], 0
    for entry in manifest:
        for lo in range(0, entry["records"], span):
            jobs.append((entry["name"], lo, min(lo + span, entry["records"]), before))
        before += entry["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                files, root = file_system(folder)
                start = job["before"] + int(_entries(files, f"{root}/{job['name']}.idx", job["lo"], job["lo"])[0, 1])
                rows = []
                for row, ids in read(folder, job["name"], first=job["lo"], last=job["hi"]):
                    rows.append((row, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                ids, starts, counts, crcs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(jobs, "name string, lo long, hi long, before long")
    return listed.repartition(max(1, min(len(jobs), 10_000))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(spark, sf_dir, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_dir(spark, "records")
    return read_back(spark, folder, write(table(spark, sf_dir, "documents"), str(tokenizer), folder))
