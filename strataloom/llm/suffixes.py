"""Duplicate substrings by range-partitioned suffixes: bytes covered by a 50-byte string that a smaller document has too.

Sorting every suffix would move each byte fifty times, so suffixes that can't share their first 50 bytes with another
document are ruled out first, without loss:

1. In every window of 50 bytes the 20-byte gram with the least hash is its anchor; equal windows have equal anchors at
   equal places. Neighbouring windows with one anchor are a run. Anchor and run hashes are grouped over all documents.
   A run that a smaller document has as a whole is covered. Runs under an anchor that other runs share may match in part;
   of equal ones the smallest document's stands for all. All other runs match nothing.
2. The windows of those runs are the suffixes left. Each is known by its first eight bytes and a fingerprint of all 50.
   Splitters sampled from them range-partition them by these leading tokens; each bucket sorts its suffixes by
   multikey quicksort (words of eight bytes, ties refined by the next word, then by document). Splitters lie between
   different suffixes, so equal ones never straddle a boundary: the first of a run of equals decides it.
3. Covered windows go back to their documents, which drop the covered bytes.

Rows travel as packed column blobs, one for each task and bucket. Before each shuffle a task settles what it can: of equal
runs or windows in it only the smallest document's is sent, the others are known to be covered; and an anchor that a task
sees with many different runs is announced by two of them instead of asked about. So a passage or copy that a third of
all documents have adds at most a few entries a task to any bucket.

Defined cases: null and empty texts have no bytes and nothing removed; a null id is smaller than none and has none
smaller: nothing is removed and nothing removed because of it; rows with equal ids don't cover each other; texts of over
PIECE bytes are worked through in overlapping pieces; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, shuffle_partitions, table, utf8_parts

LENGTH = 50
GRAM = 20
PIECE = 1 << 20
MANY = 16  # different runs under one anchor in one task from which it is announced
FLUSH = 1_000_000  # entries that a task holds before it sends them
BUCKET = 8 << 20  # bytes of text in a bucket, about; a bucket is held in memory

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_SPOT = 21  # bits of a position in a piece with its overlap
SPOTS = 40  # bits of a position in a text


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        filled = 1
        while filled < n:
            step = min(filled, n - filled)
            out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
            filled += step
    return out


class _Tables:
    """Of a worker, made at first use: a random number for each byte, and powers of the hash base and of its inverse."""

    made: tuple | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.made is None:
            n = PIECE + 2 * LENGTH
            cls.made = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64), _powers(_M, n), _powers(pow(_M, -1, 1 << 64), n)
        return cls.made


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


class Hashes:
    """Hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        numbers, up, self.down = _Tables.get()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(numbers[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts side by side in data (text i ends before ends[i]): first and last window of each run, text, anchor hash, run hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), None
    hashes = Hashes(data)
    grams = hashes.every(GRAM)
    key = (grams >> _U(_SPOT) << _U(_SPOT)) | np.arange(len(grams), dtype=np.uint64)
    width, span, least = LENGTH - GRAM + 1, 1, key
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    windows = len(data) - LENGTH + 1
    least = np.minimum(least[:windows], least[width - span : width - span + windows])
    anchor = (least & _U((1 << _SPOT) - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(windows), "right")
    valid = np.arange(windows) + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])])
    last = np.r_[change[1:], windows] - 1
    good = valid[change]
    lo, hi = change[good], last[good]
    at = anchor[lo]
    whole = hashes.of(lo, hi + LENGTH) + (at - lo).astype(np.uint64) * _U(0x9E3779B1) + (hi - lo).astype(np.uint64)
    return lo, hi, text[lo], grams[at], mix(whole) >> _U(16), hashes


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row, offset in the row's text) for texts at[i]:at[i+1]: several short ones together, long ones in overlapping pieces."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > PIECE:
            for lo in range(int(at[i]), int(at[i + 1]) - LENGTH + 1, PIECE):
                part = data[lo : min(lo + PIECE + LENGTH - 1, int(at[i + 1]))]
                yield part, np.array([len(part)]), np.array([i]), np.array([lo - at[i]])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE // 4, "right")) - 1)
        yield data[at[i] : at[j]], at[i + 1 : j + 1] - at[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, byte plane by byte plane, so that planes of zeros and of slow change cost little."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint64).astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    return n.to_bytes(8, "little") + zlib.compress(planes, 1)


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """kinds: u or i for each column."""
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zlib.decompress(blob[8:]), np.uint8).reshape(len(kinds), 8, n)
    return [np.ascontiguousarray(planes[k].T).view(np.uint64).reshape(n).view(np.uint64 if kind == "u" else np.int64) for k, kind in enumerate(kinds)]


def unpack_all(blobs: list[bytes], kinds: str) -> list[np.ndarray]:
    parts = [unpack(b, kinds) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(kinds))]


def delta(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=_U(0))


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key by quicksort, ties refined by the next key, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    same = np.r_[False, keys[0][order][1:] == keys[0][order][:-1]] if len(order) else np.zeros(0, bool)
    for key in keys[1:]:
        group = np.cumsum(~same)
        open_ = same | np.r_[same[1:], False]
        if not open_.any():
            break
        own = order[open_]
        own = own[np.lexsort((key[own], group[open_]))]
        order[open_] = own
        same &= np.r_[False, key[order][1:] == key[order][:-1]]
    return order


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document id."""
    return (mix(doc.view(np.uint64) + _U(1)) >> _U(40)).astype(np.int64) % buckets


OUT = "bucket int, data binary"
_OUT = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], schema=_OUT)


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray], deltas: int | None = None, shift: int = 0) -> pa.RecordBatch:
    """One row a bucket; within a bucket entries keep their order; column number `deltas` as differences."""
    if not len(bucket):
        return _rows([], [])
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    start = np.flatnonzero(firsts(bucket))
    names, blobs = [], []
    for lo, hi in zip(start, np.r_[start[1:], len(bucket)], strict=True):
        own = [c[lo:hi] for c in columns]
        if deltas is not None:
            own[deltas] = delta(own[deltas])
        names.append(int(bucket[lo]) + shift)
        blobs.append(pack(*own))
    return _rows(names, blobs)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: where a new combination starts."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    out = np.zeros(len(keys[0]), bool)
    out[0] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def settle_runs(gram: np.ndarray, run: np.ndarray, doc: np.ndarray, many: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of (gram, run, doc), distinct. Flags: 1 covered as a whole by a smaller document here, 2 may match in part, 0 neither."""
    start, new = firsts(gram), firsts(gram, run)
    at = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    covered = doc > doc[at]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(start)) if len(gram) else np.zeros(0, np.int64)
    size = np.diff(np.r_[np.flatnonzero(start), len(gram)])
    kinds = np.repeat(kinds, size)
    partial = ~covered & (kinds >= (many or 2))
    return covered, partial, kinds


def anchors_of(batches: Iterator[pa.RecordBatch], n: int, docs_n: int) -> Iterator[pa.RecordBatch]:
    """Buckets 0..n-1: (gram, run, doc) to be compared; buckets n..: (doc, run * 2 + flag - 1) settled already."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        gram, run, doc = (np.concatenate([h[k] for h in held]) for k in range(3))
        held.clear()
        order = multikey_order([gram, run, doc])
        gram, run, doc = gram[order], run[order], doc[order]
        del order
        keep = firsts(gram, run, doc)
        gram, run, doc = gram[keep], run[keep], doc[keep]
        covered, partial, _ = settle_runs(gram, run, doc, MANY)
        # of an announced anchor's runs the first two go on, which tells every other task that there are several
        number = np.cumsum(partial) - np.maximum.accumulate(np.where(firsts(gram), np.cumsum(partial) - partial, 0))
        sent = ~covered & (~partial | (number <= 2))
        known = covered | partial
        yield by_bucket(doc_bucket(doc[known], docs_n), [doc[known], run[known] * _U(2) + partial[known].astype(np.uint64)], shift=n)
        gram, run, doc = gram[sent], run[sent], doc[sent]
        # mixed again: anchors are the least of their windows, so their own hashes are mostly small
        yield by_bucket(((mix(gram) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64), [gram, run, doc], deltas=0)
        del gram, run, doc, keep, covered, partial, number, sent, known
        give_back()

    for batch in batches:
        ids = batch.column(0)
        some = pc.is_valid(ids)
        if not some.to_pylist().count(True):
            continue
        batch = batch.filter(some)
        doc = batch.column(0).to_numpy()
        data, at = utf8_parts(batch.column(1))
        for part, ends, row, _ in pieces(data, at):
            _, _, text, gram, run, _ = runs(part, ends)
            if len(gram):
                held.append((gram, run, doc[row[text]]))
                count += len(gram)
            if count >= FLUSH:
                yield from flush()
                count = 0
    yield from flush()


def compare_runs(key: int, blobs: list[bytes], n: int, docs_n: int) -> pa.RecordBatch:
    """A bucket of anchors_of -> (doc, run * 2 + flag - 1) by the documents' buckets."""
    if key >= n:
        return _rows([key - n] * len(blobs), blobs)
    parts = [unpack(b, "uui") for b in blobs]
    gram, run, doc = (np.concatenate([np.cumsum(p[0], dtype=np.uint64) if k == 0 else p[k] for p in parts]) for k in range(3))
    del parts
    order = multikey_order([gram, run, doc])
    gram, run, doc = gram[order], run[order], doc[order]
    covered, partial, _ = settle_runs(gram, run, doc, None)
    known = covered | partial
    return by_bucket(doc_bucket(doc[known], docs_n), [doc[known], run[known] * _U(2) + partial[known].astype(np.uint64)])


def leads(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First eight bytes as big-endian numbers: their order is that of the bytes."""
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        out = (out << _U(8)) | data[start + k].astype(np.uint64)
    return out


def spread(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number first..last with its doc."""
    size = last - first + 1
    return np.repeat(doc, size), np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows first..last as stretches that neither touch nor overlap, by doc and place. Places hold the text's number above SPOTS bits."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    text = first >> SPOTS
    group = np.cumsum(firsts(doc, text)) << SPOTS
    low = np.int64((1 << SPOTS) - 1)
    reach = np.maximum.accumulate((last & low) + group)
    new = np.r_[True, (first[1:] & low) + group[1:] > reach[:-1] + 1]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(doc)] - 1
    return doc[start], first[start], (reach[end] - group[start]) | (text[start] << SPOTS)


def text_numbers(doc: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0 for the text of an id that one row has; rows that share an id are told apart by their different texts."""
    out = np.zeros(len(doc), np.int64)
    names, number, count = np.unique(doc, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[number] > 1)
    texts: dict[int, dict[bytes, int]] = {}
    for i in sorted(rows, key=lambda i: hashlib.sha256(data[at[i] : at[i + 1]]).digest()):
        own = texts.setdefault(int(doc[i]), {})
        out[i] = own.setdefault(hashlib.sha256(data[at[i] : at[i + 1]]).digest(), len(own))
    return out


def open_windows(doc: np.ndarray, texts: pa.Array, blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of a bucket's documents: covered (doc, first, last), and the suffixes left to be compared, (lead, fingerprint, doc, place) in order."""
    none = np.zeros(0, np.int64)
    cover, left = [none] * 3, [none.astype(np.uint64)] * 2 + [none] * 2
    if not blobs or not len(doc):
        return cover, left
    its_doc, its_run = unpack_all(blobs, "iu")
    order = np.lexsort((its_run, its_doc))
    its_doc, its_run = its_doc[order], its_run[order]
    # a doc's runs are looked up under one number
    names, number = np.unique(doc, return_inverse=True)
    slot = np.searchsorted(names, its_doc)
    whole_keys = mix(its_run >> _U(1)) + slot.astype(np.uint64) * _U(_M)
    by_key = np.argsort(whole_keys, kind="stable")  # of both flags for one run, from a task and from a bucket, covered comes first
    keys, flags = whole_keys[by_key], (its_run & _U(1))[by_key]
    data, at = utf8_parts(texts)
    nth = text_numbers(doc, data, at) << SPOTS
    done, found_open = [], []
    for part, ends, row, offset in pieces(data, at):
        lo, hi, text, _, run, hashes = runs(part, ends)
        if not len(lo):
            continue
        own = mix(run) + number[row[text]].astype(np.uint64) * _U(_M)
        first = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        found = keys[first] == own
        covered = found & (flags[first] == 0)
        begin = np.r_[0, ends[:-1]] - offset - nth[row]  # of the text in the part
        done.append((doc[row[text[covered]]], lo[covered] - begin[text[covered]], hi[covered] - begin[text[covered]]))
        open_ = found & ~covered
        if open_.any():
            which, place = spread(text[open_], lo[open_], hi[open_])
            found_open.append((leads(part, place), hashes.of(place, place + LENGTH), doc[row[which]], place - begin[which]))
    if done:
        cover = [np.concatenate([d[k] for d in done]) for k in range(3)]
    if found_open:
        lead, print_, whose, place = (np.concatenate([x[k] for x in found_open]) for k in range(4))
        order = multikey_order([lead, print_, whose])
        lead, print_, whose, place = lead[order], print_[order], whose[order], place[order]
        new = firsts(lead, print_)
        least = whose[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        here = whose > least
        cover = [np.concatenate([c, x]) for c, x in zip(cover, (whose[here], place[here], place[here]), strict=True)]
        left = [lead[~here], print_[~here], whose[~here], place[~here]]
    return cover, left


def windows_of(doc: np.ndarray, texts: pa.Array, blobs: list[bytes], splitters: tuple[np.ndarray, np.ndarray], n: int, docs_n: int) -> Iterator[pa.RecordBatch]:
    """Buckets 0..n-1: suffixes (lead, fingerprint, doc, place) by at most n - 1 splitters; buckets n..: covered (doc, first, last)."""
    cover, left = open_windows(doc, texts, blobs)
    yield by_bucket(split_bucket(left[0], left[1], splitters), left, deltas=0)
    a, b, c = merged(*cover)
    yield by_bucket(doc_bucket(a, docs_n), [a, b, c], shift=n)


def split_bucket(lead: np.ndarray, print_: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of splitters (lead, fingerprint) at or before each suffix; both sorted by the two."""
    all_lead, all_print = np.concatenate([splitters[0], lead]), np.concatenate([splitters[1], print_])
    order = np.lexsort((np.r_[np.zeros(len(splitters[0])), np.ones(len(lead))], all_print, all_lead))
    is_split = order < len(splitters[0])
    out = np.zeros(len(all_lead), np.int64)
    out[order] = np.cumsum(is_split)
    return out[len(splitters[0]) :]


def sort_suffixes(key: int, blobs: list[bytes], n: int, docs_n: int) -> pa.RecordBatch:
    """A bucket of windows_of -> covered (doc, first, last) by the documents' buckets."""
    if key >= n:
        return _rows([key - n] * len(blobs), blobs)
    parts = [unpack(b, "uuii") for b in blobs]
    lead, print_, doc, place = (np.concatenate([np.cumsum(p[0], dtype=np.uint64) if k == 0 else p[k] for p in parts]) for k in range(4))
    order = multikey_order([lead, print_, doc])
    lead, print_, doc, place = lead[order], print_[order], doc[order], place[order]
    new = firsts(lead, print_)
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else doc
    covered = doc > least
    a, b, c = merged(doc[covered], place[covered], place[covered])
    return by_bucket(doc_bucket(a, docs_n), [a, b, c])


def kept_rows(doc: np.ndarray, null: np.ndarray, texts: pa.Array, blobs: list[bytes]) -> pa.RecordBatch:
    """The result rows of one bucket's documents."""
    data, at = utf8_parts(texts)
    if blobs:
        whose, first, last = merged(*unpack_all(blobs, "iii"))
        # covered bytes: windows reach LENGTH - 1 beyond their last place; stretches that then touch are one
        whose, first, last = merged(whose, first, last + LENGTH - 1)
    else:
        whose = first = last = np.zeros(0, np.int64)
    lo, hi = np.searchsorted(whose, doc, "left"), np.searchsorted(whose, doc, "right")
    nth, low = text_numbers(doc, data, at), (1 << SPOTS) - 1
    removed, spans, digests = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), []
    for i in range(len(doc)):
        raw = data[at[i] : at[i + 1]]
        digest = hashlib.sha256()
        here = 0
        if not null[i]:
            for k in range(lo[i], hi[i]):
                if first[k] >> SPOTS == nth[i]:
                    start, end = int(first[k]) & low, (int(last[k]) & low) + 1
                    digest.update(raw[here:start])
                    removed[i] += end - start
                    spans[i] += 1
                    here = end
        digest.update(raw[here:])
        digests.append(digest.hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def sampled_splitters(dealt: DataFrame, runs_: DataFrame, n: int, buckets: int = 8, each: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """n - 1 splitters from the suffixes to be compared in a few buckets of documents: at most buckets * each of them."""

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pc.is_valid(left.column("id")))
        found = open_windows(own.column("id").to_numpy(), _one(own.column("text")), right.column("data").to_pylist())[1]
        some = np.random.default_rng(5).permutation(len(found[0]))[:each]
        give_back()
        return pa.table({"lead": found[0][some].view(np.int64), "print": found[1][some].view(np.int64)})

    few = lambda df: df.where(F.col("bucket") < buckets).groupBy("bucket")
    drawn = few(dealt).cogroup(few(runs_)).applyInArrow(draw, "lead long, print long").collect()
    if not drawn or n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lead, print_ = (np.array([r[k] for r in drawn], np.int64).view(np.uint64) for k in range(2))
    order = multikey_order([lead, print_])
    at = order[np.linspace(0, len(order), n + 1).astype(int)[1:-1]]
    return lead[at], print_[at]


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Documents with their bucket, covered windows (bucket, data) and the number of buckets."""
    docs = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = docs_n = max(2 * shuffle_partitions(docs.sparkSession), -(-size // BUCKET))

    def anchors(batches):
        return anchors_of(batches, n, docs_n)

    def compare(key, tables):
        return _grouped(key, tables, lambda k, blobs: compare_runs(k, blobs, n, docs_n))

    def bucket_rows(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(ids, docs_n), pa.int32()), *batch.columns], ["bucket", "id", "text"])

    runs_ = saved(docs.mapInArrow(anchors, OUT).groupBy("bucket").applyInArrow(compare, OUT), "suffix-runs")
    dealt = docs.mapInArrow(bucket_rows, "bucket int, id long, text string")
    splitters = sampled_splitters(dealt, runs_, n)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").combine_chunks()
        some = pc.is_valid(ids)
        own = left.filter(some)
        made = list(windows_of(own.column("id").to_numpy(), _one(own.column("text")), right.column("data").to_pylist(), splitters, n, docs_n)) if own.num_rows else []
        give_back()
        return pa.Table.from_batches(made, schema=_OUT)

    def resolve(key, tables):
        return _grouped(key, tables, lambda k, blobs: sort_suffixes(k, blobs, n, docs_n))

    suffixes = dealt.groupBy("bucket").cogroup(runs_.groupBy("bucket")).applyInArrow(windows, OUT)
    covered = saved(suffixes.groupBy("bucket").applyInArrow(resolve, OUT), "suffix-covered")
    return dealt, covered, docs_n


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A chunked column as one array with 64-bit offsets."""
    column = column.cast(pa.large_string())
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())


def _grouped(key, table_: pa.Table, fn) -> pa.Table:
    made = pa.Table.from_batches([fn(key[0].as_py(), table_.column("data").to_pylist())], schema=_OUT)
    give_back()
    return made


def give_back() -> None:
    """Returns memory that the allocators hold without need to the system; executors run several workers side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    dealt, covered, _ = duplicate_spans(docs, id_col, text_col)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").combine_chunks()
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        return pa.Table.from_batches([kept_rows(ids.fill_null(0).to_numpy(), null, _one(left.column("text")), right.column("data").to_pylist())])

    return dealt.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6(spark, sf_dir) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
