"""SimHash near-duplicates joined by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21. A segment is read as a word of the perfect binary Golay code
(23, 12), zero-padded; every 23-bit word lies within three errors of exactly one codeword. The keys of a segment are the
codeword indices of itself and of the words one error away: 1 to 7 of them, and two segments that differ in one bit share
one. With two errors in all, one segment has none and, going round the segments, the next one or the one before has at
most one: so for some segment both fingerprints agree on it exactly and share a Golay key of the following one. That pair
(exact segment, Golay key of the next) is the join key; candidates are verified by their Hamming distance.

Equal fingerprints are one row before any of this. A key with very many different fingerprints is dealt out anew by exact
parts of the bits outside its exact segment (three parts, at most two errors: one part is free of them). Groups are never
expanded into all pairs: each gives the edges of a spanning forest, found block by block or, in large groups, by looking
up every fingerprint one or two flips away.

keep_one() works on whole texts at a similarity of 0.8 and five-word shingles, where fingerprints differ in far more than two
bits, in every seventh. So there they are wider, WORDS words of 23 bits, and each word goes to the Golay codeword that the sums
behind its bits are nearest to (bits close to a tie count least). As above, the codewords of two segments, going round, are a
key. For sets of few shingles such sums are coarse: they meet by the first shingles of their sets as well, which loses none.
Fingerprints of 256 bits rule out what is far from similar among texts that meet. The texts that are left are candidates: those
that share one of their rarest shingles are compared, and the sets of shingles decide.

Defined cases: null and empty texts have the fingerprint zero, linked like any other; a null id has a fingerprint and the
component of its equals, but is never the smallest id of a component (null if no other is there); repeated rows stay
separate rows of one component; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, shuffle_partitions, table, tidy
from strataloom.llm.components import components, local_forest
from strataloom.llm.rowmarks import PLACE, located, with_marks, without

SEGMENTS = [(0, 22), (22, 21), (43, 21)]  # first bit and width
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code
HOT = 1024  # fingerprints under one key beyond which the key is dealt out anew
BLOCK = 1024


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _leaders() -> np.ndarray:
    """Syndrome -> the error word of weight three or less."""
    one = 1 << np.arange(23)
    errors = np.concatenate([[0], one, [a | b for i, a in enumerate(one) for b in one[:i]], [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]]).astype(np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainder(errors)] = errors
    return out


_SYNDROME = [_remainder(np.arange(256, dtype=np.int64) << s if s < 16 else np.arange(128, dtype=np.int64) << s) for s in (0, 8, 16)]
_LEADER = _leaders()


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    words = words.astype(np.int64)
    syndrome = _SYNDROME[0][words & 255] ^ _SYNDROME[1][words >> 8 & 255] ^ _SYNDROME[2][words >> 16]
    return (words ^ _LEADER[syndrome]) >> 11


def segment(fps: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: for each segment its exact bits with each Golay key of the next."""
    rows, keys = [], []
    for k in range(3):
        following = (k + 1) % 3
        word = segment(fps, following)
        near = np.concatenate([golay_index(word)[:, None], *(golay_index(word ^ (1 << bit))[:, None] for bit in range(SEGMENTS[following][1]))], 1)
        near.sort(axis=1)
        fresh = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], 1)
        row, _ = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(k) << 40) | (segment(fps, k)[row] << 12) | near[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """64-bit SimHash over the shingles of `size` words, repeats included."""
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    shingles = (words,) if len(words) < size else zip(*(words[i:] for i in range(size)), strict=False)
    h = np.array([h64(b" ".join(s), 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        part = h[lo : lo + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); a map."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(words_of(t.as_py()), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def _flips(radius: int = 2) -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([one, one[i] | one[j]]) if radius > 1 else one


def group_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that tie together what links among one group's sorted distinct fingerprints; a spanning forest for large groups."""
    n = len(fps)
    if n <= BLOCK:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1)) if n > 2 else np.nonzero([[False, n > 1 and bool(np.bitwise_count(fps[0] ^ fps[-1]) <= 2)]])
        if n <= 64:
            return i, j
        root = local_forest(i, j, n)
    else:
        root = np.arange(n)
        if n <= 4 * BLOCK:
            for lo in range(0, n, BLOCK):
                for to in range(lo, n, BLOCK):
                    i, j = np.nonzero(np.bitwise_count(fps[lo : lo + BLOCK, None] ^ fps[None, to : to + BLOCK]) <= 2)
                    root = local_forest(np.concatenate([i + lo, np.arange(n)]), np.concatenate([j + to, root]), n)
        else:  # in proportion to n: look up each one and two flips
            for mask in _flips():
                want = fps ^ mask
                at = np.minimum(np.searchsorted(fps, want), n - 1)
                hit = np.flatnonzero(fps[at] == want)
                if len(hit):
                    root = local_forest(np.concatenate([hit, np.arange(n)]), np.concatenate([at[hit], root]), n)
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def _verify(batches):
    """Runs of rows sorted by (key, fp) -> edges (a, b) of fingerprints. A run that goes on in the next batch is carried over."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(key, fp):
        fps = fp.view(np.uint64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        first, second = [], []
        small = np.repeat(size, size)
        most = int(size[size <= 64].max(initial=0))
        for d in range(1, most):  # groups of 64 and less together, neighbours d apart at a time
            i = np.flatnonzero((key[d:] == key[:-d]) & (small[d:] <= 64))
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= 2]
            first.append(i)
            second.append(i + d)
        for g in np.flatnonzero(size > 64):
            own = slice(start[g], start[g] + size[g])
            order = np.argsort(fps[own])
            i, j = group_links(fps[own][order])
            first.append(order[i] + start[g])
            second.append(order[j] + start[g])
        i, j = np.concatenate([*first, np.zeros(0, int)]).astype(int), np.concatenate([*second, np.zeros(0, int)]).astype(int)
        names, at = np.unique(np.concatenate([fp[i], fp[j]]), return_inverse=True)
        root = local_forest(at[: len(i)], at[len(i) :], len(names))
        tied = root != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[root[tied]]), pa.array(names[tied])], schema=schema)

    for batch in batches:
        key = np.concatenate([held_k, batch.column(0).to_numpy()])
        fp = np.concatenate([held_f, batch.column(1).to_numpy()])
        cut = np.searchsorted(key, key[-1]) if len(key) else 0
        held_k, held_f = key[cut:], fp[cut:]
        if cut:
            yield links(key[:cut], fp[:cut])
    if len(held_k):
        yield links(held_k, held_f)


def linked(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) as their links at two bits or fewer do."""
    spark = fps.sparkSession
    n = shuffle_partitions(spark)

    def emit(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo in range(0, len(own), 20_000):
                row, key = fuzzy_keys(own[lo : lo + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[lo : lo + 20_000][row])], ["key", "fp"])

    keyed = saved(fps.select("fp").mapInArrow(emit, "key long, fp long"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    busy = saved(sizes.where(F.col("n") > hot).select("key"), "simhash-hot")
    # hot keys: one of three parts of the 42 or 43 bits outside the exact segment agrees
    outside = F.when(F.shiftright("key", 40) == 0, F.shiftrightunsigned("fp", 22)).when(F.shiftright("key", 40) == 1, F.shiftrightunsigned("fp", 43).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(F.lit((1 << 22) - 1)), 21))).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 43) - 1)))
    parts = F.array(*(F.xxhash64("key", F.lit(p), F.shiftright("rest", 15 * p).bitwiseAND(F.lit(0x7FFF))) for p in range(3)))
    plain = keyed.join(busy, "key", "left_anti")
    dealt = keyed.join(busy, "key", "left_semi").withColumn("rest", outside).select(F.explode(parts).alias("key"), "fp")
    rows = plain.union(dealt).repartition(n, "key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(_verify, "a long, b long").distinct()


def roots_of(fps: DataFrame) -> DataFrame:
    """its (a fingerprint), root (a fingerprint of its component): for every fingerprint in fps."""
    distinct = saved(fps.select("fp").distinct(), "simhash-distinct")
    roots = components(linked(distinct))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("its"), F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = saved(fingerprints(docs, size, id_col, text_col), "simhash")
    roots = saved(roots_of(fps), "simhash-roots")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, F.col("fp") == F.col("its")).groupBy("root").agg(F.min("first").alias("component_id"))
    of = saved(roots.join(least, "root").select("its", "component_id"), "simhash-components")
    return fps.join(of, F.col("fp") == F.col("its")).select("doc_id", "fp", "component_id")


# near copies of whole texts: Golay codewords of long fingerprints find the candidates, 256 of the bits filter, sets decide

WORDS = 144  # of 23 bits in a document's long fingerprint
STEPS = [1, 5]  # a key is the codewords of a word and of the one so many further on: 288 keys, a pair at 0.8 shares none with a chance of 0.00002
ROUNDS = [(0, 96), (96, 192), (192, 288)]  # keys looked at together: as many as the disk takes at once
MEMBERS = 4096  # different signatures under one key beyond which all are candidates, or it is dealt out in blocks
SPREAD = 32  # parts in which the members of a group meet its first row
WIDE_BITS = 256  # of a document's fingerprint: four words of 64
_SALTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]
_LONG_SALTS = np.r_[np.array(_SALTS, np.uint64), np.random.default_rng(42).integers(0, 1 << 63, -(-23 * WORDS // 64) - 4, np.uint64) * np.uint64(2) + np.uint64(1)]
_CODEWORDS = (np.arange(4096) << 11) ^ _remainder(np.arange(4096) << 11)
_SIGNS = ((_CODEWORDS[:, None] >> np.arange(23) & 1) * 2 - 1).astype(np.int32)


SHORT = 64  # shingles of a text below which its fingerprint is a coarse estimate and first shingles are its keys
SHORT_RADIUS = 96  # for those: at 0.8 no sizes of sets have more than 48 bits to be expected, sd 6.2


def wide_radius(similarity: float) -> int:
    """Differing bits of WIDE_BITS that pairs of a Jaccard similarity don't exceed: those to be expected and five standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE_BITS * share + 5 * np.sqrt(WIDE_BITS * share * (1 - share)))


def _sizes_allow(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


def _left_allow(n: np.ndarray, place: np.ndarray, m: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles can be similar whose first common one is at `place` and `at` of their orders (0: their sizes allow it)."""
    return np.minimum(n - place, m - at) >= similarity / (1 + similarity) * (n + m) - 1e-6


def shingle_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """Hashes of a text's shingles in their order; all words are one where there are fewer than `size`."""
    if not words:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    shingles = (words,) if len(words) < size else zip(*(words[i:] for i in range(size)), strict=False)
    return np.array([h64(b" ".join(s), 42) for s in shingles], np.uint64)


def _mixed(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.asarray(salt, np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def long_sums(own: np.ndarray) -> np.ndarray:
    """For each bit of the long fingerprint the shingles that set it less those that don't; the first WIDE_BITS are the short one's."""
    ones = np.zeros(64 * len(_LONG_SALTS), np.int32)
    for lo in range(0, len(own), 255):  # so that sums fit into bytes
        ones += np.unpackbits(_mixed(own[lo : lo + 255, None], _LONG_SALTS).astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return ones * 2 - len(own)


def golay_nearest(sums: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each row of 23 sums: the best by their signs with any of the four weakest turned."""
    hard = (sums > 0) @ (1 << np.arange(23))
    weak = np.int64(1) << np.argpartition(np.abs(sums).astype(np.int64) * 32 + np.arange(23), 4, axis=1)[:, :4]
    best = np.full(len(sums), np.iinfo(np.int64).min)
    for turned in range(16):
        index = golay_index(hard ^ weak[:, [k for k in range(4) if turned >> k & 1]].sum(1))
        best = np.maximum(best, np.einsum("ij,ij->i", sums, _SIGNS[index]).astype(np.int64) * 4096 + index)
    return best & 4095


def codes(sums: np.ndarray) -> np.ndarray:
    """Codeword indices [documents, WORDS] of long_sums() [documents, bits]."""
    words = np.ascontiguousarray(sums[:, : 23 * WORDS]).reshape(-1, 23)
    return golay_nearest(words).reshape(-1, WORDS).astype(np.uint16)


def code_keys(own: np.ndarray, first: int = 0, end: int = WORDS * len(STEPS)) -> np.ndarray:
    """Keys number `first` up to `end` of codes [documents, WORDS]: the codewords of a word and of the one a step further on."""
    number = np.arange(first, end)
    word, step = number % WORDS, np.array(STEPS)[number // WORDS]
    pair = own[:, word].astype(np.uint64) << np.uint64(12) | own[:, (word + step) % WORDS]
    return _mixed(number.astype(np.uint64) << np.uint64(24) | pair, _SALTS[1])


def first_keys(own: np.ndarray, similarity: float) -> np.ndarray:
    """First shingles of a sorted set: two sets with the Jaccard similarity share one if one has less than SHORT shingles.

    Sets of n shingles that are similar enough have one in common among their first n - similarity * n + 1 by hash.
    """
    n = len(own)
    if not n:
        return np.zeros(1, np.uint64)
    if n > (SHORT - 1) / similarity:  # not similar to a short one
        return np.zeros(0, np.uint64)
    return _mixed(own[: n - int(np.ceil(similarity * n - 1e-9)) + 1], _SALTS[2])


def near_keys(own: np.ndarray, similarity: float) -> np.ndarray:
    """All keys of a sorted set of shingle hashes: two sets with the Jaccard similarity share one, with the chances given above."""
    return np.unique(np.r_[code_keys(codes(long_sums(own)[None]))[0], first_keys(own, similarity)])


def signatures(texts: list[list[bytes]], size: int = 5, similarity: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each text a hash of its set of shingles, four words of the set's fingerprint, its size, its codes and its first shingles' keys."""
    sets = [np.unique(shingle_hashes(words, size)) for words in texts]
    sums, n = np.stack([long_sums(own) for own in sets]), np.array([len(own) for own in sets], np.int64)
    wide = np.packbits(sums[:, :WIDE_BITS] > 0, axis=1).view(">u8").astype(np.uint64)
    return np.array([xxhash.xxh64_intdigest(own.tobytes()) for own in sets], np.uint64), wide, n, codes(sums), [first_keys(own, similarity) for own in sets]


def _radii(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.where(np.minimum(a, b) < SHORT, max(radius, SHORT_RADIUS), radius)


def wide_links(f: np.ndarray, n: np.ndarray, radius: int, similarity: float, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one group: fingerprints f [members, 4] within radius whose sizes n, and places, allow the similarity.

    Pairs with a set of fewer than SHORT shingles need only be within SHORT_RADIUS. Pairs that are tied already aren't
    compared, so a group of copies of one text takes time in proportion to its members.
    """
    root = np.arange(len(f))
    place = np.zeros(len(f), np.int64) if place is None else place
    for i in range(len(f) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[_left_allow(n[rest], place[rest], n[i], place[i], similarity)]
        if not len(rest):
            continue
        hit = rest[np.bitwise_count(f[rest] ^ f[i]).sum(1, dtype=np.int16) <= _radii(n[rest], n[i], radius)]
        if len(hit):
            joined = np.unique(np.r_[root[i], root[hit]])
            root[np.isin(root, joined)] = joined[0]
    tied = np.flatnonzero(root != np.arange(len(f)))
    return tied, root[tied]


SIGNED = "sig long, f0 long, f1 long, f2 long, f3 long, n long"


def coded(signed: DataFrame, first: int, end: int) -> DataFrame:
    """(key, sig): keys number `first` up to `end` of all signatures' codes."""

    def emit(batches):
        for batch in batches:
            sig = batch.column(0).to_numpy()
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, WORDS)
            for lo in range(0, len(sig), 1000):
                keys = code_keys(own[lo : lo + 1000], first, end)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(sig[lo : lo + 1000], end - first))], ["key", "sig"])

    return signed.select("sig", "codes").mapInArrow(emit, "key long, sig long")


def busy_keys(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (key, sig): (key, members) of keys that two or more have, and (sig) of the keys with more than MEMBERS."""
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "near-keys")
    return sizes, keyed.join(sizes.where(F.col("members") > MEMBERS).select("key"), "key", "left_semi").select("sig")


def near_linked(signed: DataFrame, similarity: float, keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups (grp, sig) of signatures (SIGNED) that share a key with at most MEMBERS and may be close enough.

    A key's signatures whose fingerprints tie them together are a group; the same group under other keys is one.
    """
    facts = sizes.where(F.col("members") <= MEMBERS).select(F.col("key").alias("k"))
    rows = keyed.join(facts, F.col("key") == F.col("k")).select("key", "sig", F.lit(0).cast("long").alias("place"))
    whole = rows.join(signed.select(F.col("sig").alias("s"), "f0", "f1", "f2", "f3", "n"), F.col("sig") == F.col("s")).drop("s")
    return grouped(whole, similarity)


def grouped(rows: DataFrame, similarity: float) -> DataFrame:
    """Groups (grp, sig) of rows (key, SIGNED, place): what is tied together under a key by pairs that may be similar."""
    radius, n = wide_radius(similarity), shuffle_partitions(rows.sparkSession)

    def verify(batches):
        held = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(8)], 1)
            held = rows if held is None else np.concatenate([held, rows])
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if cut:
                yield _near_groups(held[:cut], radius, similarity)
                held = held[cut:]
        if held is not None:
            yield _near_groups(held, radius, similarity)

    sorted_ = rows.select("key", "sig", "f0", "f1", "f2", "f3", "n", "place").repartition(n, "key").sortWithinPartitions("key", "sig")
    return sorted_.mapInArrow(verify, "grp long, sig long").distinct()


def _near_groups(rows: np.ndarray, radius: int, similarity: float) -> pa.RecordBatch:
    """rows sorted by key: key, sig, f0..f3, n, place."""
    key, sig, f, n, place = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:6]).view(np.uint64), rows[:, 6], rows[:, 7]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    own = np.repeat(size, size)
    first, second = [], []
    for d in range(1, int(size[size <= 64].max(initial=0))):
        i = np.flatnonzero((key[d:] == key[:-d]) & (own[d:] <= 64))
        i = i[_left_allow(n[i], place[i], n[i + d], place[i + d], similarity)]
        i = i[np.bitwise_count(f[i] ^ f[i + d]).sum(1) <= _radii(n[i], n[i + d], radius)]
        first.append(i)
        second.append(i + d)
    for g in np.flatnonzero(size > 64):
        part = slice(start[g], start[g] + size[g])
        i, j = wide_links(f[part], n[part], radius, similarity, place[part])
        first.append(i + start[g])
        second.append(j + start[g])
    i, j = (np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in (first, second))
    root = local_forest(i, j, len(key))
    tied = np.flatnonzero((np.bincount(root, minlength=len(key)) > 1)[root])
    name = np.zeros(len(key), np.uint64)  # of a group: by its members, in any order
    np.add.at(name, root[tied], _mixed(sig[tied].view(np.uint64), _SALTS[3]))
    return pa.RecordBatch.from_arrays([pa.array(name[root[tied]].view(np.int64)), pa.array(sig[tied])], ["grp", "sig"])


def rare_linked(sets: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Groups (grp, sig) of the sets (its, shingles) that share one of their rarest shingles and may be similar; loses no pair.

    Each set in the order of how many sets a shingle is in: two similar ones of n shingles share one among their first
    n - similarity * n + 1. So a set is in as many rows at most, however many others are near it, and sets that differ in
    shingles of their own don't meet. What stands before the first common shingle rules out more pairs by its length. A
    shingle with more than MEMBERS sets is dealt out in pairs of blocks.
    """
    single = sets.select("its", F.explode("shingles").alias("shingle"))
    often = saved(single.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "near-often")
    shared = single.join(often, "shingle").groupBy("its").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    own = shared.join(signed.select("sig", "f0", "f1", "f2", "f3", "n"), F.col("its") == F.col("sig"))
    alone = F.col("n") - F.size("shared")  # shingles that no other set has come first
    most = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - alone).cast("int")
    rows = own.where(most > 0).select("sig", "f0", "f1", "f2", "f3", "n", alone.alias("alone"), F.posexplode(F.slice("shared", 1, most)).alias("at", "one"))
    rows = saved(rows.select(F.col("one.shingle").alias("key"), "sig", "f0", "f1", "f2", "f3", "n", (F.col("alone") + F.col("at")).cast("long").alias("place")), "near-rare")
    busy = rows.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("key", "k")
    busy = saved(busy, "near-busy")
    if not busy.isEmpty():
        block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", F.least(b, block), F.greatest(b, block)))
        dealt = rows.join(busy, F.col("key") == F.col("k")).withColumn("key", F.explode(tiles)).drop("k", "blocks")
        rows = rows.join(busy, F.col("key") == F.col("k"), "left_anti").unionByName(dealt)
    return grouped(rows, similarity)


def set_links(flat: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Smallest member that each member of a group reaches over pairs at the Jaccard similarity or more.

    Member i's distinct shingles are flat[at[i] : at[i + 1]]. Pairs that are tied already aren't compared.
    """
    n = np.diff(at)
    root = np.arange(len(n))
    ids = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(ids.max(initial=-1) + 1, np.int8)
    for i in range(len(n) - 1):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        others = others[_sizes_allow(n[others], n[i], similarity)]
        if not len(others):
            continue
        if n[i] == 0:
            hit = n[others] == 0
        else:
            mine, end = ids[at[i] : at[i + 1]], np.r_[0, np.cumsum(n[others])]
            mark[mine] = 1
            sums = np.r_[0, np.cumsum(mark[ids[np.repeat(at[others] - end[:-1], n[others]) + np.arange(end[-1])]], dtype=np.int64)]
            mark[mine] = 0
            both = np.diff(sums[end])
            hit = both >= similarity * (n[i] + n[others] - both) - 1e-9
        hit = others[hit]
        if len(hit):
            joined = np.unique(np.r_[root[i], root[hit]])
            root[np.isin(root, joined)] = joined[0]
    return root


def set_linked(groups_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of signatures of one group (grp, sig) whose sets (its, shingles) have the Jaccard similarity: a forest for each group."""
    n = shuffle_partitions(groups_.sparkSession)

    def edges(held):
        group, sig = held.column(0).to_numpy(), held.column(1).to_numpy()
        flat, at = held.column(2).flatten().to_numpy(), np.r_[0, np.cumsum(held.column(2).value_lengths().to_numpy())]
        start = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        a, b = [], []
        for lo, hi in zip(start[:-1], start[1:], strict=True):
            root = set_links(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], similarity)
            tied = np.flatnonzero(root != np.arange(hi - lo))
            a.append(sig[lo + root[tied]])
            b.append(sig[lo + tied])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def verify(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            group = held.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if cut:
                yield edges(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held)

    rows = groups_.join(sets, F.col("sig") == F.col("its")).select("grp", "sig", "shingles")
    return rows.repartition(n, "grp").sortWithinPartitions("grp", "sig").mapInArrow(verify, "a long, b long").distinct()


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id; all columns stay as they are.

    Near copies are those whose sets of shingles have a Jaccard similarity of at least `similarity` (near_keys says which
    of them meet for sure); groups are components of such links.
    Texts without words are copies of each other; of rows that repeat an id the one with the least checksum of its text
    stays, null ids come last. Texts are never shuffled: what is found out about a row goes back to it by its place.
    """
    spark, at = docs.sparkSession, located(docs)
    tagged = at.select(at["doc_id"].cast("long").alias("id"), at["text"].alias("text"), F.xxhash64(at["text"]).alias("mark"), "__file", "__row")

    def run(batches):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(lo, 256)
                sig, f, n, own, keys = signatures([words_of(t.as_py()) for t in batch.column(1)], size, similarity)
                columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (sig, *f.T, n)]
                columns += [pa.array([c.tobytes() for c in own], pa.binary()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], ["id", "mark", "file", "row", "sig", "f0", "f1", "f2", "f3", "n", "codes", "keys"])

    made = saved(tagged.mapInArrow(run, f"id long, mark long, file long, row long, {SIGNED}, codes binary, keys array<long>"), "near-signatures")
    signed = saved(made.groupBy("sig").agg(*(F.min(c).alias(c) for c in ("f0", "f1", "f2", "f3", "n")), F.first("codes").alias("codes"), F.first("keys").alias("keys")), "near-distinct")

    def whole(batch, found, sigs):
        own = [np.unique(shingle_hashes(words_of(t.as_py()), size)).view(np.int64) for t in batch.column(0).filter(pa.array(found))]
        return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(own, pa.list_(pa.int64()))], ["its", "shingles"])

    def sets_of(sigs):
        """One text for each signature of a group; its set is made anew, so that sets of other texts are never written."""
        needed = made.join(sigs, "sig").groupBy("sig").agg(F.min(F.struct("file", "row")).alias("one")).select("one.file", "one.row", F.col("sig").alias("mark"))
        return saved(with_marks(at.select("text", *PLACE), needed, whole, "its long, shingles array<long>"), "near-sets")

    wanted = []  # signatures with another one under a key that may be close enough; all those of busy keys
    for first, end in ROUNDS:
        keyed = coded(signed, first, end)
        if end == ROUNDS[-1][1]:  # and for sets of few shingles, so that none is lost
            keyed = keyed.union(signed.select(F.explode("keys").alias("key"), "sig"))
        sizes, busy = busy_keys(keyed)
        near = near_linked(signed, similarity, keyed, sizes).select("sig")
        if not sizes.where(F.col("members") > MEMBERS).isEmpty():
            near = near.union(busy)
        wanted.append(saved(near.distinct(), "near-wanted"))
        tidy(spark)
    sets = sets_of(reduce(DataFrame.union, wanted).distinct())
    groups_ = saved(rare_linked(sets, signed, similarity), "near-groups")
    rooted = components(saved(set_linked(groups_, sets, similarity), "near-edges"))
    tidy(spark)
    roots = signed.join(rooted, F.col("sig") == F.col("node"), "left").select(F.col("sig").alias("its"), F.coalesce("root", "sig").alias("root"))
    rank = F.struct(F.col("id").isNull().alias("null"), "id", "mark", "file", "row")
    per = made.groupBy("sig").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))  # a row a signature, however many copies it has
    per = saved(per.join(roots, F.col("sig") == F.col("its")).select("sig", "root", "first", "copies"), "near-texts")
    first = saved(per.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("size")).where("size > 1").select(F.col("root").alias("r"), "first"), "near-first")
    # a group or a signature may hold a third of all rows: what its members look up is laid out SPREAD times, and they are dealt to those
    laid = lambda df: df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SPREAD)).cast("int").alias("salt")
    several = laid(first.select("r"))
    several = per.select("sig", "root", salt("sig")).join(several, (F.col("root") == F.col("r")) & (F.col("salt") == F.col("s")), "left_semi").select(F.col("sig").alias("its"))
    several = laid(several)
    out = made.select("sig", "file", "row", salt("file", "row")).join(several, (F.col("sig") == F.col("its")) & (F.col("salt") == F.col("s")), "left_semi")
    out = out.select("file", "row").join(first.select("first.file", "first.row"), ["file", "row"], "left_anti")
    return without(at, out)


def op7(spark, sf_dir) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
