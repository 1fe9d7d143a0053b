import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import ann, components, decontaminate, mixing, registry, rowmarks, sharding, simhash, suffixes

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


# nearest neighbours


def test_ann_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found, facts = ann.search(rows, rows.where("vec_id % 20 = 0"))
    assert facts["recall"] >= 0.95 and 1 <= facts["visits"] <= facts["leaves"]
    table = rows.toPandas()
    x, ids = np.array([np.array(v, float) for v in table.embedding]), table.vec_id.to_numpy()
    hit = total = 0
    for q, own in found.toPandas().sort_values("rank").groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        true = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len(set(ids[true]) & set(own.vec_id))
        total += 10
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.is_monotonic_increasing
        assert all(d[ids == r.vec_id][0] == r.score for r in own.itertuples())
    assert hit / total >= 0.9


def test_ann_with_one_very_common_vector(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).round(3).tolist()) for i in range(900)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)
    found, _ = ann.search(rows, rows.where("vec_id % 50 = 0"), k=4, target=1.0)
    x = np.array([v for _, v in vectors])
    for q, own in found.toPandas().sort_values("rank").groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert own.vec_id.tolist() == [i for i in np.lexsort((np.arange(900), d)) if i != q][:4]


def test_ann_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 8 * 5 * 40)  # 40 vectors a shard
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 5)), rng.normal(size=(200, 5)) * 1e-9 + 3, rng.normal(size=(20, 5)) * 1e160])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    found, facts = ann.search(rows, rows.where("vec_id % 9 = 0"), k=6, target=1.0)
    got = found.toPandas().sort_values("rank")
    assert got.query_id.nunique() == 69 and facts["recall"] == 1.0
    hit = total = 0
    for q, own in got.groupby("query_id"):
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:6]
        hit += len(set(true) & set(own.vec_id))
        total += 6
        assert all(d[r.vec_id] == r.score for r in own.itertuples())
    assert hit / total > 0.97


def test_shards_hold_what_fits():
    first, parts = ann.shards_of(np.array([3, 4, 5, 30, 0, 2, 10, 1]), 10)
    assert first.tolist() == [0, 0, 1, 2, 4, 5, 6, 7] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1] or (first[3], parts[3]) == (2, 3)
    seen = {}
    for leaf, n in enumerate([3, 4, 5, 30, 0, 2, 10, 1]):
        for s in range(first[leaf], first[leaf] + parts[leaf]):
            seen[s] = seen.get(s, 0) + n / parts[leaf]
    assert all(n <= 10 for n in seen.values())


def test_best_bins_come_first():
    x = np.random.default_rng(1).normal(size=(600, 4))
    tree = ann.fit(x)
    leaf = tree.assign(x)
    assert tree.leaves == len(set(leaf)) and sorted(tree.order(x[0], tree.leaves)) == list(range(tree.leaves))
    assert all(tree.order(x[i], 1) == [leaf[i]] for i in range(50))


# decontamination


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute_similarity(docs, items, threshold=0.8):
    """(doc, item) -> best similarity over windows of as many shingles as the item has."""
    shingles = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    items = {i: words(t) for i, t in items if t and words(t)}
    size = {i: min(5, len(w)) for i, w in items.items()}
    bags = {i: collections.Counter(shingles(w, size[i])) for i, w in items.items()}
    df = collections.Counter(s for b in bags.values() for s in b)
    n = len(items)
    weight = lambda s: math.log1p(n / df[s]) if s in df else math.log1p(n)
    out = {}
    for d, t in docs:
        for i, bag in bags.items():
            own = shingles(words(t or ""), size[i])
            if not set(own) & set(bag):
                continue
            m = min(len(own), sum(bag.values()))
            for s in range(len(own) - m + 1):
                part = collections.Counter(own[s : s + m])
                low = sum(weight(x) * min(c, part[x]) for x, c in bag.items())
                high = sum(weight(x) * c for x, c in bag.items()) + sum(weight(x) * c for x, c in part.items()) - low
                if low / high >= threshold - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), round(low / high, 9))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 50)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if d % 3:
            w = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(0, 3)):  # a few changed, dropped or added words
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k].upper() + ",", "x"]])
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((d, " ".join(body)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["id"], r["item_id"]): r["similarity"] for r in found.collect()}
    want = brute_similarity(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 5


def test_decontamination_both_ways_to_send_the_benchmark(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "MAX_SENT", 0)
    assert {tuple(r) for r in decontaminate.contaminated(docs, items).collect()} == one


def test_decontamination_on_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.op4(spark, SF).collect()}
    assert got == pytest.approx(brute_similarity(docs, items))


def test_fingerprints_of_windows(spark):
    rng = random.Random(2)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 40, 700)]
    got = spark.createDataFrame([(r,) for r in rows], "h array<long>").select("h", decontaminate.simhash(F.col("h")).alias("fp")).collect()
    for r in got:
        assert r["fp"] % (1 << 64) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in r["h"]) * 2 > len(r["h"]))


def test_decontamination_beyond_the_radius(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "RADIUS", 3)
    assert one and {tuple(r) for r in decontaminate.contaminated(docs, items).collect()} == one


def test_decontamination_of_short_items_and_long_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    body = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, body(k)) for i, k in enumerate((1, 2, 3, 4, 5, 6, 9, 30))] + [(8, "w1 w2 w3 w4 w5 w6 w7"), (9, "w1 w2 w3 w4 w5 w6 w7 w8")]
    docs = [(d, body(rng.randrange(0, 300)) + " " + items[d % 10][1] + " " + body(rng.randrange(0, 200)) + " " + items[d % 7][1]) for d in range(30)] + [(99, items[7][1][:-3])]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]): r["similarity"] for r in found.collect()} == pytest.approx(brute_similarity(docs, items))


def test_hamming_blocks_find_everything_within_radius():
    edges = decontaminate._EDGES
    rng = random.Random(5)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1)):
            b ^= 1 << bit
        parts = [((a >> lo) & ((1 << hi - lo) - 1), (b >> lo) & ((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        assert any((x ^ y).bit_count() <= 1 for x, y in parts)


# mixing


def test_mixing_oracle(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    theirs = db.sql(registry.ORACLES["op5_mixing"]).df()
    ours = mixing.op5(spark, SF).toPandas()
    key = ["doc_id", "epoch"]
    ours, theirs = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs) > 0 and (ours.astype(str) == theirs.astype(str)).all().all()


def fill(children, budget):
    """Weighted shares with caps, by rounds: whoever is full leaves the rest to the others."""
    got, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        if not total:
            break
        full = [k for k, (w, cap) in open_.items() if cap * total <= budget * w]
        if not full:
            return got | {k: budget * w // total for k, (w, _) in open_.items()}
        for k in full:
            got[k] = open_.pop(k)[1]
            budget -= got[k]
    return got | dict.fromkeys(open_, 0)


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d1", "en", "a", 100), ("d1", "en", "b", 10), ("d1", "de", "a", 1000), ("d2", "en", "c", 5000), ("d2", "fr", "d", 0)]
    weights = [{"d1": 5, "d2": 5}, {"en": 3, None: 1}, {None: 1}]
    df = spark.createDataFrame([(*x, x[3]) for x in leaves], "domain string, lang string, source string, tokens long, cap long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(df, weights, 0.3).collect()}
    whole = int(6110 * 0.3)
    top = fill({"d1": (5, 1110), "d2": (5, 5000)}, whole)
    langs = {"d1": fill({"en": (3, 110), "de": (1, 1000)}, top["d1"]), "d2": fill({"en": (3, 5000), "fr": (1, 0)}, top["d2"])}
    want = {("d1", "de", "a"): langs["d1"]["de"], ("d2", "en", "c"): langs["d2"]["en"], ("d2", "fr", "d"): 0}
    want |= {("d1", "en", k): v for k, v in fill({"a": (1, 100), "b": (1, 10)}, langs["d1"]["en"]).items()}
    assert got == want and got["d1", "en", "a"] == 100 and got["d1", "de", "a"] == top["d1"] - 110


def test_epochs_are_whole_before_the_last(spark):
    rows = mixing.op5(spark, SF).toPandas()
    for _, own in rows.groupby(["domain", "lang", "source"]):
        budget = own.budget.iloc[0]
        assert own.taken.sum() == budget
        first = own[own.epoch == 0]
        assert not own.duplicated(["doc_id", "epoch"]).any() and set(own[own.epoch == 1].doc_id) <= set(first.doc_id)
        assert (own.sort_values("first_token").first_token.diff().dropna() >= 0).all()


def test_select_takes_copies_one_by_one(spark):
    rows = [(1, "a b c d e f g h i j", "en", "s", k % 3) for k in range(100)] + [(None, "x y", None, None, 0)] * 10 + [(2, None, "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int").repartition(6)
    weights = [{None: 1}, {None: 1}, {None: 1}]
    placed = mixing.mixed(mixing.prepared(docs), fraction=0.8, max_epochs=1, weights=weights).collect()
    assert sum(r["taken"] for r in placed) == int(1020 * 0.8)
    assert len({(r["doc_id"], r["copy"]) for r in placed}) == len(placed) and all(0 <= r["copy"] < r["copies"] for r in placed)
    kept = mixing.select(docs)
    assert kept.columns == docs.columns
    counts = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = collections.Counter((r["doc_id"], {1: rows[0][1], None: "x y", 2: None}[r["doc_id"]]) for r in mixing.mixed(mixing.prepared(docs), max_epochs=1).collect())
    assert counts == want and 70 <= counts[1, rows[0][1]] < 100


def test_null_ids_are_spread_over_the_order(spark):
    docs = spark.createDataFrame([(None, f"t{k} " * 3, "en", "s") for k in range(400)], "doc_id long, text string, lang string, source string")
    rows = mixing.mixed(mixing.prepared(docs), max_epochs=1).collect()
    assert len(rows) in (320, 321) and len({r["first_token"] for r in rows}) == len(rows)


def brute_mixture(docs, seed=1, fraction=0.8, epochs=1):
    """Rows taken with whole lists: budgets by fill(), each leaf in the order of md5 sums."""
    leaf = collections.defaultdict(list)
    for i, t, lang, source in docs:
        digits = re.search("[0-9]+$", source or "")
        leaf[f"domain{int(digits[0]) % 3 if digits else 0}", lang or "", source or ""].append((i, t or ""))
    tokens = {k: sum(len(t.split()) for _, t in v) for k, v in leaf.items()}
    weight = lambda table, key: table.get(key, table.get(None, 0))

    def down(keys, level, budget):
        if level == 3:
            return {keys[0]: budget}
        groups = collections.defaultdict(list)
        for k in keys:
            groups[k[level]].append(k)
        shares = fill({g: (weight([mixing.DOMAINS, mixing.LANGS, mixing.SOURCES][level], g), epochs * sum(tokens[k] for k in own)) for g, own in groups.items()}, budget)
        return {k: v for g, own in groups.items() for k, v in down(own, level + 1, shares[g]).items()}

    whole = min(epochs * sum(tokens.values()), int(sum(tokens.values()) * fraction))
    out = collections.Counter()
    for k, budget in down(sorted(leaf), 0, whole).items():
        for epoch in range(epochs):
            at = epoch * tokens[k]
            order = sorted(leaf[k], key=lambda r: (hashlib.md5(f"{seed}:{epoch}:{'null' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()))
            for i, t in order:
                if at < budget:
                    out[i, t] += 1
                at += len(t.split())
    return out


def test_mixing_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    kept = collections.Counter((r["doc_id"], r["text"] or "") for r in mixing.select(docs).collect())
    assert kept == brute_mixture([tuple(r) for r in docs.collect()])


# suffixes


def brute_removed(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        if i is not None:
            for p in range(len(raw) - 49):
                if first[raw[p : p + 50]] < i:
                    mark[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(raw, mark, strict=True) if not m)
        out.append((i, len(raw), sum(mark), sum(1 for j in range(len(mark)) if mark[j] and (j == 0 or not mark[j - 1])), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def made_rows(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    shared = [text(rng.randrange(30, 140)) for _ in range(6)] + ["ab" * 60, "x" * 70]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(0, 90)) for _ in range(rng.randrange(0, 6))]
        rows.append((None if i == 7 else i // 2 if i > 50 else i, None if i == 9 else "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,many,piece", [(1, 16, 1 << 20), (2, 2, 1 << 20), (3, 16, 160)])
def test_suffixes_against_brute_force(spark, monkeypatch, seed, many, piece):
    rows = made_rows(seed)
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    got = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_removed(rows)


def test_long_texts_in_pieces_cover_all_windows():
    data = np.frombuffer(random.Random(1).randbytes(700), np.uint8)
    seen = []
    old = suffixes.PIECE
    suffixes.PIECE = 128
    try:
        for part, ends, row, offset in suffixes.pieces(data, np.array([0, 300, 320, 700])):
            lo, hi, text, *_ = suffixes.runs(part, ends)
            begin = np.r_[0, ends[:-1]] - offset
            seen += [(row[t], w - begin[t]) for a, b, t in zip(lo, hi, text, strict=True) for w in range(a, b + 1)]
    finally:
        suffixes.PIECE = old
    assert sorted(seen) == [(r, w) for r, n in ((0, 300), (1, 20), (2, 380)) for w in range(n - 49)]


def test_multikey_order():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    order = suffixes.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys), strict=True))


def test_blobs_round_trip():
    a, b = np.array([5, 0, 2**64 - 1], np.uint64), np.array([-1, 7, 2**40])
    x, y = suffixes.unpack(suffixes.pack(a, b), "ui")
    assert (x == a).all() and (y == b).all()


# SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            root[f] = f = root[root[f]]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7(spark, SMALL).collect()}
    ids = [r["doc_id"] for r in docs]
    fps = [plain_fingerprint(r["text"]) for r in docs]
    assert [rows[i][0] for i in ids] == [f"{f:016x}" for f in fps] and [rows[i][1] for i in ids] == brute_components(ids, fps)


def clustered(seed, centres, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    out = []
    for _ in range(n):
        f = int(base[rng.integers(centres)])
        for bit in rng.integers(0, 64, rng.integers(0, 5)):
            f ^= 1 << int(bit)
        out.append(f)
    return out


@pytest.mark.parametrize("hot", [1024, 8])
def test_links_among_clusters(spark, hot):
    fps = sorted(set(clustered(4, 6, 500)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), hot=hot)
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = brute_components(signed, fps)
    groups = collections.defaultdict(set)
    for s, c in zip(signed, want, strict=True):
        groups[c].add(s)
    for own in groups.values():
        assert {roots.get(s, s) for s in own} == {min(own)}


@pytest.mark.parametrize("n", [40, 900, 3000, 6000])
def test_group_links_connect_what_links(n):
    fps = np.unique(np.array(clustered(n, max(1, n // 300), n), np.uint64))
    i, j = simhash.group_links(fps)
    assert (np.bitwise_count(fps[i] ^ fps[j]) <= 2).all() or len(fps) > 64  # forests tie to a root
    a, b = [], []
    for lo in range(0, len(fps), 500):
        x, y = np.nonzero(np.bitwise_count(fps[lo : lo + 500, None] ^ fps[None]) <= 2)
        a.append(x + lo)
        b.append(y)
    want = components.local_forest(np.concatenate(a), np.concatenate(b), len(fps))
    assert (components.local_forest(i, j, len(fps)) == want).all()


def test_golay_code_is_perfect():
    index = simhash.golay_index(np.arange(1 << 23))
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_two_flips_share_a_key():
    f = np.random.default_rng(9).integers(0, 1 << 63, 6, dtype=np.uint64)
    row, key = simhash.fuzzy_keys(f)
    for a in range(64):
        for b in range(a, 64):
            r, k = simhash.fuzzy_keys(f ^ np.uint64((1 << a) | (1 << b)))
            assert all(set(key[row == i]) & set(k[r == i]) for i in range(6))


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_queries(spark, monkeypatch):
    """The driver's memory grows with every query, so what a task can hold takes one, and stars no round more."""
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i * i % 97) for i in range(97)]
    want = collections.defaultdict(set)
    for held, most in [(500_000, 1), (7, 12)]:  # in one task's forest, and over many, which takes rounds
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(held, 10_000))
        made, save = [], components.saved
        monkeypatch.setattr(components, "saved", lambda df, kind, save=save, made=made: made.append(kind) or save(df, kind))
        got = components.components(spark.createDataFrame(edges, "a long, b long").coalesce(1), at_once=held).collect()
        monkeypatch.setattr(components, "saved", save)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want[frozenset((r["node"], r["root"]) for r in got)].add(held)
        assert len(got) == len({r["node"] for r in got}) and 1 <= len(made) <= most, made
        assert (len(made) > 1) == (held == 7)
    assert len(want) == 1 and all(root == 0 for node, root in next(iter(want)) if node <= 300)


# sharding


@pytest.mark.parametrize("shards", [8, 3])
def test_shards_match_the_mixture(spark, shards):
    rows = sharding.op10(spark, SF, shards).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").toPandas().set_index("doc_id")
    counts = rows.groupby("shard").size()
    assert len(counts) == shards and counts.max() - counts.min() <= 1
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    mixture = rows.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2
    for r in rows.itertuples():
        raw = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_of_few_rows_and_hot_source(spark):
    few = spark.createDataFrame([(1, "a", "s"), (2, "b", None)], "doc_id long, text string, source string")
    assert sorted(r["slot"] for r in sharding.assign(few).collect()) == [0, 0]
    hot = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, concat('s', id), 'hot') as source")
    out = sharding.interleaved(sharding.measured(hot), 5).groupBy("shard").agg(F.count("*").alias("n"), F.sum((F.col("source") == "hot").cast("int")).alias("h")).collect()
    assert {r["n"] for r in out} == {800} and max(r["h"] for r in out) - min(r["h"] for r in out) < 40


def brute_shards(rows, shards):
    """rows (id, source, size, crc) in order of the fractions of their ranks, one list; the hash is Spark's."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    placed = []
    for own in by.values():
        own.sort(key=lambda r: (r["h"] % (1 << 64), r["doc_id"]))
        placed += [((k + r["shift"]) / len(own), "-" if r["source"] is None else "+" + r["source"], r) for k, r in enumerate(own)]
    placed.sort(key=lambda x: (x[0], x[1], x[2]["h"], x[2]["doc_id"]))
    n, seen, out = len(placed), collections.Counter(), {}
    for p, (_, _, r) in enumerate(placed):
        shard = p * shards // n
        out[r["doc_id"]] = shard, seen[shard]
        seen[shard] += 1
    return out


@pytest.mark.parametrize("shards", [8, 3])
def test_shards_against_brute_force(spark, shards):
    rows = sharding.measured(spark.read.parquet(f"{SF}/documents.parquet"))
    facts = rows.select("*", F.xxhash64(F.lit(0), "doc_id", "size", "text_crc32").alias("h"), (F.shiftrightunsigned(F.xxhash64(F.lit(1), F.concat(F.lit("+"), "source")), 11).cast("double") / float(1 << 53)).alias("shift"))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleaved(rows, shards, keys=["doc_id", "size", "text_crc32"]).collect()}
    assert got == brute_shards([r.asDict() for r in facts.collect()], shards)


def test_repeated_rows_take_a_place_each(spark):
    docs = spark.createDataFrame([(1, "a", "s", k) for k in range(50)] + [(None, None, None, 0)] * 7 + [(k, f"t{k}", "s", 0) for k in range(2, 30)], "doc_id long, text string, source string, slot int").repartition(5)
    out = sharding.assign(docs, 4)
    assert set(out.columns) == {"doc_id", "text", "source", "shard", "slot"}
    rows = out.collect()
    assert collections.Counter(r["text"] for r in rows) == collections.Counter(r["text"] for r in docs.collect())
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(22 if s == 0 else 21)]


# native operators keep to DataFrame functions


def test_native_plans_have_no_python(spark):
    for name in ("op5_mixing", "op10_sharding", "op4_decontamination"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def similar_pairs(rows, threshold):
    """Jaccard similarities of sets of five-word shingles, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    out = {}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    out[b, a] = both / (len(sets[a]) + len(sets[b]) - both)
    return out


def grouped(ids, pairs):
    root = {i: i for i in ids}
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = collections.defaultdict(set)
    for i in ids:
        k = i
        while root[k] != k:
            k = root[k]
        out[k].add(i)
    return out


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    body = lambda k: [rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(60)) for _ in range(k)]
    line = body(30)
    rows = []
    for i in range(60):
        text = body(rng.randrange(20, 300))
        rows.append((10 * i, " ".join(line + text if i % 3 == 0 else text)))  # a line that very many share
        if i % 4 == 0:
            for k in range(1, 4):
                own = rows[-k][1].split()
                for _ in range(len(own) // 120):
                    own[rng.randrange(len(own))] = "changed"
                rows.append((10 * i + k, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sig string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    close = similar_pairs(rows, 0.7)
    for own in grouped([i for i, _ in rows], [p for p, j in close.items() if j >= 0.88]).values():
        assert len(kept & own) <= 1
    assert all(any(i in p for p in close) for i, _ in rows if i not in kept) and len(kept) >= 60 - 1


def test_marks_find_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rowmarks, "MARKS", 50)
    table = spark.range(1000).select(F.col("id").alias("file"), F.concat(F.lit("t"), "id").alias("text"))
    table.repartition(7).write.parquet(f"{tmp_path}/t")
    for rows in (spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/t").where("file > 10"), table):
        at = rowmarks.located(rows)
        n = at.count()
        places = at.select(F.col("file").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))
        left = rowmarks.without(at, places.where("id % 3 = 0"))
        assert left.columns == ["file", "text"] and sorted(r["file"] for r in left.collect()) == [i for i in range(1000 - n, 1000) if i % 3]
        got = rowmarks.with_marks(at, places.withColumn("mark", F.col("id")).where("id % 7 = 1").drop("id"), lambda b, found, v: pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(found)), pa.array(v)], ["a", "b"]), "a long, b long").collect()
        assert sorted(tuple(r) for r in got) == [(i, i) for i in range(1000 - n, 1000) if i % 7 == 1]
        assert rowmarks.without(at, places.where("false")).count() == n


def test_busy_keys_lose_nothing(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    one, line = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = []
    for i in range(90):  # copies of one text, each changed in its own way, and short texts that share most of a line
        own = list(one)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join([*line, *(word() for _ in range(rng.randrange(0, 12)))])) for i in range(60)]
    rows += [(200 + i, " ".join(word() for _ in range(100))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {min(own) for own in grouped([i for i, _ in rows], similar_pairs(rows, 0.8)).values()}
    for members in (4096, 16, 7):
        monkeypatch.setattr(simhash, "MEMBERS", members)
        assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == want


def test_near_copies_are_compared_under_few_keys(spark, monkeypatch):
    rng = random.Random(12)
    one = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows, compared, base = [], [], simhash.set_linked
    for i in range(120):  # of one text: a third is similar, the others are near it but too far from any
        own = list(one)
        for k in range(1 if i % 3 == 0 else 3):
            own[rng.randrange(40 * k, 40 * k + 40)] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    want = {min(own) for own in grouped([i for i, _ in rows], similar_pairs(rows, 0.8)).values()}
    monkeypatch.setattr(simhash, "set_linked", lambda groups_, *rest: compared.append(groups_.count()) or base(groups_, *rest))
    assert {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want
    assert 60 <= len(want) <= 85 and 0 < sum(compared) <= 10 * len(rows)


def test_wide_links_of_a_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (5, 4), dtype=np.uint64)
    f = base[rng.integers(0, 5, 300)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 63, (300, 4), dtype=np.uint64))
    n = rng.integers(90, 130, 300)
    pairs = [(i, j) for j in range(300) for i in range(j) if np.bitwise_count(f[i] ^ f[j]).sum() <= 20 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])]
    want = components.local_forest(*(np.array(x) for x in zip(*pairs, strict=True)), 300)
    found = components.local_forest(*simhash.wide_links(f, n, 20, 0.8), 300)
    assert {frozenset(np.flatnonzero(found == r)) for r in set(found)} == {frozenset(np.flatnonzero(want == r)) for r in set(want)}


# the pipeline, each stage against brute force on its own input


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = [i for i, _ in rows]
    kept = {r["doc_id"] for r in stages["near_dedup"](spark, docs, SMALL).collect()}
    close = similar_pairs(rows, 0.6)
    for _, own in grouped(ids, [p for p, j in close.items() if j >= 0.85]).items():
        assert len(kept & own) <= 1  # near copies: one at most
    for i in set(ids) - kept:
        assert any(i in p for p in close)  # clean documents stay
    clean = {r["doc_id"] for r in stages["decontamination"](spark, docs, SMALL).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean == set(ids) - {d for d, _ in brute_similarity(rows, items)}
    taken = {r["doc_id"] for r in stages["mixing"](spark, docs, SMALL).collect()}
    assert taken == {r["doc_id"] for r in mixing.mixed(mixing.prepared(docs), max_epochs=1).collect()} and 0 < len(taken) < len(ids)
    out = stages["sharding"](spark, docs, SMALL).toPandas()
    assert sorted(out.doc_id) == sorted(ids) and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1


def edited(rng, words, similarity):
    """words with single ones replaced as long as the five-word shingles keep the Jaccard similarity."""
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    own, now = shingles(words), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        more = [*now[:at], f"new{rng.random()}", *now[at + 1 :]]
        if len(own & shingles(more)) >= similarity * len(own | shingles(more)):
            now = more
    return now


def test_near_copies_at_the_limit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([300, 600]))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited(rng, text, 0.8)))]
        if i % 3 == 0:  # not similar enough, but no long way off
            other = edited(rng, text, 0.70)
            rows.append((1000 + i, " ".join(other)))
    close = similar_pairs(rows, 0.8)
    expected = {min(own) for own in grouped([i for i, _ in rows], close).values()}
    assert 60 <= len(close) and {i for i in expected if i >= 1000}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert not expected - kept  # nothing under the limit goes
    assert len(kept - expected) <= 3  # of 60: keys miss few


def test_sets_of_a_group():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 400)
    sets = [np.unique(base[rng.random(400) < keep]) for keep in [0.95] * 8 + [0.7] * 8] + [base[:0], base[:0], base[:1]]
    at = np.r_[0, np.cumsum([len(x) for x in sets])]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    expected = grouped(range(len(sets)), pairs)
    found = simhash.set_links(np.concatenate(sets), at, 0.8)
    assert {frozenset(np.flatnonzero(found == r)) for r in set(found)} == {frozenset(v) for v in expected.values()} and (16, 17) in pairs


def test_near_copies_of_short_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([5, 14, 20, 40, 66, 70, 80, 85]))]
        n = len(text) - 4
        more = [f"end{rng.random()}" for _ in range(rng.randrange(1, max(2, n // 4 + 1)))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, *more] if i % 2 else [*more, *text]))]
    close = similar_pairs(rows, 0.8)
    assert len(close) >= 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {min(own) for own in grouped([i for i, _ in rows], close).values()}


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, (1 << 64) - 1, 4000, np.uint64))
    for n in [*range(1, 100), 150, 400, 1500]:
        for _ in range(10):
            own = rng.permutation(pool)[: 2 * n]
            lost = int(rng.integers(0, n // 5 + 1))
            added = int((n - lost) / 0.8 - n + 1e-9)  # the most that leave 0.8
            a, b = np.sort(own[:n]), np.sort(own[lost : n + max(0, added)])
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
            assert np.isin(simhash.near_keys(a, 0.8), simhash.near_keys(b, 0.8)).any(), (n, len(b))


def test_nearest_codeword_by_sums():
    rng = np.random.default_rng(12)
    hard = rng.integers(0, 1 << 23, 3000)
    signs = (hard[:, None] >> np.arange(23) & 1) * 2 - 1
    assert np.array_equal(simhash.golay_nearest(signs.astype(np.int32)), simhash.golay_index(hard))  # all bits count the same: plain decoding
    sums = rng.normal(0, 20, (3000, 23)).astype(np.int32)
    scores = sums @ simhash._SIGNS.T  # all codewords
    found = scores[np.arange(3000), simhash.golay_nearest(sums)]
    plain = scores[np.arange(3000), simhash.golay_index((sums > 0) @ (1 << np.arange(23)))]
    assert (found >= plain).all() and (found == scores.max(1)).mean() > 0.85 > (plain == scores.max(1)).mean()


def test_long_near_copies_meet_by_golay_keys():
    rng = np.random.default_rng(13)
    keys = lambda own: simhash.code_keys(simhash.codes(simhash.long_sums(own)[None]))[0]
    apart = met = 0
    for n in [80, 100, 300, 900] * 50:
        own = np.unique(rng.integers(0, (1 << 64) - 1, 2 * n, np.uint64))
        own = rng.permutation(own)
        lost = n // 9  # of n on either side: similarity just over 0.8
        a, b, c = np.sort(own[:n]), np.sort(own[lost : n + lost]), np.sort(own[n:])
        assert set(simhash.near_keys(a, 0.8)) == set(keys(a))  # nothing but codewords
        met += np.isin(keys(a), keys(b)).any()
        apart += np.isin(keys(a), keys(c)).any()
    assert met == 200 and apart <= 2


def test_golay_keys_tie_long_texts(spark):
    rng = random.Random(14)
    rows = []
    for i in range(40):
        text = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([150, 400]))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited(rng, text, 0.8)))]
    sig, f, n, own, keys = simhash.signatures([simhash.words_of(t) for _, t in rows])
    assert not any(map(len, keys))
    made = [(int(s), *map(int, x), int(m), bytearray(c.tobytes())) for s, x, m, c in zip(sig.view(np.int64), f.view(np.int64), n, own, strict=True)]
    signed = spark.createDataFrame(made, f"{simhash.SIGNED}, codes binary")
    keyed = simhash.coded(signed, 0, simhash.WORDS * len(simhash.STEPS))
    groups_ = simhash.near_linked(signed, 0.8, keyed, simhash.busy_keys(keyed)[0]).toPandas()
    tied = {frozenset(s) for _, s in groups_.groupby("grp").sig}
    assert {frozenset(map(int, sig[k : k + 2].view(np.int64))) for k in range(0, 80, 2)} <= tied
