"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (items of fewer words: all their words). A
window of a document has as many shingles as the item it is compared with (shorter documents: one window of all of them).

1. One scan marks the shingles that some item has, for all sizes of shingles, and cuts the stretches of a document that a
   window over a marked shingle can reach; only these travel, once for each different text.
2. A window of weighted similarity t with an item holds at least t of the item's weight. So it holds one of the item's rarest
   shingles, those that make up more than 1 - t of its weight, and windows are laid where marked shingles add up to enough;
   nothing else can match.
3. Each such window gets a 64-bit SimHash. Multi-index Hamming blocks find all items of that size within RADIUS bits: with
   BLOCKS blocks and fewer than 2 * BLOCKS errors, some block has at most one, so windows look up their blocks as they are
   and items are listed under each block as it is and with each bit flipped. A window and an item that step 2 laid it for
   but whose fingerprints lie further apart are candidates as well, so the estimate loses nothing.
4. Candidates are verified by exact weighted similarity: sum of min over sum of max of shingle counts times weights, the
   weight of a shingle falling with the number of items that have it: ln(1 + items / items with it).

Only the benchmark's shingles are sent to all tasks, and only if there are at most MAX_SENT of them; a larger benchmark is
joined by shuffling marked positions instead.

Defined cases: null, empty and wordless texts and items match nothing; items repeated under several ids match under each;
null ids of documents and items are reported as null; repeated rows are reported once; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, table

SIZE = 5
SIMILARITY = 0.8
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
MAX_SENT = 60_000
_EDGES = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, wherever it is used later."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, size: int) -> Column:
    """Of every run of `size` word hashes; none in shorter arrays."""
    n = F.size(hashes)
    at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.col(hashes)[i + j] for j in range(size))))


_LANES = 0x0001000100010001  # four counters of 16 bits in a long


def simhash(shingles: Column) -> Column:
    """64 bits as a long: bit b is set if over half of the shingle hashes have it. At most 65535 hashes."""
    ones = lambda k: F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)))
    counts = F.array(*(ones(k) for k in range(16)))  # counter j of number k counts bit k + 16 * j
    bit = lambda c, b: F.when(F.shiftrightunsigned(c[b % 16], 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF)) * 2 > F.size(shingles), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(F.lit(0).cast("long"))
    return F.transform(F.array(counts), lambda c: reduce(Column.bitwiseOR, (bit(c, b) for b in range(64))))[0]


def block(fp: str | Column, k: int) -> Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.shiftrightunsigned(fp, _EDGES[k]).bitwiseAND(F.lit((1 << (_EDGES[k + 1] - _EDGES[k])) - 1))


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number for its id and text), item_id, size (of its shingles), n (their number), and its shingle hashes."""
    own = pick(benchmark, item_id=id_col, text=text_col).where(F.col("text").isNotNull()).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    words = once(own, "words", word_hashes(F.col("text"))).where(F.size("words") > 0)
    words = words.withColumn("size", F.least(F.size("words"), F.lit(SIZE)))
    per_size = reduce(lambda x, k: x.when(F.col("size") == k, shingle_hashes("words", k)), range(2, SIZE + 1), F.when(F.col("size") == 1, shingle_hashes("words", 1)))
    return once(words, "shingles", per_size).select("item", "item_id", "size", F.size("shingles").alias("n"), "shingles")


def marked(docs: DataFrame, sizes: list[int], sent: dict[int, list[int]] | None, known: DataFrame, reach: int) -> DataFrame:
    """Stretches of documents around known shingles: id, text_hash, size, all (shingles of the text), at (where it starts), part (its shingles), hits (known places in it)."""
    words = once(docs.where(F.col("text").isNotNull()), "words", word_hashes(F.col("text"))).select("id", F.xxhash64("text").alias("text_hash"), "words")
    per_size = F.array(*(F.struct(F.lit(k).alias("size"), shingle_hashes("words", k).alias("shingles")) for k in sizes))
    rows = words.select("id", "text_hash", F.explode(per_size).alias("x")).select("id", "text_hash", "x.size", "x.shingles").where(F.size("shingles") > 0)
    if sent is not None:
        is_known = lambda h: reduce(lambda x, k: x.when(F.col("size") == k, h.isin(sent[k])), sizes[1:], F.when(F.col("size") == sizes[0], h.isin(sent[sizes[0]])))
        rows = once(rows, "hits", F.filter(F.sequence(F.lit(0), F.size("shingles") - 1), lambda i: is_known(F.col("shingles")[i]))).where(F.size("hits") > 0)
    else:
        spots = rows.select("text_hash", "size", F.posexplode("shingles").alias("pos", "h")).join(known.select("size", "h"), ["size", "h"], "left_semi")
        rows = rows.join(spots.groupBy("text_hash", "size").agg(F.sort_array(F.collect_set("pos")).alias("hits")), ["text_hash", "size"])
    apart = lambda p, q: q - p > 2 * reach
    begins = F.filter("hits", lambda p, i: (i == 0) | apart(F.col("hits")[F.greatest(i - 1, F.lit(0))], p))
    ends = F.filter("hits", lambda p, i: (i == F.size("hits") - 1) | apart(p, F.col("hits")[F.least(i + 1, F.size("hits") - 1)]))
    stretches = F.zip_with(begins, ends, lambda a, b: F.struct(F.greatest(F.lit(0), a - reach + 1).alias("at"), F.least(F.size("shingles"), b + reach).alias("end")))
    cut = rows.select("id", "text_hash", "size", "shingles", "hits", F.explode(stretches).alias("x"))
    own = F.transform(F.filter("hits", lambda p: (p >= F.col("x.at")) & (p < F.col("x.end"))), lambda p: p - F.col("x.at"))
    return cut.select("id", "text_hash", "size", F.size("shingles").alias("all"), "x.at", F.slice("shingles", F.col("x.at") + 1, F.col("x.end") - F.col("x.at")).alias("part"), own.alias("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, text_hash, item_id, similarity, hamming, start (a shingle position), for each matching document and item."""
    docs = pick(docs, id=id_col, text=text_col)
    items = saved(items_of(benchmark, item_col, text_col), "bench-items")
    facts = items.agg(F.sum("n").alias("shingles"), F.count("*").alias("items"), F.sort_array(F.collect_set("size")).alias("sizes"), F.max("n").alias("reach")).first()  # one row
    if not facts["items"]:
        return docs.sparkSession.createDataFrame([], "id long, text_hash long, item_id long, similarity double, hamming int, start int")
    entries = items.select("item", "size", "n", F.explode("shingles").alias("h")).groupBy("item", "size", "n", "h").agg(F.count("*").cast("int").alias("c"))
    weights = entries.groupBy("size", "h").agg(F.countDistinct("item").alias("df")).withColumn("w", F.log1p(F.lit(float(facts["items"])) / F.col("df"))).drop("df")
    entries = saved(entries.join(weights, ["size", "h"]), "bench-shingles")
    top = F.log1p(F.lit(float(facts["items"])))  # of shingles that no item has
    whole = entries.groupBy("item", "size", "n").agg(F.sum(F.col("w") * F.col("c")).alias("weight"), F.collect_list(F.struct("h", "c", "w")).alias("entries"))
    whole = saved(whole.join(items.select("item", simhash(F.col("shingles")).alias("item_fp")), "item"), "bench-whole")
    # an item's rarest shingles, which make up more than 1 - similarity of its weight
    rare = Window.partitionBy("item").orderBy(F.desc("w"), "h").rowsBetween(Window.unboundedPreceding, -1)
    before = entries.join(whole.select("item", "weight"), "item").withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("c")).over(rare), F.lit(0.0)))
    known = saved(before.groupBy("size", "h").agg(F.first("w").alias("w"), F.collect_set(F.when(F.col("before") <= (1 - similarity + 1e-9) * F.col("weight"), F.col("item"))).alias("items")), "bench-known")
    sent = None
    if facts["shingles"] <= MAX_SENT:
        sent = {k: [] for k in facts["sizes"]}
        for r in known.select("size", "h").collect():
            sent[r["size"]].append(r["h"])
    rows = saved(marked(docs, facts["sizes"], sent, known, facts["reach"]), "bench-marked")
    place = ["text_hash", "size", "at"]
    parts = rows.drop("id").dropDuplicates(place)
    spots = parts.select(*place, F.explode("hits").alias("p"), "part").select(*place, "p", F.col("part")[F.col("p")].alias("h")).join(known, ["size", "h"])
    spots = spots.groupBy(*place).agg(F.collect_list(F.struct("p", "h", "w")).alias("known"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).where(F.size("items") > 0)
    pairs = parts.drop("hits").join(spots, place).select(*place, "all", "part", "known", F.explode("items").alias("item"))
    pairs = pairs.join(whole.select("item", "n", "weight", F.transform("entries", lambda e: e["h"]).alias("its")), "item").withColumn("length", F.least("n", "all"))
    pairs = once(pairs, "own", F.filter("known", lambda x: F.array_contains("its", x["h"]))).drop("its")
    enough = similarity * F.col("weight") - 1e-9
    pairs = pairs.where(F.aggregate("own", F.lit(0.0), lambda s, x: s + x["w"]) >= enough)
    last = F.col("all") - F.col("length") - F.col("at")  # the last place in the part at which a window fits
    first = F.array_distinct(F.flatten(F.transform("own", lambda x: F.sequence(F.greatest(F.lit(0), F.least(x["p"] - F.col("length") + 1, last)), F.greatest(F.lit(0), F.least(x["p"], last))))))
    inside = lambda name, s: F.filter(name, lambda x: (x["p"] >= s) & (x["p"] < s + F.col("length")))
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x["w"])
    laid = pairs.withColumn("s", F.explode(F.filter(first, lambda s: weight(inside("own", s)) >= enough)))
    laid = once(laid, "in", inside("known", F.col("s")))
    laid = laid.select("text_hash", "size", "n", (F.col("at") + F.col("s")).alias("start"), "item", F.slice("part", F.col("s") + 1, F.col("length")).alias("window"), (weight(F.col("in")) + (F.col("length") - F.size("in")) * top).alias("own_weight"))
    laid = saved(laid, "bench-windows")
    window = ["text_hash", "size", "n", "start"]
    windows = saved(once(laid.groupBy(*window).agg(F.first("window").alias("window"), F.first("own_weight").alias("own_weight")), "fp", simhash(F.col("window"))), "bench-prints")
    looked = windows.select(*window, "fp", F.posexplode(F.array(*(block("fp", k) for k in range(BLOCKS)))).alias("k", "key"))
    flips = lambda k: [0, *(1 << j for j in range(_EDGES[k + 1] - _EDGES[k]))]
    listed = whole.select("item", "size", "n", "item_fp", F.explode(F.concat(*(F.array(*(F.struct(F.lit(k).alias("k"), block("item_fp", k).bitwiseXOR(F.lit(f)).alias("key")) for f in flips(k))) for k in range(BLOCKS)))).alias("x")).select("item", "size", "n", "item_fp", "x.k", "x.key")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int")
    close = looked.join(listed, ["size", "n", "k", "key"]).withColumn("hamming", hamming).where(F.col("hamming") <= RADIUS).select(*window, "item", "hamming")
    far = laid.select(*window, "item").join(windows.select(*window, "fp"), window).join(whole.select("item", "item_fp"), "item").withColumn("hamming", hamming).where(F.col("hamming") > RADIUS).select(*window, "item", "hamming")
    close = close.unionByName(far).distinct().join(windows.select(*window, F.col("window").alias("part"), "own_weight"), window).join(whole.select("item", "weight", "entries"), "item")
    shared = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["w"] * F.least(e["c"], F.size(F.filter("part", lambda h: h == e["h"]))))
    close = once(close, "shared", shared).withColumn("similarity", F.col("shared") / (F.col("own_weight") + F.col("weight") - F.col("shared"))).where(F.col("similarity") >= similarity - 1e-9)
    best = close.groupBy("text_hash", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "hamming")).alias("x"))
    best = best.join(items.select("item", F.col("item_id").cast("long").alias("item_id")), "item").join(rows.select("id", "text_hash").distinct(), "text_hash")
    return best.select("id", "text_hash", "item_id", F.round("x.similarity", 9).alias("similarity"), "x.hamming", (-F.col("x.s")).alias("start"))


def op4(spark, sf_dir) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "hamming", "start").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item's passage; all columns stay as they are."""
    flagged = saved(contaminated(docs, benchmark).select(F.col("id").alias("__id"), F.col("text_hash").alias("__t")).distinct(), "contaminated")
    return docs.join(flagged, on=docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t")), how="left_anti")
