"""Sharding by proportional stratified interleaving: every shard gets the mixture of the whole.

Rows of a source are ranked in a seeded-shuffled order; the rank becomes a fraction of the source's rows, shifted by a
fixed offset of the source so that small sources don't crowd at one place; all rows are ordered by that fraction and cut
into shards of equal counts (law `rows`: at most one apart). DataFrame functions only; texts never move: only ids,
sources, sizes and checksums are shuffled.

Defined cases: null texts have no bytes (size 1, checksum 0); null sources are one source of their own; null ids and
repeated rows are rows like others (equal rows may swap places, which doesn't change the result); fewer rows than shards
leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, table
from strataloom.llm.ranks import numbered, running, unit

SPLIT = 1 << 12  # buckets of the global order; of a source's order as well


def interleaved(rows: DataFrame, shards: int, seed: int = 0, stratum: str = "source", keys: list[str] | None = None) -> DataFrame:
    """rows with shard and slot. keys: columns that tell rows apart, for the shuffled order."""
    keys = keys or [c for c in rows.columns if c != stratum]
    tie: list[Column | str] = ["__h", *keys]
    name = F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string")))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), *keys)).withColumn("__of_it", name)
    ranked = running(rows, ["__of_it"], F.floor(unit(F.col("__h")) * SPLIT).cast("int"), [F.shiftrightunsigned("__h", 1), *tie], {"__rank": "1L"}, {"__of": "1L"})
    shift = unit(F.xxhash64(F.lit(seed + 1), "__of_it"))
    ranked = ranked.withColumn("__at", (F.col("__rank") + shift) / F.col("__of"))
    bucket = F.least(F.floor(F.col("__at") * SPLIT), F.lit(SPLIT - 1)).cast("int")
    placed = running(ranked, [], bucket, ["__at", "__of_it", *tie], {"__place": "1L"}, {"__all": "1L"})
    shard = F.expr(f"__place * {shards} div __all")
    # the first place of shard s is the smallest p with floor(p * shards / all) = s
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"__place - (shard * __all + {shards - 1}) div {shards}")).drop("__h", "__of_it", "__rank", "__of", "__at", "__place", "__all")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return pick(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def op10(spark, sf_dir, shards: int = 8) -> DataFrame:
    placed = interleaved(measured(table(spark, sf_dir, "documents")), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def assign(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """docs with shard and slot; columns of these names are replaced. Texts are shuffled once, to join them to their places.

    Rows are found again by two hashes of id, source, size and checksum. Rows equal in all of them are counted before they are
    shuffled, get one place each, and are numbered part by part to take them.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    names = lambda *c: [F.xxhash64(F.lit(k), *c).alias(n) for k, n in ((1, "__a"), (2, "__b"))]
    rows = measured(docs).groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("__copies"))
    rows = rows.select("*", *names("doc_id", "source", "size", "text_crc32"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__n"))
    places = saved(interleaved(rows, shards, seed, keys=["doc_id", "size", "text_crc32", "__n"]).select("__a", "__b", "__n", "__copies", "shard", "slot"), "shard-places")
    raw = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    own = docs.select(*(docs[f"`{c}`"] for c in kept), *names(docs["doc_id"], docs["source"], (F.octet_length(raw) + 1).cast("long"), F.crc32(raw)))
    single = own.join(places.where("__copies = 1").drop("__n", "__copies"), ["__a", "__b"])
    many = places.where("__copies > 1")
    if not many.isEmpty():
        again = numbered(own.join(many.select("__a", "__b").distinct(), ["__a", "__b"], "left_semi"), ["__a", "__b"], "__n")
        single = single.unionByName(again.join(many.drop("__copies"), ["__a", "__b", "__n"]).select(*single.columns))
    return single.select(*(F.col(f"`{c}`") for c in kept), "shard", "slot")
