"""Mixing sources to target weights by hierarchical budgeting over a domain - language - source tree.

The token budget goes down the tree. At each node it is shared by the children's weights, none getting more than its
subtree can give (its tokens times the epochs allowed); what a child can't use goes to its siblings by their weights, and
only what a whole family can't use reaches the family's own siblings, because a node asks for no more than its subtree
holds. Budgets are whole tokens, computed with integers. Each leaf then takes a token-prefix of its seeded epochs: epoch
by epoch its rows in a shuffled order of that epoch, up to the row at which the budget is reached; that row counts with
the tokens still needed (`taken`). All of it is DataFrame functions; budgets stay a distributed table (one row a leaf).

Tokens are words between white space here; any whole-number column can be given instead. Defined cases: rows without
tokens (null, empty or blank text) cost nothing and are taken with the rows at their place in the order; null domain,
language or source are '' ; null ids are ids like others; repeated rows (id, text and leaf equal) are counted once and taken
copy by copy, side by side in the order; ties in the order fall to id, then checksum of the text; a node of weight 0 gets
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import pick, saved, table
from strataloom.llm.ranks import numbered, running

# Target weights of the default mixture, whole numbers; a key that isn't here has the weight under None.
DOMAINS = {"domain0": 500, "domain1": 300, "domain2": 200, None: 100}
LANGS = {"en": 600, "de": 150, "fr": 150, "es": 100, None: 50}
SOURCES = {None: 100}
LEVELS = ["domain", "lang", "source"]
#: Domain of a source: its trailing number modulo 3.
DOMAIN_SQL = "concat('domain', coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+$', 0), '') as bigint), 0) % 3)"


def weight_of(col: str, weights: dict) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in weights.items() if k is not None)
    return f"case {col} {cases} else {weights.get(None, 0)} end" if cases else str(weights.get(None, 0))


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (name, weight, cap, and the parent's budget b) with `own`: the part of b that each child gets."""
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = whole.orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), name)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    filled = (
        nodes.withColumn("__before", F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__rest", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__full", (F.col("weight") > 0) & (wide("cap") * F.col("__rest") <= (wide("b") - F.col("__before")) * F.col("weight")))
        .withColumn("__used", F.sum(F.when(F.col("__full"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("__open", F.sum(F.when(F.col("__full"), 0).otherwise(F.col("weight"))).over(whole))
    )
    own = F.expr("case when __full then cap when weight = 0 or b <= __used then 0 else cast(cast(b - __used as decimal(30,0)) * cast(weight as decimal(8,0)) div __open as bigint) end")
    return filled.withColumn("own", own).drop("__before", "__rest", "__full", "__used", "__open")


def budgets(leaves: DataFrame, weights: list[dict], fraction: float) -> DataFrame:
    """leaves (domain, lang, source, tokens, cap) with `budget` of each; the whole budget: that fraction of all tokens."""
    above = None
    for k, name in enumerate(LEVELS):
        parent, own = LEVELS[:k], LEVELS[: k + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", F.expr(weight_of(name, weights[k])).cast("long"))
        if above is None:
            whole = Window.partitionBy(F.lit(0))  # one row a domain
            nodes = nodes.withColumn("b", F.least(F.sum("cap").over(whole), F.floor(F.sum("tokens").over(whole) * F.lit(fraction))).cast("bigint"))
        else:
            nodes = nodes.join(above, parent)
        above = share(nodes, parent, name).select(*own, F.col("own").alias("b"))
    return above.withColumnRenamed("b", "budget")


def prepared(docs: DataFrame, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, mark (a checksum of the text): what the mixture is decided on."""
    mine = pick(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    mine = mine.select("doc_id", F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\u000B\\f\\r]+")), F.lit(0)).cast("long").alias("n_tokens"), mark(F.col("text")).alias("mark"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return mine.withColumn("domain", F.expr(domain_sql))


def mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mixed(rows: DataFrame, seed: int = 1, fraction: float = 0.8, max_epochs: int = 2, weights: list[dict] | None = None) -> DataFrame:
    """The rows taken, one for each copy and each epoch in which it is: with epoch, copy, copies, first_token (of its leaf) and taken."""
    rows = saved(rows.groupBy("doc_id", *LEVELS, "mark", "n_tokens").agg(F.count("*").alias("copies")), "mixture-rows")  # used twice; texts are counted once
    leaves = rows.groupBy(*LEVELS).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    wanted = budgets(leaves, weights or [DOMAINS, LANGS, SOURCES], fraction)
    plan = leaves.select(*LEVELS, "tokens").join(wanted, LEVELS)
    # rows of a leaf without any token come in the first epoch of a leaf with a budget only
    plan = saved(plan.where("budget > 0").withColumn("epochs", F.expr("cast((budget + tokens - 1) div tokens as int)")), "mixture")
    each = rows.join(plan, LEVELS).withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)")))
    each = each.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mark")))
    placed = running(each, [*LEVELS, "epoch"], F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"), ["__h", "doc_id", "mark"], {"__before": "n_tokens * copies"}, {})
    placed = placed.withColumn("__before", (F.col("epoch") * F.col("tokens") + F.col("__before")).cast("long")).where("__before < budget")
    fit = F.expr("if(n_tokens = 0, copies, least(copies, (budget - __before + n_tokens - 1) div greatest(n_tokens, 1)))")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), fit - 1)))
    placed = placed.withColumn("first_token", F.expr("__before + copy * n_tokens"))
    return placed.withColumn("taken", F.least("n_tokens", F.expr("budget - first_token"))).drop("__h", "__before", "epochs", "tokens")


def op5(spark, sf_dir) -> DataFrame:
    return mixed(prepared(table(spark, sf_dir, "documents"))).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "first_token", "taken", "budget")


def _oracle(seed: int = 1, fraction: float = 0.8, max_epochs: int = 2) -> str:
    """The same mixture in DuckDB's SQL: level by level, with plain windows over whole leaves."""
    weights = [DOMAINS, LANGS, SOURCES]
    parts = [
        f"""d as (select doc_id, md5(coalesce(text, '')) as mark, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::bigint as n_tokens, coalesce(lang, '') as lang, coalesce(source, '') as source,
 concat('domain', coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+$'), '') as bigint), 0) % 3) as domain from documents)""",
        f"leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * {max_epochs} as cap from d group by all)",
        f"a0 as (select least(sum(cap), floor(sum(tokens)::bigint * {fraction}::double)::bigint)::bigint as b from leaf)",
    ]
    for k, name in enumerate(LEVELS):
        own = ", ".join(LEVELS[: k + 1])
        join = f"join a{k} using ({', '.join(LEVELS[:k])})" if k else "cross join a0"
        by = f"partition by {', '.join(LEVELS[:k])}" if k else ""
        line = f"{by} order by cap::double / nullif(weight, 0) nulls last, {name}"
        parts += [
            f"n{k} as (select {own}, sum(cap)::bigint as cap, ({weight_of(name, weights[k])})::bigint as weight from leaf group by {own})",
            f"j{k} as (select * from n{k} {join})",
            f"s{k} as (select {own}, cap, weight, b, coalesce(sum(cap) over ({line} rows between unbounded preceding and 1 preceding), 0) as before_, sum(weight) over ({line} rows between current row and unbounded following) as rest from j{k})",
            f"f{k} as (select *, weight > 0 and cap::hugeint * rest <= (b - before_)::hugeint * weight as full_ from s{k})",
            f"g{k} as (select *, sum(case when full_ then cap else 0 end) over ({by}) as used, sum(case when full_ then 0 else weight end) over ({by}) as open_ from f{k})",
            f"a{k + 1} as (select {own}, (case when full_ then cap when weight = 0 or b <= used then 0 else ((b - used)::hugeint * weight) // open_::hugeint end)::bigint as b from g{k})",
        ]
    parts += [
        "p as (select l.domain, l.lang, l.source, l.tokens, a.b as budget, ((a.b + l.tokens - 1) // l.tokens)::int as epochs from leaf l join a3 a on l.domain = a.domain and l.lang = a.lang and l.source = a.source where a.b > 0)",
        "e as (select d.*, p.tokens, p.budget, unnest(range(p.epochs))::int as epoch from d join p on d.domain = p.domain and d.lang = p.lang and d.source = p.source)",
        f"o as (select *, (epoch * tokens + coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by md5(concat('{seed}:', epoch, ':', coalesce(doc_id::varchar, 'null'), ':', mark)), doc_id, mark rows between unbounded preceding and 1 preceding), 0))::bigint as first_token from e)",
    ]
    return "with " + ",\n".join(parts) + "\nselect doc_id, domain, lang, source, epoch, n_tokens, first_token, least(n_tokens, budget - first_token) as taken, budget from o where first_token < budget"


ORACLE = _oracle()


def select(docs: DataFrame, seed: int = 1, fraction: float = 0.8) -> DataFrame:
    """The rows of docs that one seeded epoch of the mixture takes, with their columns; each taken row is kept whole."""
    taken = mixed(prepared(docs), seed, fraction, max_epochs=1).groupBy("doc_id", *LEVELS, "mark").agg(F.count("*").alias("__taken"), F.first("copies").alias("__copies"))
    names = lambda *c: [F.xxhash64(F.lit(k), *c).alias(n) for k, n in ((1, "__a"), (2, "__b"))]
    taken = saved(taken.select(*names(F.col("doc_id").cast("long"), "lang", "source", "mark"), "__taken", "__copies"), "mixture-taken")
    own = docs.select("*", *names(docs["doc_id"].cast("long"), F.coalesce(docs["lang"], F.lit("")), F.coalesce(docs["source"], F.lit("")), mark(docs["text"])))
    kept = own.join(taken.where("__taken = __copies"), ["__a", "__b"], "left_semi").drop("__a", "__b")
    part = taken.where("__taken < __copies")
    if part.isEmpty():
        return kept
    # of repeated rows that only some are taken of: at most one row in a leaf, with its copies
    some = numbered(own.join(part.drop("__copies"), ["__a", "__b"]), ["__a", "__b"], "__n").where("__n < __taken")
    return kept.unionByName(some.select(*kept.columns))
