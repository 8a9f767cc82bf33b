"""Mixing sources to target weights by hierarchical token budgets (operator 1).

The sources form a tree: domain, language, source. A budget of tokens enters at the root and
every node hands its share to its children by integer weights, but to none more than its leaves
can supply in ``epochs`` passes. What a short child cannot take goes to its siblings by their
weights; only what all of them together cannot take goes back to the parent's siblings. As a
subtree's capacity is the sum of its leaves', one pass from the root downwards decides all of
that exactly, in whole tokens: children are ordered by capacity per weight, the short ones
come first, and the rest share what is left by cumulative rounding.

Each leaf then reads its documents in the order of a hash seeded by the epoch: whole epochs
first, then a prefix of the next epoch's order until the leaf's budget is spent. The last
document counts with the tokens that were left. The order is cut into 4,096 hash ranges; only
the range in which a leaf's budget ends is put in order, so a leaf may hold most rows.

All of it is DataFrame functions. A token is a word between the six blank characters.

Defined results: NULL and empty texts have no tokens and are never taken. NULL domains, languages
and sources are children of their own. Nodes without a weight have weight 1, weight 0 takes
nothing. Repeated rows are taken like others. Only leaves that occur can take tokens, an empty
table gives an empty table. Extra columns are kept as they are; none can clash, because a row
travels as one value. Budgets times weights must fit 63 bits: overflow is an error, never a wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import shared_table

LEVELS = ("domain", "language", "source")
RANGES = 3  # hex digits: 4,096 ranges


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def order_key(seed: int, epoch: Column, key: Column, text: Column) -> Column:
    """Hex digest that orders a leaf's documents in one epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def weight_of(weights: dict[str, int], path: Column) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(path == name, weight).otherwise(out)
    return out.cast("bigint")


def shared_out(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Adds ``taken`` to children (capacity, weight, budget): what each gets of its parent's budget.

    A parent's children are as many as it has distinct names below it.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # Capacity per weight orders the children; weight 0 comes last and takes nothing.
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("decimal(38,10)") / F.col("weight"))
    line = by.orderBy(F.col("ratio").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order])
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        children.withColumn("ratio", ratio)
        .withColumn("given", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("short", (F.col("weight") > 0) & (F.col("capacity") * F.col("open") <= (F.col("budget") - F.col("given")) * F.col("weight"))))
    rest = (
        ranked.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("short"), F.col("capacity"))).over(by), F.lit(0)))
        .withColumn("share", F.when(F.col("short"), 0).otherwise(F.col("weight")))
        .withColumn("all", F.sum("share").over(by))
        .withColumn("upto", F.sum("share").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    part = F.expr("CASE WHEN all = 0 THEN 0 ELSE (left * upto) div all - (left * (upto - share)) div all END")
    return rest.withColumn("taken", F.when(F.col("short"), F.col("capacity")).otherwise(part)).drop("ratio", "given", "open", "short", "left", "share", "all", "upto")


def leaf_budgets(leaves: DataFrame, weights: dict[str, int], share: int, epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget) from leaves (domain, language, source, tokens)."""
    above = None
    for depth in range(1, len(LEVELS) + 1):
        names, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        path = F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in names])
        nodes = leaves.groupBy(*names).agg(F.sum("tokens").cast("bigint").alias("tokens"))
        nodes = nodes.withColumn("capacity", F.col("tokens") * F.lit(epochs)).withColumn("weight", weight_of(weights, path))
        if above is None:
            total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("total", total).withColumn("budget", F.least(F.expr(f"total * {int(share)} div 100"), F.col("total") * F.lit(epochs)))
        else:
            own = nodes.withColumnsRenamed({c: f"own_{c}" for c in parent})
            nodes = own.join(above, [F.col(f"own_{c}").eqNullSafe(F.col(c)) for c in parent]).drop(*[f"own_{c}" for c in parent])
        above = shared_out(nodes, parent, names).select(*names, F.col("tokens").alias("held"), F.col("taken").alias("budget"))
        if depth < len(LEVELS):
            above = above.drop("held")
    return above.withColumnRenamed("held", "tokens")


def mixed_rows(df: DataFrame, domain: Column, weights: dict[str, int], share: int, epochs: int = 3, seed: int = 7,
               key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(row, domain, language, source, copies, part, n_tokens): rows taken, how often whole, and tokens of a last part.

    ``weights`` maps the paths domain, domain/language and domain/language/source to integers; ``share`` is the
    budget in percent of all tokens, ``epochs`` the most passes over a leaf.
    """
    base = df.select(
        F.struct("*").alias("row"), domain.cast("string").alias("domain"), F.col(lang).cast("string").alias("language"),
        F.col(source).cast("string").alias("source"), F.col(key).alias("key"), F.col(text).alias("text"))
    leaves = shared_table(base.select(*LEVELS, n_tokens(F.col("text")).alias("tokens")).groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    plan = shared_table(leaf_budgets(leaves, weights, share, epochs).where("tokens > 0 AND budget > 0").select(
        *[F.col(c).alias(f"leaf_{c}") for c in LEVELS], F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")))
    placed = base.join(plan, [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in LEVELS])
    placed = placed.withColumn("order", order_key(seed, F.col("whole"), F.col("key"), F.col("text"))).withColumn("range", F.substring("order", 1, RANGES))

    ranges = placed.withColumn("tokens", n_tokens(F.col("text"))).groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    line = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = shared_table(
        ranges.withColumn("before", F.coalesce(F.sum("tokens").over(line), F.lit(0)))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("tokens")))
        .select(*[F.col(c).alias(f"end_{c}") for c in LEVELS], F.col("range").alias("end"), "before"))
    rows = placed.join(ends, [F.col(c).eqNullSafe(F.col(f"end_{c}")) for c in LEVELS])
    kept = ["row", *LEVELS, "n_tokens", "whole"]
    clear = rows.where((F.col("range") < F.col("end")) | ((F.col("range") > F.col("end")) & (F.col("whole") > 0)))
    clear = clear.withColumn("n_tokens", n_tokens(F.col("text"))).select(
        *kept, F.when(F.col("range") < F.col("end"), 1).otherwise(0).alias("more"), F.lit(0).cast("bigint").alias("part"))
    inside = Window.partitionBy(*LEVELS).orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("range") == F.col("end")).withColumn("n_tokens", n_tokens(F.col("text")))
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    edge = edge.withColumn("room", room).select(
        *kept, F.when(F.col("room") >= F.col("n_tokens"), 1).otherwise(0).alias("more"),
        F.when((F.col("room") > 0) & (F.col("room") < F.col("n_tokens")), F.col("room")).otherwise(0).cast("bigint").alias("part"))
    out = clear.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("more")).cast("bigint"))
    return out.where("n_tokens > 0 AND (copies > 0 OR part > 0)").select("row", *LEVELS, "copies", "part", "n_tokens")


# Production parameters of the query: twenty sources in three domains.
DOMAIN_SQL = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web' WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'books' ELSE 'forum' END"
WEIGHTS = {
    "web": 5, "books": 3, "forum": 2,
    "web/en": 4, "web/de": 2, "web/fr": 2, "books/en": 3, "books/de": 3, "forum/en": 6,
    "web/en/src0": 4, "web/de/src0": 2, "books/en/src5": 2,
}
SHARE, EPOCHS, SEED = 60, 3, 7


def op1_budget_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_rows(docs, F.expr(DOMAIN_SQL), WEIGHTS, SHARE, EPOCHS, SEED).select("row.doc_id", *LEVELS, "copies", "part", "n_tokens")


def _level_sql(depth: int) -> str:
    """CTEs of one level: nodes, their order, and what each takes."""
    names, parent = LEVELS[:depth], LEVELS[: depth - 1]
    cols, path = ", ".join(names), " || '/' || ".join(f"coalesce({c}, '')" for c in names)
    weight = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    line = f"{by} ORDER BY ratio ASC NULLS LAST, {', '.join(f'{c} ASC NULLS FIRST' for c in names)} ROWS"
    budget = f"least(sum(tokens) OVER () * {SHARE} // 100, sum(tokens) OVER () * {EPOCHS})" if depth == 1 else "a.taken"
    above = "" if depth == 1 else f"JOIN t{depth - 1} a ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM a.{c}" for c in parent)
    return f"""
    n{depth} AS (SELECT {cols}, sum(tokens)::BIGINT AS tokens, CASE {path} {weight} ELSE 1 END AS weight FROM counted GROUP BY {cols}),
    b{depth} AS (SELECT n.*, n.tokens * {EPOCHS} AS capacity, {budget.replace('sum(tokens)', 'sum(n.tokens)')} AS budget,
      CASE WHEN weight > 0 THEN n.tokens * {EPOCHS} / weight END AS ratio FROM n{depth} n {above}),
    r{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({line} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
      sum(weight) OVER ({line} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM b{depth}),
    s{depth} AS (SELECT *, weight > 0 AND capacity * open <= (budget - given) * weight AS short FROM r{depth}),
    l{depth} AS (SELECT *, budget - coalesce(sum(CASE WHEN short THEN capacity END) OVER ({by}), 0) AS rest,
      CASE WHEN short THEN 0 ELSE weight END AS share FROM s{depth}),
    u{depth} AS (SELECT *, sum(share) OVER ({by}) AS total, sum(share) OVER ({line} BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM l{depth}),
    t{depth} AS (SELECT {cols}, tokens, (CASE WHEN short THEN capacity WHEN total = 0 THEN 0
      ELSE (rest * upto) // total - (rest * (upto - share)) // total END)::BIGINT AS taken FROM u{depth})"""


SQL = f"""
WITH counted AS (
    SELECT doc_id, {DOMAIN_SQL} AS domain, lang AS language, source, md5(coalesce(text, '')) AS digest,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS tokens
    FROM documents),
    {",".join(_level_sql(d) for d in (1, 2, 3))},
    placed AS (
      SELECT c.*, t.taken // t.tokens AS whole, t.taken % t.tokens AS rest,
        sum(c.tokens) OVER (PARTITION BY c.domain, c.language, c.source
          ORDER BY md5('{SEED}|' || (t.taken // t.tokens)::VARCHAR || '|' || coalesce(c.doc_id::VARCHAR, '') || '|' || digest), c.tokens
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c.tokens AS used
      FROM counted c JOIN t3 t ON c.domain IS NOT DISTINCT FROM t.domain AND c.language IS NOT DISTINCT FROM t.language
        AND c.source IS NOT DISTINCT FROM t.source
      WHERE t.tokens > 0 AND t.taken > 0),
    final AS (
      SELECT doc_id, domain, language, source, (whole + CASE WHEN rest - used >= tokens THEN 1 ELSE 0 END)::BIGINT AS copies,
        (CASE WHEN rest - used > 0 AND rest - used < tokens THEN rest - used ELSE 0 END)::BIGINT AS part, tokens AS n_tokens
      FROM placed)
SELECT * FROM final WHERE n_tokens > 0 AND (copies > 0 OR part > 0)
"""
