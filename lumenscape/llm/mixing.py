"""Mixing sources to target weights over a domain, language, source tree.

A budget of tokens goes down the tree by the weights of siblings. A child gets no more than its
subtree holds in the allowed epochs; what it leaves is dealt among its siblings by their weights,
and only what a whole subtree cannot take rises to its ancestors. Each leaf then reads epochs, each
in its own seeded order: whole ones first, then the prefix of one more that meets the leaf's quota.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenscape.llm.common import materialise
from lumenscape.llm.token_rollup import WORDS, count_matches

LEVELS = ["domain", "lang", "source"]
#: Hex digits of the order key that split a leaf into ranges; a range is what one task sorts.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Plan:
    """Integer weights by level and value (others: 1), epochs at most, the seed, and the share of all tokens wanted."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    max_epochs: int = 2
    seed: int = 1
    percent: int = 60


# The weights of the production plan.
PLAN = Plan({"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}})


def domain_of(source: Column) -> Column:
    """Domain of a source by its number."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("bigint"), F.lit(0))
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").otherwise("code")


def _weight(level: str, plan: Plan) -> Column:
    out = F.lit(1)
    for value, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parents: list[str], key: str) -> DataFrame:
    """children: parents..., key, w, c (what it can take), b (budget of the parent) -> a, what each child gets.

    By rising c/w the children that are filled come first; the others share the rest by weight.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by = group.orderBy(F.col("c") / F.col("w"), key)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda x: x.cast("decimal(38,0)")
    out = children.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("onward", F.sum("w").over(onward))
    out = out.withColumn("full", wide(F.col("c")) * F.col("onward") <= wide(F.col("w")) * (F.col("b") - F.col("before")))
    out = out.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(group), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(group))
    part = F.expr("cast(cast(w as decimal(38,0)) * (b - taken) div open as bigint)")
    return out.withColumn("a", F.when(F.col("full"), F.col("c")).otherwise(F.greatest(part, F.lit(0)))).drop("before", "onward", "full", "taken", "open")


def quotas(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves: domain, lang, source, tokens -> the same with quota (tokens to read)."""
    tree = leaves.withColumn("c", F.col("tokens") * plan.max_epochs)
    budget = leaves.agg(F.expr(f"cast(coalesce(sum(tokens), 0) as decimal(38,0)) * {plan.percent} div 100").cast("long").alias("b"))
    parents: list[str] = []
    given = None
    for level in LEVELS:
        here = [*parents, level]
        children = tree.groupBy(*here).agg(F.sum("c").alias("c")).withColumn("w", _weight(level, plan))
        children = children.crossJoin(F.broadcast(budget)) if given is None else children.join(given, parents)
        given = _share(children, parents, level).select(*here, F.col("a").alias("b"))
        parents = here
    return leaves.join(given, LEVELS).select(*LEVELS, "tokens", F.col("b").alias("quota"))


def mix(spark: SparkSession, items: DataFrame, plan: Plan = PLAN, keep: tuple[str, ...] = ()) -> DataFrame:
    """items: id, domain, lang, source, n_tokens -> id, levels, epoch, n_tokens, take_tokens of what is read.

    take_tokens is below n_tokens only for the item at which a leaf's quota ends. Defined cases: null
    levels are the empty name; items with null or no tokens are never read; a null id is ordered as
    the empty text; repeated rows are read once each; an empty table gives an empty result. Columns of
    `keep` are carried along.
    """
    clean = items.select("id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS], F.col("n_tokens").cast("long").alias("n_tokens"), *keep).where("n_tokens > 0")
    clean = materialise(spark, clean, "items")
    leaves = materialise(spark, quotas(clean.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan), "quotas")
    read = leaves.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr("(quota - 1) div tokens")))))
    read = read.where("quota > 0").select(*LEVELS, "epoch", F.least("tokens", F.col("quota") - F.col("epoch") * F.col("tokens")).alias("wanted"), "tokens")
    # leaves and epochs are few; AQE broadcasts or splits this join, a hot source stays spread
    order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = clean.join(read, LEVELS).withColumn("k", order).withColumn("range", F.substring("k", 1, RANGE_DIGITS))
    whole = rows.where("wanted = tokens").withColumn("take_tokens", F.col("n_tokens"))
    part = materialise(spark, rows.where("wanted < tokens"), "part")
    sums = part.groupBy(*LEVELS, "epoch", "range").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy(*LEVELS, "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    placed = part.join(sums, [*LEVELS, "epoch", "range"]).where("ahead < wanted")
    inside = placed.where("ahead + held <= wanted").withColumn("take_tokens", F.col("n_tokens"))
    within = Window.partitionBy(*LEVELS, "epoch", "range").orderBy("k", "id", "n_tokens", *keep).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("ahead + held > wanted").withColumn("cum", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    edge = edge.where("cum < wanted").withColumn("take_tokens", F.least("n_tokens", F.col("wanted") - F.col("cum")))
    out = ["id", *LEVELS, "epoch", "n_tokens", "take_tokens", *keep]
    return whole.select(out).union(inside.select(out)).union(edge.select(out))


def document_items(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of a table of documents, with the columns of `keep`; tokens are words between ASCII white space."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), domain_of(source).alias("domain"), "lang", source.alias("source"), F.coalesce(count_matches(F.col("text"), WORDS), F.lit(0)).alias("n_tokens"), *keep)


def _level_sql(n: int, plan: Plan) -> str:
    here, up = LEVELS[: n + 1], LEVELS[:n]
    level = LEVELS[n]
    cases = "".join(f" WHEN {level} = '{v}' THEN {w}" for v, w in plan.weights.get(level, {}).items())
    weight = f"CAST(CASE{cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"
    group = f"PARTITION BY {', '.join(up)}" if up else ""
    source = f"g{n - 1} JOIN (SELECT {', '.join(here)}, CAST(sum(tokens) * {plan.max_epochs} AS HUGEINT) AS c FROM leaves GROUP BY ALL) USING ({', '.join(up)})" if up else f"budget, (SELECT {level}, CAST(sum(tokens) * {plan.max_epochs} AS HUGEINT) AS c FROM leaves GROUP BY ALL)"
    return f"""
w{n} AS (SELECT {', '.join(here)}, c, b, {weight} AS w FROM {source}),
o{n} AS (SELECT *, coalesce(sum(c) OVER ({group} ORDER BY CAST(c AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({group} ORDER BY CAST(c AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM w{n}),
f{n} AS (SELECT *, c * onward <= w * (b - before) AS filled FROM o{n}),
g{n} AS (SELECT {', '.join(here)}, CASE WHEN filled THEN c ELSE greatest(0, w * (b - coalesce(sum(CASE WHEN filled THEN c END) OVER ({group}), 0)) // sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({group})) END AS b FROM f{n})"""


def document_sql(plan: Plan = PLAN) -> str:
    """The mix of `documents` in DuckDB SQL."""
    keys = ", ".join(LEVELS)
    levels = ",".join(_level_sql(n, plan) for n in range(len(LEVELS)))
    return rf"""
WITH raw AS (SELECT doc_id AS id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS n_tokens FROM documents),
items AS (SELECT id, CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain, lang, source, n_tokens FROM raw WHERE n_tokens > 0),
leaves AS (SELECT {keys}, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM items GROUP BY ALL),
budget AS (SELECT CAST(sum(tokens) * {plan.percent} // 100 AS HUGEINT) AS b FROM leaves),{levels},
reads AS (SELECT {keys}, tokens, b AS quota, unnest(range(CAST((b - 1) // tokens + 1 AS BIGINT))) AS epoch FROM leaves JOIN g2 USING ({keys}) WHERE b > 0),
wants AS (SELECT {keys}, epoch, least(tokens, quota - epoch * tokens) AS wanted FROM reads),
cum AS (SELECT i.*, epoch, wanted, coalesce(sum(n_tokens) OVER (PARTITION BY {keys}, epoch ORDER BY md5('{plan.seed}:' || epoch || ':' || id), id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items i JOIN wants USING ({keys}))
SELECT id AS doc_id, {keys}, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(least(n_tokens, wanted - before) AS BIGINT) AS take_tokens FROM cum WHERE before < wanted
"""
