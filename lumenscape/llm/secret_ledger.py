"""Secret scans over every historical version, incremental by a ledger of blobs.

A version's text is a blob, named by its SHA-256. The ledger holds, for every blob, the rule
versions it was scanned with and what they found. A scan takes the blobs that lack a wanted rule
version, runs only those rules on them, appends to the ledger, and joins the findings back to every
path and version that holds the blob. Copies are scanned once; a new rule version rescans blobs for
that rule alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Rule:
    """kind, version and pattern; keep(match) decides on a match, hints are lower-case texts of which one must occur."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    keep: Callable[[re.Match], bool] | None = None
    hints: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _long_value(match: re.Match) -> bool:
    return len(match[2]) >= 12


# The base rules. Letters of the assign rule's pattern count in either case, ASCII only.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, _long_value, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: What the base rules miss: private key blocks, signed web tokens and repository tokens.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyj",)),
    Rule("repo", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + EXTRA_RULES

FOUND = "array<struct<start:long,end:long,kind:string,rule:string>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def find_secrets(text: str, rules: tuple[Rule, ...]) -> list[dict]:
    """Kept matches as spans of code points, leftmost and not overlapping within a kind."""
    low, out = text.lower(), []
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in re.compile(rule.pattern, rule.flags).finditer(text):
            if rule.keep is None or rule.keep(m):
                out.append({"start": m.start(), "end": m.end(), "kind": rule.kind, "rule": rule.name})
    return out


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(spark: SparkSession, blobs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """blobs: (blob, text), repeats allowed. Appends one ledger row per blob that lacked a rule version.

    A repeat after a failure adds rows at most twice, which read back as one.
    """
    wanted = F.array(*[F.lit(r.name) for r in rules])
    seen = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # copies collapse before the shuffle, so a blob of many paths is one row
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    todo = once.join(seen, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    by_name = {r.name: r for r in rules}
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("rule", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(text.as_py(), tuple(by_name[n] for n in names.as_py())) for text, names in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, found_type)], names=["blob", "rules", "found"])

    todo.mapInArrow(run, LEDGER).write.parquet(f"{ledger}/{uuid.uuid4().hex}")


def scan_versions(spark: SparkSession, versions: DataFrame, ledger: str, path_cols: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is new, then (path_cols..., blob, found) for every row of versions.

    found: spans of the wanted rule versions, by start, then rule order. Defined cases: a null text is
    the empty text; equal texts share one scan; rows that repeat come out once each; null path columns
    stay null; an empty table gives an empty result and no ledger rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    scan_unseen(spark, blobs, ledger, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    known = read_ledger(spark, ledger).where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.name for r in rules]))
    spans = known.select("blob", F.struct(F.col("f.start").alias("start"), F.try_element_at(order, F.col("f.rule")).alias("order"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind")).alias("s"))
    spans = spans.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("found"))
    paths = versions.select(*path_cols, F.sha2(text.cast("binary"), 256).alias("blob"))
    return paths.join(spans, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:long,order:int,end:long,kind:string>>")))
