"""Secret scans over versions of files: a ledger of content-addressed blobs, scanned once for each version of a rule.

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; those whose group is shorter than `least` characters are dropped.

    `literal`: a text that every match contains, if there is one; texts without it aren't searched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    literal: str = ""

    @property
    def version(self) -> str:
        """Names the rule as it is now: a changed rule is a new one to the ledger."""
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"


# The base rules' patterns. A run of 24 hex digits or more is matched whole, as is an access key of 20 characters.
BASE = (
    Rule("assign", r"""((?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", literal="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", literal="PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", literal="eyJ"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}", literal="gh"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", literal="xox"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}", literal="AIza"),
)
RULES = BASE + EXTRA
SPAN = "struct<kind: string, start: bigint, end: bigint, version: string>"


def marks(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<rule, nth, gap, size, keep>> of a rule's matches: the characters between a match and the one before, its own, and whether it counts."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<rule: int, nth: int, gap: int, size: int, keep: boolean>>")
    parts = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("groups"))

    def each(p: Column) -> Column:
        return F.transform(
            p["found"],
            lambda x, i: F.struct(F.lit(number).alias("rule"), i.alias("nth"), F.length(F.get(p["gaps"], i)).alias("gap"), F.length(x).alias("size"), (F.length(F.get(p["groups"], i)) >= rule.least).alias("keep")),
        )

    there = text.rlike(rule.pattern)
    if rule.literal:
        there = F.contains(text, F.lit(rule.literal)) & there
    return F.when(there, F.get(F.transform(F.array(parts), each), F.lit(0))).otherwise(none)


def blob(content: Column) -> Column:
    """The address of a content: SHA-256 of its UTF-8 bytes. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, content: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that the ledger lacks: (blob, scanned array<string>, found array<SPAN>), one for each unseen blob.

    A blob is scanned once, in however many rows and versions it occurs, and only by rules whose version the ledger doesn't
    hold for it. A blob without findings gets a row too, so that it isn't scanned again. Other columns aren't read.
    """
    blobs = versions.select(F.coalesce(F.col(content), F.lit("")).alias("content")).withColumn("blob", blob(F.col("content")))
    every = F.array(*[F.lit(r.version) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("scanned", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("scanned") > 0).drop("seen")
        new = blobs.groupBy("blob").agg(F.first("content").alias("content"), F.first("scanned").alias("scanned"))
    else:
        new = blobs.groupBy("blob").agg(F.first("content").alias("content")).withColumn("scanned", every)
    none = F.array().cast("array<struct<rule: int, nth: int, gap: int, size: int, keep: boolean>>")
    found = [F.when(F.array_contains("scanned", r.version), marks(F.col("content"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    each = new.select("blob", "scanned", F.explode_outer(F.flatten(F.array(*found))).alias("m"))
    # blobs lie where the scan left them, so neither the running sums nor the lists shuffle anything
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob", "m.rule").orderBy("m.nth"))
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    rule = F.get(names, F.col("m.rule"))
    span = F.struct(rule["kind"].alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), F.col("end"), rule["version"].alias("version"))
    placed = each.withColumn("end", end).select("blob", "scanned", F.when(F.col("m.keep"), span).alias("span"))
    return placed.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.sort_array(F.collect_list("span")).cast(f"array<{SPAN}>").alias("found"))


def update(versions: DataFrame, folder: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger kept in `folder` after it has taken in versions: a scan of what it hasn't seen is added, as files of its own.

    Files are committed by the writer as a whole, so that a failed scan leaves nothing that counts; two scans at a time may both add a
    blob, which findings() takes once.
    """
    spark = versions.sparkSession
    schema = f"blob binary, scanned array<string>, found array<{SPAN}>"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    scan(versions, content, spark.read.schema(schema).parquet(folder) if there else None, rules).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def findings(versions: DataFrame, ledger: DataFrame, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with `found` array<SPAN>: what the ledger holds for each row's blob under the rules as they are now.

    Every row of versions stays, in every column but content and one named found; a blob without findings has an empty array.
    Sorted by start, then by the order of rules. Null and empty contents are one blob, without findings.
    """
    now = [r.version for r in rules]
    hits = ledger.filter(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    rank = F.create_map(*[x for i, v in enumerate(now) for x in (F.lit(v), F.lit(i))])
    ordered = F.transform(
        F.array_sort(F.transform(F.filter("found", lambda s: s["version"].isin(now)), lambda s: F.struct(s["start"].alias("start"), F.get(F.array(rank), F.lit(0))[s["version"]].alias("rank"), s.alias("span")))),
        lambda x: x["span"],
    )
    own, other, held = common.fresh(versions, "_blob", "_other", "_held")
    rows = versions.withColumn(own, blob(F.col(content))).drop(content)
    none = F.array().cast(f"array<{SPAN}>")
    joined = rows.join(hits.select(F.col("blob").alias(other), ordered.alias(held)), F.col(own) == F.col(other), "left")
    return joined.withColumn("found", F.coalesce(held, none)).drop(own, other, held)


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(F.transform(F.filter(found, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    found, base = F.col("found"), tuple(r.kind for r in BASE)
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(key, *[count(k) for k in base], F.sha2(listed(found, base).cast("binary"), 256).alias("base_sha256"), listed(found, tuple(r.kind for r in RULES)).alias("spans"))
