"""Secrets in every version of every file, by a ledger of scanned blobs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culprit.llm.shared import settled


class Rule(NamedTuple):
    """A kind of secret; a changed pattern needs a new version to be scanned again.

    Matches are leftmost and do not overlap.  Those whose `group` is shorter than
    `least` characters are dropped after matching.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of hexadecimal digits or of A-Z0-9 after AKIA cannot be longer for a later start,
# so those two carry their least length in the pattern.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    # A header of unbounded length would be looked for anew from every eyJ of a long run.
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,250}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

RULES = BASE_RULES + MORE_RULES

LEDGER = "blob binary, rule string, findings array<struct<start:long,end:long>>"


def blob_id(text: Column) -> Column:
    """The content address of a version; null is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(versions: DataFrame, text: str, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """Each blob once, with the keys of the rules that the ledger has not seen on it."""
    blobs = (
        versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
        .groupBy("blob")
        .agg(F.first("body").alias("body"))
    )
    wanted = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return (
        blobs.join(seen, "blob", "left")
        .select("blob", "body", todo.alias("todo"))
        .where(F.size("todo") > 0)
    )


def matches(rule: Rule) -> Column:
    """Every match of a rule, with the text before it, as far as the rule is to do."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("body", pattern, F.lit(0))
    gaps = F.split("body", rule.pattern, -1)
    told = F.zip_with(
        gaps,
        found,
        lambda gap, hit: F.struct(
            F.length(gap).cast("long").alias("gap"),
            F.length(hit).cast("long").alias("width"),
            (
                F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.least
                if rule.group
                else F.length(hit) >= rule.least
            ).alias("holds"),
        ),
    )
    # zip_with pads the shorter side: the text after the last match has no width.
    told = F.filter(told, lambda hit: hit["width"].isNotNull())
    due = F.array_contains("todo", rule.key) & F.col("body").rlike(rule.pattern)
    return F.when(due, told)


def scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """New ledger rows: one per blob and rule, with the findings in code points.

    Matches are exploded and their places summed up in order, so that a text with many
    matches costs in proportion to them.
    """
    told = blobs.select(
        "blob",
        "todo",
        *(matches(rule).alias(f"m{i}") for i, rule in enumerate(rules)),
    )
    by_rule = F.array(
        *(
            F.struct(F.lit(rule.key).alias("rule"), F.col(f"m{i}").alias("hits"))
            for i, rule in enumerate(rules)
        )
    )
    hits = told.select("blob", F.explode(by_rule).alias("of")).select(
        "blob", "of.rule", F.posexplode("of.hits").alias("at", "hit")
    )
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.expr("hit.gap + hit.width")).over(so_far)
    return (
        hits.select("blob", "rule", "hit", ends.alias("end"))
        .where("hit.holds")
        .select("blob", "rule", (F.col("end") - F.col("hit.width")).alias("start"), "end")
    )


NO_SPANS = "array<struct<start:long,end:long>>"


def scan_unseen(
    versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Ledger rows, form `LEDGER`, for the pairs of blob and rule version it has no row for.

    A pair has its row, findings or not: what has been scanned is never scanned again.
    """
    todo = unseen(versions, text, ledger, rules)
    spans = settled(scan(todo, rules)).groupBy("blob", "rule").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("findings")
    )
    pairs = todo.select("blob", F.explode("todo").alias("rule"))
    return pairs.join(spans, ["blob", "rule"], "left").select(
        "blob", "rule", F.coalesce("findings", F.array().cast(NO_SPANS)).alias("findings")
    )


def path_findings(
    versions: DataFrame,
    ledger: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """path, blob, findings for each row of `versions`, from the ledger alone.

    findings is an array of (start, rank, end, kind), ordered by start and then by the
    order of `rules`; rows of rule versions that are not among them are left aside.
    """
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    found = settled(
        ledger.where(F.col("rule").isin([r.key for r in rules]))
        .select("blob", "rule", F.inline("findings").alias("start", "end"))
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start",
                        ranks[F.col("rule")].alias("rank"),
                        "end",
                        F.substring_index("rule", "@", 1).alias("kind"),
                    )
                )
            ).alias("findings")
        )
    )
    addressed = versions.select(F.col(path), blob_id(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    return addressed.join(found, "blob", "left").select(
        path, "blob", F.coalesce("findings", none).alias("findings")
    )


def scan_secrets(
    versions: DataFrame,
    path: str = "doc_id",
    text: str = "text",
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger rows this run adds.

    Each version is addressed by the digest of its content.  A blob is scanned once,
    however many paths and versions hold it, and only by the rule versions that `ledger`
    has no row for; findings come back to all paths by the address.

    The first frame has one row per row of `versions` (see path_findings), the second a row
    for each pair scanned now; append it to the ledger.  A null text is an empty blob.  Null
    and repeated paths each get their row; an empty table gives empty frames; other columns
    are ignored.
    """
    added = settled(scan_unseen(versions, text, ledger, rules))
    known = added if ledger is None else added.unionByName(ledger)
    return path_findings(versions, known, path, text, rules), added


def scan_arrivals(
    arrivals: Sequence[DataFrame],
    ledger_path: str,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """The ledger below `ledger_path` after each of the arrivals, one after the other.

    Every arrival appends the pairs that are new to the ledger, and only these are scanned.
    """
    ledger = None
    for versions in arrivals:
        added = scan_unseen(versions, text, ledger, rules)
        added.write.mode("append").parquet(ledger_path)
        ledger = versions.sparkSession.read.schema(LEDGER).parquet(ledger_path)
    return ledger


def span_text(findings: Column) -> Column:
    """Findings as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )
