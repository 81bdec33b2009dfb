"""Sentences and message payloads built with string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ties to even and no thousands marks."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def _text(template: str, *args: Column) -> Column:
    return F.format_string(template, *args)


# --- fixed values: wording that must equal the published messages ----------------
def evidence_summary(cause: Column, score: Column) -> Column:
    rows = F.col("blame_row_count")
    return (
        F.when(
            cause == "upstream_null_spike",
            _text(
                "Blame column shows %s%% null rate over %d rows.",
                fixed(F.col("blame_null_rate") * 100, 1),
                rows,
            ),
        )
        .when(
            cause == "duplicate_ingestion",
            _text(
                "Blame PK has %d duplicate occurrence(s) in %d rows.",
                F.col("blame_pk_dupe_count"),
                rows,
            ),
        )
        .when(
            cause == "broken_join_dropout",
            _text(
                "%d orphan FK value(s) in blame column have no matching parent row.",
                F.col("orphan_fk_count"),
            ),
        )
        .otherwise(_text("No deterministic detector fired (score %s).", fixed(score, 2)))
    )


def suggested_fix(cause: Column, model: Column, column: Column) -> Column:
    where = F.when(F.length(column) > 0, F.concat_ws(".", model, column)).otherwise(model)
    return (
        F.when(
            cause == "upstream_null_spike",
            _text("Backfill or filter NULLs in %s; check upstream extract.", where),
        )
        .when(
            cause == "duplicate_ingestion",
            _text("De-duplicate %s before downstream models consume it.", where),
        )
        .when(
            cause == "broken_join_dropout",
            _text(
                "Restore deleted parent rows referenced by %s, or soft-delete instead.", where
            ),
        )
        .otherwise(_text("Inspect %s manually — no rule fired.", where))
    )


VERDICT_BADGES = {
    "auto": "🟢 [AUTO-RESOLVED]",
    "two_candidate": "🟡 [TWO-CANDIDATE]",
    "triage_only": "🔴 [TRIAGE-ONLY]",
}
OTHER_BADGE = "⏸"
HEADLINE = "🚨 Data Quality Failure: %s"
FALLBACK_FIX = "Inspect the raw warehouse table."
STORY = (
    "A test failure was detected in model `%s` on column `%s`.\n\n"
    "The attribution walker tracked the root blame to `%s` column `%s`. "
    "Rules classification determined the likely cause is `%s` with the current evidence."
)
REVIEW_BODY = (
    "## 🚨 Data Quality Failure Diagnosed: %s\n\n"
    "| Attribute | Details |\n"
    "|---|---|\n"
    "| **Incident ID** | `%s` |\n"
    "| **Failing Test** | `%s` |\n"
    "| **Failing Model** | `%s.%s` |\n"
    "| **Attributed Blame** | `%s.%s` |\n\n"
    "---\n\n"
    "### 🔍 Root-Cause Analysis\n\n"
    "%s\n\n"
    "### 💡 Suggested Actionable Fix\n\n"
    "```sql\n%s\n```\n"
)
CONTEXT_LINE = "*Incident:* `%s` | *Failing Test:* `%s` | *Failing Model:* `%s.%s`"
FIX_BLOCK = "*Suggested One-Line Fix:*\n```%s```"
BUTTONS = (
    ("👍 Accept Verdict", "primary", "accept"),
    ("👎 Reject Verdict", "danger", "reject"),
)
# ---------------------------------------------------------------------------------


def or_star(column: Column) -> Column:
    return F.when(F.length(column) > 0, column).otherwise("*")


def _plain(text: Column) -> Column:
    return F.struct(
        F.lit("plain_text").alias("type"), text.alias("text"), F.lit(True).alias("emoji")
    )


def _marked(text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))


def _block(kind: str, **body: Column) -> Column:
    fields = [F.lit(kind).alias("type"), *[c.alias(n) for n, c in body.items()]]
    return F.to_json(F.struct(*fields))


def chat_blocks(headline: Column, story: Column, fix: Column) -> Column:
    """Message blocks as one JSON array; expects the flat incident columns in scope."""
    incident = F.col("incident_id")
    badge = F.lit(OTHER_BADGE)
    for kind, mark in VERDICT_BADGES.items():
        badge = F.when(F.col("verdict_type") == kind, mark).otherwise(badge)
    context = _text(
        CONTEXT_LINE,
        incident,
        F.col("failing_test_name"),
        F.col("failing_model"),
        or_star(F.col("failing_column")),
    )
    buttons = F.array(
        *[
            F.struct(
                F.lit("button").alias("type"),
                _plain(F.lit(label)).alias("text"),
                F.lit(style).alias("style"),
                F.concat_ws("|", F.lit("feedback"), incident, F.lit(answer)).alias("value"),
                F.lit(f"{answer}_verdict").alias("action_id"),
            )
            for label, style, answer in BUTTONS
        ]
    )
    blocks = [
        _block("header", text=_plain(F.concat_ws(" ", badge, headline))),
        _block("context", elements=F.array(_marked(context))),
        _block("divider"),
        _block("section", text=_marked(story)),
        _block("section", text=_marked(_text(FIX_BLOCK, fix))),
        _block("divider"),
        _block("actions", elements=buttons),
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *blocks), F.lit("]"))
