"""Column names, tag order and tag categories of the annotated-thread model."""

from __future__ import annotations

from pyspark.sql import types as T

# The 31 annotated discourse tags, in file order.  The order matters, because
# the row scaler in functions/scaling.py rescales one tag after the other.
ANNOTATED_TAGS = [
    "Aggressive", "AgreeBut", "AgreeToDisagree", "Alternative", "Answer", "AttackValidity",
    "BAD", "Clarification", "Complaint", "Convergence", "CounterArgument", "CriticalQuestion",
    "DirectNo", "DoubleVoicing", "Extension", "Irrelevance", "Moderation", "NegTransformation",
    "Nitpicking", "NoReasonDisagreement", "Personal", "Positive", "Repetition",
    "RephraseAttack", "RequestClarification", "Ridicule", "Sarcasm", "Softening", "Sources",
    "ViableTransformation", "WQualifiers",
]

# Fixed value: derived tag, 1 when no annotated tag is set; always last.
UNTAGGED = "Untagged"

TAGS = ANNOTATED_TAGS + [UNTAGGED]

# Tag -> reporting category.
TAG_CATEGORY = {
    "Moderation": "Promoting Discussion",
    "RequestClarification": "Promoting Discussion",
    "AttackValidity": "Promoting Discussion",
    "Clarification": "Promoting Discussion",
    "Answer": "Promoting Discussion",
    "CounterArgument": "Promoting Discussion",
    "Extension": "Promoting Discussion",
    "ViableTransformation": "Promoting Discussion",
    "Personal": "Promoting Discussion",
    "BAD": "Low Responsiveness",
    "Repetition": "Low Responsiveness",
    "NegTransformation": "Low Responsiveness",
    "NoReasonDisagreement": "Low Responsiveness",
    "Convergence": "Low Responsiveness",
    "AgreeToDisagree": "Low Responsiveness",
    "Aggressive": "Tone and Style",
    "Ridicule": "Tone and Style",
    "Complaint": "Tone and Style",
    "Sarcasm": "Tone and Style",
    "Positive": "Tone and Style",
    "WQualifiers": "Tone and Style",
    "Softening": "Disagreement Strategies",
    "AgreeBut": "Disagreement Strategies",
    "DoubleVoicing": "Disagreement Strategies",
    "Sources": "Disagreement Strategies",
    "RephraseAttack": "Disagreement Strategies",
    "CriticalQuestion": "Disagreement Strategies",
    "Alternative": "Disagreement Strategies",
    "DirectNo": "Disagreement Strategies",
    "Irrelevance": "Disagreement Strategies",
    "Nitpicking": "Disagreement Strategies",
    "Untagged": "Untagged",
}

N_FOLDS = 5
NO_PARENT = -1

# The five profile numbers that are scaled against the other authors of the same context.
SCALED = ["num_comment", "min_ts", "sending_rate", "avg_word_text", "avg_tag_msg"]


def profile_columns(tags=TAGS) -> list[str]:
    """Names of the numbers that describe one author in one context, in output order."""
    return [
        "duration", "num_comment", "sending_rate", "avg_word_text",
        *tags, "diversity", "avg_tag_msg",
    ]


# The annotated CSV; `Unnamed: 0` is the row number that `parent` points at.
CSV_SCHEMA = T.StructType(
    [
        T.StructField("Unnamed: 0", T.LongType(), False),
        T.StructField("node_id", T.StringType()),
        T.StructField("tree_id", T.StringType()),
        T.StructField("parent", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
    + [T.StructField(t, T.IntegerType()) for t in ANNOTATED_TAGS]
)

META = ["message_id", "node_id", "tree_id", "parent", "author", "text", "ts"]
