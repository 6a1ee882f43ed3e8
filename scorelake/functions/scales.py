"""Ordinal scales of judge metrics and the expressions that map a reply label onto them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in ascending order; the raw value is the position, the score position / (n - 1).
CORRECTNESS = ("incorrect", "partially correct", "correct")
LIKERT = ("not at all", "not generally", "neutral/mixed", "generally yes", "yes")
FAITHFULNESS = ("none", "some", "approximately half", "most", "all")
HELPFULNESS = ("not helpful", "slightly helpful", "moderately helpful", "helpful", "very helpful")

# The scale each metric is judged on.
METRIC_SCALES = {
    "correctness": CORRECTNESS,
    "completeness": LIKERT,
    "helpfulness": HELPFULNESS,
    "faithfulness": FAITHFULNESS,
    "logical_coherence": LIKERT,
    "answer_correctness": CORRECTNESS,
}


@dataclass(frozen=True)
class Scale:
    """A user-supplied or built-in scale: labels in ascending order."""

    labels: tuple[str, ...]

    @property
    def middle(self) -> int:
        return len(self.labels) // 2

    def position(self, label: Column) -> Column:
        """Position of a lower-case label: exact, else first overlap in scale order, else null."""
        exact = F.array_position(F.array(*[F.lit(x) for x in self.labels]), label)
        first_overlap = F.coalesce(
            *[
                F.when(F.contains(label, F.lit(x)) | F.contains(F.lit(x), label), F.lit(i))
                for i, x in enumerate(self.labels)
            ]
        )
        return F.when(exact > 0, (exact - 1).cast("int")).otherwise(first_overlap)

    def label_at(self, position: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), position + 1)

    def score_at(self, position: Column) -> Column:
        return position.cast("double") / F.lit(float(len(self.labels) - 1))
