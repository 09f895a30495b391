"""Texts sent to a language model, filled from columns. The wording is ours; what is filled in, and how it is cut, is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.labels import signal

# Characters of a context that a prompt takes, by its purpose, and contradictions that a summary lists.
SYNTHESIS_CHARS, USED_CHARS, GAP_CHARS, CHECK_CHARS, EXTRACT_CHARS, LISTED = 6000, 3000, 1500, 4000, 3000, 5
INTENT_NAMES = ("earnings_analysis", "risk_assessment", "guidance_tracking", "comparative_analysis", "tone_drift", "macro_context", "general")


def contradictions_text(found: Column) -> Column:
    """An array of (score, source_a, source_b, interpretation) as a numbered list of the first five; None detected without any."""
    one = lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.format_string("conflict (score=%.2f)", c["score"]), F.lit("\n     Source A: "), c["source_a"], F.lit("\n     Source B: "), c["source_b"], F.lit("\n     "), c["interpretation"])
    return F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, "None detected.").otherwise(F.array_join(F.transform(F.slice(found, 1, LISTED), one), "\n"))


def synthesis(ticker: Column, period: Column, context: Column, score: Column, components: dict[str, Column], alert: Column, reason: Column, count: Column, contradictions: Column) -> Column:
    """The task of writing an analysis: figures first, then the context. A missing figure is 0, a missing alert GREEN."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = [F.format_string(f"- {name.replace('_', ' ')}: %+.3f", zero(c)) for name, c in components.items()]
    return F.concat_ws(
        "\n", F.concat(F.lit("Assess the earnings quality of "), ticker, F.lit(" for "), period, F.lit(".")),
        F.concat(F.format_string("Composite score: %+.3f (", zero(score)), signal(zero(score)), F.lit(")")), *parts,
        F.concat(F.lit("Tone alert: "), F.coalesce(alert, F.lit("GREEN")), F.lit(" "), F.coalesce(reason, F.lit(""))),
        F.concat(F.lit("Contradictions ("), F.coalesce(count, F.lit(0)).cast("string"), F.lit("):")), F.coalesce(F.nullif(contradictions, F.lit("")), F.lit("None detected.")),
        F.lit("Context:"), F.left(context, F.lit(SYNTHESIS_CHARS)), F.lit("Use the context alone. State what changed, what supports it and what is open."),
    )


def gaps(ticker: Column, question: Column, context: Column) -> Column:
    shown = F.when(F.coalesce(context, F.lit("")) == "", "No context retrieved.").otherwise(F.left(context, F.lit(GAP_CHARS)))
    return F.concat_ws("\n", F.concat(F.lit("Company: "), ticker), F.concat(F.lit("Question: "), question), F.lit("Retrieved so far:"), shown, F.lit('What is missing? Reply in JSON: {"has_gaps": bool, "needs_peer_data": bool, "needs_macro_data": bool}'))


def quality_check(context: Column, answer: Column) -> Column:
    return F.concat_ws("\n", F.lit("Context:"), F.left(context, F.lit(CHECK_CHARS)), F.lit("Answer:"), answer, F.lit('How far does the context support the answer? Reply in JSON: {"score": number from 0 to 1, "issues": [text]}'))


def extraction(text: Column) -> Column:
    return F.concat_ws("\n", F.lit("List every guided amount of this text in JSON, with metric, low, high, unit and period:"), F.left(text, F.lit(EXTRACT_CHARS)))


def classification(question: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"Which of these is the question about: {', '.join(INTENT_NAMES)}? Reply with the name alone."), question)
