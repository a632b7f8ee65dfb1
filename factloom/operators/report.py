"""Reports of small summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Texts of answers.
WEAK = "No proof was found. The question is only weakly aligned with the knowledge base: its goal may have another shape than the facts, or facts are missing."
NONE = "I don't know: no proof was found for this question."
UNTRANSLATED = "I could not translate the question into a goal."


def markdown(summary: DataFrame, title: str = "Summary") -> str:
    """A summary (one row per parser) as a Markdown table, sorted by its first column."""
    rows = sorted(summary.collect(), key=lambda r: str(r[0]))
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def text_table(summary: DataFrame) -> str:
    """The same as aligned text."""
    rows = [[*summary.columns], *([("" if v is None else str(v)) for v in r] for r in sorted(summary.collect(), key=lambda r: str(r[0])))]
    width = [max(len(r[i]) for r in rows) for i in range(len(summary.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in rows)


def answer(proof: str | None, status: str) -> str:
    """Answer text of a proof."""
    found = bool(proof and proof.strip() not in ("", "[]"))
    return f"Proved by {proof}" if found else WEAK if status == "weakly_aligned" else NONE


def answer_text(answers: list[dict], count: int, status: str, enabled: bool = True) -> str:
    """Answer text of bindings: the variables of each, and how many more there are. Switched off it is empty, but for the
    note on a weakly aligned question without a proof."""
    if not count:
        return WEAK if status == "weakly_aligned" else NONE if enabled else ""
    if not enabled:
        return ""
    shown = ["; ".join([", ".join(f"{k[1:]} = {v}" for k, v in a.items() if k[:1] in "$?")]) for a in answers]
    text = "; ".join(s or "yes" for s in shown)
    return text + (f"; and {count - len(answers)} more" if count > len(answers) else "")


def write_json(summary: DataFrame, path: str) -> None:
    """A summary as one JSON file of rows, in the file system of the path."""
    summary.coalesce(1).write.mode("overwrite").json(path)
