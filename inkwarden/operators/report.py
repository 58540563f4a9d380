"""Reports from small aggregates: Markdown and HTML for people, JSON for a round trip."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.functions.text import percent_text


def project_json(posts: DataFrame) -> DataFrame:
    """One JSON record per post, which the JSON reader and the normaliser turn into the same post."""
    return posts.select("ord", F.to_json(F.struct(*[c for c in posts.columns if c not in ("ord", "clean", "status")])).alias("json"))


def lines_of(summary: DataFrame) -> list[tuple[str, str]]:
    """Names and values of a one-row summary; unknown values are named as such."""
    row = summary.first().asDict()
    return [(k, "unknown" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)) for k, v in row.items()]


def _quoted(text: str) -> str:
    return "\n".join(f"> {line}" for line in (text or "").splitlines() or [""])


def markdown(title: str, histogram: DataFrame, coverage: DataFrame, compliance: DataFrame, candidates: DataFrame) -> str:
    """A report; all arguments are bounded aggregates or lists of the first few."""
    out = [f"# {title}", "", "## Posts by status", ""]
    out += [f"- {r['status']}: {r['posts']}" for r in histogram.collect()]
    out += ["", "## Coverage", "", *[f"- {k}: {v}" for k, v in lines_of(coverage)]]
    shown = compliance.select(*[percent_text(F.col(c)).alias(c) for c in compliance.columns])
    out += ["", "## Compliance of what was assessed", "", *[f"- {k}: {v}" for k, v in lines_of(shown)], "", "## Candidates", ""]
    for r in candidates.orderBy("rank").collect():
        out += [f"{r['rank']}. {r['id']} {r['url']}", "", _quoted(r["text"][:240]), ""]
    return "\n".join(out)


def as_html(title: str, histogram: DataFrame, coverage: DataFrame, compliance: DataFrame, candidates: DataFrame) -> str:
    """The same report as a page, with everything escaped."""
    body = []
    for line in markdown(title, histogram, coverage, compliance, candidates).splitlines():
        text = html.escape(line)
        tag = "h1" if line.startswith("# ") else "h2" if line.startswith("## ") else "p"
        if line.strip():
            body.append(f"<{tag}>{text.lstrip('# ') if tag != 'p' else text}</{tag}>")
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body>{''.join(body)}</body></html>"
