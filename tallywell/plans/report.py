"""Conclusions: checked documents of a metric, rendered only when every claim is proven."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame

from tallywell.functions.redaction import redact
from tallywell.operators.claims import SOURCE
from tallywell.sources.files import TRACKS, exists, write_bytes
from tallywell.sources.ledger import PROVENANCE


class ConclusionError(ValueError):
    pass


def validate_conclusion(c: dict) -> dict:
    """Track, provenance, metric, series pairs, and claims that all passed."""
    if not isinstance(c, dict) or c.get("track") not in TRACKS:
        raise ConclusionError("a conclusion belongs to a track")
    if missing := [k for k in PROVENANCE if not (c.get("provenance") or {}).get(k)]:
        raise ConclusionError(f"provenance lacks {', '.join(missing)}")
    metric, data = c.get("metric") or {}, c.get("data") or {}
    if not metric.get("name") or not isinstance(metric.get("version", 1), int):
        raise ConclusionError("a conclusion names its metric")
    if not data.get("snapshot_id") or not all(isinstance(r, (list, tuple)) and len(r) == 2 for r in data.get("series") or []):
        raise ConclusionError("data has a snapshot and pairs")
    claims = c.get("claims")
    if not isinstance(claims, list) or not claims:
        raise ConclusionError("nothing is claimed")
    for claim in claims:
        if claim.get("status") != "PASS" or not all((claim.get("source") or {}).get(k) for k in SOURCE):
            raise ConclusionError(f"the claim for {claim.get('period')} isn't proven")
    return c


def build_conclusion(track: str, metric: str, version: int, provenance: dict, series: list, reconciled: dict) -> dict:
    if reconciled["summary"] != "clean":
        raise ConclusionError(f"{reconciled['blocked']} claims don't match")
    return validate_conclusion({
        "track": track, "metric": {"name": metric, "version": version}, "provenance": provenance,
        "data": {"snapshot_id": provenance["snapshot_id"], "series": series}, "claims": reconciled["entries"]})


def render_html(c: dict, title: str = "") -> str:
    """A plain page with a line of the series and the claims it rests on."""
    validate_conclusion(c)
    points = [(d, v) for d, v in c["data"]["series"] if v is not None]
    low, high = min((v for _, v in points), default=0), max((v for _, v in points), default=1)
    line = " ".join(f"{10 + 580 * i / max(1, len(points) - 1):.1f},{110 - 100 * (v - low) / ((high - low) or 1):.1f}" for i, (_, v) in enumerate(points))
    rows = "".join(f"<tr><td>{html.escape(str(x['period']))}</td><td>{x['value']:g}</td><td>{html.escape(x['source']['query_id'])}</td></tr>" for x in c["claims"])
    head = html.escape(title or c["metric"]["name"])
    return (f"<!DOCTYPE html><meta charset=utf-8><title>{head}</title><h1>{head}</h1><p>{html.escape(c['track'])}, snapshot {html.escape(c['data']['snapshot_id'])}</p>"
            f"<svg width=600 height=120><polyline fill=none stroke=black points='{line}'/></svg><table>{rows}</table>")


def render_qmd(c: dict, title: str = "") -> str:
    validate_conclusion(c)
    rows = "\n".join(f"| {x['period']} | {x['value']:g} |" for x in c["claims"])
    return f"---\ntitle: \"{title or c['metric']['name']}\"\nformat: html\n---\n\nSnapshot `{c['data']['snapshot_id']}`.\n\n| period | value |\n|---|---|\n{rows}\n"


def export_report(c: dict, folder: str, ledger, kind: str = "html") -> dict:
    """Write a report and log it; nothing is written for a conclusion that isn't proven."""
    body = (render_html if kind == "html" else render_qmd)(c).encode()
    name = f"[{'C' if c['track'] == 'commerce' else 'R'}]{c['metric']['name']}-{c['provenance']['run_id']}.{kind}"
    dest = f"{folder.rstrip('/')}/{name}"
    write_bytes(dest, body)
    row = {"run_id": c["provenance"]["run_id"], "track": c["track"], "metric": c["metric"]["name"], "file_name": name, "dest": dest, "sha256": hashlib.sha256(body).hexdigest()}
    ledger.export(row)
    return row


def export_redacted(rows: DataFrame, uri: str, taken_from: str, policy: Mapping[str, object] | None = None, reveal="internal", salt: str = "tallywell") -> int:
    """Write rows as a viewer of level ``reveal`` sees them, as JSON lines; never over what they were read from.

    Returns the number of rows. An existing target is refused, whatever it is.
    """
    if uri.rstrip("/") == taken_from.rstrip("/") or exists(uri):
        raise FileExistsError(f"{uri} exists or is the input itself")
    shown = redact(rows, policy, reveal, salt)
    shown.write.mode("errorifexists").json(uri)
    return rows.sparkSession.read.schema(shown.schema).json(uri).count()


def export_claims(reconciled: dict, uri: str) -> int:
    """Write reconciled claims as JSON; the exit status is 0 only if they are clean."""
    write_bytes(uri, json.dumps(reconciled, ensure_ascii=False, indent=2, default=str).encode())
    return 0 if reconciled["summary"] == "clean" else 1
