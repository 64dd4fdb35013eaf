"""Sending findings away: webhooks and issue trackers. Nothing is sent unless these are called.

Each function gives a lazy table (finding_id, ok, detail); writing it does the sending, so write it once. A
finding that can't be sent is a row that says why."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.share import markdown, webhook_body

SENT = "finding_id string, ok boolean, detail string"


def call(url: str, body: str | None = None, headers: dict[str, str] | None = None, timeout: float = 30.0) -> dict:
    """POST of a JSON text, or GET; the JSON answer, or an empty one."""
    req = urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        got = r.read()
    try:
        return json.loads(got or b"{}")
    except ValueError:
        return {}


def _each(found: DataFrame, columns: list[str], send: Callable[..., str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, *args in zip(*(batch.column(k).to_pylist() for k in range(1 + len(columns)))):
                try:
                    rows.append((key, True, send(key, *args)))
                except Exception as e:  # noqa: BLE001 - the others are still sent
                    rows.append((key, False, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 3, (pa.string(), pa.bool_(), pa.string()))], names=["finding_id", "ok", "detail"])

    return found.select("finding_id", *columns).mapInArrow(task, SENT)


def to_webhook(found: DataFrame, url: str, style: str = "json") -> DataFrame:
    """found(finding_id, record): each record to a webhook, plain or as the two common chat services want it."""

    def send(key: str, body: str) -> str:
        call(url, body)
        return "sent"

    return _each(found.withColumn("body", webhook_body(F.col("record"), style)), ["body"], send)


def to_issues(found: DataFrame, api: str, repo: str, token: str) -> DataFrame:
    """found(finding_id, record): an issue for each finding that no issue's title names yet."""
    auth = {"Authorization": f"Bearer {token}"}

    def send(key: str, record: str) -> str:
        asked = urllib.parse.urlencode({"q": f"repo:{repo} {key} in:title"})
        if call(f"{api}/search/issues?{asked}", headers=auth).get("total_count"):
            return "there already"
        text = markdown(json.loads(record))
        made = call(f"{api}/repos/{repo}/issues", json.dumps({"title": f"{key}: {text.splitlines()[0].lstrip('# ')}", "body": text}), auth)
        return str(made.get("html_url", "made"))

    return _each(found, ["record"], send)
