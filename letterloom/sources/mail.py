"""Messages as rows: headers, body text and attachments of raw RFC 822 bytes."""

from __future__ import annotations

import email
import email.policy
import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "subject string, sender string, date string, body string, attachments array<struct<name:string,type:string,size:long>>"


def strip_html(html: str) -> str:
    """The text of a page: scripts and styles go, blocks and breaks become line ends."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html)
    text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6])\s*>", "\n", text)
    text = unescape(re.sub(r"(?s)<[^>]*>", " ", text))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.splitlines()) if x)


def parse(raw: bytes | None) -> tuple:
    """(subject, sender, date, body, attachments); all null for null or bytes that are no message."""
    if not raw:
        return None, None, None, None, None
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            files.append({"name": name or "", "type": kind, "size": len(part.get_payload(decode=True) or b"")})
        elif kind in ("text/plain", "text/html"):
            text = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", errors="replace")
            (plain if kind == "text/plain" else html).append(text)
    body = "\n".join(x.strip() for x in plain if x.strip()) or "\n".join(map(strip_html, html))
    text = lambda h: None if m[h] is None else str(m[h])
    return text("subject"), text("from"), text("date"), body, files


def messages(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with a struct ``message`` of each row's raw message; decoding runs in Arrow batches."""

    @F.pandas_udf(MESSAGE)
    def decode(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in rows], columns=["subject", "sender", "date", "body", "attachments"])

    return df.withColumn("message", decode(raw))
