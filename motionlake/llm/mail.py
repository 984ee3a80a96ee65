"""Text parts of raw messages: headers, nested multiparts, transfer encodings, HTML, quote marks.

Truncated parts are decoded as far as they go; undecodable bytes become U+FFFD. Parts that are not
text give nothing. A message without a blank line has no body.
"""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator

BLANK_LINE = re.compile(r"\n[ \t]*\r?\n|\A\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_CONTENT = re.compile(r"^content-(type|transfer-encoding):[ \t]*([^\n]*(?:\n[ \t][^\n]*)*)", re.I | re.M)
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*(?:"([^"]*)"|([^\s;]+))')
_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|hr|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|body|html|section|article)\b[^>]*>")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*(?:>|\Z)")
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def headers(block: str) -> dict[str, str]:
    """Unfolded content headers by lower-case name (``type``, ``transfer-encoding``); the first counts."""
    out: dict[str, str] = {}
    for name, value in _CONTENT.findall(block):
        out.setdefault(name.lower(), _FOLD.sub(" ", value).strip())
    return out


def split(text: str) -> tuple[dict[str, str], int]:
    """Headers of a message and the offset of its body (-1 without one)."""
    m = BLANK_LINE.search(text)
    return (headers(text[: m.start()]), m.end()) if m else (headers(text), -1)


def content_type(head: dict[str, str]) -> tuple[str, dict[str, str]]:
    value = head.get("type", "text/plain")
    kind = value.partition(";")[0].strip().lower() or "text/plain"
    return kind, {k.lower(): a or b for k, a, b in _PARAM.findall(value)} if ";" in value else {}


def encoding(head: dict[str, str]) -> str:
    return head.get("transfer-encoding", "").strip().lower()


def decode(body: str, how: str, charset: str) -> str:
    if how not in ("base64", "quoted-printable"):
        return body
    if how == "base64":
        chars = _NOT_BASE64.sub("", body.partition("=")[0] if body.rstrip().endswith("=") else body)
        chars = chars[: len(chars) - (len(chars) % 4 == 1)]
        raw = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))
    else:
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def html_text(source: str) -> str:
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", source))))


def text_parts(text: str, depth: int = 0) -> Iterator[str]:
    """Decoded text of every text part, HTML reduced to its text, in the order of the message."""
    head, at = split(text)
    if at < 0:
        return
    kind, params = content_type(head)
    body = text[at:]
    if kind.startswith("multipart/") and params.get("boundary"):
        if depth > 20:
            return
        for piece in ("\n" + body).split("\n--" + params["boundary"])[1:]:
            if piece.startswith("--"):
                break
            line, _, part = piece.partition("\n")
            if not line.strip():  # else a longer boundary that merely starts alike
                yield from text_parts(part, depth + 1)
        return
    if kind == "message/rfc822":
        yield from text_parts(decode(body, encoding(head), ""), depth + 1)
        return
    if kind.startswith("text/"):
        plain = decode(body, encoding(head), params.get("charset", ""))
        yield html_text(plain) if kind == "text/html" else plain


def without_quote_marks(text: str) -> str:
    return _QUOTE.sub("", text) if ">" in text else text
