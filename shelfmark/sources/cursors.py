"""Page cursors: the position after a page, bound to the query and to what the catalogue was, with a keyed digest against changes."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict

from shelfmark.operators.browse import AssetQuery


class InvalidCursor(ValueError):
    pass


def query_digest(q: AssetQuery) -> str:
    """Of everything that decides the rows and their order; the limit and the position don't."""
    parts = {k: v for k, v in asdict(q.normal()).items() if k not in ("limit", "after")} | {"terms": q.terms()}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def encode(key: bytes, q: AssetQuery, revision: int, values: tuple) -> str:
    body = json.dumps({"v": 1, "r": revision, "q": query_digest(q), "p": values}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.digest(key, body, "sha256") + body).rstrip(b"=").decode()


def decode(key: bytes, q: AssetQuery, revision: int, cursor: str) -> tuple:
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
        tag, body = raw[:32], raw[32:]
        if not hmac.compare_digest(tag, hmac.digest(key, body, "sha256")):
            raise InvalidCursor("not ours")
        got = json.loads(body)
    except (ValueError, TypeError) as e:
        raise InvalidCursor("unreadable") from e
    if got["v"] != 1 or got["r"] != revision or got["q"] != query_digest(q):
        raise InvalidCursor("of another query or state")
    return tuple(got["p"])
