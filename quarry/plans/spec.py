"""What a search asks for: normalised parameters, cursors and orders."""

from __future__ import annotations

import base64
import json
import math
import re
import unicodedata
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import fold_tables

# Fixed values of the service's contract.
DEFAULT_LIMIT, MAX_LIMIT = 20, 200
LATEST_LIMIT = 30
WHOLE_SET = -1
MAX_RESULTS, MOST_RESULTS = 2000, 20_000
MAX_CURSOR = 256
SORTS = {"fetchedAt": "fetched_at", "totalSize": "total_size", "relevance": "score"}


def whole_number(value: Any, fallback: int, least: int, most: int) -> int:
    """``value`` rounded down and clamped; ``fallback`` if it is no finite number."""
    number = _number(value)
    return fallback if number is None else max(least, min(most, math.floor(number)))


def _number(value: Any) -> float | None:
    if value is None or isinstance(value, bool):
        return None if value is None else float(value)
    if isinstance(value, str) and not value.strip():
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def page_limit(value: Any) -> int:
    """20 unless a positive number (at most 200); -1, only as a number, or ``all`` for the whole set."""
    if isinstance(value, int) and not isinstance(value, bool) and value == WHOLE_SET:
        return WHOLE_SET
    if isinstance(value, str) and value.strip().lower() == "all":
        return WHOLE_SET
    number = _number(value)
    return DEFAULT_LIMIT if number is None or number <= 0 else whole_number(number, DEFAULT_LIMIT, 1, MAX_LIMIT)


def size_bound(value: Any) -> float | None:
    """A finite number of at least 0; everything else, an empty string too, means no bound."""
    number = _number(value)
    return number if number is not None and number >= 0 else None


def folded(text: str) -> str:
    """The index's form of a text, on the driver."""
    low = text.lower().translate(str.maketrans(*fold_tables()))
    return "".join(c for c in low if unicodedata.category(c) != "Mn")


def query_terms(text: str | None) -> list[str]:
    """Tokens of a query in the index's form; the last one is a prefix."""
    found, run = [], []
    for c in folded(text or "") + " ":
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            found.append("".join(run))
            run = []
    return found


def words(text: str | None) -> list[str]:
    """Distinct lower-case tokens for previews and highlights, in order."""
    return list(dict.fromkeys(m.lower() for m in re.findall(r"[^\W_]+", text or "")))


@dataclass(frozen=True)
class SearchSpec:
    """Normalised parameters; making one of its own fields changes nothing."""

    query: str = ""
    sort_by: str | None = None
    order: str = "desc"
    by: str = "fts"
    search_in: str | None = None
    min_size: float | None = None
    max_size: float | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    cursor: str | None = None

    @classmethod
    def of(cls, raw: SearchSpec | dict[str, Any] | None = None, **more: Any) -> SearchSpec:
        given = dict(raw.__dict__) if isinstance(raw, SearchSpec) else dict(raw or {})
        given |= more
        query = given.get("query")
        if isinstance(query, (list, tuple)):
            query = query[0] if query else None
        cursor = given.get("cursor")
        return cls(
            query=query.strip() if isinstance(query, str) else "",
            sort_by=given.get("sort_by") if given.get("sort_by") in SORTS else None,
            order="asc" if str(given.get("order")).lower() == "asc" else "desc",
            by="hash" if given.get("by") == "hash" else "fts",
            search_in="name" if given.get("search_in") == "name" else None,
            min_size=size_bound(given.get("min_size")),
            max_size=size_bound(given.get("max_size")),
            limit=page_limit(given.get("limit")),
            offset=whole_number(given.get("offset"), 0, 0, 2**53 - 1),
            cursor=cursor if isinstance(cursor, str) and 0 < len(cursor) <= MAX_CURSOR else None,
        )

    @property
    def whole(self) -> bool:
        return self.limit == WHOLE_SET

    @property
    def sort_column(self) -> str:
        return SORTS[self.sort_by] if self.sort_by else "id"

    @property
    def keyset(self) -> bool:
        """Whether a cursor applies: not to hash look-ups, the whole set or relevance."""
        return self.by == "fts" and not self.whole and self.sort_by != "relevance"

    def without_paging(self) -> SearchSpec:
        return replace(self, limit=DEFAULT_LIMIT, offset=0, cursor=None, sort_by=None, order="desc")


def latest_page(limit: Any = None, offset: Any = None) -> tuple[int, int]:
    number = _number(limit)
    own = LATEST_LIMIT if number is None or number <= 0 else whole_number(number, LATEST_LIMIT, 1, MAX_LIMIT)
    return own, whole_number(offset, 0, 0, 2**53 - 1)


def encode_cursor(value: Any, row_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": value, "i": row_id}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[Any, int]:
    """Sort value and id of a cursor; ValueError if it is none."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        value, row_id = got["v"], got["i"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(row_id, int) or isinstance(row_id, bool) or not isinstance(value, (int, float)):
        raise ValueError("invalid cursor")
    return value, row_id


def ordering(spec: SearchSpec) -> list[Column]:
    """The total order of a spec: ties go by id, in the same direction except under relevance."""
    ascending = spec.order == "asc"
    if spec.sort_by == "relevance":  # lower scores are better
        return [F.col("score").desc() if ascending else F.col("score").asc(), F.col("id").asc()]
    columns = ["id"] if spec.sort_column == "id" else [spec.sort_column, "id"]
    return [F.col(c).asc() if ascending else F.col(c).desc() for c in columns]


def after_cursor(spec: SearchSpec) -> Column | None:
    """Rows that come after the cursor, as a predicate that reaches the scan."""
    if spec.cursor is None or not spec.keyset:
        return None
    value, row_id = decode_cursor(spec.cursor)
    ascending = spec.order == "asc"
    past = F.col("id") > row_id if ascending else F.col("id") < row_id
    if spec.sort_column == "id":
        return past
    own = F.col(spec.sort_column)
    return (own > value if ascending else own < value) | ((own == value) & past)


def size_range(spec: SearchSpec, column: str = "total_size") -> Column:
    """Both bounds included; always true without bounds."""
    out = F.lit(True)
    if spec.min_size is not None:
        out = out & (F.col(column) >= spec.min_size)
    if spec.max_size is not None:
        out = out & (F.col(column) <= spec.max_size)
    return out
