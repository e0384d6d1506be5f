"""Rule tables that a caller may pass in, as values or as a DataFrame of bounded size."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import rules

# Rules become part of the plan, so a table of them must stay small.
MOST = 10_000


def _tokens(values: Iterable[str]) -> tuple[str, ...]:
    return tuple(values)


class _Table:
    @classmethod
    def from_table(cls, table: DataFrame, kind: str = "kind", value: str = "value", order: str | None = None, most: int = MOST):
        """Rules from rows (kind, value): ``kind`` names a field; kinds without rows keep the shipped rules.

        A table of more than ``most`` rows is refused before it is read; an unknown kind too.
        """
        rows = table.select(F.col(kind).alias("kind"), F.col(value).alias("value"), (F.col(order) if order else F.col(value)).alias("place"))
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"a rule table holds {most} rows at most")
        names = {f.name for f in fields(cls)}
        unknown = {r.kind for r in found} - names
        if unknown:
            raise ValueError(f"unknown kinds of rules: {sorted(map(str, unknown))}")
        given: dict[str, list[str]] = {}
        for r in sorted(found, key=lambda r: r.place):
            given.setdefault(r.kind, []).append(r.value)
        return cls(**{k: tuple(v) for k, v in given.items()})


@dataclass(frozen=True)
class LinkRules(_Table):
    """What makes a link a product, a listing, a catalogue entry or neither."""

    product_paths: tuple[str, ...] = _tokens(rules.PRODUCT_PATH_TOKENS)
    listing_paths: tuple[str, ...] = _tokens(rules.LISTING_PATH_TOKENS)
    listing_texts: tuple[str, ...] = _tokens(rules.LISTING_TEXT_TOKENS)
    entry_paths: tuple[str, ...] = _tokens(rules.ENTRY_PATH_TOKENS)
    entry_texts: tuple[str, ...] = _tokens(rules.ENTRY_TEXT_TOKENS)
    news: tuple[str, ...] = _tokens(rules.NEWS_TOKENS)
    skipped: tuple[str, ...] = _tokens(rules.SKIP_TOKENS)


@dataclass(frozen=True)
class ApiRules(_Table):
    """Patterns with one group that find endpoint and feed addresses in page text."""

    patterns: tuple[str, ...] = _tokens(rules.API_PATTERNS)
    fetches: tuple[str, ...] = (rules.FETCH_PATTERN,)
    feed_endings: tuple[str, ...] = _tokens(rules.FEED_EXTENSIONS)


@dataclass(frozen=True)
class ImageRules(_Table):
    """Tokens of image addresses that are no product pictures."""

    rejected: tuple[str, ...] = _tokens(rules.BAD_IMAGE_TOKENS)
    rejected_social: tuple[str, ...] = _tokens(rules.SOCIAL_IMAGE_TOKENS)


def context_rules(table: DataFrame, most: int = MOST) -> tuple[tuple[str, str], ...]:
    """(name, pattern) rows as the context table of ``source_profile``."""
    found = table.select("name", "pattern").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a rule table holds {most} rows at most")
    return tuple(sorted((r.name, r.pattern) for r in found))
