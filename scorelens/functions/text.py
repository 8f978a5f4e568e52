"""String helpers: display titles, first element of a JSON array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the item display format "artist - title (creator) [version]".
TITLE_FORMAT = "%s - %s (%s) [%s]"


def item_title(artist, title, creator, version) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in (artist, title, creator, version)]
    return F.format_string(TITLE_FORMAT, *cols)


def json_first(text, element_schema: str) -> Column:
    """First element of a JSON array of objects; NULL for bad text or an empty array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_element_at(F.from_json(c, f"array<{element_schema}>"), F.lit(1))
