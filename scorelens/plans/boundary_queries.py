"""Registered queries: the score log held against its declaration."""

from __future__ import annotations

from ..sources import fixture
from ..sources.checked import KEYS, SCHEMAS, enforce
from .curation_sql import with_curation
from .registry import register

# Few counters of the fixture lie outside; a real log has its own bounds.
RANGES = {"countgeki": (None, 490), "count300": (1, None)}
_COLS = ", ".join(f.name for f in SCHEMAS["scores"].fields)
_REASON = "CASE WHEN countgeki > 490 THEN 'range countgeki' WHEN count300 < 1 THEN 'range count300' END"
_PLACED = (f"SELECT {_COLS}, copies, reason, row_number() OVER (PARTITION BY score_id, reason ORDER BY {_COLS}) AS place "
           f"FROM (SELECT {_COLS}, {_REASON} AS reason, count(*) AS copies FROM scores GROUP BY ALL)")


def _enforced(spark, sf_dir):
    return enforce(fixture.scores(spark, sf_dir), SCHEMAS["scores"], KEYS["scores"], RANGES)


@register("enforced_scores", with_curation(f"SELECT {_COLS} FROM ({_PLACED}) WHERE reason IS NULL AND place = 1"))
def q_enforced_scores(spark, sf_dir):
    return _enforced(spark, sf_dir)[0]


@register("quarantine", with_curation(
    f"SELECT * FROM (SELECT {_COLS}, CAST(CASE WHEN reason IS NULL AND place = 1 THEN copies - 1 ELSE copies END AS BIGINT) AS copies, "
    f"coalesce(reason, 'key') AS reason FROM ({_PLACED})) WHERE copies > 0"))
def q_quarantine(spark, sf_dir):
    return _enforced(spark, sf_dir)[1]
