"""Frozen parameter sets and the dataset naming key.

``CurationConfig`` carries the thresholds of the curation job.  The defaults
are the reference's published ones; ``FIXTURE_CURATION`` lowers the two
activity thresholds and raises the variance bound so the small test tables
keep rows (see FIXTURES.md).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CurationConfig:
    sr_min: float = 2.0
    sr_max: float = 15.0
    acc_min: float = 0.85
    acc_max: float = 1.0
    min_scores_per_mid: int = 50
    min_scores_per_uid: int = 50
    max_svness: float = 0.05
    # "uid": a player active in any year keeps all years (the reference's SQL);
    # "uid_year": the player must be active in that year (its documentation).
    user_key: str = "uid"
    # Item catalogue filter (fixed values of the reference): mania mode, 4K/7K.
    playmode: int = 3
    key_counts: tuple = (4, 7)

    def params(self) -> list:
        """Parameters in the order they enter the dataset name."""
        return [self.sr_min, self.sr_max, self.acc_min, self.acc_max,
                self.min_scores_per_mid, self.min_scores_per_uid, self.max_svness]


FIXTURE_CURATION = CurationConfig(min_scores_per_mid=8, min_scores_per_uid=5, max_svness=0.08)


@dataclass(frozen=True)
class TrainConfig:
    split: tuple = (0.8, 0.1, 0.1)
    seed: int = 373
    n_quantiles: int = 1000
    rank: int = 6
    max_iter: int = 10
    reg_param: float = 0.05
    # "all" fits the target transform and the encoders before the split (the
    # reference); "train" fits them on the training part only.
    fit_on: str = "all"
    # Blocks of the factorisation; None: one for about a million ratings.
    n_blocks: int | None = None

    def __post_init__(self):
        if abs(sum(self.split) - 1.0) > 1e-9:
            raise ValueError("train/test/val fractions must sum to 1")


def config_key(source: str, params: list, code: str, inputs: str = "") -> str:
    """``<tag>_<md5(source|inputs)[:8]>_<md5(params)[:8]>_<md5(code)[:8]>`` with ``|`` between
    the parts, so that (2, 15) and (21, 5) do not collide; the tag is for reading only."""
    import hashlib
    import re

    def digest(text: str) -> str:
        return hashlib.md5(text.encode()).hexdigest()[:8]

    whole = source.rstrip("/")
    tag = re.sub(r"[^A-Za-z0-9.]+", "-", whole.strip("/"))[-40:]
    return "_".join([tag, digest(f"{whole}|{inputs}"), digest("|".join(str(v) for v in params)), digest(code)])
