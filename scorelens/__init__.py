"""scorelens: score-log curation and accuracy prediction on Spark DataFrames.

Typical use::

    from scorelens import CurationConfig, TrainConfig, curate, train, predict
    data = curate(scores_df, items_df, steps_df, CurationConfig())   # (mid, uid, accuracy)
    trained = train(data, TrainConfig())                             # split, transform, codes, ALS
    preds = predict(trained.model, pairs_df)                         # raises on unknown keys
"""

__version__ = "0.1.0"

from .config import CurationConfig, TrainConfig  # noqa: E402
from .operators.model import load, predict, save  # noqa: E402
from .plans.curation import curate, curation_stages  # noqa: E402
from .plans.modeling import (evaluation_report, holdout_predictions, predict_head,  # noqa: E402
                             train, train_two_branch)

__all__ = ["CurationConfig", "TrainConfig", "curate", "curation_stages", "train", "train_two_branch",
           "predict", "predict_head", "save", "load", "holdout_predictions", "evaluation_report"]
