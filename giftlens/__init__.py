"""giftlens: gift-demand analytics as Spark DataFrame operators.

The main operators, importable from the package (see ``giftlens.operators``
for the full set)::

    from giftlens import training_frame, company_features, score_fallback
"""

__version__ = "0.1.0"

_EXPORTS = {
    "training_frame": "giftlens.operators.training",
    "selection_groups": "giftlens.operators.training",
    "company_stats": "giftlens.operators.features",
    "company_features": "giftlens.operators.features",
    "shop_features": "giftlens.operators.features",
    "company_split": "giftlens.operators.split",
    "cv_folds": "giftlens.operators.split",
    "score_fallback": "giftlens.operators.scoring",
    "validate_requests": "giftlens.operators.scoring",
    "classify_gender": "giftlens.operators.names",
    "upsert_presents": "giftlens.operators.products",
    "parse_attributes": "giftlens.operators.products",
    "system_api_stats": "giftlens.operators.usage",
    "top_users": "giftlens.operators.usage",
    "regression_metrics": "giftlens.operators.quality",
    "train_model": "giftlens.operators.model",
    "score_requests": "giftlens.operators.model",
    "register_sql_functions": "giftlens.functions.sql",
    "build_session": "giftlens.session",
}


def __getattr__(name):  # lazy: importing the package does not start Spark
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
