"""Fixed values and column lists shared by the operators.

Everything under the FIXED VALUES banner must keep its exact text, because
results (hashes, rates, classifications) depend on it. The rest are column
lists that describe the data model.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------

# Token that stands for a missing category.
MISSING = "NONE"

# Text values a CSV reader treats as missing (the pandas default list). "NONE"
# is deliberately not in it.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

GENDERS = ["male", "female"]

# Allowed values of the four enumerated product attributes.
TARGET_DEMOGRAPHICS = ["male", "female", "unisex"]
UTILITY_TYPES = ["practical", "work", "aesthetic", "status", "sentimental", "exclusive"]
DURABILITIES = ["consumable", "durable"]
USAGE_TYPES = ["shareable", "individual"]

# House vendor: its name is left out of the product key.
HOUSE_VENDOR = "gavefabrikken"

# Built-in first-name list: name -> gender.
BUILTIN_NAMES = {
    "ea": "female", "my": "female", "freja": "female", "saga": "female",
    "alba": "female", "liv": "female", "naja": "female", "maja": "female",
    "clara": "female", "frida": "female", "vigga": "female", "luna": "female",
    "nova": "female", "aya": "female", "nora": "female", "alma": "female",
    "bo": "male", "aksel": "male", "villads": "male", "malthe": "male",
    "viggo": "male", "theodor": "male", "bertram": "male", "storm": "male",
    "august": "male", "magnus": "male", "felix": "male", "noah": "male",
    "lucas": "male", "oscar": "male", "victor": "male", "emil": "male",
}

# Keyword rules for describing a gift from free text: first matching rule wins
# (case-insensitive substring match); the last entry is the default.
DESCRIPTION_RULES = [
    (["pizza", "oven"], {
        "product_main_category": "Home & Kitchen",
        "product_sub_category": "Cookware",
        "product_brand": "Tisvilde",
        "product_color": "NONE",
        "product_durability": "durable",
        "product_target_gender": "unisex",
        "product_utility_type": "practical",
        "product_type": "individual",
    }),
    (["bag", "toiletry"], {
        "product_main_category": "Bags",
        "product_sub_category": "Toiletry Bag",
        "product_brand": "Markberg",
        "product_color": "black",
        "product_durability": "durable",
        "product_target_gender": "female",
        "product_utility_type": "practical",
        "product_type": "individual",
    }),
    ([], {
        "product_main_category": "General",
        "product_sub_category": "Unknown",
        "product_brand": "NONE",
        "product_color": "NONE",
        "product_durability": "durable",
        "product_target_gender": "unisex",
        "product_utility_type": "practical",
        "product_type": "individual",
    }),
]

# Rule-based selection rate (used when no trained model is available).
RULE_BASE_RATE = 0.30
RULE_CATEGORY_RATES = {"Home & Kitchen": 0.45, "Bags": 0.35}
RULE_SAME_GENDER_FACTOR = 1.5
RULE_UNISEX_FACTOR = 1.0
RULE_OTHER_GENDER_FACTOR = 0.7
RULE_NOISE_SPAN = 0.2
RULE_RATE_MIN = 0.1
RULE_RATE_MAX = 1.0

# Confidence of a prediction: min(CAP, BASE + SLOPE * mean positive rate).
CONFIDENCE_BASE = 0.5
CONFIDENCE_SLOPE = 2.0
CONFIDENCE_CAP = 0.95

# Company -> shop mapping used at scoring time; unknown companies map to the
# default shop.
COMPANY_SHOP_MAP = {
    "12233445": "shop123",
    "34446505": "shop123",
    "14433445": "shop456",
    "28892055": "shop456",
}
UNKNOWN_SHOP = "shop_unknown"

# Company features used at scoring time for a company without statistics.
DEFAULT_COMPANY_FEATURES = {
    "company_main_category_diversity": 3,
    "company_brand_diversity": 5,
    "company_utility_type_diversity": 2,
    "company_total_selections": 50,
    "company_most_frequent_main_category": "Home & Kitchen",
    "is_company_most_frequent_main_category": 0,
}

# Request limits.
CVR_DIGITS = 8
MAX_EMPLOYEES = 10000
MAX_PRESENTS = 100
MAX_NAMES = 1000
CONFIDENCE_LEVEL = 0.95

# Classification status values.
STATUS_SUCCESS = "success"
STATUS_PENDING = "pending_classification"
STATUS_INVALIDATED = "invalidated"
STATUS_MISSING_DETAILS = "error_missing_details"
STATUS_NO_DATA = "error_openai_nodata"
STATUS_API_ERROR = "error_openai_api"
STATUS_PROCESSING_FAILED = "error_processing_failed"

# Retention periods (days) and trailing-window defaults.
LOG_RETENTION_DAYS = 90
CACHE_RETENTION_DAYS = 30
USER_STATS_DAYS = 30
SYSTEM_STATS_HOURS = 24
PAYLOAD_PREVIEW_CHARS = 500

# Model settings of the boosted-tree trainer.
GBT_ITERATIONS = 1000
GBT_LEARNING_RATE = 0.1
GBT_DEPTH = 6
GBT_SEED = 42
GBT_EARLY_STOP_ROUNDS = 50
GBT_LEAF_PENALTY = 3.0
SPLIT_SEED = 42
VALIDATION_SHARE = 0.2
CV_FOLDS = 3

# ---------------------------------------------------------------------------
# Column lists of the data model.
# ---------------------------------------------------------------------------

GROUP_KEYS = ["shop_id", "company_cvr", "gift_id", "employee_gender"]

PRODUCT_COLUMNS = [
    "product_main_category", "product_sub_category", "product_brand",
    "product_color", "product_durability", "product_target_gender",
    "product_utility_type", "product_type",
]

SELECTION_COLUMNS = ["shop_id", "company_cvr", "employee_gender", "gift_id"] + PRODUCT_COLUMNS

LOWERCASE_COLUMNS = [
    "employee_gender", "product_target_gender", "product_utility_type",
    "product_durability", "product_type",
]

COMPANY_FEATURE_COLUMNS = [
    "company_main_category_diversity", "company_brand_diversity",
    "company_utility_type_diversity", "company_total_selections",
    "company_most_frequent_main_category", "is_company_most_frequent_main_category",
]

FEATURE_COLUMNS = GROUP_KEYS + PRODUCT_COLUMNS + COMPANY_FEATURE_COLUMNS

CATEGORICAL_FEATURES = GROUP_KEYS + PRODUCT_COLUMNS + ["company_most_frequent_main_category"]

NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c not in CATEGORICAL_FEATURES]

# Attribute JSON keys (camelCase) -> table columns (snake_case).
ATTRIBUTE_COLUMNS = {
    "itemMainCategory": "item_main_category",
    "itemSubCategory": "item_sub_category",
    "color": "color",
    "brand": "brand",
    "vendor": "vendor",
    "valuePrice": "value_price",
    "targetDemographic": "target_demographic",
    "utilityType": "utility_type",
    "durability": "durability",
    "usageType": "usage_type",
}
