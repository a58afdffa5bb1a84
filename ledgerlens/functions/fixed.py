"""Fixed values of the scoring, parsing and reporting rules."""

# Categories that are not spend.
NON_SPEND = ["Income", "Refund"]

# Rules score.
RULES_PRIOR = 0.02
RULES_NEW_DEVICE = 0.35
RULES_IP_MISMATCH = 0.20
RULES_NO_KYC = 0.15
RULES_HIGH_RISK_USER = 0.12
RULES_AMOUNT_STEPS = [(4.0, 0.20), (2.0, 0.10), (1.0, 0.03)]
RULES_NIGHT = 0.05
RULES_FAILURES = (2, 0.08)
RULES_YOUNG_ACCOUNT = (30, 5000, 0.08)
RULES_UNKNOWN_AGE = 999
RULES_CAP = 0.98

# Score used without model artefacts.
FALLBACK_PRIOR = 0.05
FALLBACK_NEW_DEVICE = 0.35
FALLBACK_IP_MISMATCH = 0.20
FALLBACK_HIGH_RISK_USER = 0.15
FALLBACK_AMOUNT = (3.0, 0.15)
FALLBACK_NIGHT = 0.05
FALLBACK_NO_KYC = 0.05
FALLBACK_CAP = 0.99
OFFLINE_AMOUNT = 10000
OFFLINE_SCORES = (0.88, 0.05)

# Five-feature logistic score.
LIGHT_INTERCEPT = -3.50
LIGHT_WEIGHTS = {
    "amount_deviation_score": 0.85,
    "new_device_flag": 1.60,
    "ip_location_mismatch": 1.20,
    "transaction_velocity": 0.95,
    "failed_attempts_last_24h": 0.70,
}

# Ensemble weights by scorer.
ENSEMBLE_WEIGHTS = {"rules": 0.15, "tree": 0.60, "light_lr": 0.25}

# Alert cuts and what each level asks for.
ALERT_CUTS = [(0.70, "high"), (0.40, "medium"), (0.20, "low")]
ALERT_ACTIONS = {
    "high": "block and notify",
    "medium": "PIN re-entry",
    "low": "silent flag",
    "none": "log",
}

# Message gates and extraction patterns.
SENDER_PATTERN = r"(?i)^[A-Z]{2}-[A-Z0-9]{4,6}$"
KEYWORD_PATTERN = r"(?i)\b(debited|credited|upi|rs\.|inr|transaction|payment)\b"
EXTRACT_PATTERN = (
    r"(?i)(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d{1,2})?)"
    r"|(?:to|at|towards)\s+([A-Za-z0-9@._\-\s]{2,40}?)(?=\s+(?:for|on|via|ref|\d))"
    r"|(?:UPI\s*Ref\.?|Ref\s*No\.?|Txn\s*[Ii][Dd])[:\s]*([A-Z0-9]{8,20})"
    r"|(\d{1,2}[-/]\w{3}[-/]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
)
LENIENT_KEYWORDS = ["debited", "credited", "spent", "alert", "withdrawn"]
LENIENT_AMOUNT_PATTERN = r"(?i)(?:Rs\.?|INR|₹)\s*([\d,]+(?:\.\d{2})?)"
LENIENT_PAYEE_PATTERN = (
    r"(?i)(?:to|towards|at|debited to)\s+([A-Za-z0-9\s]+?)(?:\s+(?:UPI|Ref|on|Bal|a\/c|from|$))"
)
LENIENT_AMOUNT = 100.0

# Keyword rules, first match wins: keyword, category, confidence.
KEYWORD_RULES = [
    ("zomato", "Food", 0.99),
    ("swiggy", "Food", 0.99),
    ("dominos", "Food", 0.99),
    ("irctc", "Travel", 0.99),
    ("ola", "Travel", 0.97),
    ("uber", "Travel", 0.97),
    ("amazon", "Shopping", 0.98),
    ("flipkart", "Shopping", 0.98),
    ("netflix", "Entertainment", 0.98),
    ("hotstar", "Entertainment", 0.98),
    ("electricity", "Utilities", 0.96),
    ("bsnl", "Recharge", 0.95),
    ("airtel", "Recharge", 0.95),
    ("jio", "Recharge", 0.95),
]
KEYWORD_MIN_CONFIDENCE = 0.65
LENIENT_RULES = [
    ("zomato", "Food & Dining", 1.0),
    ("swiggy", "Food & Dining", 1.0),
    ("starbucks", "Food & Dining", 1.0),
    ("hotel", "Food & Dining", 1.0),
    ("amazon", "Shopping", 1.0),
    ("flipkart", "Shopping", 1.0),
    ("myntra", "Shopping", 1.0),
    ("grocery", "Grocery", 1.0),
    ("supermarket", "Grocery", 1.0),
    ("mart", "Grocery", 1.0),
    ("uber", "Travel", 1.0),
    ("ola", "Travel", 1.0),
    ("irctc", "Travel", 1.0),
    ("netflix", "Entertainment", 1.0),
    ("spotify", "Entertainment", 1.0),
    ("multiplex", "Entertainment", 1.0),
]
SHARE_CATEGORIES = [
    "Food & Dining", "Shopping", "Grocery", "Travel", "Entertainment", "Uncategorized",
]

# Closed vocabularies of a scoring record.
APPS = ["GPay", "PhonePe", "Paytm", "Amazon Pay", "BHIM", "WhatsApp Pay"]
DEVICES = ["Android", "iOS", "Web"]
VOCABULARIES = {
    "receiver_type": ["Merchant", "User"],
    "transaction_type": ["P2M", "P2P", "Bill Payment", "EMI", "Recharge", "Subscription", "ATM"],
    "payment_app": APPS,
    "device_type": DEVICES,
    "usr_age_group": ["18-24", "25-34", "35-44", "45-54", "55+"],
    "usr_preferred_app": APPS,
    "usr_preferred_device": DEVICES,
    "mrc_category": [
        "Food", "Food & Dining", "Travel", "Grocery", "Electronics",
        "Clothing", "Healthcare", "Entertainment", "Education",
        "Utilities", "Fuel", "Insurance", "Shopping", "Recharge", "P2P Transfer",
    ],
    "mrc_size": ["Small", "Medium", "Enterprise", "P2P"],
}
ADDRESS_PATTERN = r"^[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}$"

# The scoring record, in order.
MODEL_FEATURES = [
    "receiver_type", "transaction_type", "payment_app", "device_type",
    "usr_age_group", "usr_preferred_app", "usr_preferred_device",
    "mrc_category", "mrc_size", "amount", "hour_of_day", "day_of_week",
    "is_weekend", "is_night_transaction", "time_since_last_txn_min",
    "transaction_velocity", "amount_deviation_score", "failed_attempts_last_24h",
    "recurring_payment_flag", "transaction_frequency_score", "new_device_flag",
    "ip_location_mismatch", "user_city_tier", "user_avg_monthly_txn",
    "user_avg_txn_value", "user_loyalty_score", "balance_after_transaction",
    "txn_success_flag", "kyc_verified_flag", "usr_home_city_tier",
    "usr_account_age_days", "usr_linked_bank_count", "usr_avg_monthly_txn_profile",
    "usr_avg_txn_value_profile", "usr_is_high_risk", "mrc_avg_daily_txn",
    "mrc_is_registered", "mrc_rating", "device_risk_score", "ip_risk_score",
]

# Vocabulary maps of the training table.
TYPE_MAP = {"POS": "P2M", "QR": "P2M", "Online": "P2M", "ATM": "ATM"}
WEEKDAY_MAP = {
    "Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3,
    "Friday": 4, "Saturday": 5, "Sunday": 6,
}
TIER_MAP = {"Tier 1": 1, "Tier 2": 2, "Tier 3": 3}
RISK_CUT = 0.70

# Names of joined profile columns.
USER_COLUMNS = {
    "age_group": "usr_age_group",
    "city": "usr_home_city",
    "city_tier": "usr_home_city_tier",
    "account_age_days": "usr_account_age_days",
    "linked_bank_count": "usr_linked_bank_count",
    "avg_monthly_transactions": "usr_avg_monthly_txn_profile",
    "avg_transaction_value": "usr_avg_txn_value_profile",
    "preferred_app": "usr_preferred_app",
    "preferred_device": "usr_preferred_device",
    "is_high_risk_user": "usr_is_high_risk",
}
MERCHANT_COLUMNS = {
    "merchant_category": "mrc_category",
    "merchant_size": "mrc_size",
    "avg_daily_transactions": "mrc_avg_daily_txn",
    "is_registered": "mrc_is_registered",
    "rating": "mrc_rating",
}
P2P_DEFAULTS = {
    "mrc_category": "P2P Transfer",
    "mrc_size": "P2P",
    "mrc_avg_daily_txn": 0,
    "mrc_is_registered": 1,
}
DROPPED_BEFORE_TRAINING = [
    "transaction_id", "user_id", "receiver_id", "timestamp", "date",
    "data_source", "user_kyc_status", "status", "usr_home_city",
]

# Weekly tips.
TIPS = {
    "Food": "Try cooking 2 extra meals at home — saves ≈₹800/week on average.",
    "Food & Dining": "Limit restaurant visits to weekends to cut food spend by 30%.",
    "Travel": "Book rides 15 min before departure — surge pricing drops fast.",
    "Shopping": "Add items to cart, wait 24h — impulse urge passes 60% of the time.",
    "Grocery": "Buy staples in bulk monthly — saves ≈15% vs weekly small trips.",
    "Entertainment": "Share OTT subscriptions — you can legally share with 1 household.",
    "Recharge": "Switch to a quarterly recharge plan — saves ₹50–120 per cycle.",
    "Healthcare": "Schedule non-urgent appointments in bulk to save on consultation fees.",
}

# Thresholds tried and what a good one must reach.
SWEEP = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]
MIN_RECALL = 0.75
MIN_PRECISION = 0.50

# Boosted trees.
TREE_PARAMS = {
    "maxIter": 400, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 10, "seed": 42,
}
