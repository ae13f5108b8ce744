"""Fixed values.

Every table in this module must equal the values the analysed dashboard uses,
otherwise derived features differ. They are stated plainly and in their
natural order; nothing here is computed.
"""

# --- fixed values: yearly purchase count per frequency label -----------------
FREQUENCY_PER_YEAR = {
    "Weekly": 52,
    "Bi-Weekly": 26,
    "Fortnightly": 26,
    "Quarterly": 4,
    "Annually": 1,
    "Monthly": 12,
    "Every 3 Months": 4,
}

# --- fixed values: payment method to payment type ----------------------------
PAYMENT_TYPE = {
    "Cash": "Cash",
    "Credit Card": "Card",
    "Debit Card": "Card",
    "PayPal": "Online",
    "Venmo": "Online",
    "Bank Transfer": "Online",
}

# --- fixed values: age bins, right-closed (0,30] (30,45] (45,56] (56,200] ----
AGE_EDGES = [0, 30, 45, 56, 200]
AGE_LABELS = ["18-30", "31-45", "46-56", "57-70"]

# --- fixed values: loyalty bins [0,13] (13,25] (25,38] (38,200] --------------
LOYALTY_EDGES = [0, 13, 25, 38, 200]
LEVEL_LABELS = ["Low", "Mid", "High", "Very High"]

# --- fixed values: US state to climate group ---------------------------------
COLD_STATES = ["Alaska", "North Dakota", "South Dakota", "Minnesota", "Wisconsin",
               "Michigan", "Montana", "Wyoming", "Maine", "Vermont", "New Hampshire"]
COOL_STATES = ["Massachusetts", "Connecticut", "Rhode Island", "New York",
               "Pennsylvania", "New Jersey", "Ohio", "Indiana", "Illinois", "Iowa",
               "Nebraska", "Kansas", "Colorado", "Utah", "Idaho", "Washington", "Oregon"]
WARM_STATES = ["Virginia", "Maryland", "Delaware", "Kentucky", "Missouri",
               "West Virginia", "North Carolina", "Tennessee", "Arkansas", "Oklahoma"]
HOT_STATES = ["Florida", "Texas", "Louisiana", "Mississippi", "Alabama", "Georgia",
              "South Carolina", "Arizona", "Nevada", "New Mexico", "California"]
TROPICAL_STATES = ["Hawaii"]
CLIMATE_GROUPS = [("Cold", COLD_STATES), ("Cool", COOL_STATES), ("Warm", WARM_STATES),
                  ("Hot", HOT_STATES), ("Tropical", TROPICAL_STATES)]

# --- fixed values: segment names and actions by segment rank ------------------
SEGMENT_NAMES = {
    3: "VIP'e En Yakınlar",
    0: "Avantaj Avcıları",
    2: "Büyük Sepetliler",
    4: "Kararsızlar",
    1: "Sessiz Kitle",
}
SEGMENT_ACTIONS = {
    3: "Upsell / Premium",
    0: "Upsell / Premium",
    2: "Nurture / Education",
    4: "Winback / Aggressive Promo",
    1: "Winback / Aggressive Promo",
}
DEFAULT_SEGMENT_NAME = "Genel Segment"
DEFAULT_SEGMENT_ACTION = "Genel"
UNKNOWN_SEGMENT_NAME = "Bilinmiyor"

# --- fixed values: rare-label rule and redundancy rule -------------------------
RARE_SHARE = 0.01
RARE_LABEL = "Rare"
REDUNDANCY_V = 0.80
TOP_LOCATIONS = 10
TARGET_RECALL = 0.85
DEFAULT_THRESHOLD = 0.50

# --- fixed values: columns the model never sees -------------------------------
MODEL_DROP_COLUMNS = [
    "customer_id", "subscription_status", "item_purchased", "location", "color",
    "size", "frequency_of_purchases", "payment_method", "shipping_type",
    "purchase_amount_usd", "previous_purchases", "review_rating", "age",
    "discount_applied", "season", "promo_code_used",
]
LEAKAGE_PREFIXES = ("sub_freq_new", "promo_no_sub_new", "ship_sub_new")

# --- fixed values: behavioural inputs of the segmentation ----------------------
SEGMENT_FEATURES = [
    "purchase_amount_usd",
    "previous_purchases",
    "frequency_value_new",
    "spend_per_purchase_new",
    "total_spend_weighted_new",
]
