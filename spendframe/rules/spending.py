"""Report vocabulary: exchange rates, item categories, currencies and month names."""

from __future__ import annotations

# Units of each currency per US dollar.
EXCHANGE_RATES = {
    "USD": 1.0,
    "EUR": 0.85,
    "GBP": 0.73,
    "CAD": 1.25,
    "AUD": 1.35,
    "JPY": 110.0,
    "CHF": 0.92,
}

# Item categories in order of precedence; a description belongs to
# the first category with a keyword anywhere in it.
CATEGORY_KEYWORDS = {
    "Electronics": ["echo", "fire tv", "kindle", "tablet", "phone", "charger", "headphone", "speaker", "smart home"],
    "Books": ["book", "novel", "textbook", "magazine", "journal", "comic"],
    "Clothing": ["shirt", "pants", "dress", "shoe", "jacket", "hat", "accessory"],
    "Home & Garden": ["garden", "plant", "furniture", "decor", "kitchen", "bathroom", "tool"],
    "Sports & Outdoors": ["bike", "tent", "camping", "fishing", "hiking", "sport", "exercise"],
    "Health & Beauty": ["shampoo", "lotion", "vitamin", "supplement", "cosmetic", "perfume"],
    "Food & Grocery": ["food", "grocery", "snack", "beverage", "coffee", "tea"],
    "Toys & Games": ["toy", "game", "puzzle", "board game", "video game"],
    "Office Supplies": ["pen", "paper", "notebook", "printer", "office", "stationery"],
    "Automotive": ["car", "auto", "tire", "oil", "part", "accessory"],
}
OTHER_CATEGORY = "Other"

# Fixed values.
DEFAULT_VENDOR = "Amazon"
BASE_CURRENCY = "USD"
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
GROWTH_BAND = 5.0
