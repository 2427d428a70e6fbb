"""Thresholds, weights and texts of the quality rules."""

from __future__ import annotations

# Thresholds, in cents unless noted.
TOTAL_TOLERANCE_SHARE = 0.01
TOTAL_TOLERANCE_CENTS = 10
COMPLEX_FACTOR = 3.0
COMPLEX_SHARE = 0.05
ITEM_TOLERANCE_CENTS = 100
MINOR_TOLERANCE_CENTS = 10
CRITICAL_SHARE = 0.1
HIGH_PRICE_CENTS = 100_000
VERY_HIGH_PRICE_CENTS = 500_000
HIGH_TOTAL_CENTS = 1_000_000
LOW_TOTAL_CENTS = 100
OLDEST_YEAR = 2010
ERROR_PENALTY = 20
WARNING_PENALTY = 5

# Labels that show an order of several shipments when they repeat.
SUBTOTAL_LABELS = [r"Item\(s\) Subtotal", "Zwischensumme", "Sous-total"]

# Fixed value: accepted order numbers.
ORDER_NUMBER_PATTERN = r"^\d{3}-\d{7}-\d{7}$|^[A-Z0-9]{3}-\d{7}-\d{7}$"

# First checklist, field -> (critical, shown name).
CHECKLIST_A = {
    "order_number": (True, "Order Number"),
    "order_date": (True, "Order Date"),
    "items": (True, "Items"),
    "subtotal": (False, "Subtotal"),
    "shipping": (False, "Shipping"),
    "tax": (False, "Tax"),
    "total": (True, "Total"),
    "currency": (True, "Currency"),
    "vendor": (False, "Vendor"),
}
STATUS_A = [(80, "excellent"), (60, "good"), (40, "fair"), (0, "poor")]

# Second checklist, field -> (critical, category).
CHECKLIST_B = {
    "orderNumber": (True, "order"),
    "orderDate": (True, "order"),
    "items": (True, "items"),
    "subtotal": (True, "financial"),
    "shipping": (False, "financial"),
    "tax": (True, "financial"),
    "discount": (False, "financial"),
    "total": (True, "financial"),
    "currency": (False, "financial"),
}
STATUS_B = [(90, "excellent"), (75, "good"), (60, "fair"), (40, "poor"), (0, "critical")]
KNOWN_CURRENCIES = ["USD", "EUR", "GBP", "CHF", "JPY", "CAD", "AUD"]

# Error classes in order of precedence:
# (words in the message, words in the context, exact context, level, type, recoverable, suggestion).
ERROR_CLASSES = [
    (["file not found", "permission denied", "invalid file type"], [], None,
     "critical", "file_access_error", False, "Check file path and permissions"),
    (["pdf parsing failed", "invalid pdf"], [], "pdf-parsing",
     "recoverable", "pdf_parsing_error", True, "Try re-saving PDF or check file corruption"),
    (["extraction failed"], ["field-extraction"], None,
     "recoverable", "field_extraction_error", True, "Partial data extraction attempted - check results"),
    (["validation"], ["validation"], None,
     "info", "validation_warning", True, "Data validated with warnings - review validation results"),
    ([], [], None,
     "recoverable", "unknown_error", True, "Unexpected error occurred - partial recovery attempted"),
]

# Recovery actions per error type in order:
# (action, description, priority, only with usable data).
RECOVERY_ACTIONS = {
    "pdf_parsing_error": [
        ("resave_pdf", 'Re-save the PDF using "Save As" in your PDF viewer', "high", False),
        ("check_corruption", "Verify PDF is not corrupted by opening in a PDF viewer", "high", False),
        ("use_partial_data", "Partial data extracted successfully - review and supplement manually", "medium", True),
    ],
    "field_extraction_error": [
        ("manual_review", "Review partial data and manually add missing fields", "medium", True),
        ("check_format", "Verify invoice format matches supported Amazon templates", "low", False),
    ],
    "file_access_error": [
        ("check_permissions", "Ensure read permissions on file and directory", "high", False),
        ("verify_path", "Double-check file path and filename", "high", False),
    ],
    "other": [
        ("use_extracted_data", "Partial data available for use", "medium", True),
        ("contact_support", "Report issue for investigation", "low", False),
    ],
}
CONFIDENCE_ACTIONS = [
    (0.7, "high_confidence_data", "High confidence data extracted - safe to use", "high"),
    (0.3, "medium_confidence_data", "Medium confidence data - manual verification recommended", "medium"),
]

# Parser-side penalties.
PARSER_PENALTIES = {
    "number_format": 15,
    "number_missing": 25,
    "date_missing": 20,
    "no_items": 15,
    "item_description": 5,
    "amount_format": 10,
    "total_missing": 15,
    "total_low": 5,
}
