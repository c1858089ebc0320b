"""Label space, field maps, prefixes, columns and defaults.

All tables here are small constants (at most 41 rows) and turn into literal expressions or
broadcast dimension tables; none of them grows with the data.
"""

from __future__ import annotations

# 41 semantic labels in declared order; index 0 of the BIO id space is ``O``.
SEMANTIC_LABELS = (
    "STATUS", "INVOICE_TYPE", "SUPPLIER_NAME", "SELLER_TAX_CODE", "SELLER_ADDRESS",
    "SELLER_PHONE", "BUYER_CONTACT", "BUYER_ORGANIZATION", "BUYER_TAX_CODE",
    "BUYER_BUDGETARY_UNIT_CODE", "BUYER_ADDRESS", "INVOICE_NUMBER", "INVOICE_SERIAL",
    "INVOICE_DATE", "PAYMENT_METHOD", "INVOICE_LOOKUP_CODE", "CONTRACT_REFERENCE",
    "BID_PACKAGE", "DELIVERY_UNIT", "RECEIVER_NAME", "LINE_NUMBER", "RAW_DESCRIPTION",
    "MEDICINE_NAME", "STRENGTH", "MANUFACTURER", "COUNTRY_OF_MANUFACTURE",
    "ITEM_BID_PACKAGE", "ITEM_CONTRACT_REFERENCE", "LOT_NUMBER", "EXPIRY_DATE", "UNIT",
    "QUANTITY", "UNIT_PRICE", "LINE_AMOUNT", "ITEM_VAT_RATE", "VAT_AMOUNT", "SUBTOTAL",
    "TOTAL_VAT_RATE", "VAT_TOTAL", "GRAND_TOTAL", "AMOUNT_IN_WORDS",
)

# Item label -> table column.
ITEM_COLUMNS = {
    "LINE_NUMBER": 0, "RAW_DESCRIPTION": 1, "MEDICINE_NAME": 2, "STRENGTH": 3,
    "MANUFACTURER": 4, "COUNTRY_OF_MANUFACTURE": 5, "ITEM_BID_PACKAGE": 6,
    "ITEM_CONTRACT_REFERENCE": 7, "LOT_NUMBER": 8, "EXPIRY_DATE": 9, "UNIT": 10,
    "QUANTITY": 11, "UNIT_PRICE": 12, "LINE_AMOUNT": 13, "ITEM_VAT_RATE": 14,
    "VAT_AMOUNT": 15,
}

# Record section -> field -> (label, kind).
FIELD_MAP = {
    "invoice": {
        "invoice_number": ("INVOICE_NUMBER", "identifier"),
        "invoice_serial": ("INVOICE_SERIAL", "identifier"),
        "invoice_date": ("INVOICE_DATE", "date"),
        "payment_method": ("PAYMENT_METHOD", "text"),
        "invoice_lookup_code": ("INVOICE_LOOKUP_CODE", "identifier"),
        "contract_reference": ("CONTRACT_REFERENCE", "identifier"),
    },
    "supplier": {
        "supplier_name": ("SUPPLIER_NAME", "text"),
        "tax_code": ("SELLER_TAX_CODE", "identifier"),
        "address": ("SELLER_ADDRESS", "text"),
        "phone": ("SELLER_PHONE", "identifier"),
    },
    "buyer": {
        "buyer_contact": ("BUYER_CONTACT", "text"),
        "buyer_organization": ("BUYER_ORGANIZATION", "text"),
        "tax_code": ("BUYER_TAX_CODE", "identifier"),
        "budgetary_unit_code": ("BUYER_BUDGETARY_UNIT_CODE", "identifier"),
        "address": ("BUYER_ADDRESS", "text"),
    },
    "totals": {
        "subtotal_excluding_vat": ("SUBTOTAL", "money"),
        "vat_rate_percent": ("TOTAL_VAT_RATE", "number"),
        "vat_total": ("VAT_TOTAL", "money"),
        "grand_total": ("GRAND_TOTAL", "money"),
        "amount_in_words": ("AMOUNT_IN_WORDS", "text"),
    },
    "items": {
        "line_number": ("LINE_NUMBER", "number"),
        "raw_description": ("RAW_DESCRIPTION", "text"),
        "medicine_name": ("MEDICINE_NAME", "text"),
        "strength": ("STRENGTH", "text"),
        "manufacturer": ("MANUFACTURER", "text"),
        "country_of_manufacture": ("COUNTRY_OF_MANUFACTURE", "text"),
        "bid_package_name": ("ITEM_BID_PACKAGE", "text"),
        "contract_reference": ("ITEM_CONTRACT_REFERENCE", "identifier"),
        "lot_number": ("LOT_NUMBER", "identifier"),
        "expiry_date": ("EXPIRY_DATE", "date"),
        "unit": ("UNIT", "text"),
        "quantity": ("QUANTITY", "number"),
        "unit_price": ("UNIT_PRICE", "money"),
        "line_amount": ("LINE_AMOUNT", "money"),
        "vat_rate_percent": ("ITEM_VAT_RATE", "number"),
        "vat_amount": ("VAT_AMOUNT", "money"),
    },
    "workflow_fields": {
        "status": ("STATUS", "text"),
        "invoice_type": ("INVOICE_TYPE", "text"),
        "bid_package": ("BID_PACKAGE", "text"),
        "delivery_unit": ("DELIVERY_UNIT", "text"),
        "receiver_name": ("RECEIVER_NAME", "text"),
    },
}

# Item fields joined as text, and those parsed as numbers.
ITEM_TEXT_LABELS = {
    "RAW_DESCRIPTION": "raw_description", "MEDICINE_NAME": "medicine_name",
    "STRENGTH": "strength", "MANUFACTURER": "manufacturer",
    "COUNTRY_OF_MANUFACTURE": "country_of_manufacture", "ITEM_BID_PACKAGE": "bid_package_name",
    "ITEM_CONTRACT_REFERENCE": "contract_reference", "LOT_NUMBER": "lot_number", "UNIT": "unit",
}
ITEM_NUMBER_LABELS = {
    "QUANTITY": "quantity", "UNIT_PRICE": "unit_price", "LINE_AMOUNT": "line_amount",
    "ITEM_VAT_RATE": "vat_rate_percent", "VAT_AMOUNT": "vat_amount",
}

# Printed prefixes (folded) that anchor a value to its label, in trial order.
VALUE_PREFIXES = {
    "INVOICE_NUMBER": ("so hoa don", "so"),
    "INVOICE_SERIAL": ("ky hieu hoa don", "ky hieu"),
    "PAYMENT_METHOD": ("hinh thuc thanh toan",),
    "SELLER_TAX_CODE": ("ma so thue",),
    "BUYER_TAX_CODE": ("ma so thue",),
    "SUBTOTAL": ("tong tien chua thue", "tong tien hang", "cong tien hang"),
    "TOTAL_VAT_RATE": ("thue suat gtgt", "thue suat"),
    "VAT_TOTAL": ("tien thue gtgt", "thue gtgt"),
    "GRAND_TOTAL": ("tong cong tien thanh toan", "tong tien thanh toan"),
    "AMOUNT_IN_WORDS": ("so tien viet bang chu",),
    "EXPIRY_DATE": ("han su dung", "han dung"),
}

# Match methods trusted without review (after removing ``multi_box_``).
SAFE_METHODS = (
    "exact", "whitespace_normalized", "exact_normalized", "anchored_exact_normalized",
    "identifier_normalized", "money_normalized", "number_normalized", "date_normalized",
)

# Names that mark a metric as lower-is-better.
LOWER_IS_BETTER = ("cer", "wer", "latency", "time", "runtime", "memory", "ram", "unresolved", "failed")

# Protocol attributes compared between two runs; the first three are strict.
PROTOCOL_ATTRIBUTES = (
    "split_manifest_hash", "test_document_ids", "schema_version", "preprocessing_config_hash",
    "postprocessing_config_hash", "workflow_defaults_hash", "validation_tolerance", "batch_size",
    "num_workers", "device", "hardware_fingerprint", "metric_code_version",
)
STRICT_ATTRIBUTES = PROTOCOL_ATTRIBUTES[:3]

# File suffixes taken as documents, and the annotation stages.
DOCUMENT_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "pdf")
STAGES = ("detection", "recognition", "layout", "final")

# Required fields and tolerance of the default workflow.
REQUIRED_FIELDS = (
    "invoice.invoice_number", "invoice.invoice_date", "supplier.supplier_name",
    "buyer.buyer_organization", "totals.grand_total",
)
DEFAULT_TOLERANCE = "1"
BATCH_TYPE = "VAT_INVOICE_BATCH"


def bio_ids(labels: tuple[str, ...] = SEMANTIC_LABELS) -> dict[str, int]:
    """``O`` is 0, then B-x and I-x per label in declared order."""
    ordered = ["O"] + [f"{prefix}-{label}" for label in labels for prefix in ("B", "I")]
    return {name: position for position, name in enumerate(ordered)}
