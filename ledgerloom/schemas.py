"""Explicit schemas of the engine's tables."""

MONEY = "decimal(18,2)"
ITEM = f"struct<description:string,quantity:double,unit_price:decimal(18,6),total_price:{MONEY},confidence:double>"
ITEMS = f"array<{ITEM}>"
ISSUES = "array<struct<type:string,severity:string>>"
WARNINGS = "array<string>"
OCR_RESULT = "file_id string, file_name string, raw_text string, ocr_method string, ocr_confidence double, processing_time double, success boolean, error string"
