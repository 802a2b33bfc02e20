"""Formatted records and export templates: a template is compiled to one projection."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import formatting as fmt

FORMATS = ("csv", "xlsx", "json")


@dataclass(frozen=True)
class Mapping:
    """A path in the formatted record, the exported name, a formatter and a default for missing values."""

    source: str
    name: str
    formatter: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class Template:
    name: str
    fields: tuple[Mapping, ...]
    date_format: str = "yyyy-MM-dd"
    symbol: str = "$"
    constants: dict[str, str] = field(default_factory=dict)
    formats: tuple[str, ...] = ("xlsx",)


def _m(*fields: tuple) -> tuple[Mapping, ...]:
    return tuple(Mapping(*f) for f in fields)


# The built-in templates.
TEMPLATES = {
    "personal_expenses": Template(
        "personal_expenses",
        _m(("transaction.date", "Date"), ("merchant.name", "Merchant"), ("amounts.total", "Amount", "currency"), ("amounts.tax", "Tax", "currency"), ("payment.method", "Payment Method"),
           ("items", "Description", "items_summary"), ("metadata.items_count", "Items Count"), ("confidence.validation_confidence", "Confidence", "percentage")),
        date_format="MM/dd/yyyy", formats=("xlsx", "csv"),
    ),
    "business_expenses": Template(
        "business_expenses",
        _m(("transaction.date", "Date"), ("merchant.name", "Vendor"), ("merchant.address", "Vendor Address"), ("amounts.subtotal", "Subtotal", "currency"), ("amounts.tax", "Tax Amount", "currency"),
           ("amounts.total", "Total", "currency"), ("payment.method", "Payment Method"), ("transaction.receipt_number", "Receipt Number"), ("items", "Business Purpose", "items_business"), ("validation.is_valid", "Valid Receipt", "boolean")),
        constants={"employee_name": "", "department": "", "project_code": "", "approval_status": "Pending"}, formats=("xlsx", "csv", "json"),
    ),
    "tax_preparation": Template(
        "tax_preparation",
        _m(("transaction.date", "Date"), ("merchant.name", "Payee"), ("amounts.total", "Amount", "currency"), ("amounts.tax", "Sales Tax", "currency"), ("payment.method", "Payment Type"),
           ("items", "Expense Category", "tax_category"), ("merchant.address", "Location"), ("validation.is_valid", "Verified", "boolean")),
        date_format="MM/dd/yyyy", formats=("xlsx", "csv"),
    ),
    "accounting": Template(
        "accounting",
        _m(("transaction.date", "Transaction Date"), ("merchant.name", "Vendor Name"), ("amounts.total", "Amount", "currency"), ("amounts.tax", "Tax Amount", "currency"), ("payment.method", "Payment Account"),
           ("items", "Account Code", "accounting_code"), ("transaction.receipt_number", "Reference"), ("merchant.address", "Vendor Address"), ("file_info.file_name", "Source Document")),
        symbol="", formats=("csv", "json"),
    ),
    "detailed_analysis": Template(
        "detailed_analysis",
        _m(("file_info.file_name", "File Name"), ("transaction.date", "Date"), ("transaction.time", "Time"), ("merchant.name", "Merchant Name"), ("merchant.address", "Merchant Address"), ("merchant.phone", "Merchant Phone", "phone"),
           ("amounts.subtotal", "Subtotal"), ("amounts.tax", "Tax"), ("amounts.tip", "Tip"), ("amounts.total", "Total"), ("payment.method", "Payment Method"), ("payment.card_last_four", "Card Last Four"),
           ("transaction.receipt_number", "Receipt Number"), ("metadata.items_count", "Items Count"), ("metadata.ocr_method", "OCR Method"), ("confidence.ocr_confidence", "OCR Confidence"),
           ("confidence.validation_confidence", "Validation Confidence"), ("validation.is_valid", "Is Valid")),
        formats=("xlsx", "json"),
    ),
}


def sections_of(date_format: str = "yyyy-MM-dd", symbol: str = "$", validation: bool = False) -> dict[str, Column]:
    """The nested text sections of a record; ``validation`` needs the columns of the validator."""
    money = lambda c: fmt.currency(F.col(c), symbol)
    item = lambda x: F.struct(
        x["description"].alias("description"), fmt.quantity(x["quantity"]).alias("quantity"), fmt.currency(x["unit_price"], symbol).alias("unit_price"),
        fmt.currency(x["total_price"], symbol).alias("total_price"), fmt.percentage(x["confidence"]).alias("confidence"),
    )
    section = lambda **cols: F.struct(*(c.alias(n) for n, c in cols.items()))
    col = F.col
    sections = {
        "file_info": section(file_name=F.coalesce("file_name", F.lit("Unknown")), file_id=F.coalesce("file_id", F.lit(""))),
        "merchant": section(name=col("merchant_name"), address=col("merchant_address"), phone=fmt.phone(col("merchant_phone"))),
        "transaction": section(date=fmt.date(col("date"), date_format), time=F.coalesce("time", F.lit("")), receipt_number=col("receipt_number")),
        "amounts": section(subtotal=money("subtotal"), tax=money("tax_amount"), tip=money("tip_amount"), total=money("total_amount")),
        "payment": section(method=col("payment_method"), card_last_four=col("card_last_four")),
        "items": F.transform("items", item),
        "metadata": section(items_count=F.size("items"), ocr_method=col("ocr_method"), processing_time=col("processing_time")),
        "confidence": section(
            ocr_confidence=fmt.percentage(col("ocr_confidence")), validation_confidence=fmt.percentage(col("confidence_score")), overall_confidence=fmt.percentage((col("ocr_confidence") + col("confidence_score")) / 2)
        ),
    }
    if validation:
        sections["validation"] = section(is_valid=col("is_valid"), confidence_score=fmt.percentage(col("validation_score")), issues_count=F.size("issues"), warnings_count=F.size("warnings"))
    return sections


def formatted(df: DataFrame, date_format: str = "yyyy-MM-dd", symbol: str = "$", validation: bool = False) -> DataFrame:
    """Records as nested text sections."""
    return df.select("file_id", *(c.alias(n) for n, c in sections_of(date_format, symbol, validation).items()))


def _value(schema, m: Mapping, at: str = "") -> Column:
    """A mapped field of the sections in the struct ``at``, or of the row."""
    kind = schema
    for part in m.source.split("."):
        kind = kind[part].dataType if part in kind.names else None
        if kind is None:
            return F.lit(m.default).cast("string")
    c, name = F.col(at + m.source), kind.typeName()
    missing = {"array": F.coalesce(F.size(c), F.lit(0)) == 0, "boolean": ~F.coalesce(c, F.lit(False)), "string": F.coalesce(c, F.lit("")) == ""}.get(name, F.coalesce(c, F.lit(0)) == 0 if name != "struct" else c.isNull())
    plain = F.when(c.isNotNull(), "[]") if name == "array" else F.initcap(c.cast("string")) if name == "boolean" else c.cast("string")
    shown = fmt.FORMATTERS[m.formatter](c).cast("string") if m.formatter in fmt.FORMATTERS else plain
    return F.when(missing, F.coalesce(F.lit(m.default), plain)).otherwise(shown)


def apply(df: DataFrame, template: Template, key: str | None = None) -> DataFrame:
    """The template's projection of records, its constants added; ``key`` is kept in front if given."""
    made = formatted(df, template.date_format, template.symbol, "is_valid" in df.columns)
    fields = [_value(made.schema, m).alias(m.name) for m in template.fields]
    return made.select(*([key] if key else []), *fields, *(F.lit(v).alias(n) for n, v in template.constants.items()))


def header(template: Template) -> list[str]:
    return [*(m.name for m in template.fields), *template.constants]


def _described(template: Template) -> bool:
    """Whether the template shows nothing of items but their number and what is made of descriptions, so that their amounts needn't be formatted."""
    return all(fmt.FORMATTERS.get(m.formatter) in (None, *fmt.OF_DESCRIPTIONS) for m in template.fields if m.source == "items")


def held(df: DataFrame, templates: list[Template]) -> tuple[DataFrame, list[Column]]:
    """Records with the sections of all templates as columns t0, t1, ..., and the cells of each template over them: texts in the order of ``header``."""
    checked = "is_valid" in df.columns
    sections = [sections_of(t.date_format, t.symbol, checked) | ({"items": F.transform("items", lambda x: F.struct(x["description"].alias("description")))} if _described(t) else {}) for t in templates]
    out = df.select("*", *(F.struct(*(c.alias(n) for n, c in x.items())).alias(f"t{i}") for i, x in enumerate(sections)))
    kinds = out.schema
    return out, [F.array(*(_value(kinds[f"t{i}"].dataType, m, f"t{i}.") for m in t.fields), *(F.lit(v).cast("string") for v in t.constants.values())) for i, t in enumerate(templates)]


def problems(template: Template) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a template."""
    errors = [] if template.name else ["a template needs a name"]
    errors += [] if template.fields else ["a template needs a field"]
    errors += [f"field {i}: source and name are needed" for i, m in enumerate(template.fields) if not (m.source and m.name)]
    return errors, [f"unknown format {f}" for f in template.formats if f not in FORMATS]


def stem(name: str) -> str:
    """The name of a template's file, and the key that it is found by."""
    return name.lower().replace(" ", "_")


def as_dict(template: Template) -> dict:
    fields = [{"source_field": m.source, "export_name": m.name, "formatter": m.formatter, "default_value": m.default} for m in template.fields]
    shown = {"date_format": template.date_format, "symbol": template.symbol}
    return {"name": template.name, "fields": fields, "formatting": shown, "business_fields": dict(template.constants), "export_formats": list(template.formats)}


def from_dict(raw: dict) -> Template:
    """A template of its parts, as in a file; raises ValueError with what is wrong with it."""
    try:
        fields = tuple(Mapping(f["source_field"], f["export_name"], f.get("formatter"), f.get("default_value")) for f in raw["fields"])
        shown, formats = raw.get("formatting") or {}, tuple(str(f).lower() for f in raw.get("export_formats") or ("xlsx",))
        given = {k: v for k, v in (("date_format", shown.get("date_format")), ("symbol", shown.get("symbol"))) if v is not None}
        made = Template(raw["name"], fields, constants={k: "" if v is None else str(v) for k, v in (raw.get("business_fields") or {}).items()}, formats=formats, **given)
    except (KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"not a template: {type(e).__name__}: {e}") from e
    errors, notes = problems(made)
    if errors:
        raise ValueError("; ".join(errors))
    for note in notes:
        warnings.warn(f"template {made.name}: {note}", stacklevel=2)
    return replace(made, formats=tuple(f for f in formats if f in FORMATS))


def create(name: str, fields: list[dict], formatting: dict | None = None, **more) -> Template:
    """A template of field mappings (source_field, export_name, formatter, default_value) and formatting options."""
    return from_dict({"name": name, "fields": fields, "formatting": formatting, **more})


def save(template: Template, folder: str) -> Path:
    """Writes a template to its file, which ``load`` finds."""
    errors, _ = problems(template)
    if errors:
        raise ValueError("; ".join(errors))
    at = Path(folder) / f"{stem(template.name)}.json"
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(as_dict(template), indent=2, ensure_ascii=False), encoding="utf-8")
    return at


def load(folder: str) -> dict[str, Template]:
    """Templates of the JSON files in a folder beside the built-in ones; a bad file is left out with a warning."""
    out = dict(TEMPLATES)
    for path in sorted(Path(folder).glob("*.json")):
        try:
            made = from_dict(json.loads(path.read_text(encoding="utf-8")))
        except (ValueError, OSError) as e:
            warnings.warn(f"template {path.name} is left out: {e}", stacklevel=2)
            continue
        out[stem(made.name)] = made
    return out


def suggestions(df: DataFrame) -> dict[str, list[str]]:
    """Paths that fields of a template can name, by section of the formatted record."""
    made = formatted(df.limit(0), validation="is_valid" in df.columns).schema
    return {f.name: [f"{f.name}.{n}" for n in f.dataType.names] if hasattr(f.dataType, "names") else [f.name] for f in made if f.name != "file_id"}


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header, JSON lines or Parquet, written by the executors."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
