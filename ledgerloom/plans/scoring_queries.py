"""Queries of scores and validation: (Spark plan, DuckDB SQL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions import scoring, truth
from ledgerloom.functions import validation as V
from ledgerloom.sources.records import read, records, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = dt.date(2008, 1, 1)


def add(name: str, plan, text: str, items: bool = False, raw: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(records(spark, sf_dir, items=items, text=raw))
    SQL[name] = sql(text, items=items, text=raw)


def _r(c) -> object:
    return F.round(c, 6)


#: Facts of a record in SQL, in integer cents, from which the scores follow.
_FACTS = """
  s AS (SELECT k, count(*) AS n_items, sum(line_c) AS items_c,
      sum(CASE WHEN length(description) >= 3 THEN 1 WHEN line_c > 0 AND line_c <= 1000000 AND abs(unit_c * quantity - line_c) < 2 THEN 1 ELSE 0 END) AS sound,
      sum(CASE WHEN unit_c <> 0 AND abs(unit_c * quantity - line_c) >= 2 THEN 1 ELSE 0 END) AS wrong FROM i1 GROUP BY k),
  f AS (SELECT b.*, coalesce(n_items, 0) AS n_items, coalesce(items_c, 0) AS items_c, sound, coalesce(wrong, 0) AS wrong,
      merchant_name IS NOT NULL AS has_name, dt IS NOT NULL AS has_date, total_c <> 0 AS has_total, subtotal_c <> 0 AS has_sub, tax_c <> 0 AS has_tax,
      n_items IS NOT NULL AS has_items, payment_method IS NOT NULL AS has_method, coalesce(tip_c, 0) <> 0 AS has_tip,
      subtotal_c <> 0 AND tax_c <> 0 AND total_c <> 0 AND abs(subtotal_c + tax_c - total_c) < 2 AS sums, coalesce(n_items IS NOT NULL AND subtotal_c <> 0 AND abs(items_c - subtotal_c) < 2, false) AS items_fit
    FROM {base} b LEFT JOIN s ON b.k = s.k)
"""


def _facts(select: str, base: str = "r") -> str:
    return f"WITH {_FACTS.format(base=base).strip()} {select}"


_CONS = "least(1.0, 0.5 + CASE WHEN sums THEN 0.3 ELSE 0 END + CASE WHEN items_fit THEN 0.2 ELSE 0 END)::DOUBLE"
_PTS = "(has_name::INT + has_date::INT + 2 * has_total::INT + has_sub::INT + has_tax::INT + has_items::INT + has_method::INT)"
add("score_consistency", lambda r: r.select("file_id", _r(scoring.consistency()).alias("consistency")), _facts(f"SELECT file_id, round({_CONS}, 6) AS consistency FROM f"), items=True)
add(
    "score_basic", lambda r: r.select("file_id", _r(scoring.basic(F.col("ocr_confidence"))).alias("score")),
    _facts(f"""SELECT file_id, round(ocr_confidence * 0.4::DOUBLE + {_PTS} / 8.0::DOUBLE * 0.3::DOUBLE + {_CONS} * 0.2::DOUBLE
      + least(1.0, 0.5 + CASE WHEN length(merchant_name) > 3 THEN 0.2 ELSE 0 END + CASE WHEN has_date THEN 0.2 ELSE 0 END + CASE WHEN has_total THEN 0.1 ELSE 0 END)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM f"""),
    items=True,
)
add(
    "score_enhanced", lambda r: r.select("file_id", _r(scoring.enhanced(F.col("confidence_score"))).alias("score")),
    _facts(f"""SELECT file_id, round(least(1.0::DOUBLE, confidence_score * 0.4::DOUBLE + 0.2::DOUBLE * has_name::INT
      + (0.2::DOUBLE * has_date::INT + 0.3::DOUBLE * has_total::INT + 0.3::DOUBLE * has_items::INT + 0.1::DOUBLE * has_tax::INT + 0.1::DOUBLE * has_name::INT) * 0.3::DOUBLE + {_CONS} * 0.1::DOUBLE), 6) AS score FROM f"""),
    items=True,
)

_D = "::DOUBLE"
_FINE_DATE = f"(has_date AND dt <= DATE '{AS_OF}' AND DATE '{AS_OF}' - dt <= {V.OLDEST})"
_OK_AMOUNT = "({0} > 0 AND {0} <= 1000000)"
_USUAL = "(tax_c * 100 >= subtotal_c AND tax_c * 5 <= subtotal_c)"
_TAX_OK = f"(has_tax AND {_OK_AMOUNT.format('tax_c')})"
_SCORES = {
    "merchant": "(0.8 * (coalesce(length(merchant_name), 0) >= 3)::INT + 0.1 * (coalesce(length(merchant_address), 0) >= 10)::INT + 0.1 * (merchant_phone IS NOT NULL)::INT)::DOUBLE",
    "date_time": f"((CASE WHEN {_FINE_DATE} THEN 0.7 WHEN has_date THEN 0.3 ELSE 0 END) + 0.3 * (tm IS NOT NULL)::INT)::DOUBLE",
    "amounts": f"(0.5 * {_OK_AMOUNT.format('total_c')}::INT + 0.2 * {_OK_AMOUNT.format('subtotal_c')}::INT + 0.1 * {_TAX_OK}::INT + 0.1 * ({_TAX_OK} AND has_sub AND {_USUAL})::INT + 0.1 * (has_tip AND {_OK_AMOUNT.format('coalesce(tip_c, 0)')})::INT)::DOUBLE",
    "items": "(CASE WHEN has_items THEN sound::DOUBLE / n_items::DOUBLE ELSE 0 END)",
    "calculations": "least(1.0, 0.5 + 0.3 * (has_sub AND has_tax AND has_total AND abs(subtotal_c + tax_c + coalesce(tip_c, 0) - total_c) < 2)::INT + 0.2 * (has_items AND has_sub AND abs(items_c - subtotal_c) < 5)::INT)::DOUBLE",
}
_TQ = r"(CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE (CASE WHEN length({0}) > 50 THEN 0.3 WHEN length({0}) > 20 THEN 0.2 ELSE 0 END) + 0.3 * regexp_matches({0}, '\p{{L}}')::INT + 0.2 * regexp_matches({0}, '\p{{Nd}}')::INT + 0.2 * regexp_matches({0}, '[.,;:!?$()\[\]{{}}]')::INT END)::DOUBLE"
_SCORES["data_quality"] = f"(confidence_score * 0.4::DOUBLE + (has_name::INT + has_date::INT + has_total::INT + has_sub::INT + has_tax::INT + has_items::INT + has_method::INT) / 7.0::DOUBLE * 0.3::DOUBLE + {_TQ.format('raw_text')} * 0.3::DOUBLE)"
_ISSUES = {
    "merchant": [("NOT has_name", "missing_merchant_name")],
    "date_time": [(f"has_date AND NOT {_FINE_DATE}", "unreasonable_date"), ("NOT has_date", "missing_date")],
    "amounts": [(f"has_total AND NOT {_OK_AMOUNT.format('total_c')}", "unreasonable_total"), ("NOT has_total", "missing_total")],
    "items": [("NOT has_items", "no_items")],
    "calculations": [("has_sub AND has_tax AND has_total AND NOT abs(subtotal_c + tax_c + coalesce(tip_c, 0) - total_c) < 2", "total_calculation_error")],
    "data_quality": [],
}


def _joined(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join([f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs] or ["NULL"]) + ")"


def _check(name: str, key: str) -> None:
    def plan(r):
        points, issues, warnings = V.checks(AS_OF)[name]
        return r.select("file_id", _r(points).alias("score"), F.array_join(F.transform(issues, lambda i: i["type"]), ",").alias("issues"), F.size(warnings).alias("n_warnings"))

    warned = {"amounts": f"({_TAX_OK} AND has_sub AND NOT {_USUAL})::INT", "items": "wrong::INT", "calculations": "(has_items AND has_sub AND NOT abs(items_c - subtotal_c) < 5)::INT"}.get(name, "0")
    text = name == "data_quality"
    add(key, plan, _facts(f"SELECT file_id, round({_SCORES[name]}, 6) AS score, {_joined(_ISSUES[name])} AS issues, {warned} AS n_warnings FROM f", "t" if text else "r"), items=True, raw=text)


for _name, _key in (("merchant", "validate_merchant"), ("date_time", "validate_datetime"), ("amounts", "validate_amounts"), ("items", "validate_items"), ("calculations", "validate_calcs"), ("data_quality", "validate_quality")):
    _check(_name, _key)
_OVERALL = " + ".join(f"{_SCORES[n]} * {w}::DOUBLE" for n, w in V.WEIGHTS.items())
add(
    "validate_overall", lambda r: V.validate(r, AS_OF).select("file_id", _r("validation_score").alias("score"), "is_valid"),
    _facts(f"SELECT file_id, round(({_OVERALL}), 6) AS score, round(({_OVERALL}), 9) >= 0.6 AND has_total AS is_valid FROM f", "t"), items=True, raw=True,
)
_SEVERITY = {"missing_merchant_name": "minor", "unreasonable_date": "warning", "missing_date": "minor", "unreasonable_total": "warning", "missing_total": "critical", "no_items": "minor", "total_calculation_error": "warning"}
add(
    "issue_counts", lambda r: V.validate(r, AS_OF).select(F.explode("issues").alias("i")).groupBy(F.col("i.type").alias("type"), F.col("i.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n")),
    _facts(" UNION ALL ".join(f"SELECT '{t}' AS type, '{_SEVERITY[t]}' AS severity, count(*) AS n FROM f WHERE {c} HAVING count(*) > 0" for pairs in _ISSUES.values() for c, t in pairs)), items=True, raw=True,
)
add(
    "format_checks", lambda r: r.select("file_id", F.when(F.col("time").isNotNull(), V.valid_time(F.col("time"))).alias("time_ok"), V.valid_phone(F.concat(F.when(F.col("k") % 3 == 0, "+1").otherwise(""), F.col("merchant_phone"))).alias("phone_ok")),
    "SELECT file_id, CASE WHEN tm IS NOT NULL THEN true END AS time_ok, merchant_phone IS NOT NULL AND k % 3 <> 0 AS phone_ok FROM r",
)
add(
    "sanity_flags",
    lambda r: r.select(
        "file_id", truth.date("date").alias("dated"), F.coalesce(F.datediff(F.lit(AS_OF), "date") > 365, F.lit(False)).alias("old"), (~scoring.sums_agree()).alias("sums_differ"), (~scoring.items_agree()).alias("items_differ")
    ),
    _facts(f"SELECT file_id, has_date AS dated, coalesce(DATE '{AS_OF}' - dt > 365, false) AS old, NOT sums AS sums_differ, NOT items_fit AS items_differ FROM f"), items=True,
)
QUERIES["text_quality"] = lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", _r(V.text_quality(F.col("text"))).alias("quality"))
SQL["text_quality"] = f"SELECT doc_id, round({_TQ.format('text')}, 6) AS quality FROM documents"
