"""From pictures and recognised candidates to records: quality, steps, text, fields, items, validation; what fails becomes a row with its stage and error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import merchants as M
from ledgerloom.functions import text as T
from ledgerloom.functions import validation as V
from ledgerloom.operators import ocr, pictures

NO_METHOD, NO_TEXT = "All OCR methods failed", "No text"


def eligible(files: DataFrame) -> DataFrame:
    """Files to recognise: processed, with a path in the cache."""
    return files.where((F.col("status") == "processed") & (F.coalesce("cache_path", F.lit("")) != ""))


def text_only(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Adds success, method, confidence, raw_text and error to rows with the candidates of every engine.

    Candidates are ``<engine>_ok``, ``<engine>_conf`` and ``<engine>_text`` for vision, doc and tess. A row with a
    ``problem`` (an unreadable picture) fails with that error; one that no engine read fails as well. No row is lost.
    """
    chosen = ocr.choose(df, threshold)
    fine, method = F.col("problem").isNull(), F.col("method")
    read = F.when(method == "google_vision", F.col("vision_text")).when(method == "document_detection", F.col("doc_text")).when(method == "tesseract", F.col("tess_text"))
    success = fine & (method != "none")
    return chosen.withColumns(
        {
            "success": success, "method": F.when(fine, method).otherwise("none"), "confidence": F.when(fine, F.col("confidence")).otherwise(0.0),
            "raw_text": F.coalesce(F.when(success, read), F.lit("")), "error": F.coalesce("problem", F.when(~success, F.lit(NO_METHOD))),
        }
    )


def gated(df: DataFrame, **chain) -> DataFrame:
    """The picture's way before recognition: quality measured, the chain of steps applied, in one pass over rows with data, width and height.

    A picture that can't be loaded is a ``problem`` of its row, which then fails at stage ``load``. One whose step failed goes on as it
    was, and ``failed_step`` and ``step_error`` say so. ``chain`` has arguments of ``pictures.preprocessed``.
    """
    done = pictures.preprocessed(df, measure=True, **chain)
    known = F.col("problem") if "problem" in df.columns else F.lit(None).cast("string")
    return done.withColumn("problem", F.coalesce(known, F.when(F.col("failed_step") == pictures.LOAD, F.col("step_error"))))


def process(df: DataFrame, as_of=None, threshold: float = 0.8, parse: bool = False) -> DataFrame:
    """One record for each row: text, fields, items and scores, validation if a day is given; failed rows have no fields.

    ``stage`` is where a row failed, null for a whole record: ``load`` (it has a ``problem``), ``recognise`` (no engine read it), ``extract`` (nothing was
    written on it); ``error`` says why. With ``parse`` merchant templates and further items follow extraction, before validation.
    """
    read = text_only(df, threshold).withColumnsRenamed({"method": "ocr_method", "confidence": "ocr_confidence"})
    blank = F.col("success") & (F.col("raw_text") == "")
    read = read.withColumn("stage", F.when(F.col("problem").isNotNull(), "load").when(~F.col("success"), "recognise").when(blank, "extract"))
    read = read.withColumn("error", F.coalesce("error", F.when(blank, NO_TEXT)))
    found = T.extract(read.withColumn("shown", F.when(F.col("stage").isNull(), F.col("raw_text"))), "shown")
    if parse:
        found = M.parse(found, "shown")
    whole = F.col("stage").isNull()
    found = found.withColumn("confidence_score", F.when(whole, F.col("confidence_score"))).drop("shown")
    if not as_of:
        return found
    checked = V.validate(found, as_of)
    of = ("scores", "issues", "warnings", "validation_score", "is_valid")
    return checked.withColumns({c: F.when(whole, F.col(c)) for c in of})
