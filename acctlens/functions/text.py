"""Delimited key-value texts kept in an account's description field, and the JSON form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Field markers of the text format (fixed values).
KEY_MARK = "CDM Key: "
ACCOUNT_MARK = "Demo Account ID:"
SCORE_MARK = "Risk Score: "
CATEGORY_MARK = "Risk Category: "
ASSESSED_MARK = "Assessed: "
FAMILY_PATTERN = "Product Family: (.+)"
NO_SCORE = "No risk score found. Run the batch scoring job first."
BAD_SCORE = "Risk score is not a number."

_SPACE = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(_SPACE))


def left(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)


def after(text: Column, mark: str) -> Column:
    """Text behind the first mark; NULL if the mark is missing."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text)))


def until(text: Column, stop: str) -> Column:
    """Text before the stop mark; NULL unless something stands before it."""
    return F.when(F.instr(text, stop) > 1, F.substring_index(text, stop, 1))


def key_text(key: Column, account_id: Column) -> Column:
    """The mapping's text; a key that is not known is written as ``None``, so the id still stands."""
    known = F.coalesce(key.cast("string"), F.lit("None"))
    return F.concat(F.lit(KEY_MARK), known, F.lit(f" | {ACCOUNT_MARK} "), account_id)


def parse_cdm_key(text: Column) -> Column:
    return F.regexp_extract(text, r"CDM Key: *(\d+)", 1).try_cast("bigint")


def parse_account_id(text: Column) -> Column:
    """The part between the first account mark and the next one, stripped."""
    rest = after(text, ACCOUNT_MARK)
    return strip(F.substring_index(rest, ACCOUNT_MARK, 1))


def score_text(key: Column, score: Column, category: Column, assessed_at: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.concat(F.lit(KEY_MARK), key.cast("string")),
        F.concat(F.lit(SCORE_MARK), score.cast("string")),
        F.concat(F.lit(CATEGORY_MARK), category),
        F.concat(F.lit(ASSESSED_MARK), assessed_at),
    )


def read_score(text: Column) -> Column:
    """Struct (score, category, assessed, success, error) read from the text or the JSON form."""
    is_json = F.coalesce(F.get_json_object(text, "$.risk_score").isNotNull(), F.lit(False))
    has_text = F.coalesce(text.contains("Risk Score:"), F.lit(False)) & ~is_json

    raw_score = strip(until(after(text, SCORE_MARK), " |"))
    raw_category = after(text, CATEGORY_MARK)
    category = strip(F.coalesce(until(raw_category, " |"), raw_category))
    score = F.when(is_json, F.get_json_object(text, "$.risk_score")).when(has_text, raw_score)
    number = score.try_cast("double")
    broken = score.isNotNull() & number.isNull()
    found = is_json | has_text
    success = found & ~broken
    return F.struct(
        number.alias("score"),
        F.when(is_json, F.get_json_object(text, "$.risk_category"))
        .when(has_text & ~broken, category).alias("category"),
        F.when(has_text & ~broken, strip(after(text, ASSESSED_MARK))).alias("assessed"),
        success.alias("success"),
        F.when(~found, NO_SCORE).when(broken, BAD_SCORE).alias("error"),
    )


def first_name_part(text: Column) -> Column:
    return F.substring_index(text, "/", 1)


def mail_address(first: Column, last: Column, company: Column) -> Column:
    """first.last@company.com with blanks and ampersands removed and 20 characters kept."""
    host = left(F.regexp_replace(F.lower(company), "[ &]", ""), 20)
    return F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), host, F.lit(".com"))


def json_field_or_raw(text: Column, field: str) -> Column:
    """Field of a JSON text; the stripped text itself when it is not a JSON object."""
    return F.when(F.json_object_keys(text).isNull(), strip(text)).otherwise(
        F.get_json_object(text, f"$.{field}")
    )


def iso_utc(moment: Column) -> Column:
    """A timestamp as ISO text in UTC with the fixed ending ``.000Z``, whatever the session's time zone."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
