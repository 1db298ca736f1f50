"""Normal forms and scores of fields by their kind, for evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import dates, text

DATES = ("date_of_birth", "date_of_issue", "date_of_expiry")
NAMES = ("surname", "given_names", "nationality", "place_of_birth", "issuing_authority")
#: Names of nationalities in other languages (fixed values).
ALIASES = {"FRANCAISE": "FRANCE", "FRANCAIS": "FRANCE", "RUSSE": "RUSSIAN FEDERATION", "RUSSO": "RUSSIAN FEDERATION", "EMIRATS ARABES UNIS": "UNITED ARAB EMIRATES"}
AMOUNTS = ("total_net_worth", "total_vat", "total_gross_worth")
IDENTIFIERS = ("invoice_no", "seller_tax_id", "client_tax_id", "iban")


def _mapped(known: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in (known or {"": ""}).items() for x in pair)), c)


def expanded_nationality(c: Column, countries: dict[str, str]) -> Column:
    """A code of three letters becomes its country, then a name in another language the English one; others stay."""
    named = F.when(F.length(c) == 3, F.coalesce(_mapped(countries, c), c)).otherwise(c)
    return F.coalesce(_mapped(ALIASES, named), named)


def imported_nationality(name: Column, code: Column, known: dict[str, str]) -> Column:
    """The known spelling of the name, else the name; without a name the same of the code. In upper case; null without both."""
    of = lambda c: F.coalesce(_mapped(known, F.upper(text.squash(c))), F.upper(text.squash(c)))
    return F.coalesce(of(name), of(code))


def by_field(key: Column, value: Column, countries: dict[str, str] | None = None) -> Column:
    """The normal form in which a field's values are compared: numbers without signs, dates by dots, zones without blanks, the first letter of the sex, names without commas."""
    plain = text.without_accents(value)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit(","), F.lit(" ")), "[.]+", "."), " +", " "))
    out = F.when(key == "document_number", F.regexp_replace(plain, "[^A-Z0-9]", ""))
    out = out.when(key.isin(*DATES), dates.dotted(F.translate(value, text.ACCENTED, text.PLAIN)))
    out = out.when(key == "mrz", F.regexp_replace(plain, f"{text.WS}+", "")).when(key == "sex", F.left(plain, F.lit(1)))
    return out.when(key == "nationality", expanded_nationality(name, countries or {})).when(key.isin(*NAMES), name).otherwise(plain)


def soft_score(key: Column, predicted: Column, truth: Column) -> Column:
    """Null without a truth, 0 without a prediction; else by the kind of the field: digits, date, amount, or shared tokens. Runs Arrow-batched Python for the ratio of digits."""
    from scriptorium.functions.trees import date_similarity, digit_similarity
    from scriptorium.operators.metrics import token_dice

    amount = dates.amount_similarity(dates.amount(predicted), dates.amount(truth))
    tokens = token_dice(text.normal_text(predicted), text.normal_text(truth))
    kind = F.when(key.isin(*IDENTIFIERS), digit_similarity(predicted, truth)).when(key == "invoice_date", date_similarity(predicted, truth)).when(key.isin(*AMOUNTS), amount).otherwise(tokens)
    return F.when(truth.isNull(), None).when(predicted.isNull(), 0.0).otherwise(kind)


def exact_match(key: Column, predicted: Column, truth: Column) -> Column:
    """Null without a truth; amounts are compared as numbers (two that are none are equal), others in their normal form."""
    same = F.when(key.isin(*AMOUNTS), dates.amount(predicted).eqNullSafe(dates.amount(truth))).otherwise(text.normal_text(predicted).eqNullSafe(text.normal_text(truth)))
    return F.when(truth.isNotNull(), same)


def is_zone_job(raw: Column) -> Column:
    """Whether the raw result (JSON text) came by the zone."""
    return F.coalesce(F.get_json_object(raw, "$.mode") == "passport_mrz", F.lit(False))


def zone_valid(result: Column) -> Column:
    """validation.is_valid of a result (JSON text); false without it."""
    return F.coalesce(F.get_json_object(result, "$.validation.is_valid") == "true", F.lit(False))


def joined(items: Column) -> Column:
    """Items of an array joined by commas; null items are None."""
    return F.array_join(items, ",", "None")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def percent(c: Column) -> Column:
    """A share as a rounded percentage; null is a dash."""
    return F.when(c.isNull(), "—").otherwise(F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%")))
