"""What a model is asked and what it should answer: prompts and target texts of records, result envelopes and the columns of other data sets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import evaluation, passport, text
from scriptorium.functions.typed import CATALOGUE

#: Order of a passport's lines (fixed values).
FLAT_KEYS = ("document_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "place_of_birth", "date_of_issue", "date_of_expiry", "issuing_authority", "mrz")
#: Sentences of the prompt (fixed values).
PROMPT = (
    "Extract the document into a JSON object with keys `document_type` and `fields`. ", "The document type is `{kind}`. ", "Use only these field keys inside `fields`: ", "Use only schema-relevant field keys.",
    " Return exactly one valid JSON object. Fill missing values with null. Use [] only for list fields. Do not add explanation text. Do not add markdown. Follow this schema exactly: ",
)
OTHER_SKELETON = '{"document_type":"other","fields":{}}'


def prompt_of(kind: str) -> str:
    """The prompt of a record type: its field keys and an empty record, made from the catalogue."""
    fields = CATALOGUE.get(kind)
    head = PROMPT[0] + PROMPT[1].format(kind=kind)
    if fields is None:
        return head + PROMPT[3] + PROMPT[4] + OTHER_SKELETON
    hint = PROMPT[2] + ", ".join(f"`{f}`" for f in fields) + "."
    skeleton = f'{{"document_type":"{kind}","fields":{{' + ",".join(f'"{f}":{"[]" if shape in ("texts", "items") else "null"}' for f, shape in fields.items()) + "}}"
    return head + hint + PROMPT[4] + skeleton


def prompt(kind: Column) -> Column:
    """The prompt of a row's type; types without fields of their own name themselves."""
    known = F.create_map(*(F.lit(x) for k in CATALOGUE for x in (k, prompt_of(k))))
    other = F.concat(*(kind if part == "\0" else F.lit(part) for part in prompt_of("\0").replace("\0", "|\0|").split("|")))
    return F.coalesce(F.try_element_at(known, kind), other)


def target(kind: Column, fields: Column, form: str = "json") -> Column:
    """What the model should say of a record (map of texts): json, or for passports passport_mrz (the zone, else null) or passport_flat (a line for each key, null where there is no value)."""
    whole = F.to_json(F.struct(kind.alias("document_type"), fields.alias("fields")), {"ignoreNullFields": "false"})
    value = lambda k: F.try_element_at(fields, F.lit(k))
    if form == "passport_mrz":
        return F.when(kind == "passport", F.coalesce(F.nullif(value("mrz"), F.lit("")), F.lit("null"))).otherwise(whole)
    if form == "passport_flat":
        return F.when(kind == "passport", F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(value(k), F.lit("null"))) for k in FLAT_KEYS))).otherwise(whole)
    if form != "json":
        raise ValueError(f"unknown form {form}")
    return whole


def mapped_passport(raw: Column, countries: dict[str, str]) -> Column:
    """Struct of FLAT_KEYS from a row of another data set (map of texts): the first filled one of the columns that may hold a field, in its import form."""
    at = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(raw, F.lit(n)), F.lit("")) for n in names))
    values = {
        "document_number": text.squash(at("pass_num", "passport_number")), "surname": text.imported_name(at("surname")), "given_names": text.imported_name(at("given_name", "given_names")),
        "nationality": evaluation.imported_nationality(at("nationality"), at("nationality_code"), countries), "date_of_birth": text.squash(at("date_of_birth")), "sex": text.sex(at("sex")), "place_of_birth": text.squash(at("place_of_birth")),
        "date_of_issue": text.squash(at("date_of_issue")), "date_of_expiry": text.squash(at("date_of_expiry")), "issuing_authority": text.squash(at("authority")), "mrz": passport.imported_zone(at("mrz")),
    }
    return F.struct(*(values[k].alias(k) for k in FLAT_KEYS))


def envelope(kind: Column, filename: Column, fields: Column, entities: Column, raw_text: Column, verdict: Column, engine: Column, model: Column, began: Column, ended: Column) -> Column:
    """The result of an engine in one struct: the record, its entities, its text, the verdict (is_valid, code, severity) as a validation and how it was made."""
    issue = F.struct(verdict["code"].alias("code"), verdict["severity"].alias("severity"))
    return F.struct(
        F.lit("1.0").alias("schema_version"), kind.alias("document_type"), filename.alias("source_filename"), fields.alias("fields"), entities.alias("normalized_entities"), raw_text.alias("raw_text"),
        F.struct(raw_text.alias("generated_text"), engine.alias("engine"), kind.alias("requested_document_type")).alias("raw_result"), F.struct(verdict["is_valid"].alias("is_valid"), F.array(issue).alias("issues")).alias("validation"),
        F.struct(engine.alias("engine"), model.alias("model_name"), began.alias("inference_started_at"), ended.alias("inference_finished_at"), evaluation.elapsed_ms(began, ended).alias("elapsed_ms"), F.lit(1).alias("page_count")).alias("processing_meta"),
    )
