"""Invoices from generated text: ten fields by their tags, or without any tag by the n-th hit of patterns, as Column expressions. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import dates, passport, text
from scriptorium.functions.mrz import let
from scriptorium.functions.payload import EDGE_L, EDGE_R

#: Fields, their fallback tags and patterns (fixed values).
FIELDS = ("invoice_no", "invoice_date", "seller", "client", "seller_tax_id", "client_tax_id", "iban", "total_net_worth", "total_vat", "total_gross_worth")
SELLER_TAGS = ("Name", "Straße", "Stadt")
DATE_TAG, NET_TAG, GROSS_TAG = "Geburtsdatum", "Gesetzl. Netto", "Gesamtbrutto"
AMOUNT = r"[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{2})|[0-9]+(?:,[0-9]{2})"
TAX_ID, IBAN, NUMBER = "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", "[0-9]{6,10}"


def schema(c: Column) -> Column:
    """Struct of FIELDS: what stands between their tags; where none is tagged, a seller and a date by other tags, tax ids and amounts by the order of their hits, the first IBAN and the first number of 6 to 10 digits."""

    def of(clean: Column) -> Column:
        tagged = F.struct(*(text.tag(clean, f"s_{f}").alias(f) for f in FIELDS))
        return let(tagged, lambda s: F.when(F.coalesce(*(s[f] for f in FIELDS)).isNotNull(), s).otherwise(fallback(clean)))

    def fallback(t: Column) -> Column:
        # each pattern is sought once
        every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
        return let(F.struct(every(EDGE_L + TAX_ID + EDGE_R).alias("ids"), every(AMOUNT).alias("amounts")), lambda hits: values(t, hits))

    def values(t: Column, hits: Column) -> Column:
        first = lambda p: F.nullif(F.regexp_extract(t, EDGE_L + p + EDGE_R, 0), F.lit(""))
        tag = lambda name: F.nullif(text.tag(t, f"s_{name}"), F.lit(""))
        nth = lambda name, n: F.get(hits[name], F.lit(n))
        found = {
            "invoice_no": first(NUMBER), "invoice_date": dates.space_date(text.tag(t, f"s_{DATE_TAG}")), "seller": F.nullif(F.concat_ws(" ", *map(tag, SELLER_TAGS)), F.lit("")), "client": F.lit(None),
            "seller_tax_id": nth("ids", 0), "client_tax_id": nth("ids", 1), "iban": first(IBAN),
            "total_net_worth": dates.amount_text(F.coalesce(tag(NET_TAG), nth("amounts", 0))), "total_vat": F.lit(None), "total_gross_worth": dates.amount_text(F.coalesce(tag(GROSS_TAG), nth("amounts", 1))),
        }
        return F.struct(*(found[f].cast("string").alias(f) for f in FIELDS))

    # what the tags and patterns are sought in is worked out once
    return F.when(c.isNotNull(), let(passport.without_special(c), of))


def truth(json: Column) -> Column:
    """Struct of FIELDS from a ground truth's header and summary (JSON text)."""
    at = lambda part, f: F.get_json_object(json, f"$.{part}.{f}")
    return F.struct(*(at("summary" if f.startswith("total_") else "header", f).alias(f) for f in FIELDS))


#: Keys of a flat ground truth, by part (fixed values).
HEADER = FIELDS[:7]
ITEMS = ("item_desc", "item_qty", "item_net_price", "item_net_worth", "item_vat", "item_gross_worth")
SUMMARY = FIELDS[7:]


def simplified(json: Column, with_items: bool = False) -> Column:
    """A ground truth (JSON text) with header and summary only, and with_items its items: nested parts as they are, else made of flat keys; parts without any key are left out."""

    def part(name: str, keys: tuple[str, ...], opening: str, said: Column, parsed: Column) -> Column:
        nested = let(F.get_json_object(json, f"$.{name}"), lambda raw: F.when(raw.startswith(opening), raw))
        value = lambda k: F.coalesce(F.to_json(F.try_variant_get(parsed, f"$.{k}", "variant")), F.lit("null"))
        here = F.array_compact(F.array(*(F.when(F.array_contains(said, k), F.concat(F.lit(f'"{k}":'), value(k))) for k in keys)))
        made = lambda x: F.concat(F.lit("[{" if opening == "[" else "{"), F.array_join(x, ","), F.lit("}]" if opening == "[" else "}"))
        return F.concat(F.lit(f'"{name}":'), F.coalesce(nested, let(here, lambda x: F.when(F.size(x) > 0, made(x)))))

    wanted = [("header", HEADER, "{"), *([("items", ITEMS, "[")] if with_items else []), ("summary", SUMMARY, "{")]
    # the text's keys are listed once, and its values read from one parse
    made = lambda x: F.array_compact(F.array(*(part(*w, x["keys"], x["values"]) for w in wanted)))
    parts = let(F.struct(F.json_object_keys(json).alias("keys"), F.try_parse_json(json).alias("values")), made)
    return F.when(json.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
