"""Field maps of recognised documents: canonical keys, sentinels, renames and repairs, as Column expressions on map<string,string>.

Two named profiles differ and are never mixed: `service` lets a later sentinel hide an earlier value and drops characters
repeated throughout; `evaluator` skips sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.dates import better_identity_date, better_issue_date, mmddyyyy
from scriptorium.functions.mrz import let
from scriptorium.functions.text import SENTINELS, sanitized, strip

#: Squashed spellings of keys, by canonical key (fixed values).
COMMON = {
    "given_names": ("firstname", "forename", "givenname", "givennames"),
    "surname": ("lastname", "surname", "familyname"),
    "nationality": ("nationality", "citizenship"),
    "sex": ("sex", "gender"),
    "date_of_birth": ("dob", "dateofbirth", "birthdate"),
    "date_of_issue": ("issuedate", "dateofissue", "documentdate"),
    "date_of_expiry": ("expirydate", "expirationdate", "dateofexpiry", "dateofexpiration"),
    "issuing_authority": ("authority", "issuingauthority"),
}
TYPED = {
    "driver_license": {
        "license_number": ("dl", "dlnumber", "drivelicensenumber", "licensenumber", "licence", "licencenumber", "licenzen", "documentnumber"),
        "surname": ("ln",),
        "given_names": ("fn",),
        "date_of_expiry": ("exp",),
        "date_of_issue": ("iss", "dd"),
        "categories": ("class", "category", "categories"),
        "address": ("addr",),
    },
    "passport": {"document_number": ("passportnumber", "passportno", "documentnumber"), "mrz": ("mrz",), "place_of_birth": ("placeofbirth",)},
    "id_card": {"document_number": ("documentnumber", "idnumber"), "personal_number": ("personalnumber",), "place_of_birth": ("placeofbirth",), "address": ("addr",)},
}
#: Keys that move to another one where that is absent, in this order (fixed values).
MOVES = {
    "service": {
        "driver_license": (("document_number", "license_number"), ("expiry_date", "date_of_expiry"), ("issue_date", "date_of_issue"), ("document_date", "date_of_issue")),
        "passport": (("document_date", "date_of_issue"), ("expiry_date", "date_of_expiry")),
        "id_card": (("document_date", "date_of_issue"), ("expiry_date", "date_of_expiry")),
    },
    "evaluator": {
        "driver_license": (("document_number", "license_number"), ("expiry_date", "date_of_expiry"), ("issue_date", "date_of_issue")),
        "passport": (("expiry_date", "date_of_expiry"), ("issue_date", "date_of_issue")),
        "id_card": (),
    },
}
#: Values that a passport's name and zone never have (fixed values).
NO_NAMES = ("abu dhabi", "<<", "<8")
CATEGORIES = "AM|A1|A2|A|B1|B|C1|C|D1|D|BE|CE|DE|T"
LABELS = ("DL", "EXP", "DOB", "ISS", "FN", "LN")
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Stands before the JSON text of a nested value; such values are not cleaned or repaired.
NESTED = "\x00"
SLASHED = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"


def _table(spellings: dict[str, tuple[str, ...]], without: tuple[str, ...] = ()) -> Column:
    return F.create_map(*[F.lit(x) for k, many in spellings.items() for s in many if s not in without for x in (s, k)])


def canonical_key(kind: Column, key: Column, profile: str = "service") -> Column:
    """The canonical name of a key: common spellings first, then those of the document type, else the key itself."""
    squashed = F.regexp_replace(F.lower(key), "[^a-z0-9]+", "")
    typed = [F.when(kind == k, F.try_element_at(_table(v), squashed)) for k, v in TYPED.items()]
    return F.coalesce(F.try_element_at(_table(COMMON, ("surname",) if profile == "evaluator" else ()), squashed), *typed, key)


def license_categories(c: Column, profile: str = "service") -> Column:
    """Categories of a text, in order without repeats; the evaluator takes every word of up to three letters but labels."""
    words = F.regexp_extract_all(F.upper(c), F.lit(f"{EDGE_L}(?:{CATEGORIES if profile == 'service' else '[A-Z]{1,3}'}){EDGE_R}"), F.lit(0))
    return F.array_distinct(words if profile == "service" else F.filter(words, lambda w: ~w.isin(*LABELS)))


def _moved(m: Column, old: str, new: str) -> Column:
    def move(x: Column) -> Column:
        here = F.map_contains_key(x, F.lit(old)) & ~F.map_contains_key(x, F.lit(new))
        return F.when(here, F.transform_keys(x, lambda k, v: F.when(k == old, F.lit(new)).otherwise(k))).otherwise(x)

    return let(m, move)


def _repaired(kind: str, k: Column, v: Column, profile: str) -> Column:
    token = lambda n: F.coalesce(F.nullif(F.regexp_extract(v, f"{EDGE_L}[A-Z0-9]{{{n},10}}{EDGE_R}", 0), F.lit("")), v)
    undated = F.when(~v.rlike(SLASHED), v)
    if kind == "driver_license":
        wrong = ("address", "issuing_authority") if profile == "service" else ("address",)
        return F.when(k == "license_number", token(7)).when(k.isin(*wrong), undated).when((k == "categories") & ~v.startswith(NESTED), F.nullif(F.array_join(license_categories(v, profile), ","), F.lit(""))).otherwise(v)
    if kind == "passport":
        out = F.when(k == "document_number", token(8)).when(k.isin("surname", "given_names", "mrz"), F.when(~F.lower(strip(v)).isin(*NO_NAMES), v))
        out = out.when(k == "issuing_authority", undated).when(k == "document_time", F.lit(None)) if profile == "service" else out
        return out.otherwise(v)
    return v


def normalize(kind: Column, fields: Column, profile: str = "service") -> Column:
    """Map of canonical keys to clean values; of keys that fall together the last wins. A null map stays null."""
    if profile == "service":
        clean = sanitized
    else:
        clean = lambda c: F.when(~strip(c).isin(*SENTINELS), strip(c))
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(canonical_key(kind, e["key"], profile).alias("k"), clean(e["value"]).alias("v")))
    if profile == "evaluator":
        pairs = F.filter(pairs, lambda p: p["v"].isNotNull())

    def unique(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), -1)["v"]))

    filled = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    base = filled(let(pairs, unique))

    def typed(m: Column, name: str) -> Column:
        for old, new in MOVES[profile][name]:
            m = _moved(m, old, new)
        return filled(F.transform_values(m, lambda k, v: _repaired(name, k, v, profile)))

    def by_type(m: Column) -> Column:
        out = F.when(kind == "driver_license", typed(m, "driver_license")).when(kind == "passport", typed(m, "passport"))
        return out.when(kind == "id_card", typed(m, "id_card")).otherwise(m)

    return F.when(fields.isNotNull(), let(base, by_type))


#: Places of fields among the normalised entities (fixed values).
ENTITIES = {
    "document_number": "document.number", "license_number": "document.number", "surname": "person.surname", "given_names": "person.given_names", "nationality": "person.nationality",
    "date_of_birth": "person.date_of_birth", "place_of_birth": "person.place_of_birth", "address": "person.address", "personal_number": "person.personal_number",
    "date_of_issue": "document.issue_date", "date_of_expiry": "document.expiry_date", "issuing_authority": "document.issuing_authority",
}


def entities(fields: Column) -> Column:
    """Array of (key, value, source_field) of the fields that have a place and a value."""
    found = [F.when(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) != "", F.struct(F.lit(e).alias("key"), F.try_element_at(fields, F.lit(k)).alias("value"), F.lit(k).alias("source_field"))) for k, e in ENTITIES.items()]
    return F.array_compact(F.array(*found))


def populated(fields: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.map_values(fields), lambda v: F.coalesce(v, F.lit("")) != "")), F.lit(0))


def identity_gate(fields: Column) -> Column:
    """Four filled fields make an identity record valid."""
    return F.when(populated(fields) >= 4, F.struct(F.lit(True).alias("is_valid"), F.lit("info").alias("severity"))).otherwise(F.struct(F.lit(False).alias("is_valid"), F.lit("warning").alias("severity")))


def first_present(fields: Column, candidates: tuple[str, ...]) -> Column:
    """The value of the first candidate that is a key, in any case; a blank value of it gives null and ends the search."""

    def of(m: Column) -> Column:
        keys = F.transform(F.map_keys(m), F.lower)
        value = lambda k: F.element_at(F.map_values(m), F.nullif(F.size(keys) + 1 - F.array_position(F.reverse(keys), k), F.size(keys) + 1).cast("int"))
        out = F.lit(None).cast("string")
        for c in reversed(candidates):
            out = F.when(F.array_contains(keys, c.lower()), F.nullif(F.regexp_replace(strip(value(c.lower())), r"\s+", " "), F.lit(""))).otherwise(out)
        return out

    return let(fields, of)


def infer_type(template: Column) -> Column:
    t = F.lower(template)
    return F.when(t.startswith("pp_") | t.contains("passport"), "passport").when(t.startswith("id_card") | t.contains("idcard") | t.startswith("rp_") | t.contains("residence"), "id_card").otherwise("other")


def loops(text: Column, most: int = 20) -> Column:
    """Whether an opening tag occurs `most` times or more: a generation that doesn't end."""
    tags = F.regexp_extract_all(text, F.lit("<s_[^>]+>"), F.lit(0))
    return F.coalesce(let(tags, lambda ts: F.exists(F.array_distinct(ts), lambda t: F.size(F.filter(ts, lambda x: x == t)) >= most)), F.lit(False))


def upload_code(size: Column, mime: Column, limit: int, allowed: tuple[str, ...]) -> Column:
    """400 for nothing, 413 over the limit, 415 for another type, else 200."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, 400).when(size > limit, 413).when(~F.coalesce(mime, F.lit("")).isin(*allowed), 415).otherwise(200)


def merge(kind: Column, primary: Column, fallback: Column) -> Column:
    """Field map of two engines: the primary's values, blanks filled from the fallback; other than identity documents keep the primary's map.

    A licence also takes the fallback's number where its own looks like a date, and the fallback's dates where they are the
    better ones; the issue date is judged against the birth and expiry that came out. A null map counts as empty.
    """
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(primary, empty), F.coalesce(fallback, empty)
    filled = lambda v: F.nullif(v, F.lit(""))
    both = F.map_zip_with(a, F.map_filter(b, lambda k, v: filled(v).isNotNull()), lambda k, x, y: F.coalesce(filled(x), y, x))
    get = lambda m, k: F.try_element_at(m, F.lit(k))

    def chosen(m: Column, k: str, better: Column) -> Column:
        return F.when(filled(get(b, k)).isNotNull() & better, get(b, k)).otherwise(get(m, k))

    def licence(m: Column) -> Column:
        birth = chosen(m, "date_of_birth", better_identity_date(get(b, "date_of_birth"), get(m, "date_of_birth"), True))
        expiry = chosen(m, "date_of_expiry", better_identity_date(get(b, "date_of_expiry"), get(m, "date_of_expiry"), False))
        picked = F.struct(birth.alias("date_of_birth"), expiry.alias("date_of_expiry"))

        def with_dates(d: Column) -> Column:
            issue = chosen(m, "date_of_issue", better_issue_date(get(b, "date_of_issue"), get(m, "date_of_issue"), d["date_of_birth"], d["date_of_expiry"]))
            number = chosen(m, "license_number", mmddyyyy(get(m, "license_number")))
            return F.transform_values(m, lambda k, v: F.when(k == "date_of_birth", d["date_of_birth"]).when(k == "date_of_expiry", d["date_of_expiry"]).when(k == "date_of_issue", issue).when(k == "license_number", number).otherwise(v))

        return let(picked, with_dates)

    return F.when(kind == "driver_license", let(both, licence)).when(kind.isin("passport", "id_card"), both).otherwise(a)
