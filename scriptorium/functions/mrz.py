"""Machine-readable zones of passports (TD3: two lines of 44) as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.dates import mrz_iso

WIDTH = 44
#: Start of a second line: number, digit, country, birth, digit, sex (fixed value).
SECOND = "[A-Z0-9<]{9}[0-9<][A-Z]{3}[0-9]{6}[0-9<][MFX<]"
#: Characters that recognition mixes up, with their alternatives in the order they are tried (fixed values).
CONFUSIONS = {
    "0": "ODQ", "O": "0DQ", "D": "0O", "Q": "0O", "1": "IL", "I": "1LT", "L": "1I", "T": "I7", "2": "Z", "Z": "2", "5": "S", "S": "5", "8": "B", "B": "8",
    "6": "G", "G": "6C", "7": "T", "4": "A", "A": "4", "<": "KC", "K": "<", "C": "<G", "U": "V", "V": "UY", "Y": "V", "M": "N", "N": "M",
}


#: The further mix-ups that the larger table of the evaluation scripts adds (fixed values).
MORE_CONFUSIONS = CONFUSIONS | {"9": "g", "E": "F", "F": "E", "P": "R", "R": "P"}


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c bound to a variable, so that a long expression stands in the plan once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def char_value(c: Column) -> Column:
    """< is 0, digits are themselves, letters start at 10."""
    a = F.ascii(F.upper(c))
    return F.when(c == "<", 0).when(a.between(48, 57), a - 48).otherwise(a - 55)


_KNOWN = "<0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_VALUES = [0, *range(10), *range(10, 36), *range(10, 36)]


def check_digit(s: Column) -> Column:
    """Sum of the values weighed by 7, 3, 1 in turn, modulo 10, as a character.

    Only the last digit of each product counts, so each third character becomes that digit at once; the digits' sum is taken bit
    by bit, from how many of them have each bit. Texts with other characters go one by one.
    """

    def third(weight: int, begin: int) -> Column:
        own = F.regexp_replace(F.substr(s, F.lit(begin)), "(.).{0,2}", "$1")
        return F.translate(own, _KNOWN, "".join(str(v * weight % 10) for v in _VALUES))

    def total(u: Column) -> Column:
        having = lambda digits: F.length(u) - F.length(F.translate(u, digits, ""))
        return F.pmod(having("13579") + 2 * having("2367") + 4 * having("4567") + 8 * having("89"), F.lit(10)).cast("string")

    quick = let(F.concat(third(7, 1), third(3, 2), third(1, 3)), total)
    return F.when(s.rlike(r"\A[<0-9A-Za-z]*\z"), quick).otherwise(_one_by_one(s))


def _one_by_one(s: Column) -> Column:
    characters = F.filter(F.split(s, ""), lambda c: c != "")
    weighed = F.transform(characters, lambda c, i: char_value(c) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.pmod(F.aggregate(weighed, F.lit(0), lambda a, b: a + b), F.lit(10)).cast("string")


def padded(l2: Column) -> Column:
    return F.rpad(F.left(F.upper(l2), F.lit(WIDTH)), WIDTH, "<")


def composite(l2: Column) -> Column:
    return F.concat(F.substring(l2, 1, 10), F.substring(l2, 14, 7), F.substring(l2, 22, 22))


def digits(l2: Column) -> dict[str, Column]:
    """The five checks of a padded second line."""
    at = lambda i, n=1: F.substring(l2, i, n)
    return {"cd_doc": check_digit(at(1, 9)) == at(10), "cd_dob": check_digit(at(14, 6)) == at(20), "cd_exp": check_digit(at(22, 6)) == at(28), "cd_personal": check_digit(at(29, 14)) == at(43), "cd_final": check_digit(composite(l2)) == at(44)}


def line2_valid(l2: Column) -> Column:
    """Number, birth, expiry and composite digits; the personal number's digit isn't asked."""

    def good(p: Column) -> Column:
        d = digits(p)
        return d["cd_doc"] & d["cd_dob"] & d["cd_exp"] & d["cd_final"]

    return let(padded(l2), good)


def validate(l1: Column, l2: Column) -> Column:
    """Lengths, format, the five digits and the verdict."""
    ok = (F.length(l1) >= 10) & (F.length(l2) >= 28) & F.left(F.upper(l1), F.lit(1)).isin("P", "V")

    def report(p: Column) -> Column:
        d = digits(p)
        verdict = ok & d["cd_doc"] & d["cd_dob"] & d["cd_exp"] & d["cd_final"]
        return F.struct(F.length(l1).alias("len_l1"), F.length(l2).alias("len_l2"), ok.alias("ok_format"), *(c.alias(k) for k, c in d.items()), verdict.alias("valid"))

    return let(padded(l2), report)


def split_lines(text: Column) -> Column:
    """(l1, l2) from recognised text: the last two long lines, else cut where a second line starts, else a single long one."""
    raw = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9<]", "")), lambda x: x != "")
    pair = lambda a, b: F.struct(a.alias("l1"), b.alias("l2"))
    none = F.lit("")

    def choose(raw: Column) -> Column:
        long_, joined = F.filter(raw, lambda x: F.length(x) >= 28), F.array_join(raw, "")
        at, one = F.regexp_instr(joined, F.lit(SECOND)), F.get(long_, F.lit(0))
        return (
            F.when(F.size(long_) >= 2, pair(F.element_at(long_, -2), F.element_at(long_, -1)))
            .when(at > 2, pair(F.substr(joined, F.lit(1), at - 1), F.substr(joined, at)))
            .when((F.size(long_) == 1) & one.startswith("P<"), pair(one, none))
            .when(F.size(long_) == 1, pair(none, one))
            .otherwise(pair(none, none))
        )

    return let(raw, choose)


def answer_lines(text: Column) -> Column:
    """(l1, l2) of a model's answer: the first two lines of 20 zone characters or more; a single one that starts with P< is cut at 44, as is the whole text if it has no such line. Null without any; l2 is null if there is one line."""
    zone = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9<]", "")
    pair = lambda a, b: F.struct(a.alias("l1"), b.cast("string").alias("l2"))
    cut = lambda c: pair(F.left(c, F.lit(WIDTH)), F.nullif(F.substr(c, F.lit(WIDTH + 1)), F.lit("")))

    def choose(found: Column) -> Column:
        one, whole = F.get(found, F.lit(0)), zone(text)
        return (
            F.when(F.size(found) >= 2, pair(one, F.get(found, F.lit(1))))
            .when((F.size(found) == 1) & one.startswith("P<"), cut(one))
            .when(F.size(found) == 1, pair(one, F.lit(None)))
            .when(whole.startswith("P<") & (F.length(whole) >= WIDTH), cut(whole))
        )

    long_ = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), zone), lambda x: F.length(x) >= 20)
    return F.when(F.lower(F.trim(text)) != "null", let(long_, choose))


def names(l1: Column) -> Column:
    """(surname, given): split at the first <<; < is a blank."""
    clean = F.regexp_replace(F.upper(l1), "[^A-Z0-9<\n]", "")
    parts = F.split(F.substr(clean, F.lit(6)), "<<", 2)
    blank = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    surname = F.nullif(blank(F.get(parts, F.lit(0))), F.lit(""))
    given = F.nullif(F.trim(F.regexp_replace(blank(F.get(parts, F.lit(1))), " +", " ")), F.lit(""))
    return F.when(F.length(clean) >= 6, F.struct(surname.alias("surname"), given.alias("given_names")))


def parse(l1: Column, l2: Column, this_year: int, countries: dict[str, str] | None = None) -> Column:
    """Typed fields of two lines. countries maps codes to names; others keep their code."""
    known = F.create_map(*[F.lit(x) for pair in (countries or {"": ""}).items() for x in pair])

    def fields(p: Column) -> Column:
        plain = lambda i, n: F.nullif(F.trim(F.replace(F.substring(p, i, n), F.lit("<"), F.lit(""))), F.lit(""))
        code, n, sex = plain(11, 3), names(l1), F.substring(p, 21, 1)
        return F.struct(plain(1, 9).alias("document_number"), n["surname"].alias("surname"), n["given_names"].alias("given_names"), F.coalesce(F.try_element_at(known, code), code).alias("nationality"), code.alias("nationality_code"), mrz_iso(F.substring(p, 14, 6), this_year).alias("date_of_birth"), F.when(sex.isin("M", "F"), sex).alias("sex"), mrz_iso(F.substring(p, 22, 6), this_year, expiry=True).alias("date_of_expiry"))

    return let(padded(l2), fields)


def build(country: Column, surname: Column, given: Column, number: Column, birth: Column, sex: Column, expiry: Column) -> tuple[Column, Column]:
    """Two valid lines."""
    l1 = F.rpad(F.concat(F.lit("P<"), country, surname, F.lit("<<"), given), WIDTH, "<")
    doc = F.rpad(number, 9, "<")
    head = F.concat(doc, check_digit(doc), country, birth, check_digit(birth), sex, expiry, check_digit(expiry), F.lit("<" * 14), F.lit("0"))
    return l1, let(head, lambda h: F.concat(h, check_digit(composite(F.rpad(h, WIDTH, "<")))))


def char_accuracy(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of the 88 positions at which both readings agree; short lines are filled up with ~."""
    fit = lambda c: F.rpad(F.left(F.coalesce(c, F.lit("")), F.lit(WIDTH)), WIDTH, "~")
    both = F.arrays_zip(F.split(F.concat(fit(a1), fit(a2)), "").alias("x"), F.split(F.concat(fit(b1), fit(b2)), "").alias("y"))
    return F.size(F.filter(both, lambda p: (p["x"] == p["y"]) & (p["x"] != ""))) / F.lit(2.0 * WIDTH)


#: First and last place (from 0) of what each asked digit covers, and the place of the digit; the composite has three parts.
_CHECKS = (((range(0, 9),), 9), ((range(13, 19),), 19), ((range(21, 27),), 27), ((range(0, 10), range(13, 20), range(21, 43)), 43))
_WEIGHTS = tuple({p: (7, 3, 1)[i % 3] for i, p in enumerate(p for r in parts for p in r)} for parts, _ in _CHECKS)


def _value(c: str) -> int:
    return 0 if c == "<" else int(c) if c in "0123456789" else ord(c.upper()) - 55


def changes(confusions: dict[str, str]) -> list[tuple]:
    """place (from 1), character, order, alternative, the change of each of the four sums modulo 10: a row for each substitution that a line of 44 may undergo."""
    return [(p + 1, c, (p + 1) * 100 + n, a, *((w.get(p, 0) * (_value(a) - _value(c))) % 10 for w in _WEIGHTS)) for p in range(WIDTH) for c, many in confusions.items() for n, a in enumerate(many)]


def repair(df: DataFrame, l2: str, key: str, confusions: dict[str, str] = CONFUSIONS) -> DataFrame:
    """key, fixed (padded line), n_edits (0 valid, 1 repaired, -1 not repairable by one substitution) and n_candidates (valid single substitutions).

    A line that fails gives a row for each of its 44 characters, with its four sums; the substitutions, a table of a few thousand rows whatever
    the data, are joined to them by place and character and carry what they change, so that no changed line is built but the
    winning one. A valid line isn't always the true one: n_candidates over 1 tells that the choice was ambiguous.
    """
    from scriptorium.operators.rows import bound

    base = bound(df.select(F.col(key).alias("k"), F.col(l2).alias("given")), l2=padded(F.col("given"))).drop("given")
    base = bound(base, sums=F.array(*(check_digit(c) for c in (F.substring("l2", 1, 9), F.substring("l2", 14, 6), F.substring("l2", 22, 6), composite(F.col("l2"))))), said=F.array(*(F.substring("l2", at + 1, 1) for _, at in _CHECKS)))
    bad = base.where("sums != said")
    table = df.sparkSession.createDataFrame(changes(confusions), "place int, old string, n int, new string, d0 int, d1 int, d2 int, d3 int")
    each = bad.select("k", "l2", "said", F.transform("sums", lambda x: x.cast("int")).alias("sums"), F.posexplode(F.split("l2", "")).alias("p", "old")).where("p < 44")
    tried = each.withColumn("place", F.col("p") + 1).join(F.broadcast(table), ["place", "old"])
    good = F.lit(True)
    for i, (_, at) in enumerate(_CHECKS):
        wanted = F.when(F.col("place") == at + 1, F.col("new")).otherwise(F.get("said", F.lit(i)))
        good = good & (F.pmod(F.get("sums", F.lit(i)) + F.col(f"d{i}"), F.lit(10)).cast("string") == wanted)
    changed = F.concat(F.substr("l2", F.lit(1), F.col("place") - 1), "new", F.substr("l2", F.col("place") + 1))
    best = tried.where(good).groupBy("k", "l2").agg(F.min(F.struct("n", changed.alias("candidate"))).alias("best"), F.count_distinct(changed).alias("n_candidates"))
    found = bad.select("k", "l2").join(best, ["k", "l2"], "left")
    fixed = found.select(F.col("k").alias(key), F.coalesce("best.candidate", "l2").alias("fixed"), F.when(F.col("best").isNotNull(), 1).otherwise(-1).alias("n_edits"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))
    return base.where("sums = said").select(F.col("k").alias(key), F.col("l2").alias("fixed"), F.lit(0).alias("n_edits"), F.lit(0).cast("long").alias("n_candidates")).unionByName(fixed)


def _two_edits(line: str, confusions: dict[str, str] = CONFUSIONS) -> str | None:
    """The first line that passes after two substitutions, by the first one's order and then the second one's. Sums are carried along, not built anew."""

    def changed(sums: list[int], at: int, old: str, new: str) -> list[int]:
        return [s + w.get(at, 0) * (_value(new) - _value(old)) for s, w in zip(sums, _WEIGHTS, strict=True)]

    sums = [sum(w * _value(line[p]) for p, w in weights.items()) for weights in _WEIGHTS]
    for i, a in ((i, a) for i, c in enumerate(line) for a in confusions.get(c, "")):
        once, half = line[:i] + a + line[i + 1 :], changed(sums, i, line[i], a)
        for j, b in ((j, b) for j, c in enumerate(once) for b in confusions.get(c, "")):
            if all(str(s % 10) == (b if at == j else once[at]) for s, (_, at) in zip(changed(half, j, once[j], b), _CHECKS, strict=True)):
                return once[:j] + b + once[j + 1 :]
    return None


def repair_pairs(df: DataFrame, l2: str, key: str, confusions: dict[str, str] = CONFUSIONS) -> DataFrame:
    """repair, and for the lines that one substitution leaves invalid the first pair that helps; n_edits is then the number of places that differ.

    Only those lines go to Python, in Arrow batches; each costs about ten thousand small sums and nothing is gathered.
    """
    import pandas as pd

    once = repair(df, l2, key, confusions).withColumn("_left", F.col("n_edits") == -1)

    def mend(batches):
        for b in batches:
            found = [_two_edits(x, confusions) for x in b["fixed"]]
            far = [sum(x != y for x, y in zip(f, x0, strict=True)) if f else -1 for f, x0 in zip(found, b["fixed"], strict=True)]
            yield b.assign(n_edits=pd.Series(far, b.index, dtype="int32"), fixed=[f or x for f, x in zip(found, b["fixed"], strict=True)])

    columns = [key, "fixed", "n_edits", "n_candidates"]
    rest = once.where("_left").select(*columns)
    return once.where("not _left").select(*columns).unionByName(rest.mapInPandas(mend, rest.schema))
