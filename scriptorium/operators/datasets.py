"""Dataset curation: de-duplication, routing, promotion, splits, validation, leakage and profiles. Order is carried in a column, never taken from the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.rows import packed, unpacked


def first_wins(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("file_no", "line_no")) -> DataFrame:
    """The first row of each key; rows with a null or empty key all stay. A map-side aggregate finds the first, so a hot key costs no task."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    best = df.where(~blank).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return best.unionByName(df.where(blank)).select(*df.columns)


def last_of_group_split(df: DataFrame, group: str = "source_dataset", key: str = "id", order: tuple[str, ...] = ("file_no", "line_no")) -> DataFrame:
    """df with split: of each group of two or more the row with the greatest key, the last in order among equal keys, is val, the rest train; null groups and keys are 'None'."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = packed(df, g=none(group), at=F.struct(none(key).alias("key"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))))
    stats = rows.groupBy("g").agg(F.max("at").alias("last"), F.count("*").alias("n"))
    val = (F.col("n") >= 2) & (F.col("at") == F.col("last"))
    return unpacked(rows.join(stats, "g"), df.columns, split=F.when(val, "val").otherwise("train"))


def split_families(df: DataFrame, families: dict[str, Column]) -> DataFrame:
    """family, split and the columns of df: each family's rows, split by themselves."""
    parts = [last_of_group_split(df.where(c)).withColumn("family", F.lit(name)) for name, c in families.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leakage(train: DataFrame, val: DataFrame, key: str = "id", image: str = "image_path") -> DataFrame:
    """kind, value, n_train, n_val: ids in both sets, and images in both under different ids, with how many distinct ids each side has. A row for each leak, whatever the number of rows that share it: no pairs are made."""
    ids = train.select(key).intersect(val.select(key)).select(F.lit("id").alias("kind"), F.col(key).alias("value"), F.lit(1).cast("long").alias("n_train"), F.lit(1).cast("long").alias("n_val"))
    both = train.select(F.col(image).alias("value"), F.col(key).alias("id"), F.lit(True).alias("t")).unionByName(val.select(F.col(image).alias("value"), F.col(key).alias("id"), F.lit(False).alias("t"))).where("value is not null and id is not null").distinct()
    found = both.groupBy("value").agg(F.count_if("t").alias("n_train"), F.count_if(~F.col("t")).alias("n_val"), (F.min("id") != F.max("id")).alias("differ")).where("differ and n_train > 0 and n_val > 0")
    return ids.unionByName(found.select(F.lit("image").alias("kind"), "value", "n_train", "n_val"))


def leak_members(train: DataFrame, val: DataFrame, key: str = "id", image: str = "image_path") -> DataFrame:
    """kind, value, id, split, n_links: the members of each leak, that is each distinct id of each side that is linked with the other one, by the same id or by an image under another id.

    value is the class (the id or the image), n_links the number of ids of the other side that the member is linked with. All pairs
    follow from the members, and none are made: a row for each id, image and side.
    """
    sides = [s.select(F.col(key).cast("string").alias("id"), F.col(image).cast("string").alias("image"), F.lit(name).alias("split")) for s, name in ((train, "train"), (val, "val"))]
    classes = F.inline(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("value")), F.struct(F.lit("image").alias("kind"), F.col("image").alias("value"))))
    rows = sides[0].unionByName(sides[1]).where("id is not null").select("id", "split", classes).where("value is not null")
    each = rows.groupBy("kind", "value", "id").agg(F.max((F.col("split") == "train").cast("long")).alias("train"), F.max((F.col("split") == "val").cast("long")).alias("val"))
    whole = each.groupBy("kind", "value").agg(F.sum("train").alias("n_train"), F.sum("val").alias("n_val")).where("n_train > 0 and n_val > 0")
    own = lambda c: F.when(F.col("kind") == "image", F.col(c)).otherwise(F.lit(0))  # noqa: E731  an image under the same id is a leak of the id
    member = lambda name, other: F.when(F.col(name) == 1, F.struct(F.lit(name).alias("split"), (F.col(f"n_{other}") - own(other)).alias("n_links")))
    members = each.join(whole, ["kind", "value"]).select("kind", "value", "id", F.inline(F.array_compact(F.array(member("train", "val"), member("val", "train")))))
    return members.where("n_links > 0")


def route(df: DataFrame, good: Column, diverse: Column) -> DataFrame:
    """df with route: train, eval or manual; one pass."""
    return df.withColumn("route", F.when(good, "train").when(diverse, "eval").otherwise("manual"))


def promote(queue: DataFrame, wanted: DataFrame, target: DataFrame, key: str = "id", order: tuple[str, ...] = ("line_no",), workflow: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the queue that are wanted and not yet in the target, the first of each key, without workflow columns."""
    new = queue.join(wanted.select(key).distinct(), key, "left_semi").join(target.select(key), key, "left_anti")
    return first_wins(new, key, order).drop(*workflow)


def issues(df: DataFrame, known_images: DataFrame, key: str = "id", image: str = "image_path", order: str = "line_no") -> DataFrame:
    """order and issue, a row for each fault of a row. populated is the number of its filled fields, null if fields is no object."""
    own = df.select(*(F.col(c).alias(c) for c in dict.fromkeys((key, image, order, "document_type", "populated", "bootstrap_template"))))  # so that no other column clashes
    first = own.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(order).alias("_first"))
    marked = own.join(first, key, "left").join(known_images.select(F.col(image), F.lit(True).alias("_there")).distinct(), image, "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    stop = F.col("populated").isNull()
    found = [
        F.when(empty(key), "missing id").when(F.col(order) > F.col("_first"), "duplicate id"),
        F.when(empty(image), "missing image_path").when(F.col("_there").isNull(), "image file does not exist"),
        F.when(empty("document_type"), "missing document_type"),
        F.when(stop, "fields must be an object"),
        F.when(~stop & (F.col("populated") == 0), "all fields are empty"),
        F.when(~stop & F.coalesce(F.col("bootstrap_template"), F.lit(False)), "bootstrap template"),
    ]
    return marked.select(order, F.explode(F.array_compact(F.array(*found))).alias("issue"))


def counter(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n: how often each value occurs for each group; null values count as 'None'."""
    named = F.coalesce(F.col(value).cast("string"), F.lit("None"))
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by), named.alias("value")).agg(F.count("*").alias("n")).select(by, F.lit(value).alias("field"), "value", "n")


def coverage(df: DataFrame, by: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of each group, and how many have each field (not null, not empty)."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *(F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias(f"n_{f}") for f in fields))


def source_flags(source: Column) -> dict[str, Column]:
    """What the name of a source tells."""
    return {"is_russian": F.lower(source).contains("russian"), "is_printed_variant": F.lower(source).contains("printed-")}


def profile(df: DataFrame, by: str, counters: dict[str, Column], fields: tuple[str, ...]) -> DataFrame:
    """by, n_rows, counts, coverage: for each group a map of counter to a map of value to rows (null as 'None', sorted), and a map of field to the rows that fill it (fields that no row fills are left out).

    Values are counted before anything is collected, so a group's maps hold its distinct values only: counters are for columns of
    few values.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    filled = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
    item = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.alias("value"))
    items = [item("rows", "", F.lit(""))] + [item("counts", n, text(c)) for n, c in counters.items()] + [F.when(filled(f), item("coverage", f, F.lit(""))) for f in fields]
    counted = df.select(text(F.col(by)).alias("g"), F.inline(F.array_compact(F.array(*items)))).groupBy("g", "kind", "name", "value").agg(F.count("*").alias("n"))
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    named = counted.groupBy("g", "kind", "name").agg(pairs("value", "n").alias("values"), F.sum("n").alias("n"))
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    of = lambda kind, c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", c))), by_name))
    return named.groupBy(F.col("g").alias(by)).agg(F.max(F.when(F.col("kind") == "rows", F.col("n"))).alias("n_rows"), of("counts", "values").alias("counts"), of("coverage", "n").alias("coverage"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the most frequent value of each key; on a tie the smallest."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def hash_split(df: DataFrame, ratio: float, key: str = "id", seed: int = 0) -> DataFrame:
    """df with split: about `ratio` of the rows are val, by a hash of the key; the same for every run and size."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(ratio * 1_000_000), "val").otherwise("train"))


def shuffle_split(df: DataFrame, ratio: float, key: str = "id", seed: int = 0) -> DataFrame:
    """df with split: of the n distinct keys exactly max(1, int(n * ratio)) are val, the first ones by a seeded hash. Rows of one key stay together; rows with a null key are train.

    Only the last val key is searched: hashes are counted in at most 65,536 parts, and only the part that it lies in is ranked. What
    goes to all tasks is this one key.
    """
    named = F.col(f"`{key}`").cast("string")
    hashed = lambda k: F.md5(F.concat(F.lit(f"{seed}:"), k))
    keys = df.select(named.alias("k")).where("k is not null").distinct().select("k", hashed(F.col("k")).alias("h")).withColumn("part", F.left("h", F.lit(4)))
    sizes = keys.groupBy("part").agg(F.count("*").alias("n"))
    sums = sizes.select("part", "n", F.sum("n").over(Window.orderBy("part")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("whole"))
    wanted = F.greatest(F.lit(1), F.floor(F.col("whole") * F.lit(float(ratio))))
    border = sums.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select("part", (wanted - F.col("upto") + F.col("n")).alias("place"))
    ranked = keys.join(F.broadcast(border), "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("h", "k")))
    last = ranked.where("rank = place").agg(F.max(F.struct("h", "k")).alias("last"))  # one row, null without keys
    marked = packed(df, at=F.when(named.isNotNull(), F.struct(hashed(named).alias("h"), named.alias("k"))))
    val = F.coalesce(F.col("at") <= F.col("last"), F.lit(False))
    return unpacked(marked.crossJoin(F.broadcast(last)), df.columns, split=F.when(val, "val").otherwise("train"))


def fallback_split(df: DataFrame, order: str = "line_no") -> DataFrame:
    """df with its column split: where no row is val and more than one is train, the last train row becomes val (all that share its place). Broadcasts one row."""
    train = F.col("split") == "train"
    state = df.agg(F.count_if(F.col("split") == "val").alias("vals"), F.count_if(train).alias("trains"), F.max(F.when(train, F.col(order))).alias("last"))
    marked = packed(df, was=F.col("split"), place=F.col(order)).crossJoin(F.broadcast(state))
    moved = (F.col("vals") == 0) & (F.col("trains") > 1) & (F.col("was") == "train") & (F.col("place") == F.col("last"))
    return unpacked(marked, df.columns, split=F.when(moved, "val").otherwise(F.col("was")))


def prioritized(df: DataFrame, source: str, priorities: dict[str, int], populated: str = "populated", key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """df by the priority of its source (of the first part that it contains, 99 without), filled fields falling, then key; `order` decides among equal keys."""
    rank = F.lit(99)
    for part, n in reversed(priorities.items()):
        rank = F.when(F.col(source).contains(part), n).otherwise(rank)
    return df.orderBy(rank, F.desc(populated), key, *order)
