"""Reports and manifests: small tables as Markdown, JSON reports, and the images that several datasets name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int = 25) -> str:
    """The first `most` rows as a Markdown section: a report for people, so df should be ordered and only its head is fetched. Null is an empty cell."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    row = lambda values: "| " + " | ".join(values) + " |\n"
    rows = "".join(row(map(cell, r)) for r in df.limit(most).collect())
    return f"## {title}\n\n" + row(df.columns) + "|" + "-|" * len(df.columns) + "\n" + rows


def write_json(df: DataFrame, path: str) -> None:
    """One object a row with nulls kept, columns in order of their names."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def bundle(datasets: list[DataFrame], image: str = "image_path") -> DataFrame:
    """The distinct image paths of several datasets, nulls and empty ones left out."""
    paths = [d.select(image).where(F.coalesce(F.col(image), F.lit("")) != "") for d in datasets]
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.distinct()


def manifest(datasets: dict[str, DataFrame], image: str = "image_path") -> DataFrame:
    """A row: n_rows (map of dataset to rows, without empty ones), image_count of the distinct images, image_roots (their first folders, sorted)."""
    roots = bundle(list(datasets.values()), image).groupBy(F.split_part(F.replace(image, F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(1)).alias("root")).agg(F.count("*").alias("n"))
    images = roots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("image_count"), F.sort_array(F.collect_list("root")).alias("image_roots"))
    sizes = None
    for name, df in datasets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    counts = sizes.where("n > 0").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("n_rows"))
    return counts.crossJoin(F.broadcast(images))  # one row each
