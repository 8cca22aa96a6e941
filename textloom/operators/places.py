"""Place and country dictionaries from tables (SRC-10, PS-1 to PS-13, JOIN-6, SNK-3)."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import ascii_key, clean_cell, composed


def clean_places(rows: DataFrame, name: str = "name", order: str = "ord", latin: bool = False) -> DataFrame:
    """Names with collapsed blanks, of 2 to 100 characters and only of letters, marks and joining signs; the first of each
    small spelling stays (PS-1 to PS-3)."""
    cleaned = F.btrim(F.regexp_replace(F.translate(composed(F.col(name)), "’ʼ‘", "'''"), r"\s+", " "))
    out = rows.withColumn("name", cleaned).where(F.char_length("name").between(2, 100) & F.col("name").rlike(r"^\p{L}[\p{L}\p{M}\p{N} .,'()/-]*$"))
    if latin:
        out = out.where(~F.col("name").rlike(r"[\p{L}\p{N}&&[^\x{0}-\x{24F}]]"))
    w = Window.partitionBy(F.lower("name")).orderBy(order)
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cities(rows: DataFrame, home: str = "MT") -> tuple[DataFrame, DataFrame]:
    """Places abroad and places at home of a gazetteer with class, code and country (PS-4, PS-5)."""
    abroad = rows.where((F.col("feature_class") == "P") & (F.col("country") != home))
    own = rows.where((F.col("country") == home) & ((F.col("feature_class") == "P") | ((F.col("feature_class") == "A") & (F.col("feature_code") == "ADM1"))))
    return abroad, own


def preferred_alias(aliases: Column, prefixes: tuple[str, ...]) -> Column:
    """The shortest alias with the first prefix that any has (PS-6)."""
    shortest = lambda p: F.get(F.array_sort(F.transform(F.filter(aliases, lambda a: a.startswith(p)), lambda a: F.struct(F.length(a).alias("n"), a.alias("a")))), F.lit(0))["a"]
    return F.coalesce(*[shortest(p) for p in prefixes])


def fold(name: Column) -> Column:
    """The key under which spellings of a name meet (PS-8)."""
    return F.regexp_replace(ascii_key(F.translate(name, "àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu")), r"[^\p{L}\p{N}]", "")


def quality(name: Column) -> Column:
    """Ten for each letter of the alphabet beyond ASCII, less two for each gh (PS-9)."""
    own = F.length(name) - F.length(F.translate(name, "ħġċżĦĠĊŻ", ""))
    return 10 * own - 2 * F.regexp_count(F.lower(name), F.lit("gh"))


def best_spelling(rows: DataFrame, order: str = "ord") -> DataFrame:
    """The best spelling of each key, the first of equal ones (PS-10)."""
    w = Window.partitionBy(fold(F.col("name"))).orderBy(F.desc(quality(F.col("name"))), order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_articles(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names with the best bare name among their aliases (PS-7): by kind of match, quality and length."""
    bare = lambda c: F.regexp_replace(c, r"(?i)^(?:l|il|i[cċdgnrstxzż])-", "")
    left = rows.select("name", fold(bare(F.col("name"))).alias("k"))
    right = aliases.select(bare(F.col("alias")).alias("bare"), (bare(F.col("alias")) != F.col("alias")).alias("had"), fold(bare(F.col("alias"))).alias("k"))
    w = Window.partitionBy("name").orderBy(F.desc("had"), F.desc(quality(F.col("bare"))), F.length("bare"), "bare")
    return left.join(right, "k").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("name", "bare")


def without(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Names that none of the other tables has (PS-11)."""
    for other in others:
        rows = rows.join(other.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_anti")
    return rows.orderBy("name")


def sections(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(section, line): the distinct lines of each part in order, parts one after the other (PS-12)."""
    out = None
    for number, (tag, rows) in enumerate(parts):
        part = rows.select(F.lit(number).alias("section"), F.concat_ws("/", "name", F.lit(tag)).alias("line")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("section", "line")


def json_values(rows: DataFrame, column: str, name: str) -> DataFrame:
    """All string values of one property at any depth of JSON texts (PS-13)."""
    pattern = rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)"'
    return rows.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("value"))


class _Table(html.parser.HTMLParser):
    """Cells of the tables of one class; tables within are skipped, footnotes too."""

    def __init__(self, css: str) -> None:
        super().__init__(convert_charrefs=True)
        self.css, self.depth, self.skip = css, 0, 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if tag == "table" and (self.depth or self.css in classes):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = []
        elif tag == "sup":
            self.skip += 1
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag == "sup":
            self.skip = max(0, self.skip - 1)
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            if self.rows:
                self.rows[-1].append("".join(self.cell))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.depth == 1 and self.cell is not None and not self.skip:
            self.cell.append(data)


def html_rows(pages: DataFrame, css: str, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, row, cells) of the tables of class ``css`` in HTML pages (SRC-10)."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch[id_column], batch[html_column]):
                parser = _Table(css)
                parser.feed(text or "")
                out += [(page, i, cells) for i, cells in enumerate(r for r in parser.rows if r)]
            yield pd.DataFrame(out, columns=[id_column, "row", "cells"])

    rows = pages.select(id_column, html_column).mapInPandas(run, f"{id_column} {kind}, row int, cells array<string>")
    return rows.withColumn("cells", F.transform("cells", clean_cell))


def by_code(rows: DataFrame) -> DataFrame:
    """Rows keyed by their first cell of two capital letters; the first of each key stays (JOIN-6)."""
    code = F.get(F.filter("cells", lambda c: c.rlike("^[A-Z]{2}$")), F.lit(0))
    w = Window.partitionBy("iso").orderBy("row")
    return rows.withColumn("iso", code).where("iso is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def countries(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Countries of two tables by code, and the codes that only one of them has (JOIN-6)."""
    a, b = by_code(first).select("iso", F.col("cells").alias("mt")), by_code(second).select("iso", F.col("cells").alias("en"))
    both = a.join(b, "iso", "full_outer")
    lonely = both.where("mt is null or en is null").select("iso", F.col("mt").isNotNull().alias("in_first"))
    demonyms = F.filter(F.transform(F.split(F.coalesce(F.element_at("mt", -1), F.lit("")), ","), lambda d: F.btrim(d)), lambda d: d != "")
    return both.where("mt is not null and en is not null").select("iso", F.get("en", F.lit(0)).alias("english"), F.get("mt", F.lit(0)).alias("maltese"), demonyms.alias("demonyms")), lonely
