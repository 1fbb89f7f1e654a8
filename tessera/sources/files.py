"""Sources and sinks: delimited and report files, and graph exports."""

from __future__ import annotations

import gzip
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import storage


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values, gzipped or not, without their leading # lines."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", '"').option("escape", '"').option("comment", "#").csv(path)


def claimed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(nodes, edges) that a header line ``# Nodes: n Edges: m`` claims."""
    line = spark.read.text(path).filter(F.col("value").startswith("#") & F.col("value").contains("Nodes:"))
    number = lambda name: F.regexp_extract("value", rf"{name}:\s*([0-9]+)", 1).cast("long")
    return line.select(number("Nodes").alias("nodes"), number("Edges").alias("edges"))


def read_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_tsv, refused if the number of rows isn't what the header claims."""
    rows = read_tsv(spark, path, schema)
    claim = claimed_counts(spark, path).first()
    if claim and claim["edges"] is not None and rows.count() != claim["edges"]:
        raise ValueError(f"{path} claims {claim['edges']} edges and has another number")
    return rows


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.option("sep", "\t").option("compression", "gzip").option("header", header).csv(path)


def write_single_tsv(df: DataFrame, path: str, comment: list[str]) -> None:
    """One gzipped file: a member with the comment lines, then the members that the tasks wrote, in order."""
    spark = df.sparkSession
    parts = path + ".parts"
    write_tsv(df, parts)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(target, True)
    out.write(bytearray(gzip.compress("".join(f"# {line}\n" for line in comment).encode(), mtime=0)))
    for e in storage.listed(spark, parts):
        if e.name.startswith("part-"):
            piece = system.open(jvm.org.apache.hadoop.fs.Path(e.path))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 16, False)
            piece.close()
    out.close()
    storage.remove(spark, parts)


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in ranges of the keys, so that a lookup reads few row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def write_communities(members: DataFrame, path: str, group: str = "community", node: str = "node", least: int = 3, top: int | None = None, names: str | None = None) -> None:
    """One line a group, largest first: its node ids in order, joined by tabs; the largest ``top`` only, if given; with ``names``,
    a file beside it that says which group a line is."""
    lists = members.groupBy(group).agg(F.array_sort(F.collect_set(node)).alias("x")).filter(F.size("x") >= least)
    ordered = lists.orderBy(F.size("x").desc(), group)
    ordered = ordered if top is None else ordered.limit(top)
    ordered.select(F.array_join(F.transform("x", lambda v: v.cast("string")), "\t").alias("value")).write.text(path)
    if names:
        ordered.select(F.concat_ws("\t", F.col(group).cast("string"), F.size("x").cast("string")).alias("value")).write.text(names)


def inverted_text(column: str) -> Column:
    """The text of a JSON map from words to their positions."""
    words = F.from_json(F.col(column), T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    placed = F.flatten(F.transform(F.map_entries(words), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def sections(text: str) -> list[tuple[str, int, list[str]]]:
    """(Title, row number, cells) of a report: ``=== title``, a header, dashes, rows of cells two or more spaces apart."""
    out, title, state, n = [], None, "", 0
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if line.startswith("==="):
            title, state, n = line.strip("= ").strip(), "header", 0
        elif title and state == "header" and re.fullmatch(r"[\s-]*-[\s-]*", line):
            out.append((title, 0, re.split(r"\s{2,}", lines[i - 1].strip())))
            state = "rows"
        elif not line.strip():
            state = "" if state == "rows" else state
        elif state == "rows":
            n += 1
            out.append((title, n, re.split(r"\s{2,}", line.strip())))
    return out


@F.udtf(returnType="title string, row int, cells array<string>")
class ReportSections:
    """The tables of one report's text; row 0 of each is its header."""

    def eval(self, text: str):
        yield from sections(text or "")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def report_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, row, cells) of all report files below a path; row 0 is the header."""
    return _files(spark, path).lateralJoin(ReportSections(F.col("value").outer())).select("file", "title", "row", "cells")


def report_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, line) of the loose lines between tables, log lines left out."""
    lines = _files(spark, path).select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    title = F.last(F.when(F.col("line").startswith("==="), F.trim(F.regexp_replace("line", "=", ""))), True).over(Window.partitionBy("file").orderBy("at"))  # a report's lines
    loose = lines.withColumn("title", title).filter((F.trim("line") != "") & ~F.col("line").startswith("===") & ~F.col("line").startswith("[") & ~F.col("line").rlike(r"\S\s{2,}\S") & ~F.col("line").rlike(r"^[\s-]+$") & F.col("title").isNotNull())
    return loose.select("file", "title", F.trim("line").alias("line"))


def report_values(tables: DataFrame, start: str) -> DataFrame:
    """(row, column, text, number) of the tables whose title begins so: each cell with its column's name."""
    of = tables.filter(F.col("title").startswith(start))
    head = of.filter("row = 0").select("file", "title", F.col("cells").alias("head"))
    cells = of.filter("row > 0").join(head, ["file", "title"]).select("row", F.posexplode("cells").alias("at", "text"), "head")
    return cells.select("row", F.get("head", F.col("at")).alias("column"), "text", number("text").alias("number")).filter("column IS NOT NULL")


def keyed(values: DataFrame, key: str) -> DataFrame:
    """(key, column, text, number): a table's rows named by one of its columns."""
    names = values.filter(F.col("column") == key).select("row", F.col("text").alias("key"))
    return values.filter(F.col("column") != key).join(names, "row").select("key", "column", "text", "number")


def network_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A network job's report: what each graph is like, the giant component, communities, weights and distances."""
    t = report_sections(spark, path)
    distance = report_notes(spark, path).select(*[F.regexp_extract("line", rf"{p} ([0-9.]+)", 1).try_cast("double").alias(n) for n, p in (("mean", "mean distance"), ("median", "median"), ("p90", "90th percentile"))])
    return {
        "overview": keyed(report_values(t, "Network overview"), "graph"), "structure": keyed(report_values(t, "Structure of the giant component"), "measure"), "communities": keyed(report_values(t, "Communities in the giant component"), "measure"),
        "weights": report_values(t, "Edge weights"), "components": report_values(t, "Component sizes"), "distances": distance.filter("mean IS NOT NULL"),
    }


def match_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A report on matching an external source: rates by kind, what it would add, fields and countries."""
    t = report_sections(spark, path)
    return {"match": keyed(report_values(t, "Match rate and agreement"), "kind"), "adds": report_values(t, "What"), "fields": report_values(t, "OpenAlex research field"), "countries": report_values(t, "Countries")}


def power_law_report(spark: SparkSession, path: str) -> DataFrame:
    """(distribution, xmin, alpha, error) of a report's power-law fits; alpha stands as ``a \u00b1 e``."""
    v = keyed(report_values(report_sections(spark, path), "Power-law fits"), "distribution")
    one = lambda c, x: F.max(F.when(F.col("column") == c, x))
    part = lambda i: F.regexp_extract("text", r"^([0-9.]+)\s*\u00b1\s*([0-9.]+)", i).try_cast("double")
    return v.groupBy(F.col("key").alias("distribution")).agg(one("xmin", F.col("number")).alias("xmin"), one("alpha", part(1)).alias("alpha"), one("alpha", part(2)).alias("error"))


def compared(expected: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """(name, values, missing, worst, ok): (name, key, value) of a published chart against what is computed now."""
    both = expected.select("name", "key", F.col("value").alias("want")).join(actual.select("name", "key", F.col("value").alias("got")), ["name", "key"], "left").filter("want IS NOT NULL")
    n = both.groupBy("name").agg(F.count("*").alias("values"), F.count_if(F.col("got").isNull()).alias("missing"), F.coalesce(F.max(F.abs(F.col("want") - F.col("got"))), F.lit(0.0)).alias("worst"))
    return n.withColumn("ok", (F.col("missing") == 0) & (F.col("worst") <= tolerance))


def number(cell) -> Column:
    """A cell as a number, without thousands separators and percent signs; null if it isn't one."""
    return F.expr(f"try_cast(regexp_replace({cell}, '[,%]', '') AS DOUBLE)") if isinstance(cell, str) else F.regexp_replace(cell, "[,%]", "").try_cast("double")
