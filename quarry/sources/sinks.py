"""Exports: flat rows, JSON documents, one file per row, and results of remote calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import slug
from quarry.operators.merge import placed

VIN = r"^[A-HJ-NPR-Z0-9]{17}$"
VIN_OR_SHORTER = r"^[A-HJ-NPR-Z0-9]{11,17}$"


def flat_rows(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, keep_alone: bool = False) -> DataFrame:
    """A row per vehicle and cluster; with keep_alone also vehicles in no cluster."""
    edges = membership.join(clusters.select("cluster_id", "type", "label"), "cluster_id")
    rows = vehicles.drop("note", "cluster_id").join(edges, vehicles["id"] == edges["vehicle_id"], "left" if keep_alone else "inner").drop("vehicle_id")
    return rows.withColumns({"note": F.coalesce("note", F.lit("")), "label": F.coalesce("label", F.lit(""))})


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, escape='"', mode="overwrite")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite")


def json_document(sections: list[tuple[str, DataFrame | None, list[Column | str]]], close: str, path: str) -> None:
    """One JSON document as text files whose names' order is its order; nothing passes the driver.

    sections: text before a list, its items (a column value of JSON) and their order. Behind each item but a
    list's last comes a comma.
    """
    spark = SparkSession.active()
    lines = spark.createDataFrame([(2 * i, -1, text) for i, (text, _, _) in enumerate(sections)] + [(2 * len(sections), 0, close)], "section int, place long, value string")
    for i, (_, items, order) in enumerate(sections):
        if items is not None:
            own = placed(items, order)
            n = own.count()
            lines = lines.unionByName(own.select(F.lit(2 * i + 1).alias("section"), F.col("_place").alias("place"), F.concat("value", F.when(F.col("_place") < n - 1, ",").otherwise("")).alias("value")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "section", "place").sortWithinPartitions("section", "place").select("value").write.text(path)


def _array(columns: list[str]) -> Column:
    """A row's values as a JSON array."""
    text = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{(?:"x":(.*))?\}$', "$1"), F.lit(""))
    return F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.nullif(text(c), F.lit("")), F.lit("null")) for c in columns)), F.lit("]"))


def export_document(rows: DataFrame, columns: list[str], order: list[Column | str], path: str, generated_at: str) -> None:
    """{generated_at, row_count, rows}: rows as arrays of the columns, in order."""
    head = f'{{"generated_at":{json.dumps(generated_at)},"row_count":{rows.count()},"rows":['
    items = rows.withColumn("value", _array(columns))
    json_document([(head, items, order)], "]}", path)


def compact(vehicles: DataFrame, clusters: DataFrame, membership: DataFrame, path: str) -> None:
    """{v, m, c}: vehicles and membership as arrays of rows, and a map from clusters to type and label."""
    name = F.regexp_replace(F.to_json(F.array(F.col("cluster_id").cast("string"))), r"(?s)^\[(.*)\]$", "$1")
    groups = clusters.withColumn("value", F.concat(name, F.lit(":"), _array(["type", "label"])))
    rows = lambda df: df.withColumn("value", _array(df.columns))
    json_document([('{"v":[', rows(vehicles), vehicles.columns), ('],"m":[', rows(membership), membership.columns), ('],"c":{', groups, ["cluster_id"])], "}}", path)


def bundle(template: str, parts: dict[str, object], required: str = "__DATA__") -> str:
    """A page with its placeholders replaced by JSON that is safe inside a script."""
    if required not in template:
        raise ValueError(f"the template lacks {required}")
    for name, value in parts.items():
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/")
        template = template.replace(name, text)
    return template


def write_text_files(files: DataFrame, root: str) -> DataFrame:
    """Write content to root/path for every row of files (path, content), each in its task; returns path and bytes. A repeated task writes the same again."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = (pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if root.startswith(("file:", "/")) else pafs.FileSystem.from_uri(root)
        for part in parts:
            sizes = []
            for path, content in zip(*part.columns):  # one at a time, out of the batch's own memory
                fs.create_dir(f"{folder}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{folder}/{path}", compression=None) as out:
                    sizes.append(out.write(content.as_buffer()))
            done = pa.RecordBatch.from_arrays([pa.array(part.column(0).to_pylist(), pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])
            part = path = content = None  # the next batch comes in when this one is gone
            yield done

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def write_job_files(rows: DataFrame, root: str) -> None:
    """A Markdown file for each finished job under its cluster's folder, and their index as one JSON document. rows: cluster_id, scope, job, model, content, created_at."""
    own = rows.withColumn("path", F.concat(slug("cluster_id"), F.lit("/"), slug("job"), F.lit(".md")))
    files = own.select("path", F.concat(F.lit("# "), "cluster_id", F.lit(": "), "job", F.lit("\n\n"), "content", F.lit("\n")).alias("content"))
    write_text_files(files, root).count()
    index = own.select("scope", "cluster_id", "job", F.to_json(F.struct("cluster_id", "scope", "job", "model", "created_at", "path")).alias("value"))
    json_document([("[", index, ["scope", "cluster_id", "job"])], "]", f"{root}/index")


def vin_fields(payloads: DataFrame) -> DataFrame:
    """vin, make, model, year, trim, engine out of decoder answers (vin, payload)."""
    schema = "Results array<map<string,string>>"
    first = F.try_element_at(F.from_json("payload", schema)["Results"], F.lit(1))
    field = lambda k: F.nullif(F.try_element_at(first, F.lit(k)), F.lit(""))
    rows = payloads.filter(F.upper("vin").rlike(VIN)).withColumn("_first", first)
    litres = F.when(field("DisplacementL").isNotNull(), F.concat(F.format_string("%.1f", field("DisplacementL").cast("double")), F.lit("L")))
    cylinders = F.when(field("EngineCylinders").isNotNull(), F.concat(field("EngineCylinders"), F.lit("cyl")))
    return rows.select(F.upper("vin").alias("vin"), F.initcap(field("Make")).alias("make"), field("Model").alias("model"), field("ModelYear").cast("int").alias("year"), F.concat_ws(" · ", field("Trim"), field("DriveType")).alias("trim"), F.concat_ws(" ", field("EngineModel"), cylinders, litres).alias("engine"))


def vin_values(payloads: DataFrame) -> DataFrame:
    """vin, year, make, model, trim, series, engine as the decoder words them, empty where it says nothing; numbers of 11 to 17 signs."""
    first = F.try_element_at(F.from_json("payload", "Results array<map<string,string>>")["Results"], F.lit(1))
    field = lambda k: F.coalesce(F.try_element_at(first, F.lit(k)), F.lit(""))
    vin = F.upper(F.btrim("vin"))
    engine = F.array_join(F.filter(F.array(*map(field, ("EngineModel", "EngineCylinders", "DisplacementL"))), lambda x: x != ""), " ")
    rows = payloads.filter(vin.rlike(VIN_OR_SHORTER) & first.isNotNull())
    return rows.select(vin.alias("vin"), field("ModelYear").alias("year"), field("Make").alias("make"), field("Model").alias("model"), field("Trim").alias("trim"), field("Series").alias("series"), engine.alias("engine"))


def fetched(requests: DataFrame, fetch: Callable[[str], str], column: str = "vin") -> DataFrame:
    """Requests with the answers of an injected client; the library itself opens no connection."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({column: part[column], "payload": [fetch(x) for x in part[column]]})

    return requests.select(column).mapInPandas(run, f"{column} string, payload string")


def request_lines(targets: DataFrame, prompt: Column, model: str, max_tokens: int) -> DataFrame:
    """JSON lines for a batch interface: custom_id and the parameters of one request each."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return targets.select(F.to_json(F.struct("custom_id", F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), message.alias("messages")).alias("params"))).alias("value"))
