"""Contract documents in JSON, JSON lines or YAML, and trees of files, read by Spark's own sources.

A document is kept as text beside its typed form, so that what the schema doesn't know is seen: ``check_documents`` tells texts that are no
object, fields that a contract doesn't have at any depth, and values that don't fit their type. Files come from any store that Spark reads.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.sources.contracts import SCHEMAS

#: Modes of plain files, executables and symbolic links in a tree listing.
FILE_MODES, LINK_MODE = ("100644", "100755"), "120000"


@F.pandas_udf(T.StringType())
def yaml_as_json(texts: pd.Series) -> pd.Series:
    """YAML texts as JSON, dates as text; null if a text is not one valid document."""
    import yaml

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(yaml.safe_load(text), default=str, allow_nan=False)
        except (yaml.YAMLError, ValueError, TypeError):
            return None

    return texts.map(one)


def read_documents(spark: SparkSession, name: str, path: str) -> DataFrame:
    """key, text (JSON) and document (typed) of a contract's documents: files in .json, .yaml or .yml hold one each, .jsonl one a line.

    The key is the file's name, or the SHA-256 of a line. Other extensions are refused.
    """
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "jsonl":
        rows = spark.read.text(path).filter("trim(value) <> ''").select(F.sha2("value", 256).alias("key"), F.col("value").alias("text"))
    elif suffix in ("json", "yaml", "yml"):
        text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
        rows = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("key"), (text if suffix == "json" else yaml_as_json(text)).alias("text"))
    else:
        raise ValueError(f"{path}: a contract is read from .json, .jsonl, .yaml or .yml")
    return rows.withColumn("document", F.from_json("text", SCHEMAS[name]))


def unknown_fields(text: Column, schema: T.StructType, at: str = "$") -> Column:
    """Paths of the fields of a JSON object that ``schema`` doesn't have, in nested objects and arrays of objects too."""
    none = F.array().cast("array<string>")
    keys = F.map_keys(F.from_json(text, "map<string,string>"))
    found = [F.transform(F.array_except(keys, F.array(*(F.lit(f.name) for f in schema.fields))), lambda k: F.concat(F.lit(f"{at}."), k))]
    for field in schema.fields:
        inner = F.get_json_object(text, f"$.{field.name}")
        if isinstance(field.dataType, T.StructType):
            found.append(unknown_fields(inner, field.dataType, f"{at}.{field.name}"))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            found.append(_unknown_in_array(inner, field.dataType.elementType, f"{at}.{field.name}[]"))
    return F.concat(*(F.coalesce(x, none) for x in found))


def _unknown_in_array(text: Column, schema: T.StructType, at: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.from_json(text, "array<string>"), lambda x: unknown_fields(x, schema, at))))


def check_documents(documents: DataFrame, name: str) -> DataFrame:
    """Violations (rule, key, detail): not_object, unknown_field (its path), bad_value (a field that is there, but not of its type)."""
    schema = documents.schema["document"].dataType
    is_object = F.coalesce(F.from_json("text", "map<string,string>").isNotNull() & F.col("text").rlike(r"^\s*\{"), F.lit(False))
    rows = documents.withColumn("object", is_object)
    out = rows.filter("not object").select(F.lit("not_object").alias("rule"), "key", F.lit("").alias("detail"))
    some = rows.filter("object")
    out = out.union(some.select(F.lit("unknown_field"), "key", F.explode(unknown_fields(F.col("text"), schema))))
    stated = lambda f: F.get_json_object("text", f"$.{f.name}").isNotNull() & F.col(f"document.{f.name}").isNull()
    bad = F.array_compact(F.array(*(F.when(stated(f), F.lit(f.name)) for f in schema.fields)))
    return out.union(some.select(F.lit("bad_value"), "key", F.explode(bad)))


def price_rows(documents: DataFrame) -> DataFrame:
    """Rows of the contract ``price`` from price tables: an entry each, with its table's version, date and currency."""
    return documents.select("document.*").select("version", "effective_date", "currency", F.inline("entries"))


def read_tree(spark: SparkSession, root: str, modes: DataFrame | None = None) -> DataFrame:
    """path (under ``root``), content (binary), size and mode of all files of a tree; modes (path, mode) is its listing, else all are plain files."""
    inside = F.regexp_replace("path", f"^.*{_escaped(root)}/*", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(inside.alias("path"), "content", F.col("length").alias("size"))
    if modes is None:
        return files.withColumn("mode", F.lit(FILE_MODES[0]))
    return files.join(modes.select("path", "mode"), "path", "left").withColumn("mode", F.coalesce("mode", F.lit(FILE_MODES[0])))


def _escaped(root: str) -> str:
    plain = root.rstrip("/").split("://")[-1].removeprefix("file:")
    return "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in plain)


def check_tree(files: DataFrame, binary_policy: str = "omit", symlink_policy: str = "reject") -> DataFrame:
    """Violations (rule, key): symlink (unless followed), unsupported (any other mode), and under the policy reject: binary (a NUL byte), not_utf8."""
    nul = F.expr("position(x'00' in content) > 0")
    rules = [F.when(~F.col("mode").isin(*FILE_MODES, LINK_MODE), F.lit("unsupported"))]
    if symlink_policy == "reject":
        rules.append(F.when(F.col("mode") == LINK_MODE, F.lit("symlink")))
    if binary_policy == "reject":
        rules += [F.when(nul, F.lit("binary")), F.when(~nul & ~F.expr("is_valid_utf8(content)"), F.lit("not_utf8"))]
    return files.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("path").alias("key"))
