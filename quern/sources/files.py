"""Import and export: tagged JSON lines, CSV, and backup folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.model import ValidationError

#: An accepted number: at most 38 digits, exponent free; out of range is another matter.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def tagged(c: Column, t: T.DataType) -> Column:
    """A value as tagged JSON: {"S": ..}, {"N": ".."}, and so on; null where missing."""
    if isinstance(t, T.StringType):
        return F.to_json(F.struct(c.alias("S")))
    if isinstance(t, T.NumericType):
        return F.to_json(F.struct(F.regexp_replace(c.cast("string"), r"\.0$", "").alias("N")))
    if isinstance(t, T.BinaryType):
        return F.to_json(F.struct(F.base64(c).alias("B")))
    if isinstance(t, T.BooleanType):
        return F.to_json(F.struct(c.alias("BOOL")))
    if isinstance(t, T.ArrayType):
        return F.concat(F.lit('{"L":['), F.array_join(F.transform(c, lambda x: tagged(x, t.elementType)), ","), F.lit("]}"))
    if isinstance(t, T.StructType):
        return F.concat(F.lit('{"M":'), _members([(f.name, c.getField(f.name), f.dataType) for f in t.fields]), F.lit("}"))
    return F.to_json(F.struct(c.cast("string").alias("S")))


def _members(fields: list[tuple]) -> Column:
    """A JSON object of the members that are present, names in order."""
    parts = [F.when(c.isNotNull(), F.concat(F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.lit(len(json_name(name)))), F.lit(":"), tagged(c, t))) for name, c, t in sorted(fields, key=lambda f: f[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_name(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)


def item_lines(df: DataFrame) -> DataFrame:
    item = _members([(f.name, F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return df.select(F.concat(F.lit('{"Item":'), item, F.lit("}")).alias("value"))


def export(df: DataFrame, path: str, gzip: bool = False) -> None:
    """One file a task; an existing folder is refused."""
    w = item_lines(df).write.mode("errorifexists")
    (w.option("compression", "gzip") if gzip else w).text(path)


def backup(df: DataFrame, keys: tuple[str, ...], path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Gzip JSON lines in key order, and a manifest of rows by file beside them, which is returned."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    item_lines(ordered).write.mode("errorifexists").option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(f"{path}/data")
    spark = df.sparkSession
    manifest = spark.read.text(f"{path}/data").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("items"), F.sum(F.crc32(F.encode("value", "UTF-8"))).alias("checksum"))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def _path(v: str, name: str, tag: str) -> Column:
    return F.try_variant_get(F.col(v), f"$['{name}'].{tag}", "string")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tagged JSON lines, wrapped in Item or bare, as a typed table; blank lines are skipped. A number that can't be read stops the job, one out of the column's range drops its row (see rejected)."""
    return _typed(_parsed(spark, path), schema).filter(F.col("_bad") == "").drop("_bad")


def rejected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows by fault: '' (good), 'range'."""
    return _typed(_parsed(spark, path), schema).groupBy(F.col("_bad").alias("fault")).agg(F.count("*").alias("rows"))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    v = F.parse_json("value")
    return lines.select(v.alias("v")).select(F.coalesce(F.try_variant_get("v", "$.Item", "variant"), F.col("v")).alias("v"))


def _typed(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    cols, bad = [], F.lit("")
    for f in schema.fields:
        if isinstance(f.dataType, T.NumericType):
            raw = _path("v", f.name, "N")
            checked = F.when(raw.isNotNull() & ~raw.rlike(NUMBER), F.raise_error(F.concat(F.lit("malformed number "), raw)).cast("string")).otherwise(raw)
            c = checked.try_cast(f.dataType)
            bad = F.when(raw.isNotNull() & c.isNull(), "range").otherwise(bad)
        elif isinstance(f.dataType, T.BooleanType):
            c = _path("v", f.name, "BOOL").cast("boolean")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.unbase64(_path("v", f.name, "B"))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.coalesce(F.try_variant_get("v", f"$['{f.name}'].SS", "array<string>"), F.transform(F.try_variant_get("v", f"$['{f.name}'].L", "array<variant>"), lambda x: F.try_variant_get(x, "$.S", "string")))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.transform(F.try_variant_get("v", f"$['{f.name}'].L", "array<variant>"), _number_of(f.dataType.elementType))
        else:
            c = _path("v", f.name, "S").cast(f.dataType)
        cols.append(c.alias(f.name))
    return parsed.select(*cols, bad.alias("_bad"))


def _number_of(t: T.DataType):
    return lambda x: F.try_variant_get(x, "$.N", "string").try_cast(t)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: list[str] | None = None) -> DataFrame:
    """Every value is a string, trimmed; an empty cell is a missing attribute. header: names where the file has none."""
    if len(delimiter) != 1:
        raise ValidationError("the delimiter is one character")
    r = spark.read.option("sep", delimiter).option("inferSchema", "false").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").option("escape", '"')
    df = r.schema(", ".join(f"`{h}` string" for h in header)).csv(path) if header else r.option("header", "true").csv(path)
    return df.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_items(spark: SparkSession, path: str, format: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """format: DYNAMODB_JSON, ION (read by the same reader of JSON lines), CSV."""
    if format in ("DYNAMODB_JSON", "ION"):
        return read_json(spark, path, schema)
    if format == "CSV":
        return read_csv(spark, path, **options)
    raise ValidationError(f"no format {format}")
