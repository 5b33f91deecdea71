"""File readers.  Each returns a lazy DataFrame over every file of a path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

HEADER_TYPES = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def read_csv_inferred(
    spark: SparkSession, path: str, alias: str | None = None, sampling_ratio: float = 1.0
) -> DataFrame:
    """CSV with header.  Inferring reads the files once more; on large inputs
    pass a sampling ratio or use `read_csv_schema`."""
    df = spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sampling_ratio)
    return df.alias(alias) if alias else df


def read_csv_schema(
    spark: SparkSession, path: str, schema: T.StructType | str, header: bool = False
) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def typed_header_schema(line: str) -> T.StructType:
    """Schema of a header such as ``key:string, size:integer``."""
    fields = []
    for cell in line.split(","):
        name, _, kind = cell.strip().partition(":")
        if kind not in HEADER_TYPES:
            raise ValueError(f"unknown column type in header cell {cell!r}")
        fields.append(T.StructField(name, HEADER_TYPES[kind]))
    return T.StructType(fields)


def read_csv_typed_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first line declares `name:type`; cells are trimmed, empty cells
    are null, and a row with another number of cells fails the job."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    return (
        spark.read.schema(typed_header_schema(first["value"]))
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)  # check every cell, not just the used ones
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "")
        .csv(path)
    )


def split_fields(line: Column, sep: str, names: Sequence[str]) -> list[Column]:
    """Trimmed fields of a delimited line; trailing empty fields are kept."""
    literal_sep = "\\Q" + sep + "\\E"
    fields = F.split(line, literal_sep, -1)
    return [F.trim(F.get(fields, F.lit(i))).alias(name) for i, name in enumerate(names)]


def read_text_split(
    spark: SparkSession, path: str, names: Sequence[str], sep: str = ","
) -> DataFrame:
    """Delimited text lines as string columns."""
    return spark.read.text(path).select(*split_fields(F.col("value"), sep, names))


def read_text_skip_header(
    spark: SparkSession, path: str, header_word: str, names: Sequence[str], sep: str = ","
) -> DataFrame:
    """Like `read_text_split`, leaving out every line that holds `header_word`."""
    lines = spark.read.text(path).filter(~F.col("value").contains(header_word))
    return lines.select(*split_fields(F.col("value"), sep, names))


def read_labelled_tsv(
    spark: SparkSession, path: str, label: str = "label", text: str = "text"
) -> DataFrame:
    """Tab-separated label and text; rows without a label are dropped."""
    lines = spark.read.text(path)
    fields = F.split("value", "\t", -1)
    parsed = lines.select(F.get(fields, F.lit(0)).alias(label), F.get(fields, F.lit(1)).alias(text))
    return parsed.filter(F.col(label) != "")


def read_csv_drop_bad(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ","
) -> DataFrame:
    """Delimited rows that parse into `schema`; a row with a missing or
    unreadable cell is dropped."""
    names = schema.fieldNames()
    raw = spark.read.text(path).filter(F.size(F.split("value", "\\Q" + sep + "\\E", -1)) == len(names))
    cells = raw.select(*split_fields(F.col("value"), sep, names))
    typed = cells.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed.na.drop(how="any")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user::item::rating::time`` lines with exactly four fields."""
    fields = F.split("value", "::", -1)
    return (
        spark.read.text(path)
        .filter(F.size(fields) == 4)
        .select(
            fields[0].cast("int").alias("user"),
            fields[1].cast("int").alias("item"),
            fields[2].cast("float").alias("rating"),
            fields[3].cast("long").alias("timestamp"),
        )
    )


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """``label index:value ...`` lines as label and sparse vector.  Giving the
    number of features saves a pass over the data."""
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def numbers(text: Column, sep: str) -> Column:
    """The numbers of a text list as array<double>."""
    return F.transform(F.split(F.trim(text), sep), lambda x: F.trim(x).cast("double"))


def read_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """``y,x1 x2 ...`` lines as label and vector."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(
        parts[0].cast("double").alias("label"),
        array_to_vector(numbers(parts[1], "\\s+")).alias("features"),
    )


# Text forms of vectors: "x1 x2", "[x1,x2]" and "(y,[x1,x2])".
LABELLED_VECTOR = r"^\(\s*([^,\[]+?)\s*,\s*\[(.*)\]\s*\)$"
PLAIN_VECTOR = r"^\[(.*)\]$"


def parse_vector_text(line: Column) -> tuple[Column, Column]:
    """(label or null, array of doubles) of a line in any of the vector forms."""
    line = F.trim(line)
    labelled = line.rlike(LABELLED_VECTOR)
    plain = line.rlike(PLAIN_VECTOR)
    label = F.when(labelled, F.regexp_extract(line, LABELLED_VECTOR, 1).cast("double"))
    values = (
        F.when(labelled, numbers(F.regexp_extract(line, LABELLED_VECTOR, 2), ","))
        .when(plain, numbers(F.regexp_extract(line, PLAIN_VECTOR, 1), ","))
        .otherwise(numbers(line, "\\s+"))
    )
    return label, values


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    label, values = parse_vector_text(F.col("value"))
    return spark.read.text(path).select(label.alias("label"), values.alias("values"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
