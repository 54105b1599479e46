"""Source files as DataFrames: CSV with explicit text columns, text lines, JSON rows.

Columns come in as text and are cast by the loading operators, so a bad cell becomes NULL and
not a failed read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import numbered
from ..schema import ITEMS

# Column headings of the published files.
REGISTER = {"Facility Name": "facility_name", "State Name": "state_name", "District Name": "district_name",
            "Subdistrict Name": "subdistrict_name", "Facility Type": "facility_type",
            "Location Type": "location_type", "Latitude": "latitude", "Longitude": "longitude"}
POPULATION = {"State/ UT": "state",
              "Average Rural Population [Census 2011] covered by a Sub Centre": "sub_cen",
              "Average Rural Population [Census 2011] covered by a PHC": "phc",
              "Average Rural Population [Census 2011] covered by a CHC": "chc"}
STAFFING = {"State/ UT": "state", "Required - [R]": "required", "Sanctioned - [S]": "sanctioned",
            "In Position - [P]": "in_position"}
ESTABLISHMENTS = {"CO_CNES": "code", "TP_UNIDADE": "type", "CO_MOTIVO_DESAB": "closed_reason",
                  "NO_FANTASIA": "name", "CO_IBGE": "ibge", "NU_LATITUDE": "own_lat", "NU_LONGITUDE": "own_long"}
COORDINATES = {"co_cnes": "code", "municipio": "municipality", "uf": "uf", "lat": "lat", "long": "long"}


def csv(spark: SparkSession, path, columns: dict[str, str], **options) -> DataFrame:
    """The wanted columns of a CSV with a heading line, as text."""
    df = spark.read.csv(path, header=True, inferSchema=False, **options)
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in columns.items()], *(
        [F.col("_metadata.file_name").alias("source_file")]))


def facility_register(spark: SparkSession, path: str) -> DataFrame:
    return numbered(csv(spark, path, REGISTER).drop("source_file"))


def population(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, POPULATION).drop("source_file")


def staffing(spark: SparkSession, paths) -> DataFrame:
    """All staffing files of one edition; the file name says which cadre a row belongs to."""
    return csv(spark, paths, STAFFING)


def establishments(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path, ESTABLISHMENTS, sep=";", encoding="ISO-8859-1").drop("source_file")
    return df.withColumn("type", F.col("type").try_cast("int"))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    return numbered(csv(spark, path, COORDINATES).drop("source_file"), "ord")


def municipalities(spark: SparkSession, path: str, year: int = 2022) -> DataFrame:
    rows = csv(spark, path, {"id_municipality": "municipality_id", "year": "year", "population": "population"})
    return rows.filter(F.col("year").try_cast("int") == year).select(
        "municipality_id", F.col("population").try_cast("bigint").alias("population"))


def document_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of text documents in file order, for the price-list operator."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("line"))
    return numbered(rows, "line_no")


def ceiling_prices(spark: SparkSession, path: str) -> DataFrame:
    """Chosen prices; the order of the file decides between two that match."""
    rows = csv(spark, path, {"item_match": "item_match", "unit": "unit", "ceiling_price_inr": "price"}).drop("source_file")
    return numbered(rows, "ord").withColumn("price", F.col("price").try_cast("double"))


def items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).json(path)


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """Export for other systems: JSON rows, or CSV with a heading."""
    if form not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown form {form!r}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
