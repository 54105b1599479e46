"""The given tables in the shape raw source files have: text columns, stray spaces, codes
with quotes, wide months, wrapped lines. Input for the loading operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import CALENDAR
from .testbed import CADRES, DRIVERS, PHC_ONLY_CADRES, _mod, _pick, read

FORMS = {"ECONOMY": "Tablet 500 mg", "STANDARD": "Oral liquid 5 ml", "SMALL": "Capsule 250 mg",
         "PROMO": "Injection 1 ml", "MEDIUM": "Cream 1%", "LARGE": ""}
CODES = [("red widget", "X01AA01"), ("small", "X02AB03"), ("blue", "X03AC05"), ("green gear", "X04AD07")]


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("row_no"), F.when(_mod(k, 13) != 0, F.col("s_name")).alias("facility_name"),
        F.concat(F.lit(" "), "r_name", F.lit(" ")).alias("state_name"),
        F.when(_mod(k, 17) != 0, F.concat("n_name", F.lit(" "))).alias("district_name"),
        F.lit(None).cast("string").alias("subdistrict_name"),
        F.when(_mod(k, 19) != 0, _pick([" PHC ", "CHC", "Sub_Cen", "dis_h", "S_T_H "], _mod(k, 5))).alias("facility_type"),
        F.when(_mod(k, 23) == 0, "Public").otherwise(_pick([" Rural", "URBAN "], _mod(k, 2))).alias("location_type"),
        F.when(_mod(k, 31) == 0, "abc").otherwise((_mod(k * 37, 2000).cast("double") / F.lit(100.0)).cast("string")).alias("latitude"),
        (F.lit(70.0) + _mod(k * 53, 2000).cast("double") / F.lit(100.0)).cast("string").alias("longitude")))


def population_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    per = (c.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("n").alias("n")))
    rows = per.select(F.concat("r_name", F.lit(" ")).alias("state"), F.col("n").cast("string").alias("sub_cen"),
                      (F.col("n") * 5).cast("string").alias("phc"),
                      F.when(F.col("r_name") == "ASIA", "NA").otherwise((F.col("n") * 20).cast("string")).alias("chc"))
    total = per.agg(F.sum("n").cast("string").alias("t")).select(
        F.lit("All India").alias("state"), F.col("t").alias("sub_cen"), F.col("t").alias("phc"), F.col("t").alias("chc"))
    return rows.unionByName(total)


def demand_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    per = (o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
           .groupBy("c_nationkey", "o_orderpriority", "o_orderstatus", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("r_name").alias("state"), F.col("n_name").alias("district"),
                   F.concat(F.lit("'"), F.substring("o_orderpriority", 1, 1), F.lit("."), "o_orderstatus", F.lit("'")).alias("code"),
                   _pick(CALENDAR, F.col("m") - 1).alias("month"), "n"))
    total = per.groupBy("state", F.lit("Total").alias("district"), "code", "month").agg(F.sum("n").alias("n"))
    both = per.unionByName(total)
    return both.groupBy("state", "district", "code").pivot("month", CALENDAR).agg(F.sum("n").cast("string"))


def code_drivers(spark: SparkSession) -> DataFrame:
    rows = [(f"{d[0]}.{s}", d) for d in DRIVERS for s in "FO"] + [("9.X", "Never reported")]
    return spark.createDataFrame(rows, "code string, indicator string")


def messy_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(_mod(k, 3) == 0, F.concat(
        F.lit("  nation   "), n, F.lit(" "))).when(_mod(k, 3) == 1, "Ahmadnagar").otherwise(
        F.concat(F.lit("Nation "), n)).alias("district"))


def parsed_medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    spelled = (F.when(_mod(k, 50) == 7, F.concat(name, F.lit(" + extra"))).when(_mod(k, 3) == 0, F.upper(name))
               .when(_mod(k, 3) == 1, F.concat(name, F.lit(" (as mentioned)"))).otherwise(F.concat(name, F.lit("*"))))
    form = F.coalesce(*[F.when(F.col("p_type") == t, f) for t, f in FORMS.items()])
    return read(spark, sf_dir, "part").select(
        k.alias("ord"), spelled.alias("medicine"), form.alias("dosage_forms"),
        _pick(["P,S,T", "S,T", "S,T", "T"], _mod(k, 4)).alias("level_of_care"),
        F.when(_mod(k, 9) == 0, "x").otherwise(F.col("p_size").cast("string")).alias("section_no"))


def medicine_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "key string, atc_code string")


def curated_items(items: DataFrame) -> DataFrame:
    n = F.substring_index("item_id", "#", -1).cast("bigint")
    return items.select(F.when(_mod(n, 5) == 0, F.concat(F.lit("X "), "display_name")).otherwise(F.col("display_name")).alias("display_name"),
                        F.when(n == 3, "No such driver").otherwise(F.col("demand_driver")).alias("demand_driver"))


def staffing_rows(staffing: DataFrame) -> DataFrame:
    stem = F.concat(F.lower(F.regexp_replace("cadre", "[^A-Za-z]+", "-")), F.lit(".csv"))
    cols = ("required", "sanctioned", "in_position")
    rows = staffing.select(F.concat("state", F.lit(" ")).alias("state"), stem.alias("source_file"),
                           *[F.when((F.col("sanctioned") == 0) & F.lit(c != "required"), "NA").otherwise(F.col(c).cast("string")).alias(c) for c in cols])
    total = staffing.groupBy(stem.alias("source_file")).agg(*[F.sum(c).cast("string").alias(c) for c in cols])
    return rows.unionByName(total.withColumn("state", F.lit("All India/ Total")))


def staffing_files(spark: SparkSession) -> DataFrame:
    import re
    rows = [(re.sub("[^A-Za-z]+", "-", c).lower() + ".csv", c, ["phc"] if c in PHC_ONLY_CADRES else ["phc", "chc"])
            for c in CADRES.values()]
    return spark.createDataFrame(rows, "source_file string, cadre string, applies_to_facility_types array<string>")


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.initcap("p_name")
    price = F.concat(F.format_number("p_retailprice", 2), F.lit(" 1499(E) 30.03.2022"))
    sec = lambda head, *x: F.concat(F.lit(head), k.cast("string"), F.lit(" "), *x)
    lines = (F.when(_mod(k, 4) == 0, F.array(sec("4.2.", name, F.lit(" Tablet 500 mg 1 Tablet "), price)))
             .when(_mod(k, 4) == 1, F.array(F.concat(F.lit("Capsule 250 mg  1 Capsule "), price)))
             .when(_mod(k, 4) == 2, F.array(F.lit("Injection 5 mg/ml"), F.concat(F.lit("1 ml "), price)))
             .otherwise(F.array(sec("5.1.", F.lit("Ferrous "), name), F.lit("acid (B)"), F.lit("Tablet 100 mg"),
                                F.concat(F.lit("1 Tablet "), price))))
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), k, F.posexplode(lines).alias("j", "line")).select(
        "doc_id", (F.col("p_partkey") * 10 + F.col("j")).alias("line_no"), "line")


def priced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read(spark, sf_dir, "part").select("p_name").distinct()
            .withColumn("unit", F.explode(F.array(F.lit("tablet"), F.lit("vial"), F.lit("bottle"))))
            .select(F.concat("p_name", F.lit(" (any)")).alias("display_name"), "unit"))


def establishments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    two = lambda m: F.lpad(_mod(k * m, 100).cast("string"), 2, "0")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("00"), k.cast("string")).alias("code"), _mod(k, 4).cast("int").alias("type"),
        F.when(_mod(k, 11) == 0, "closed").alias("closed_reason"),
        F.when(_mod(k, 13) != 0, F.col("c_name")).alias("name"),
        (F.lit(310000) + F.col("c_nationkey")).cast("string").alias("ibge"),
        F.when(_mod(k, 5) != 0, F.concat(F.lit("-19,"), two(3))).alias("own_lat"),
        F.when(_mod(k, 5) != 0, F.concat(F.lit("-44,"), two(7))).alias("own_long"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("0"), (k * 3).cast("string")).alias("code"), (k * 2 + F.col("j")).alias("ord"),
        F.col("n_name").alias("municipality"), F.col("r_name").alias("uf"),
        F.when(_mod(k, 7) != 0, F.concat(F.lit("-20,"), F.lpad(_mod(k + F.col("j"), 100).cast("string"), 2, "0"))).alias("lat"),
        F.concat(F.lit("-45."), F.lpad(_mod(k, 100).cast("string"), 2, "0")).alias("long"))


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    return read(spark, sf_dir, "nation").select(
        ((F.lit(310000) + n) * 10 + 3).alias("municipality_id"), (F.lit(1000) * (n + 1)).alias("population"))


def location_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").filter(_mod(k, 3) != 0).select(
        F.concat(F.lit("F"), k.cast("string")).alias("facility_id"),
        _pick([" Rural ", "URBAN", "Public"], _mod(_mod(k, 7), 3)).alias("location_type"))
