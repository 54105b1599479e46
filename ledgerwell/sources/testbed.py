"""Domain tables derived from the given test tables.

Every table is a DataFrame over the parquet files; ``ledgerwell.oracle.base`` holds the
same mappings as SQL. Facility positions are clustered by district so that neighbours
exist, and a few are missing or impossible so that the validity flag has work to do.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import CALENDAR
from ..plans.widen import widen

# Fixed values of the mapping.
CADRES = {"AUTOMOBILE": "Doctor (allopathic)", "BUILDING": "Nursing staff",
          "FURNITURE": "Pharmacist", "HOUSEHOLD": "Health assistants",
          "MACHINERY": "Laboratory technician"}
PHC_ONLY_CADRES = ("Doctor (allopathic)", "Health assistants")
DRIVERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SIGNAL_CLASSES = [("1-URGENT", "leading"), ("2-HIGH", "leading"), ("3-MEDIUM", "coincident"),
                  ("4-NOT SPECIFIED", "programme"), ("5-LOW", "coincident")]
FIRST = ["Amoxa", "Betro", "Cefal", "Doxin", "Ergot"]
SECOND = ["Forte", "Plus", "Oral", "Retard", "Junior"]
UNITS = ["tablet", "vial", "sachet", "bottle"]
VEN = ["Vital", "Essential", "Desirable"]
CAPTURE_BY_DIGIT = ["voice", "chat", "tap"]


TEXTS = ("events", "documents", "conversations")      # parsed row by row


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(df) if name in TEXTS else df


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _mod(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def item_name(n: Column) -> Column:
    return F.concat(_pick(FIRST, _mod(n, 5)), F.lit(" "), _pick(SECOND, _mod(F.floor(n / 5), 5)))


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k, nk = F.col("s_suppkey"), F.col("n_nationkey").cast("bigint")
    lat = (F.lit(800) + _mod(nk, 5) * 150 + _mod(k * 37, 200)).cast("double") / F.lit(100.0)
    lon = (F.lit(7000) + F.floor(nk / 5).cast("bigint") * 150 + _mod(k * 53, 200)).cast("double") / F.lit(100.0)
    ten = _mod(k, 10)
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
             .select(
        F.concat(F.lit("F"), k.cast("string")).alias("facility_id"),
        F.lit("IN").alias("country_code"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("admin_l1"),
        F.col("n_name").alias("admin_l2"),
        F.when(ten == 0, "dis_h").when(ten == 1, "s_t_h").when(ten.isin(2, 3), "chc")
         .when(ten == 4, "sub_cen").otherwise("phc").alias("facility_type"),
        F.when(_mod(k, 12) == 3, None).when(_mod(k, 4) == 0, "urban")
         .otherwise("rural").alias("location_type"),
        F.when(_mod(k, 41) == 7, None).when(_mod(k, 37) == 11, F.lit(92.41))
         .otherwise(lat).alias("latitude"),
        lon.alias("longitude"),
        F.when(_mod(k, 29) != 5, F.lit(5000) + _mod(k * 7919, 45000)).alias("population_served"),
        (_mod(k, 6) == 0).alias("is_demo_facility"),
        (_mod(k, 7) != 3).alias("is_forecast_facility")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("list_price"))
    n = F.substring_index("p_brand", "#", -1).cast("bigint")
    atc = F.concat(F.lit("A0"), _mod(n, 5).cast("string"), F.lit("AB"),
                   F.lpad(n.cast("string"), 2, "0"))
    return brands.select(
        F.col("p_brand").alias("item_id"),
        F.when(n != 13, atc).alias("atc_code"),
        item_name(n).alias("display_name"),
        _pick(UNITS, _mod(n, 4)).alias("unit"),
        _pick(VEN, _mod(n, 3)).alias("ven_class"),
        F.when(n != 24, _pick(DRIVERS, _mod(n + F.floor(n / 21), 5))).alias("demand_driver"),
        (F.lit(1.0) + _mod(n, 4) * F.lit(0.5)).alias("units_per_driver_event"),
        (_mod(n, 8) != 0).alias("is_forecast_item"),
        F.col("list_price"))


#: Goes up when rows or buckets of the stored ledger would come out otherwise.
LEDGER_VERSION = 2
STOCK_EVENT_COLUMNS = ["event_id", "resource_type", "facility_id", "item_id", "event_type", "quantity", "event_ts", "source", "confidence",
                       "raw_transcript", "expiry_date", "resource_subtype", "capacity", "event_date"]


def version(spark: SparkSession, sf_dir: str) -> str:
    """A name for the ledger of a folder that changes with the files it is made of."""
    hadoop, parts = spark._jvm.org.apache.hadoop.fs, [str(LEDGER_VERSION), sf_dir]
    for name in ("lineitem", "part"):
        path = hadoop.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        parts += [str(status.getLen()), str(status.getModificationTime())]
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


def stock_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medicine ledger: one row per line item, seven years folded into one."""
    li = read(spark, sf_dir, "lineitem")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    qty = F.col("l_quantity").cast("bigint")
    cents = lambda c: F.floor(F.col(c) * 100 + F.lit(0.5)).cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"),
                     _mod(F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")), 365).cast("int"))
    event_id = F.md5(F.concat_ws(
        "|", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"), line.cast("string"), qty.cast("string"),
        cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), flag,
        F.col("l_linestatus"), F.to_date("l_shipdate").cast("string")))
    digit = _mod(F.col("l_orderkey"), 10)
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("event_date", day)
    return rows.select(
        event_id.alias("event_id"),
        F.lit("medicine").alias("resource_type"),
        F.concat(F.lit("F"), F.col("l_suppkey").cast("string")).alias("facility_id"),
        F.col("p_brand").alias("item_id"),
        F.when(flag == "N", "received").when(flag == "R", "dispensed")
         .when(line.isin(2, 6), "dispatched").when(line == 4, "lost")
         .otherwise("expired").alias("event_type"),
        F.when(flag == "N", qty * 3).otherwise(qty).alias("quantity"),
        F.col("event_date").cast("timestamp_ntz").alias("event_ts"),
        F.when(digit < 7, "seed").otherwise(_pick(CAPTURE_BY_DIGIT, F.greatest(digit - 7, F.lit(0)))).alias("source"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("raw_transcript"),
        F.when((flag == "N") & (line != 7),
               F.date_add("event_date", (F.lit(60) + _mod(F.col("l_partkey") * 7, 600)).cast("int"))).alias("expiry_date"),
        F.lit(None).cast("string").alias("resource_subtype"),
        F.lit(None).cast("double").alias("capacity"),
        F.col("event_date"))


def _k(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed, staff and stock-count rows derived from the events table."""
    e = read(spark, sf_dir, "events").withColumn("k", _k())
    t = F.col("event_type")
    whole = F.floor("value").cast("bigint")
    return e.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(t.isin("view", "error", "purchase"), "bed").when(t == "signup", "personnel")
         .otherwise("medicine").alias("resource_type"),
        F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("facility_id"),
        F.when(t.isin("view", "error", "purchase"), "BED-INPATIENT")
         .when(t == "signup", "STAFF-NURSE")
         .otherwise(F.concat(F.lit("Brand#"), (_mod(F.col("k"), 25) + 1).cast("string"))).alias("item_id"),
        F.when(t == "view", "occupancy").when(t == "error", "turned_away")
         .otherwise("count").alias("event_type"),
        F.when(t == "error", F.when(F.col("k") < 5, F.col("k") + 1).otherwise(0))
         .when(t == "view", F.least(whole, F.lit(6)))
         .otherwise(whole).cast("bigint").alias("quantity"),
        F.col("ts").cast("timestamp_ntz").alias("event_ts"),
        _pick(CAPTURE_BY_DIGIT, _mod(F.col("k"), 3)).alias("source"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("raw_transcript"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(None).cast("string").alias("resource_subtype"),
        F.when(t.isin("view", "error"), (F.lit(4) + _mod(F.col("user_id"), 5)).cast("double")).alias("capacity"),
        F.to_date("ts").alias("event_date"))


def demand_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """District x month x indicator; each district's indicator has one busy month."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    per_month = (o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("c_nationkey", F.month("o_orderdate").alias("m"),
                           F.col("o_orderpriority").alias("indicator"))
                  .agg(F.count("*").alias("orders")))
    busy = _mod(F.col("c_nationkey").cast("bigint") * 5
                + F.substring("indicator", 1, 1).cast("bigint"), 12) + 1
    return (per_month.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                     .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
                     .select(
        F.lit("IN").alias("country_code"),
        F.col("r_name").alias("admin_l1"), F.col("n_name").alias("admin_l2"),
        F.upper(F.trim("n_name")).alias("district_key"),
        _pick(CALENDAR, F.col("m") - 1).alias("month"),
        F.col("indicator"),
        (F.col("orders") * F.when(F.col("m") == busy, 4).otherwise(1)).cast("double").alias("value")))


def staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    per = (c.groupBy("c_nationkey", "c_mktsegment")
            .agg(F.count("*").alias("posts"), F.count_if(F.col("c_acctbal") > 2000).alias("filled"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("r_name").alias("state"), "c_mktsegment")
            .agg(F.sum("posts").alias("posts"), F.sum("filled").alias("filled")))
    cadre = _pick(list(CADRES.values()),
                  F.array_position(F.array(*[F.lit(x) for x in CADRES]), F.col("c_mktsegment")) - 1)
    none = (F.col("state") == "MIDDLE EAST") & (F.col("c_mktsegment") == "HOUSEHOLD")
    sanctioned = F.when(none, F.lit(0)).otherwise(F.col("posts")).cast("bigint")
    in_pos = (F.when(none, F.lit(0))
               .when((F.col("state") == "ASIA") & (F.col("c_mktsegment") == "BUILDING"), F.col("posts") + 9)
               .otherwise(F.col("filled")).cast("bigint"))
    only = cadre.isin(*PHC_ONLY_CADRES)
    out = per.select(
        "state", cadre.alias("cadre"),
        F.when(only, F.array(F.lit("phc"))).otherwise(F.array(F.lit("phc"), F.lit("chc"))).alias("applies_to_facility_types"),
        (F.col("posts") + 5).cast("bigint").alias("required"),
        sanctioned.alias("sanctioned"), in_pos.alias("in_position"))
    from ..functions.num import ratio, rnd
    return (out.withColumn("vacant", F.col("sanctioned") - F.col("in_position"))
               .withColumn("vacancy_rate", rnd(ratio("vacant", "sanctioned"), 4)))


def transfer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("recommendation_id"),
        F.concat(F.lit("Q"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(t == "click", "approved").when(t == "view", "dispatched")
         .when(t == "purchase", "received").otherwise("recommended").alias("step"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model reply per event: fenced, bare array, single object, or prose."""
    e = read(spark, sf_dir, "events").withColumn("k", _k())
    k, t = F.col("k"), F.col("event_type")
    brand = F.concat(F.lit("Brand#"), (_mod(k, 25) + 1).cast("string"))
    row = F.struct(
        F.when(_mod(k, 10) == 9, "banana").otherwise(F.concat(
            item_name(_mod(k, 25) + 1), F.when(_mod(k, 4) == 0, " 500 mg").otherwise(""))).alias("local_name"),
        F.when(_mod(k, 3) == 0, brand).when(_mod(k, 10) == 8, "NOPE").alias("item_id"),
        F.when(_mod(k, 7) == 0, "BETRO forte").alias("generic_name"),
        F.when(t == "click", "dispensed").when(t == "view", "received")
         .when(t == "purchase", F.when(_mod(k, 5) == 0, "issued").otherwise("count"))
         .when(t == "error", "lost").when(_mod(k, 2) == 0, "request").otherwise("identify").alias("event_type"),
        F.when(_mod(k, 11) != 0, F.floor("value").cast("bigint")).alias("quantity"),
        F.lit("unit").alias("unit"),
        (F.lit(0.5) + _mod(k, 10).cast("double") / F.lit(20.0)).alias("confidence"),
        F.when(_mod(k, 6) != 0, " Broken ").alias("loss_reason"))
    js = F.to_json(row)
    text = (F.when(_mod(k, 17) == 3, "no medicine was heard")
            .when(_mod(k, 4) == 0, F.concat(F.lit("```json\n["), js, F.lit("]\n```")))
            .when(_mod(k, 4) == 1, js).otherwise(F.concat(F.lit("["), js, F.lit("]"))))
    return e.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("report_id"),
        F.col("event_id").alias("seq"), F.lit("medicine").alias("resource_type"),
        F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("facility_id"),
        F.col("ts").cast("timestamp_ntz").alias("event_ts"), F.lit("chat").alias("source"),
        text.alias("reply"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", _k())
    target = F.col("event_id") - _mod(F.col("event_id"), 3)
    return e.select(
        F.concat(F.lit("A"), F.col("event_id").cast("string")).alias("approval_id"),
        F.concat(F.lit("E"), target.cast("string")).alias("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("approved_at"),
        F.when(_mod(F.col("k"), 7) == 0, F.lit(-1)).when(_mod(F.col("k"), 5) != 0, F.col("k"))
         .cast("bigint").alias("approved_quantity"))


def teachings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("k", _k())
    return e.select(F.col("event_id").alias("teaching_id"),
                    F.concat(F.when(F.col("k") < 10, "P").otherwise("PACK"), F.col("k").cast("string")).alias("code"),
                    F.concat(F.lit("Brand#"), (_mod(F.col("user_id"), 30) + 1).cast("string")).alias("item_id"),
                    F.col("ts").cast("timestamp_ntz").alias("taught_at"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_type = 'view'").withColumn("k", _k())
    return e.select(F.col("event_id").alias("scan_id"),
                    F.concat(F.when(_mod(F.col("k"), 13) == 0, "PACK/").otherwise("PACK"),
                             F.col("k").cast("string")).alias("code"))


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mod(F.col("conv_id"), 3)
    head = F.concat(F.lit("in-"), F.col("conv_id").cast("string"))
    return read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(m == 0, F.concat(head, F.lit("  "), F.col("text"))).when(m == 1, head)
        .otherwise(F.col("text")).alias("message"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"),
                                      F.lit("2,024 1 2 3.0 10")).alias("facts"))


def prices(items_df: DataFrame) -> DataFrame:
    n = F.substring_index("item_id", "#", -1).cast("bigint")
    return items_df.filter((_mod(n, 3) != 2) & (_mod(n, 5) != 4)).select(
        F.when(_mod(n, 3) == 0, F.col("display_name")).otherwise(_pick(FIRST, _mod(n, 5))).alias("item_match"),
        F.col("list_price").alias("price"), n.alias("ord"))


def impact_parts(ledger: DataFrame, facilities_df: DataFrame) -> DataFrame:
    units = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("quantity")).otherwise(0))
    per = ledger.groupBy("facility_id").agg(
        F.max("event_date").alias("as_of_date"), units("dispensed").alias("units_dispensed"),
        units("lost").alias("units_unmet"), units("expired").alias("units_expired_fefo"),
        units("expired", "lost").alias("units_expired_fifo"))
    return per.join(facilities_df.select("facility_id", F.col("admin_l1").alias("part")), "facility_id").groupBy("part").agg(
        F.max("as_of_date").alias("as_of_date"), *[F.sum(c).alias(c) for c in (
            "units_dispensed", "units_unmet", "units_expired_fefo", "units_expired_fifo")])


def catalogue(items_df: DataFrame) -> DataFrame:
    """The item catalogue with spoken spellings."""
    first, second = F.split_part("display_name", F.lit(" "), F.lit(1)), F.split_part("display_name", F.lit(" "), F.lit(2))
    n = F.substring_index("item_id", "#", -1)
    return items_df.withColumn("local_name_in", F.col("display_name")).withColumn("spoken_variants", F.array(
        F.lower("display_name"), F.concat(F.lower(second), F.lit(" "), F.lower(first), F.lit(" goli")),
        F.concat(F.lit("गोली "), n), F.lower(F.concat(F.substring(first, 1, 3), F.substring(second, 1, 3)))))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item names as people say them, and whole unrelated texts."""
    e = read(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    name = item_name(_mod(k, 25) + 1)
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    cut = F.concat(F.substring(first, 1, 1), F.substring(first, 3, 20), F.lit(" "), second)
    said = F.when(_mod(k, 6) == 0, name).when(_mod(k, 6) == 1, cut) \
        .when(_mod(k, 6) == 2, F.concat(name, F.lit(" ke do sau tablet aaye"))) \
        .when(_mod(k, 6) == 3, F.concat(second, F.lit(" "), F.lower(first), F.lit(" 650 mg"))) \
        .when(_mod(k, 6) == 4, F.concat(F.lit("hello "), first)).otherwise("haan ji boliye")
    a = e.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("utterance_id"), said.alias("text"))
    b = read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("utterance_id"), "text")
    return a.unionByName(b)
