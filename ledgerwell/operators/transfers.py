"""Redistribution, access and the transfer lifecycle."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.num import nvl0, ratio, rnd, to_long
from ..plans.listing import upto
from ..plans.near import KM_PER_DEGREE, near_pairs, with_cell, with_probe_cells
from ..plans.one_row import beside
from ..plans.ordered import range_cell, running_totals
from ..plans.ranks import counted, holds
from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width
from .stock import PAIR

TARGET = 1.5
MAX_KM = 150.0
USABLE_DAYS = 30
FIRST_DAY = "0001-01-01"
LIFECYCLE = ("recommended", "approved", "dispatched", "received")


# -- batches -----------------------------------------------------------------------------

def batch_risk(stock: DataFrame, rs: DataFrame) -> DataFrame:
    """Units of a batch the holder cannot use before it expires, given what expires
    earlier. Undated batches sort first and have no risk figure."""
    lots = stock.select(*PAIR, "batch_id", "expiry_date", "days_to_expiry", "remaining_qty",
                        F.coalesce("expiry_date", F.lit(FIRST_DAY).cast("date")).alias("_lot"),
                        range_cell(stock, "batch_id").alias("_part"))
    run = running_totals(lots, PAIR, ["_lot", "_part"], ["batch_id"],
                         {"upto": F.col("remaining_qty")}).drop("_lot", "_part")
    earlier = F.col("upto") - F.col("remaining_qty")
    usable = F.greatest(F.lit(0.0), F.col("avg_daily_demand") * F.col("days_to_expiry") - earlier)
    return (run.join(rs.select(*PAIR, "avg_daily_demand"), PAIR)
            .select(*PAIR, "batch_id", "expiry_date", "days_to_expiry", "remaining_qty",
                    earlier.alias("units_expiring_earlier"),
                    F.when(F.col("days_to_expiry").isNotNull(), F.greatest(
                        F.lit(0.0), F.col("remaining_qty") - usable)).alias("at_risk_units")))


def fefo_batch(risk: DataFrame) -> DataFrame:
    """The batch a donor should send: at risk first, then soonest expiry. A struct
    minimum, so batches are combined before the shuffle."""
    level = (F.when(F.col("at_risk_units") > 0, 0).when(F.col("at_risk_units").isNotNull(), 1)
             .otherwise(2))
    best = risk.groupBy(*PAIR).agg(F.min(F.struct(
        level.alias("level"), "expiry_date", "batch_id", "days_to_expiry", "remaining_qty",
        "at_risk_units")).alias("b"))
    return best.select(*PAIR, F.col("b.batch_id").alias("fefo_batch_id"),
                       F.col("b.expiry_date").alias("fefo_expiry_date"),
                       F.col("b.days_to_expiry").alias("fefo_days_to_expiry"),
                       F.col("b.remaining_qty").alias("fefo_batch_qty"),
                       F.col("b.at_risk_units").alias("fefo_at_risk_units"))


def places(facilities: DataFrame) -> DataFrame:
    return facilities.filter("has_valid_coords").select("facility_id", "latitude", "longitude")


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns if c not in keep], *keep)


# -- nearest donor -----------------------------------------------------------------------

FINER = 8.0                      # a level's radius is this many times smaller than the one above
LEVELS = 4                       # 150 km down to about 300 m


def best_donor(need: DataFrame, offer: DataFrame, key: list[str], radius_km: float,
               accept: Column, order: list, also_on: tuple | list = (), grows: tuple | list = (),
               levels: int = LEVELS, asks: dict[str, Column] | None = None) -> DataFrame:
    """For each need row the first acceptable offer: same item before same class, then
    by ``order`` (which starts with distance).

    ``need`` has to_lat/to_lon, requested_item_id, atc_class; ``offer`` has from_lat/from_lon,
    supplied_item_id, donor_class. Of the offer, ``accept`` reads the columns ``grows`` only, and an offer
    that has more of them is never less acceptable. ``asks`` names for each of ``grows`` what a need asks for: an
    offer with as much of each is acceptable to every need that accepts any. It leaves out offers that no need takes.

    Offers lie in cells of several levels. Every cell knows the most that any of its offers has,
    and for each of ``grows`` the offer that has it. In its own cells a need finds how near an acceptable
    offer is for certain; offers are then looked up once, on the level that covers this distance,
    and only in cells that it reaches and where the most there is can be acceptable. Nothing is searched twice, needs that
    cannot be met meet no offers, and a crowded place is a matter of its smallest cells.
    """
    on, place = [*also_on, "_match"], ["_level", "_band", "_cell"]
    radii = [radius_km / FINER ** i for i in range(levels)]
    radius = F.lit(radius_km) / F.pow(F.lit(FINER), F.col("_level"))

    def matched(df: DataFrame, item: str, group: str) -> DataFrame:
        """Twice: by item (side 0) and by class (side 1)."""
        by = F.when(F.col("_side") == 0, F.concat(F.lit("i:"), item)).otherwise(F.concat(F.lit("c:"), group))
        return df.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_match", by).filter(F.col("_match").isNotNull())

    every_level = F.explode(F.array(*[F.lit(i) for i in range(levels)]))
    # what only the answer needs of a row travels as one column
    of_need = [c for c in need.columns if c not in key and c not in order]
    of_offer = [c for c in offer.columns if c not in key and c not in order and c not in of_need]
    offers = matched(offer.filter("from_lat IS NOT NULL AND from_lon IS NOT NULL").withColumn("_offer", F.struct(*of_offer)), "supplied_item_id", "donor_class").drop("_side")
    if asks:
        most = matched(need, "requested_item_id", "atc_class").groupBy(*on).agg(*[F.max(a).alias(f"_ask_{c}") for c, a in asks.items()])
        serves = reduce(Column.__and__, [F.coalesce(F.col(c) >= F.col(f"_ask_{c}"), F.lit(False)) for c in asks])
        offers = up_to_a_sure_one(offers.join(most, on).withColumn("_serves", serves).drop(*most.drop(*on).columns), on, order[1:])
    cells = with_cell(offers.withColumn("_level", every_level), "from_lat", "from_lon", radius)
    # dealt by the key once: the sums and joins by key below find their rows in place
    needs = matched(need.filter("to_lat IS NOT NULL AND to_lon IS NOT NULL").withColumn("_need", F.struct(*of_need)).repartition(shuffle_width(need), *key), "requested_item_id", "atc_class")
    other = (F.col("to_facility_id") != F.col("from_facility_id")) & ((F.col("_side") == 0) | (F.col("supplied_item_id") != F.col("requested_item_id")))

    told = ["from_facility_id", "supplied_item_id", "from_lat", "from_lon", *grows]
    has_it = [F.max_by(F.struct(*told), F.struct(c, "from_facility_id", "supplied_item_id")) for c in (grows or told[:1])]
    known = cells.groupBy(*on, *place).agg(F.array_distinct(F.array(*has_it)).alias("_known"), *[F.max(c).alias(c) for c in grows])
    own = with_cell(needs.withColumn("_level", every_level), "to_lat", "to_lon", radius).join(known.drop(*grows), [*on, *place])
    sure = own.withColumn("_k", F.explode("_known")).drop("_known").select("*", "_k.*").filter(other & accept)
    km = haversine_km("to_lat", "to_lon", "from_lat", "from_lon")
    found = sure.groupBy(*key).agg(*[F.min(F.when((F.col("_side") == i) & (km <= F.lit(float(radius_km))), km)).alias(f"_near{i}") for i in (0, 1)])

    # distances are compared in tenths: everything in the same tenth is looked at
    sure_km = F.when(F.col("_side") == 0, F.col("_near0")).otherwise(F.col("_near1"))
    bound = F.least(F.lit(float(radius_km)), F.coalesce(sure_km + 0.1, F.lit(float(radius_km))))
    level = F.lit(0)
    for i, r in enumerate(radii[1:], 1):
        level = F.when(F.col("_bound") <= F.lit(r), i).otherwise(level)
    wanted = (F.col("_side") == 0) | F.col("_near0").isNull()
    search = with_probe_cells(needs.join(found, key, "left").filter(wanted).withColumn("_bound", bound).withColumn("_level", level),
                              "to_lat", "to_lon", radius, F.col("_bound"))
    if grows:
        search = search.join(known.drop("_known"), [*on, *place]).filter(accept).drop(*grows)
    pairs = (search.join(cells, [*on, *place]).withColumn("km", km)
             .filter((F.col("km") <= F.col("_bound")) & other & accept)
             .withColumn("distance_km", rnd("km", 1)).withColumn("is_substitution", F.col("_side") == 1))
    rest = ["_need", "_offer", *(["km"] if "km" not in order else [])]
    best = pairs.groupBy(*key).agg(F.min(F.struct("is_substitution", *order, *rest)).alias("b"))
    return best.select(*key, "b.*").select(*key, "is_substitution", *order, "_need.*", "_offer.*", *rest[2:])


def up_to_a_sure_one(offer: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The offers of a place, ``on`` and item that some need may take: in ``order`` none after the second facility
    that ``_serves`` all needs. Two, because a facility does not serve itself. Facilities share a place in towns
    that have one position for all; without this every need there meets every offer. Equal rows stay together."""
    place, rank = Window.partitionBy(*on, "supplied_item_id", "from_lat", "from_lon"), F.struct(*order)
    return (offer.withColumn("_first", F.min(F.when(F.col("_serves"), rank)).over(place))
            .withColumn("_second", F.min(F.when(F.col("_serves") & (F.col("from_facility_id") != F.col("_first.from_facility_id")), rank)).over(place))
            .filter(F.col("_second").isNull() | (rank <= F.col("_second"))).drop("_serves", "_first", "_second"))


def first_of_place(offer: DataFrame, on: list[str]) -> DataFrame:
    """The first two facilities by id of every place and ``on``. Where anything is acceptable and distance comes
    before the id, no later one of the place is ever taken; two, because a facility does not serve itself."""
    order = Window.partitionBy(*on, "from_lat", "from_lon").orderBy("from_facility_id")
    return (offer.filter("from_lat IS NOT NULL AND from_lon IS NOT NULL")
            .withColumn("_nth", F.dense_rank().over(order)).filter(F.col("_nth") <= 2).drop("_nth"))


def transfer_id(*cols) -> Column:
    return F.sha2(F.concat_ws("|", *cols), 256)


def recommendations(rs: DataFrame, stock: DataFrame, facilities: DataFrame,
                    max_km: float = MAX_KM, target: float = TARGET,
                    usable_days: int = USABLE_DAYS) -> DataFrame:
    at = places(facilities)
    need = (rs.filter("needs_reorder AND avg_daily_demand > 0").join(at, "facility_id")
            .select(F.col("facility_id").alias("to_facility_id"), F.col("facility_name").alias("to_facility_name"),
                    F.col("state").alias("to_state"), F.col("district").alias("to_district"),
                    F.col("item_id").alias("requested_item_id"), F.col("item_name").alias("requested_item_name"),
                    "atc_class", "ven_class", "unit", "priority_score", "status",
                    F.col("on_hand").alias("receiver_on_hand"),
                    F.col("avg_daily_demand").alias("receiver_daily_demand"),
                    F.col("reorder_point").alias("receiver_reorder_point"),
                    F.col("days_of_cover").alias("receiver_cover_before"),
                    F.col("lead_time_days").alias("receiver_lead_time"),
                    F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon")))
    offer = (rs.filter(F.col("on_hand") > F.col("reorder_point") * target)
             .join(at, "facility_id")
             .join(fefo_batch(batch_risk(stock, rs)), PAIR)
             .filter(F.col("fefo_days_to_expiry") >= usable_days)
             .select(F.col("facility_id").alias("from_facility_id"), F.col("facility_name").alias("from_facility_name"),
                     F.col("item_id").alias("supplied_item_id"), F.col("item_name").alias("supplied_item_name"),
                     F.col("atc_class").alias("donor_class"), F.col("on_hand").alias("donor_on_hand"),
                     F.col("avg_daily_demand").alias("donor_daily_demand"),
                     F.col("days_of_cover").alias("donor_cover_before"),
                     (F.col("on_hand") - F.col("reorder_point")).alias("spare_units"),
                     "fefo_batch_id", "fefo_expiry_date", "fefo_days_to_expiry", "fefo_batch_qty",
                     "fefo_at_risk_units",
                     F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon")))
    size = to_long(F.greatest(F.lit(0.0), F.least(
        F.col("receiver_reorder_point") * target - F.col("receiver_on_hand"),
        F.col("spare_units"), F.col("fefo_batch_qty"))))
    worth = F.greatest(F.lit(1).cast("bigint"), F.ceil("receiver_daily_demand"))
    accept = (F.col("fefo_days_to_expiry") >= F.col("receiver_lead_time") + usable_days) & (size >= worth)
    best = best_donor(snapshot(need, "e1-need"), snapshot(offer, "e1-offer"),
                      ["to_facility_id", "requested_item_id"], max_km, accept,
                      ["distance_km", "fefo_days_to_expiry", "from_facility_id", "supplied_item_id"],
                      grows=["fefo_days_to_expiry", "spare_units", "fefo_batch_qty"],
                      asks={"fefo_days_to_expiry": F.col("receiver_lead_time") + usable_days, "spare_units": worth, "fefo_batch_qty": worth})
    q = F.col("quantity")
    return (best.withColumn("quantity", size)
            .select(transfer_id("to_facility_id", "requested_item_id", "from_facility_id",
                                "supplied_item_id", "fefo_batch_id").alias("recommendation_id"),
                    "to_facility_id", "to_facility_name", "to_state", "to_district",
                    "from_facility_id", "from_facility_name", "requested_item_id",
                    "requested_item_name", "supplied_item_id", "supplied_item_name",
                    "is_substitution", "ven_class", "unit", "priority_score", "status",
                    "quantity", "distance_km", "fefo_batch_id", "fefo_expiry_date",
                    "fefo_days_to_expiry", "receiver_cover_before",
                    rnd(ratio(F.col("receiver_on_hand") + q, "receiver_daily_demand"), 1).alias("receiver_cover_after"),
                    "donor_cover_before",
                    rnd(ratio(F.col("donor_on_hand") - q, "donor_daily_demand"), 1).alias("donor_cover_after"),
                    to_long(F.least(q, F.col("fefo_at_risk_units"))).alias("waste_avoided_units")))


def transfer_effects(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count("*").alias("transfers"), F.count_if("is_substitution").alias("substitutions"),
        nvl0(F.sum("quantity")).alias("units"), nvl0(F.sum("waste_avoided_units")).alias("waste_avoided"),
        F.count_if(F.col("receiver_cover_after") > F.col("receiver_cover_before")).alias("receivers_improved"),
        F.max("distance_km").alias("max_km"),
        F.count_distinct("to_facility_id").alias("receivers"),
        F.count_distinct("from_facility_id").alias("donors"))


def donor_safety_check(recs: DataFrame) -> DataFrame:
    return recs.agg(F.count_if(F.col("donor_cover_after") < 0).alias("negative_donor"))


# -- substitutes -------------------------------------------------------------------------

def substitutes(rs: DataFrame) -> DataFrame:
    """Same facility, same class, other item above its own reorder point. The join key is
    (facility, class): its size is bounded by the items of one class."""
    want = rs.filter("needs_reorder AND atc_class IS NOT NULL").select(
        "facility_id", "atc_class", "facility_name", "state", "district",
        F.col("item_id").alias("requested_item_id"), F.col("item_name").alias("requested_item_name"),
        F.col("ven_class").alias("requested_ven_class"), F.col("on_hand").alias("requested_on_hand"),
        F.col("days_of_cover").alias("requested_days_of_cover"))
    have = rs.filter("on_hand > reorder_point AND atc_class IS NOT NULL").select(
        "facility_id", "atc_class", "unit",
        F.col("item_id").alias("alternative_item_id"), F.col("item_name").alias("alternative_item_name"),
        F.col("ven_class").alias("alternative_ven_class"), F.col("atc_code").alias("alternative_atc_code"),
        F.col("on_hand").alias("alternative_on_hand"), F.col("days_of_cover").alias("alternative_days_of_cover"))
    w = Window.partitionBy("facility_id", "requested_item_id").orderBy(
        F.desc_nulls_last("alternative_days_of_cover"), "alternative_item_id")
    return (want.join(have, ["facility_id", "atc_class"])
            .filter("requested_item_id <> alternative_item_id")
            .withColumn("rank_by_cover", F.row_number().over(w)))


def substitution_constraint(rs: DataFrame) -> DataFrame:
    per = (rs.filter("atc_class IS NOT NULL").select("atc_class", "item_id").distinct()
           .groupBy("atc_class").agg(F.count("*").alias("n")))
    return per.agg(F.count("*").alias("classes"), F.count_if(F.col("n") > 1).alias("classes_with_a_pair"))


# -- distance-scored redistribution ------------------------------------------------------

def score_redistribution(inventory: DataFrame, coords: DataFrame, threshold_days: int = 14,
                         max_km: float = 50.0) -> DataFrame:
    """Best donor by cover left after the transfer per kilometre."""
    t = float(threshold_days)
    cover = F.when(F.col("daily_demand") > 0, F.col("on_hand") / F.col("daily_demand"))
    rows = inventory.withColumn("cover", cover).join(coords, "facility_id")
    # No demand means endless cover: never short, always able to give.
    need = rows.filter(F.col("cover") < t).select(
        "item_id", F.col("facility_id").alias("to_facility_id"), F.col("on_hand").alias("r_hand"),
        F.col("daily_demand").alias("r_demand"), F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"))
    offer = rows.filter(F.col("cover").isNull() | (F.col("cover") > 3 * t)).select(
        "item_id", F.col("facility_id").alias("from_facility_id"), F.col("on_hand").alias("d_hand"),
        F.col("daily_demand").alias("d_demand"), F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon"))
    pairs = near_pairs(need, offer, max_km, on=["item_id"]).filter("km > 0")
    qty = transfer_size("r_hand", "r_demand", "d_hand", "d_demand", t)
    pairs = pairs.withColumn("quantity", qty).filter("quantity > 0")
    post = ratio(F.col("d_hand") - F.col("quantity"), "d_demand")
    score = F.coalesce(post / F.col("km"), F.lit(float("inf")))
    best = pairs.groupBy("to_facility_id", "item_id").agg(F.min(F.struct(
        (-score).alias("neg"), "from_facility_id", "quantity", "km", "d_hand", "d_demand",
        "r_hand", "r_demand")).alias("b")).select("to_facility_id", "item_id", "b.*")
    return best.select(
        "to_facility_id", "item_id", "from_facility_id", "quantity", rnd("km", 2).alias("distance_km"),
        rnd(ratio(F.col("d_hand") - F.col("quantity"), "d_demand"), 1).alias("donor_post_cover"),
        rnd(ratio(F.col("r_hand") + F.col("quantity"), "r_demand"), 1).alias("receiver_post_cover"),
        rnd(-F.col("neg"), 2).alias("score"))


def transfer_size(r_hand, r_demand, d_hand, d_demand, threshold_days: float) -> Column:
    """Fill the receiver to twice the threshold from what the donor holds above twice its
    own, in whole units."""
    two = F.lit(2.0 * threshold_days)
    want = F.floor(two * F.col(r_demand)) - F.col(r_hand)
    spare = F.col(d_hand) - F.floor(two * F.col(d_demand))
    return F.greatest(F.lit(0), F.least(want, spare)).cast("bigint")


# -- access ------------------------------------------------------------------------------

def nearest_help(rs: DataFrame, facilities: DataFrame, vital_only: bool = True,
                 search_km=(100.0, 600.0)) -> DataFrame:
    """Per shortage the nearest facility able to spare the same item; shortages without
    any source stay. The last step has no radius and only sees what is left. The others go by
    ``best_donor``, so a shortage meets the sources about its nearest one and not all within the radius."""
    at = facilities.filter("has_valid_coords").select(
        "facility_id", "latitude", "longitude", "population_served")
    short = rs.filter("needs_reorder")
    if vital_only:
        short = short.filter("ven_class = 'Vital'")
    short = (short.join(at, "facility_id").select(
        "facility_id", "facility_name", "state", "district", "item_id", "item_name", "unit",
        "ven_class", "on_hand", "days_of_cover", "status",
        F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"),
        F.col("population_served").alias("population")))
    source = (rs.filter("NOT needs_reorder AND on_hand > 0").join(at, "facility_id").select(
        F.col("item_id").alias("supplied_item_id"), F.lit(None).cast("string").alias("donor_class"),
        F.col("facility_id").alias("from_facility_id"), F.col("facility_name").alias("source_name"),
        F.col("district").alias("source_district"), F.col("state").alias("source_state"),
        F.col("on_hand").alias("source_on_hand"),
        F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon")))
    short, source = snapshot(short, "e9-short"), snapshot(first_of_place(source, ["supplied_item_id"]), "e9-source")
    key, told = ["facility_id", "item_id"], ["source_name", "source_district", "source_state", "source_on_hand"]
    order = ["km", "from_facility_id", *told]
    ends = ["to_facility_id", "requested_item_id"]
    left, found = short.select(F.col("facility_id").alias(ends[0]), F.col("item_id").alias(ends[1]),
                               F.lit(None).cast("string").alias("atc_class"), "to_lat", "to_lon"), []

    def keep(best: DataFrame, step: str) -> DataFrame:
        return snapshot(best.select(*[F.col(e).alias(k) for e, k in zip(ends, key)], F.col("from_facility_id").alias("source_id"),
                                    *told, rnd("km", 1).alias("km")), f"e9-{step}")

    for i, radius in enumerate(search_km):
        best = keep(best_donor(left, source, ends, radius, F.lit(True), order), str(i))
        found.append(best)
        left = left.join(best.select(*[F.col(k).alias(e) for e, k in zip(ends, key)]), ends, "left_anti")
    rest = left.select(*[F.col(e).alias(k) for e, k in zip(ends, key)], "to_lat", "to_lon")
    far = (_far_pairs(rest, source.withColumnRenamed("supplied_item_id", "item_id"), key).filter("from_facility_id <> facility_id")
           .groupBy(*key).agg(F.min(F.struct(*order)).alias("b")))
    found.append(keep(far.select(*[F.col(k).alias(e) for e, k in zip(ends, key)], "b.*"), "far"))
    hits = reduce(DataFrame.unionByName, found)
    return short.drop("to_lat", "to_lon").join(hits, key, "left")


def _far_pairs(left: DataFrame, source: DataFrame, key: list[str], degrees: float = 2.0) -> DataFrame:
    """Pairs that hold the nearest source of the item however far: coarse cells in use are
    compared by the bounds of their distance, and only those that can hold it are opened. A
    row meets at most the 16,200 cells of the globe, whatever the number of sources."""
    source = (source.withColumn("_row", F.floor(F.col("from_lat") / degrees))
                    .withColumn("_col", F.floor(F.col("from_lon") / degrees)))
    cells = source.select("item_id", "_row", "_col").distinct().select(
        "*", ((F.col("_row") + 0.5) * degrees).alias("_lat"), ((F.col("_col") + 0.5) * degrees).alias("_lon"))
    far = degrees / 2 * 2 ** 0.5 * KM_PER_DEGREE * 1.01       # from a cell's centre to its corner
    seen = left.join(cells, "item_id").withColumn("_km", haversine_km("to_lat", "to_lon", "_lat", "_lon"))
    bound = seen.groupBy(*key).agg((F.min("_km") + 2 * far).alias("_bound"))
    opened = seen.join(bound, key).filter(F.col("_km") <= F.col("_bound")).drop("_lat", "_lon", "_km", "_bound")
    pairs = opened.join(source, ["item_id", "_row", "_col"]).drop("_row", "_col")
    return (pairs.withColumn("km", haversine_km("to_lat", "to_lon", "from_lat", "from_lon"))
                 .withColumn("distance_km", rnd("km", 1)))


def access_summary(cases: DataFrame, near_km: float = 25, far_km: float = 100) -> DataFrame:
    km = F.col("km")
    counts = cases.agg(
        F.count("*").alias("cases"),
        F.count_if(km <= near_km).alias("near"),
        F.count_if((km > near_km) & (km <= far_km)).alias("between"),
        F.count_if(km > far_km).alias("far"), F.count_if(km.isNull()).alias("unreachable"))
    reached = counted(cases.filter(km.isNotNull()), ["km"])
    total = reached.agg(nvl0(F.sum("n"))).scalar()
    median = reached.filter(holds(F.floor(total / 2))).agg(F.min("km").alias("median_km"))
    people = (cases.groupBy("facility_id").agg(F.max("population").alias("p"))
              .agg(F.count("*").alias("centres"), nvl0(F.sum("p")).alias("people")))
    return beside(counts, median, people)


def triage(rs: DataFrame, recs: DataFrame) -> DataFrame:
    covered = recs.select(F.col("to_facility_id").alias("facility_id"),
                          F.col("requested_item_id").alias("item_id")).distinct().withColumn("hit", F.lit(True))
    rows = rs.filter("needs_reorder").join(covered, PAIR, "left")
    moved = F.coalesce("hit", F.lit(False))
    late = ~moved & F.coalesce(F.col("days_of_cover") < F.col("lead_time_days"), F.lit(False))
    return rows.select(
        "facility_id", "facility_name", "state", "district", "item_id", "item_name", "unit", "ven_class",
        "on_hand", "reorder_point",
        F.greatest(to_long(F.col("reorder_point") - F.col("on_hand")), F.lit(0)).alias("shortfall"),
        "days_of_cover", "lead_time_days", "status", moved.alias("has_transfer"),
        late.alias("too_late_to_order"),
        F.when(moved, "transfer").when(late, "escalate").otherwise("order").alias("answer"))


def triage_summary(rows: DataFrame) -> DataFrame:
    a = F.col("answer")
    esc = a == "escalate"
    return rows.agg(
        F.count("*").alias("total"), F.count_if(a == "transfer").alias("transfer"),
        F.count_if(a == "order").alias("order"), F.count_if(esc).alias("escalate"),
        F.count_if(esc & (F.col("ven_class") == "Vital")).alias("escalate_vital"),
        F.count_if(esc & (F.col("on_hand") <= 0)).alias("escalate_out_now"))


# -- ranked reads ------------------------------------------------------------------------

def alerts(rs: DataFrame, limit: int | None = None) -> DataFrame:
    return (rs.filter("needs_reorder")
            .orderBy(F.desc("priority_score"), F.asc_nulls_first("days_of_cover"), *PAIR).transform(upto, limit)
            .select(*PAIR, "facility_name", "state", "district", "item_name", "unit", "ven_class", "on_hand",
                    "avg_daily_demand", "days_of_cover", "reorder_point", "safety_stock",
                    "legacy_threshold", "lead_time_days", "priority_score", "status",
                    "days_to_soonest_expiry", "soonest_expiry"))


def recommendation_list(recs: DataFrame, limit: int | None = None) -> DataFrame:
    return (recs.orderBy(F.desc("priority_score"), "distance_km", "recommendation_id").transform(upto, limit)
            .select("recommendation_id", "from_facility_id", "to_facility_id", "requested_item_id",
                    "supplied_item_id", "is_substitution", "quantity", "distance_km",
                    "waste_avoided_units", "priority_score", "status"))


def best_substitutes(subs: DataFrame, limit: int | None = None, per_item: int = 3) -> DataFrame:
    return (subs.filter(F.col("rank_by_cover") <= per_item)
            .orderBy(F.asc_nulls_first("requested_days_of_cover"),
                     F.desc_nulls_last("alternative_days_of_cover"),
                     "facility_id", "requested_item_id", "alternative_item_id").transform(upto, limit))


# -- lifecycle ---------------------------------------------------------------------------

def movement_id(step) -> Column:
    return F.concat_ws(":", "recommendation_id", step)


def apply_requests(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Accepted steps of every transfer: no skip, no reverse, no repeat.

    A step counts at its first request after the step before it was accepted, so each
    step is one struct minimum per transfer: nothing is replayed row by row and a
    transfer with very many requests is combined before the shuffle. ``known`` (recommendation_id,
    reached) has the steps accepted before these requests, as places in ``LIFECYCLE``.
    """
    at = F.struct("ts", "request_id")
    req = requests.select("recommendation_id", "step", at.alias("at"))
    accepted, prior = None, None
    for place, step in enumerate(LIFECYCLE[1:], 1):
        rows = req.filter(F.col("step") == step)
        if prior is not None:
            if known is not None:                                  # reached earlier: every request is after it
                prior = prior.unionByName(known.filter(F.col("reached") == place - 1).select("recommendation_id"), allowMissingColumns=True)
            rows = rows.join(prior, "recommendation_id").filter(F.col("after").isNull() | (F.col("at") > F.col("after")))
        elif known is not None:
            rows = rows.join(known, "recommendation_id", "left_anti")
        first = rows.groupBy("recommendation_id").agg(F.min("at").alias("after"))
        log = first.select("recommendation_id", F.lit(step).alias("fulfilment_status"),
                           F.col("after.ts").alias("updated_at"),
                           F.col("after.request_id").alias("request_id"),
                           F.when(F.lit(step != "approved"), movement_id(F.lit(step))).alias("movement_event_id"))
        accepted = log if accepted is None else accepted.unionByName(log)
        prior = first
    return accepted


def rejected_requests(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    return (requests.join(accepted.select("request_id"), "request_id", "left_anti")
            .groupBy("step").agg(F.count("*").alias("rejected")))


def transfer_pending(log: DataFrame) -> DataFrame:
    """Latest state per transfer, with the time of every step."""
    when = lambda s: F.max(F.when(F.col("fulfilment_status") == s, F.col("updated_at")))
    step = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("fulfilment_status"))
    return log.groupBy("recommendation_id").agg(
        F.max_by("fulfilment_status", F.struct("updated_at", step)).alias("fulfilment_status"),
        when("approved").alias("approved_at"), when("dispatched").alias("dispatched_at"),
        when("received").alias("received_at"))


def movement_reconcile(movements: DataFrame, log: DataFrame) -> DataFrame:
    """Ledger movements against the recorded steps."""
    seen = movements.groupBy("event_id").agg(F.count("*").alias("n"))
    steps = log.filter("movement_event_id IS NOT NULL").select(F.col("movement_event_id").alias("event_id")).distinct().withColumn("in_log", F.lit(1))
    both = seen.join(steps, "event_id", "full")
    return both.agg(
        F.count_if(F.col("n") > 1).alias("duplicated_movements"),
        F.count_if(F.col("in_log").isNull()).alias("movement_without_step"),
        F.count_if(F.col("n").isNull()).alias("step_without_movement"),
        F.count_if(F.col("n").isNotNull() & F.col("in_log").isNotNull()).alias("matched"))
