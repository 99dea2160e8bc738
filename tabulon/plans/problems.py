"""The queries p1 to p7: the core operators over the trip tables, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import bitmaps, digest, impute, profile, sessions, spatial, spikes
from tabulon.runtime import Query, clean_key, clean_name, epoch_seconds, no_value, reliable_checkpoint, table, union_all, usable_number

SESSION_GAP_S = 2700
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
AMOUNTS = ("fare_amount", "trip_distance", "tip_amount")
#: Amounts that stand for "not recorded" in tips.
TIP_SENTINELS = (-1.0, -9.0, -99.0, -999.0, 999.0, 999.99, 9999.0, 9999.99, 99999.0, 99999.99)
WATCHED = ("passenger_count", "rate_code", "store_and_fwd_flag", "payment_type")
DISTINCT_ERROR = 0.01
MILE_M = 1609.344


# -- 1 ----------------------------------------------------------------------------------------------------------------
def trip_ends(trips: DataFrame) -> DataFrame:
    """Both ends of every trip: trip_id, trip_end, lon, lat, stored neighborhood and borough."""
    end = lambda e: F.struct(F.lit(e).alias("trip_end"), F.col(f"{e}_longitude").alias("lon"), F.col(f"{e}_latitude").alias("lat"), clean_name(f"{e}_neighborhood").alias("nb"), clean_name(f"{e}_borough").alias("bo"))
    return trips.select("trip_id", F.inline(F.array(end("pickup"), end("dropoff")))).where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nb = table(spark, d, "neighborhoods")
    areas = nb.select(F.col("neighborhood_id").alias("ref_id"), "boundary", clean_name("neighborhood").alias("area_nb"), clean_name("borough").alias("area_bo"))
    stands = table(spark, d, "stands").select(F.col("stand_id").alias("ref_id"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "radius_m")
    # Names travel as the first id that has them, those of no area as null; areas are a fixed table and Spark sizes the joins.
    nbs = areas.where("area_nb is not null").groupBy("area_nb").agg(F.min("ref_id").alias("nb_code"))
    bos = areas.where("area_bo is not null").groupBy("area_bo").agg(F.min("ref_id").alias("bo_code"))
    ends = trip_ends(table(spark, d, "example"))
    ends = ends.join(nbs, ends.nb == nbs.area_nb, "left").join(bos, ends.bo == bos.area_bo, "left")
    ends = ends.select("trip_id", (F.col("trip_end") == "pickup").alias("up"), "lon", "lat", F.coalesce("nb_code", F.lit(-1)).alias("nb"), F.coalesce("bo_code", F.lit(-1)).alias("bo"))
    hits = spatial.match(ends, stands, areas)
    names = areas.join(nbs, "area_nb", "left").join(bos, "area_bo", "left").select(F.col("ref_id").alias("area"), F.coalesce("nb_code", F.lit(-1)).alias("anb"), F.coalesce("bo_code", F.lit(-1)).alias("abo"))
    hits = hits.join(names, (hits.kind == "inside") & (hits.ref_id == names.area), "left")
    hits = hits.where((F.col("kind") == "near") | (F.col("nb") != F.col("anb")) | (F.col("bo") != F.col("abo")))
    return hits.select("trip_id", F.when(F.col("up"), "pickup").otherwise("dropoff").alias("trip_end"), F.col("kind").alias("match_kind"), "ref_id")


# -- 2 ----------------------------------------------------------------------------------------------------------------
def _num(c: str) -> Column:
    return F.coalesce(usable_number(F.col(c)), F.lit(0.0))


def _bin(c: Column, steps: tuple[float, ...]) -> Column:
    out = F.lit(len(steps))
    for i, s in reversed(list(enumerate(steps))):
        out = F.when(c < s, i).otherwise(out)
    return F.when(c.isNotNull(), out)


def filled_example(spark: SparkSession, d: str) -> DataFrame:
    """example with tip_amount and payment_type completed and marked."""
    e = table(spark, d, "example")
    tip = usable_number(F.col("tip_amount"))
    pays = F.upper(F.trim("payment_type"))
    fare = F.least(F.greatest(_num("fare_amount"), F.lit(0.0)), F.lit(300.0))
    miles = F.least(F.greatest(_num("trip_distance"), F.lit(0.0)), F.lit(100.0))
    card = F.coalesce(F.upper("payment_type").isin("CARD", "BANK CARD", "APP"), F.lit(False)).cast("double")
    step = (0.01, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0)
    return impute.impute(e, "trip_id", [
        impute.Field("tip_amount", "numeric", tip.isNull() | tip.isin(*TIP_SENTINELS), [card, card * fare, fare, miles, _num("tolls_amount")], floor=0.0, value=tip),
        impute.Field("payment_type", "categorical", no_value(F.col("payment_type"), "payment_type"), [_bin(F.col("tip_amount"), step), clean_key("vendor_id"), _bin(fare, (5, 10, 20, 40)), F.col("pickup_hour"), clean_name("pickup_borough")], value=pays),
    ])


def filled_taxi(spark: SparkSession, d: str) -> DataFrame:
    """taxi with dropoff_neighborhood completed and marked."""
    t = table(spark, d, "taxi")
    lon, lat = usable_number(F.col("dropoff_longitude")), usable_number(F.col("dropoff_latitude"))
    cell = F.concat_ws(":", F.floor(lon * 100), F.floor(lat * 100))
    known = lambda c: F.when(~no_value(F.col(c), c), clean_name(c))
    return impute.impute(t, "row_id", [
        impute.Field("dropoff_neighborhood", "categorical", no_value(F.col("dropoff_neighborhood"), "dropoff_neighborhood"), [F.when(lon.isNotNull() & lat.isNotNull(), cell), known("dropoff_borough"), known("pickup_neighborhood"), _bin(usable_number(F.col("trip_distance")), (1, 2, 4, 8, 16))], value=F.lower(F.trim("dropoff_neighborhood"))),
    ], rounds=1)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    e, t = filled_example(spark, d), filled_taxi(spark, d)
    marks = lambda df, tbl, key, *names: df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*[F.when(F.col(f"{n}_filled"), F.lit(n)) for n in names]))).alias("field_name"))
    return marks(e, "example", "trip_id", "tip_amount", "payment_type").unionByName(marks(t, "taxi", "row_id", "dropoff_neighborhood"))


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells with their new values."""
    e, t = filled_example(spark, d), filled_taxi(spark, d)
    return union_all([
        df.where(f"{c}_filled").select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value"))
        for df, tbl, key, c in ((e, "example", "trip_id", "tip_amount"), (e, "example", "trip_id", "payment_type"), (t, "taxi", "row_id", "dropoff_neighborhood"))
    ])


# -- 3 ----------------------------------------------------------------------------------------------------------------
def driver_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "example")
    return e.select(clean_key("hack_license").alias("entity"), clean_key("medallion").alias("medallion"), epoch_seconds(e, "pickup_datetime").alias("start_s"), epoch_seconds(e, "dropoff_datetime").alias("end_s"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessions(driver_events(spark, d), SESSION_GAP_S, same=["medallion"])
    return s.select(F.col("entity").alias("hack_license"), F.col("start_s").alias("session_start"), F.col("end_s").alias("session_end"), F.col("events").alias("trips"))


def p3_gap_settings(spark: SparkSession, d: str) -> DataFrame:
    """Sessions for several gap settings, all cut from one tree."""
    tree = sessions.gap_tree(sessions.segments(driver_events(spark, d), same=["medallion"]))
    tree = tree.select("*", F.explode(F.array(*[F.lit(m * 60) for m in (15, 45, 120, 480)])).alias("gap_setting_s"))
    s = tree.where("gap_s <= gap_setting_s and gap_setting_s < parent_gap_s")
    return s.groupBy("entity", "gap_setting_s").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("trips"), F.max(F.col("end_s") - F.col("start_s")).alias("longest_s")).withColumnRenamed("entity", "hack_license")


# -- 4 ----------------------------------------------------------------------------------------------------------------
def amounts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "example")
    each = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("double").alias("value")) for c in AMOUNTS])
    return e.select("load_id", clean_name("pickup_neighborhood").alias("pickup_neighborhood"), F.inline(each))


def p4_load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per load and neighborhood, from digests of single loads, with counted rank errors."""
    keys = ["load_id", "pickup_neighborhood", "field_name"]
    values = amounts(spark, d)
    found = reliable_checkpoint(digest.estimate(digest.digests(values, keys, "value"), PERCENTILES))
    return digest.certify(values, keys, "value", found)


def merged_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["pickup_neighborhood", "field_name"]
    values = amounts(spark, d)
    loads = digest.digests(values, ["load_id", *keys], "value")
    found = reliable_checkpoint(digest.estimate(digest.merge(loads, keys), PERCENTILES))
    return digest.certify(values, keys, "value", found)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per neighborhood over all loads, by merging the digests of single loads."""
    return merged_percentiles(spark, d)


def p4_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per group and percentile: the exact count of values, and whether the counted rank error is within its bound."""
    r = merged_percentiles(spark, d)
    bound = 4 * 3.141592653589793 / digest.DELTA * F.sqrt(F.col("p") * (1 - F.col("p"))) + 2 / F.col("n") + 1e-9
    return r.select("pickup_neighborhood", "field_name", "p", "n", (F.col("rank_error") <= bound).alias("within_bound"))


# -- 5 ----------------------------------------------------------------------------------------------------------------
#: Bits of the bitmaps, sized for 200,000 identifiers at DISTINCT_ERROR; the sizing is checked against a first estimate.
LEAST_IDS = 200_000
LEVELS = {"day_borough": ["day", "borough"], "day": ["day"], "borough": ["borough"]}


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """load_id, day, borough, id_kind, id: both identifiers of every trip."""
    e = table(spark, d, "example")
    ids = F.array(*[F.struct(F.lit(c).alias("id_kind"), clean_key(c).alias("id")) for c in ("medallion", "hack_license")])
    return e.select("load_id", F.col("pickup_day_of_month").alias("day"), clean_name("pickup_borough").alias("borough"), F.inline(ids)).where("id is not null")


def id_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Partial bitmaps per load, day, borough and identifier; every row says how large its bitmap is."""
    rows = identifiers(spark, d)
    largest = max(r[0] or 0 for r in rows.groupBy("id_kind").agg(F.approx_count_distinct("id")).select("approx_count_distinct(id)").collect() or [[0]])
    return bitmaps.bitmaps(rows, ["load_id", "day", "borough", "id_kind"], F.col("id"), bitmaps.size_bits(max(LEAST_IDS, 1.2 * largest), DISTINCT_ERROR))


def _level(df: DataFrame, level: str, *rest: str) -> DataFrame:
    """df with its level's name and null for the keys that it doesn't have."""
    return df.select(F.lit(level).alias("grouping_level"), *[F.col(k) if k in LEVELS[level] else F.lit(None).cast(t).alias(k) for k, t in (("day", "int"), ("borough", "string"))], *rest)


def p5_load_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """The partial results of each load for all levels: bitmaps that later loads' results can be united with."""
    fine = id_bitmaps(spark, d)
    own = ["load_id", "id_kind", "bits", "page", *bitmaps.WORDS]
    return union_all([_level(fine if len(keys) == 2 else bitmaps.union(fine, ["load_id", *keys, "id_kind"]), level, *own) for level, keys in LEVELS.items()])


def p5_load_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers per load, day and borough, read off the partial results."""
    return bitmaps.estimates(id_bitmaps(spark, d), ["load_id", "day", "borough", "id_kind"])


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers per day, per borough and per combination, by union of the loads' bitmaps of each level."""
    united = bitmaps.union(p5_load_bitmaps(spark, d), ["grouping_level", "day", "borough", "id_kind"])
    return bitmaps.estimates(united, ["grouping_level", "day", "borough", "id_kind"])


def p5_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Per level and group: the exact number of identifiers, and whether the estimate is within its stated bound of it."""
    ids = identifiers(spark, d)
    exact = union_all([_level(ids.groupBy(*keys, "id_kind").agg(F.count_distinct("id").alias("ids")), level, "id_kind", "ids") for level, keys in LEVELS.items()])
    keys = ["grouping_level", "day", "borough", "id_kind"]
    both = exact.alias("x").join(p5_distinct(spark, d).alias("e"), F.expr(" and ".join(f"x.{k} <=> e.{k}" for k in keys)))
    return both.select(*[F.col(f"x.{k}") for k in keys], "ids", (F.abs(F.col("estimate") - F.col("ids")) <= F.col("error_bound") * F.col("estimate") + 0.5).alias("within_bound"))


# -- 6 ----------------------------------------------------------------------------------------------------------------
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.forms(table(spark, d, "example"), "load_id")
    return profile.changed_loads(counts).where(F.col("column_name").isin(*WATCHED)).select(F.col("load").alias("load_id"), F.col("column_name").alias("field_name"))


def p6_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Nulls, different values and ranges of every column per load."""
    return profile.ranges(table(spark, d, "example"), "load_id")


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls, least and greatest value of the watched fields per load."""
    r = profile.ranges(table(spark, d, "example"), "load_id", list(WATCHED))
    return r.select(F.col("load").alias("load_id"), F.col("column_name").alias("field_name"), "n", "nulls", "low", "high")


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    """Written forms of every column, with the dominant one and rare ones marked."""
    return profile.mask_profile(profile.forms(table(spark, d, "example"), "load_id"))


def p6_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.divergence(profile.forms(table(spark, d, "example"), "load_id"))


# -- 7 ----------------------------------------------------------------------------------------------------------------
READINGS = ("trip_distance", "trip_time_in_secs", "fare_amount")


#: Rows of a rate code from which it can be told to be a flat fare: one fare is that of half of them or more.
FLAT_ROWS = 8


def readings(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    """What spikes are looked for in: trips with their readings, and what else tells of these; and the flat fares by rate code."""
    e = table(spark, d, "example")
    numbers = [*READINGS, "tip_amount", "total_amount", "surcharge", "mta_tax", "tolls_amount", *[f"{p}_{c}" for p in ("pickup", "dropoff") for c in ("longitude", "latitude")]]
    # cleaned values first, each once: what is derived from them below refers to columns, which keeps the generated code small
    t = e.select(
        "trip_id", clean_key("medallion").alias("source"), epoch_seconds(e, "pickup_datetime").alias("t"), epoch_seconds(e, "dropoff_datetime").alias("end"),
        F.regexp_replace(F.trim("rate_code"), r"^0+(?=\d)|\.0+$", "").alias("rate"), *[usable_number(F.col(c)).alias(c) for c in numbers],
    )
    fares = t.where("rate is not null and fare_amount > 0").groupBy("rate", "fare_amount").agg(F.count(F.lit(1)).alias("k"))
    usual = fares.groupBy("rate").agg(F.sum("k").alias("n"), F.max(F.struct("k", "fare_amount")).alias("m")).where(f"n >= {FLAT_ROWS} and m.k * 2 >= n")
    flat = {r.rate: r.m.fare_amount for r in usual.collect()}  # rate codes are few
    t = t.withColumns({f"rad_{p}": F.radians(f"{p}_latitude") for p in ("pickup", "dropoff")} | {"d_lat": F.sin(F.radians(F.col("dropoff_latitude") - F.col("pickup_latitude")) / 2), "d_lon": F.sin(F.radians(F.col("dropoff_longitude") - F.col("pickup_longitude")) / 2)})
    chord = F.sqrt(F.least(F.lit(1.0), F.col("d_lat") * F.col("d_lat") + F.cos("rad_pickup") * F.cos("rad_dropoff") * F.col("d_lon") * F.col("d_lon")))
    implied = F.col("total_amount") - F.col("surcharge") - F.col("mta_tax") - F.col("tolls_amount") - F.when(~F.col("tip_amount").isin(*TIP_SENTINELS), F.col("tip_amount"))
    weekend = F.when(F.pmod(F.floor(F.col("t") / 86400) + 3, F.lit(7)) >= 5, 1).otherwise(0)
    fixed = F.when(F.col("rate").isNull() & F.col("fare_amount").isin(*flat.values()), F.col("fare_amount")) if flat else F.lit(None).cast("double")
    for rate, fare in flat.items():
        fixed = F.when(F.col("rate") == rate, fare).otherwise(fixed)
    t = t.select(
        "trip_id", "source", "t", *READINGS, "rate", fixed.alias("flat"),
        F.when(F.col("end") > F.col("t"), F.col("end") - F.col("t")).cast("double").alias("elapsed"),
        F.when((F.col("pickup_longitude") != 0) & (F.col("dropoff_longitude") != 0), 2 * spatial.EARTH_M / MILE_M * F.asin(chord)).alias("line"),
        implied.alias("implied"), (F.floor(F.pmod("t", F.lit(86400)) / 10800) * 2 + weekend).cast("int").alias("season"),
    ).withColumn("implied", F.when(F.col("implied") > 0.5, F.col("implied")))
    return t.withColumn("season", F.coalesce("season", F.lit(0))), flat


def spike_model(t: DataFrame, risk: float = spikes.RISK) -> spikes.SpikeModel:
    return spikes.fit(t, [
        spikes.Reading("trip_distance", ["line"], ["trip_time_in_secs", "fare_amount"], 0.1),
        spikes.Reading("trip_time_in_secs", ["elapsed"], ["trip_distance", "fare_amount"], 30.0),
        spikes.Reading("fare_amount", ["implied", "flat"], ["trip_distance", "trip_time_in_secs"], 0.5),
    ], "source", "season", risk)


def p7_found(spark: SparkSession, d: str, risk: float = spikes.RISK) -> DataFrame:
    t, flat = readings(spark, d)
    model = spike_model(t, risk)
    free = F.coalesce(F.col("flat").isNotNull() | F.col("fare_amount").isin(*flat.values()), F.lit(False)) if flat else F.lit(False)
    s = spikes.stuck(t, list(READINGS), "source", "t", ["trip_id"], exempt={"fare_amount": free})
    s = model.apply(s)
    short = F.coalesce((F.col("trip_time_in_secs") < 90) & (F.col("fare_amount") < 4), F.lit(False))
    rules = {
        "trip_distance": (F.col("trip_distance") < 0) | ((F.col("trip_distance") == 0) & ~short),
        "trip_time_in_secs": (F.col("trip_time_in_secs") < 0) | ((F.col("trip_time_in_secs") == 0) & (F.coalesce("elapsed", F.lit(0.0)) > 0)) | ((F.col("trip_time_in_secs") == 0) & (F.col("trip_distance") > 0.1)),
        "fare_amount": F.col("fare_amount") <= 0,
    }
    bad = lambda c: F.coalesce(rules[c], F.lit(False)) | F.col(f"spike_{c}") | F.col(f"stuck_{c}")
    hits = F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in READINGS]))
    return s.select("trip_id", F.explode(hits).alias("field_name"))


def p7_tails(spark: SparkSession, d: str) -> DataFrame:
    """The fitted tail of each medallion and reading: rows, peaks over the threshold, centre and scale, shape, scale and share of the tail, cutoff."""
    h = spike_model(readings(spark, d)[0]).habits
    name = F.element_at(F.array(*[F.lit(c) for c in READINGS]), F.col("field") + 1)
    return h.select(F.col("__source").alias("medallion"), name.alias("field_name"), *[c for c in h.columns if c not in ("__source", "field")])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p2_found, p2_filled, p3_found, p3_gap_settings, p4_percentiles, p4_load_percentiles, p4_within_bound, p5_load_bitmaps, p5_distinct, p5_load_counts, p5_within_bound,
        p6_found, p6_ranges, p6_bounds, p6_masks, p6_divergence, p7_found, p7_tails,
    )}
