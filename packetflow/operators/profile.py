"""Column-level data quality profile of loads.

All columns are unpivoted to (load, field, value) and counted once, with map-side combine; null shares, distinct counts,
frequencies, ranges and medians are read from those counts, so a value that fills a third of a table is one row. Loads
are compared with the one before by filled share, mode share, median and population stability index.

Results for odd input: null, empty and blank values are missing; an empty table gives no rows; repeated rows count in the
profile as stored and once in the list of malformed rows; ties of the most frequent value share one count, so the share
is defined; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetflow.functions.text import blank_to_null
from packetflow.session import cut_lineage

FIELDS = ("vehicle_vin", "odometer_reading", "purchase_price", "driver_dob")
#: The standard check-digit weights and letter values of vehicle identification numbers.
VIN_LETTERS, VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
_NUMBER = r"([0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)"


def vin_ok(vin: Column, digits: Column) -> Column:
    """17 characters without I, O, Q and the right check digit; digits is vin with letters replaced by their values."""
    weights = F.array(*[F.lit(w) for w in VIN_WEIGHTS])
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda a, i: a + F.element_at(weights, i) * (F.ascii(F.substr(digits, i, F.lit(1))) - 48))
    check = F.lit("0123456789X").substr(total % 11 + 1, F.lit(1))
    return vin.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(vin, 9, 1) == check)


def _digits(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(F.regexp_extract(value, pattern, group), ",", "")


def odometer_number(value: Column) -> Column:
    """Miles or kilometres as a number; null when malformed."""
    n = _digits(value, rf"(?i)^{_NUMBER} ?(?:mi|miles|km)?$").try_cast("double")
    return F.when(n <= 499_999, n)


def price_number(value: Column) -> Column:
    """Amount as a number; null when malformed."""
    n = _digits(value, rf"^\$? ?({_NUMBER}(?:\.[0-9]{{2}})?)$").try_cast("double")
    return F.when(n.between(500, 400_000), n)


def birth_date(value: Column) -> Column:
    """A real date from 1925 to 2009; null when malformed."""
    us, iso = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    text = F.when(value.rlike(us), F.concat_ws("-", F.regexp_extract(value, us, 3), F.regexp_extract(value, us, 1), F.regexp_extract(value, us, 2))).when(value.rlike(iso), value)
    date = text.try_cast("date")
    return F.when(date.between(F.lit("1925-01-01").cast("date"), F.lit("2009-12-31").cast("date")), date)


def unpivot(extractions: DataFrame, keys: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row and field: keys, field_name, value (stripped; missing is null)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.value").alias("value")) for f in fields])
    return extractions.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.field_name", blank_to_null(F.col("p.value")).alias("value"))


def judged(long: DataFrame) -> DataFrame:
    """With number (odometer, price), date (birth) and well_formed (null when missing)."""
    field, value = F.col("field_name"), F.col("value")
    number = F.when(field == "odometer_reading", odometer_number(value)).when(field == "purchase_price", price_number(value))
    vin = F.when(field == "vehicle_vin", F.regexp_replace(F.upper(value), "[- ]", ""))
    ok = F.when(field == "vehicle_vin", vin_ok(F.col("vin"), F.col("vin_digits"))).when(field == "driver_dob", F.col("date").isNotNull()).otherwise(F.col("number").isNotNull())
    date = F.when(field == "driver_dob", birth_date(value))
    long = long.withColumns({"number": number, "date": date, "vin": vin}).withColumn("vin_digits", F.translate("vin", VIN_LETTERS, VIN_VALUES))
    return long.withColumn("well_formed", F.when(value.isNotNull(), F.coalesce(ok, F.lit(False)))).drop("vin", "vin_digits")


def value_counts(extractions: DataFrame) -> DataFrame:
    """(feed_id, load_no, load_id, field_name, value, n, number, date, well_formed): every distinct value of a load once."""
    keys = ["feed_id", "load_no"]
    long = unpivot(extractions, [*keys, "load_id"])
    return judged(long.groupBy(*keys, "field_name", "value").agg(F.count("*").alias("n"), F.max("load_id").alias("load_id")))


def _medians(counts: DataFrame, keys: list[str], width: int = 1000) -> DataFrame:
    """Exact weighted medians of number: counts by bucket first, then only the buckets that hold the middle ranks.

    No window ever sees more than the buckets of a load or the distinct values of one bucket, however large the load is.
    """
    known = counts.filter("well_formed and number is not null").withColumn("bucket", F.floor(F.col("number") / width))
    buckets = known.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    load, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(*keys, "bucket", "n", F.sum("n").over(load).alias("total"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = buckets.filter((low < F.col("before") + F.col("n")) & (high >= F.col("before"))).select(*keys, "bucket", "total", "before")
    inside = known.join(middle, [*keys, "bucket"]).groupBy(*keys, "bucket", "number").agg(F.sum("n").alias("n"), F.first("total").alias("total"), F.first("before").alias("before"))
    running = W.partitionBy(*keys, "bucket").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(running))
    hit = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("number")))
    return inside.groupBy(*keys).agg(((hit(low) + hit(high)) / 2).alias("median"))


def load_profile(counts: DataFrame) -> DataFrame:
    """Per field and load: rows, filled, distinct values, most frequent count, well-formed count, range, median."""
    keys = ["field_name", "feed_id", "load_no"]
    filled = F.col("value").isNotNull()
    base = counts.groupBy(*keys).agg(
        F.max("load_id").alias("load_id"), F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"), F.count("value").alias("distinct_values"),
        F.coalesce(F.max(F.when(filled, F.col("n"))), F.lit(0)).alias("mode_n"), F.coalesce(F.sum(F.when(F.col("well_formed"), F.col("n"))), F.lit(0)).alias("good"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
    )
    return base.join(_medians(counts, keys), keys, "left")


def compared(profile: DataFrame) -> DataFrame:
    """Each load with whether it differs from the one before in its feed: shifted_fill, shifted_mode, shifted_median."""
    before = W.partitionBy("field_name", "feed_id").orderBy("load_no")
    lagged = profile.withColumns({f"p_{c}": F.lag(c).over(before) for c in ("n_rows", "filled", "mode_n", "good", "median")})
    share, p_share = F.col("filled") / F.col("n_rows"), F.col("p_filled") / F.col("p_n_rows")
    enough = (F.col("filled") >= 20) & (F.col("p_filled") >= 20)
    mode = F.abs(F.col("mode_n") / F.col("filled") - F.col("p_mode_n") / F.col("p_filled"))
    numeric = F.col("field_name").isin("odometer_reading", "purchase_price") & (F.col("good") >= 20) & (F.col("p_good") >= 20)
    moved = (F.col("median") > 1.5 * F.col("p_median")) | (F.col("median") < F.col("p_median") / 1.5)
    flags = {"shifted_fill": (share > 2 * p_share) | (share < p_share / 2), "shifted_mode": enough & (mode > 0.15), "shifted_median": numeric & moved}
    return lagged.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def _classes() -> Column:
    """array<struct<kind, class>>: the classes of a value by value, shape and state.

    Numbers fall into fixed bins of half a doubling, birth dates into five years; other values and malformed ones are classes of their own.
    """
    value, number, date = F.col("value"), F.col("number"), F.col("date")
    state = F.when(value.isNull(), "missing").when(F.col("well_formed"), "well-formed").otherwise("malformed")
    number_bin = F.concat(F.lit("number "), F.floor(2 * F.log2(number + 1)).cast("string"))
    date_bin = F.concat(F.lit("date "), F.floor(F.year(date) / 5).cast("string"))
    exact = F.when(value.isNull(), "missing").when(number.isNotNull(), number_bin).when(date.isNotNull(), date_bin).otherwise(F.concat(F.lit("value "), value))
    shape = F.coalesce(F.regexp_replace(F.regexp_replace(F.upper(value), "[A-Z]+", "A"), "[0-9]+", "9"), F.lit("missing"))
    return F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("class")) for k, c in (("psi", exact), ("psi_shape", shape), ("psi_state", state))])


def stability_index(counts: DataFrame) -> DataFrame:
    """(field_name, feed_id, load_no, psi, psi_shape, psi_state): population stability indexes against the load before.

    psi compares the values, psi_shape their shapes (letters A, digits 9, runs shortened), psi_state the missing, malformed and
    well-formed shares, which many values that occur once would hide in psi. A class absent on one side counts as half a row.
    """
    keys = ["field_name", "feed_id", "load_no"]
    classes = counts.select(*keys, "n", F.explode(_classes()).alias("c")).groupBy(*keys, "c.kind", "c.class").agg(F.sum("n").alias("n"))
    loads = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    loads = loads.withColumns({"p_load_no": F.lag("load_no").over(o := W.partitionBy("field_name", "feed_id").orderBy("load_no")), "p_total": F.lag("total").over(o)}).filter("p_load_no is not null")
    now = classes.join(loads, keys)
    then = classes.withColumnRenamed("n", "p_n").withColumnRenamed("load_no", "p_load_no").join(loads, ["field_name", "feed_id", "p_load_no"])
    both = now.select(*keys, "kind", "class", "total", "p_total", "n").join(then.select(*keys, "kind", "class", F.col("total").alias("t2"), F.col("p_total").alias("pt2"), "p_n"), [*keys, "kind", "class"], "full")
    p, q = F.coalesce("n", F.lit(0.5)) / F.coalesce("total", "t2"), F.coalesce("p_n", F.lit(0.5)) / F.coalesce("p_total", "pt2")
    part = (p - q) * F.log(p / q)
    return both.groupBy(*keys).agg(*[F.sum(F.when(F.col("kind") == k, part)).alias(k) for k in ("psi", "psi_shape", "psi_state")])


def malformed_rows(extractions: DataFrame) -> DataFrame:
    """(field_name, extraction_id) of values that are there and not well-formed; rows delivered again count once."""
    return judged(unpivot(extractions, ["extraction_id"])).filter("not well_formed").select("field_name", "extraction_id").distinct()


def found_quality(extractions: DataFrame) -> DataFrame:
    """(field_name, scope, key_id): malformed rows and loads that differ from the one before."""
    rows = malformed_rows(extractions).select("field_name", F.lit("row").alias("scope"), F.col("extraction_id").alias("key_id"))
    loads = compared(load_profile(cut_lineage(value_counts(extractions)))).filter("shifted_fill or shifted_mode or shifted_median")
    return rows.unionByName(loads.select("field_name", F.lit("load").alias("scope"), F.col("load_id").alias("key_id")).distinct())
