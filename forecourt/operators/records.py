"""Keyed records: upsert, delete, request status, dealer views and reservation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.semantics import any_of, col, filled, strip, truthy
from forecourt.functions.vocabulary import RESERVATION_FIELDS
from forecourt.sources.record_store import materialize


def one_change_per_key(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Changes of one key as one: of each field the latest truthy value by order (without one, the greatest value)."""
    fields = [c for c in changes.columns if c not in (key, order)]
    present = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    last = lambda c: F.max_by(c, F.when(present(c), F.struct(order, c))) if order else F.max(F.when(present(c), F.col(c)))
    return changes.groupBy(key).agg(*(last(c).alias(c) for c in fields)) if fields else changes.select(key).distinct()


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Latest state by key: changed fields that are truthy win, other fields and keys stay; one row a key.

    Several changes of a key count in the given order (see one_change_per_key).
    """
    fields = [c for c in current.columns if c != key]
    changes = one_change_per_key(changes, key, order)
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields if c in changes.columns))
    joined = current.join(new, key, "full_outer")
    pick = lambda c: F.when(F.coalesce(F.col(f"_new_{c}").cast("string") != "", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in changes.columns else F.col(c)
    return joined.select(key, *(pick(c).alias(c) for c in fields))


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def request_status(requests: DataFrame, known: DataFrame, key: str, method: str) -> DataFrame:
    """Adds status: 400 without a key, 409 for creating a known one, 404 for an unknown one, else 200."""
    marks = known.select(key).distinct().withColumn("_known", F.lit(True))
    own = requests.join(marks, key, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    status = F.when(~truthy(F.col(key).cast("string")), 400).when((F.col(method) == "create") & F.col("_known"), 409).when((F.col(method) != "create") & ~F.col("_known"), 404).otherwise(200)
    return own.withColumn("status", status).drop("_known")


def dealer_filter(df: DataFrame, brand: str = "", date: str = "", status: str = "", search: str = "", names: dict[str, str] | None = None) -> DataFrame:
    """Rows by brand (any case), date, status, and a text in name, brand or model (any case); blanks pass."""
    n = {k: (names or {}).get(k, k) for k in ("name", "brand", "model", "date", "status")}
    if brand:
        df = df.where(F.lower(n["brand"]) == brand.lower())
    if date:
        df = df.where(F.col(n["date"]) == date)
    if status:
        df = df.where(F.col(n["status"]) == status)
    if search:
        df = df.where(any_of([F.lower(n[k]).contains(search.lower()) for k in ("name", "brand", "model")]))
    return df


def reservations(df: DataFrame, order: list, status: str = "", brand: str = "", start: str = "", end: str = "", limit: int = 50, offset: int = 0, names: dict[str, str] | None = None) -> DataFrame:
    """A page of the filtered list in a total order."""
    n = {k: (names or {}).get(k, k) for k in ("status", "brand", "date")}
    if status:
        df = df.where(F.col(n["status"]) == status)
    if brand:
        df = df.where(F.col(n["brand"]) == brand)
    if start:
        df = df.where(F.col(n["date"]) >= start)
    if end:
        df = df.where(F.col(n["date"]) <= end)
    return df.orderBy(*order).offset(offset).limit(limit)


def form_errors(fields: dict[str, str], phone: str) -> Column:
    """array<string> of blank fields, and of a phone with other characters than digits."""
    blank = [F.when(~filled(c), F.lit(k)) for k, c in fields.items() if c != phone]
    return F.array_compact(F.array(*blank, F.when(~filled(phone), F.lit("phone")).when(~strip(phone).rlike("^[0-9]+$"), F.lit("phone_digits"))))


def merge_reservation(current: DataFrame, changes: DataFrame, key: str = "phone_number", order: str | None = None) -> DataFrame:
    """Upsert of reservations: five fields and the model may change, the reservation's phone never does."""
    kept = [c for c in changes.columns if c in (key, order, "car_model", *RESERVATION_FIELDS) and c != "reservation_phone_number"]
    return upsert(current, changes.select(*kept), key, order)


def known_models(names: DataFrame, brands: DataFrame, name: str = "name", brand: str = "brand") -> DataFrame:
    """Rows whose name is Brand-Model with a listed brand, with brand and model."""
    split = names.withColumn("_m", split_model(name)).where("_m is not null").select(*names.columns, F.col("_m.brand").alias("brand"), F.col("_m.model").alias("model"))
    return split.join(brands.select(F.col(brand).alias("brand")).distinct(), "brand", "left_semi").select(*names.columns, "brand", "model")


def dealer_rows(df: DataFrame, order: list, info: str = "test_drive_info") -> DataFrame:
    """The nested fields flat, with a 1-based id in the given order.

    The order cuts the rows into ranges; ids come from the counts of the ranges before, so that no task numbers all rows.
    """
    flat = df.select(*(c for c in df.columns if c != info), f"{info}.*")
    return numbered(flat, order, "id")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds a 1-based number in the given total order, by ranges and the counts before them.

    The ordered ranges are written once with each row's range and place, so that counts and rows are of the same ranges
    whatever an adaptive plan would make of them when it runs again.
    """
    part, place, before = (new_name(df, x) for x in ("_part", "_place", "_before"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    own = materialize(ranged.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)), "numbered")
    earlier = F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = own.groupBy(part).count().select(part, earlier.alias(before))
    return own.join(F.broadcast(counts), part).withColumn(name, F.col(before) + F.col(place) + 1).drop(part, place, before)


def new_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_model(name: Column | str) -> Column:
    """struct<brand, model> of Brand-Model; null without a hyphen."""
    c = col(name)
    return F.when(c.contains("-"), F.struct(F.split(c, "-", 2)[0].alias("brand"), F.split(c, "-", 2)[1].alias("model")))
