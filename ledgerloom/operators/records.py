"""The record store on tables: listing, duplicates, insert, patch, delete, push state, ERP payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import ERP_WIDTHS, fit_width, strip
from ledgerloom.sources.scratch import written

# Record column to ERP field.
VENDOR_ERP = {
    "vendor_name": "Name", "address_1": "Address", "city": "City", "state": "County", "country": "Country_Region_Code", "pin_code": "Post_Code", "telephone_1": "Phone_No",
    "telephone_2": "MobilePhoneNo", "email": "E_Mail", "website": "Home_Page", "pan": "PAN_Number", "gst_no": "GST_Number",
}
CUSTOMER_ERP = {
    "company_name": "Name", "contact_name": "Contact", "billing_address": "Address", "city": "City", "state": "County", "country": "Country_Region_Code", "zip_code": "Post_Code",
    "phone_number": "Phone_No", "email_id_to": "E_Mail", "pan_number": "PAN_Number", "gst_registration_number": "GST_Number",
}


def page(records: DataFrame, limit: int = 100, offset: int = 0, newest: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first; limits beyond 500 and negative offsets are refused."""
    if not 0 < limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return records.orderBy(F.desc(newest), F.desc(key)).offset(offset).limit(limit)


def blank_to_null(records: DataFrame, columns: list[str]) -> DataFrame:
    """Blank identities are null, so that uniqueness does not apply to them."""
    return records.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in columns})


def duplicates(incoming: DataFrame, records: DataFrame, keys: tuple[str, ...], key: str = "id", exclude: str | None = None) -> DataFrame:
    """Adds existing_id and clash (the column): the first of ``keys`` that is taken, smallest id. Null keys clash with nothing.

    One equi-join per key against the smallest id of each value (with ``exclude`` the two smallest): partial aggregations, so
    hot values neither gather nor multiply rows."""
    out = incoming
    for k in keys:
        own = records.where(F.col(k).isNotNull()).select(F.col(k).alias(f"__{k}"), F.col(key).alias("__id"))
        least = own.groupBy(f"__{k}").agg(F.min("__id").alias(f"__one_{k}"))
        if exclude:
            more = own.join(least, f"__{k}").where(F.col("__id") > F.col(f"__one_{k}")).groupBy(f"__{k}").agg(F.min("__id").alias(f"__two_{k}"))
            least = least.join(more, f"__{k}", "left")
        out = out.join(least, F.col(k) == F.col(f"__{k}"), "left")

    def first(k: str) -> Column:
        one = F.col(f"__one_{k}")
        return F.when(one.eqNullSafe(F.col(exclude)), F.col(f"__two_{k}")).otherwise(one) if exclude else one

    found = F.coalesce(*[F.when(first(k).isNotNull(), F.struct(first(k).alias("id"), F.lit(k).alias("on"))) for k in keys])
    return out.withColumn("__f", found).select(*incoming.columns, F.col("__f.id").alias("existing_id"), F.col("__f.on").alias("clash"))


def accepted_in_order(claims: DataFrame) -> DataFrame:
    """(row) of those that a store would accept if they came one by one: a row is refused if a value that it claims is taken by an
    earlier accepted one. ``claims`` are (row, kind, value), rows numbered in their order.

    Rounds until nothing is open: a row that comes first for all its values is accepted, and all others that claim one of these
    are refused. Each round is written, and rows' other columns take no part. A row waits only for earlier rows that share a value with it,
    so there are as many rounds as the longest such chain has accepted rows; a hot value is settled as soon as its first row is."""
    open_, done, rounds = written(claims, "insert-claims"), claims.select("row").limit(0), 0
    while not open_.isEmpty():
        rounds += 1
        least = open_.groupBy("kind", "value").agg(F.min("row").alias("first"))
        marked = written(open_.join(least, ["kind", "value"]), "insert-marked")
        now = marked.groupBy("row").agg(F.bool_and(F.col("row") == F.col("first")).alias("own")).where("own").select("row")
        now = written(now, "insert-accepted")
        taken = marked.where(F.col("row") == F.col("first")).join(now, "row").select("kind", "value")
        out = marked.join(taken, ["kind", "value"], "left_semi").select("row").distinct()
        open_ = written(marked.join(out, "row", "left_anti").select("row", "kind", "value"), "insert-claims")
        done = done.unionByName(now)
        if rounds % 16 == 0:
            done = written(done, "insert-done")
    return done


def insert(
    incoming: DataFrame, records: DataFrame, keys: tuple[str, ...], required: str, order: str, key: str = "id", owner: str | None = None, owners: DataFrame | None = None
) -> DataFrame:
    """Incoming rows with ``outcome``, ``clash`` (the column) and ``existing_id``.

    missing_required (``required`` is null or empty), unknown_owner (``owner`` names none of ``owners``, which has the same
    column), conflict (a key is taken in the store, or by an earlier row that is accepted), accepted: what a store would answer
    that takes the rows one by one. Null keys clash with nothing. ``order`` is unique."""
    told = duplicates(incoming, records, keys, key)
    if owner and owners is not None:
        known = owners.select(F.col(owner).alias("__owner")).distinct()
        told = told.join(known, F.col(owner) == F.col("__owner"), "left").withColumn("__lost", F.col(owner).isNotNull() & F.col("__owner").isNull()).drop("__owner")
    else:
        told = told.withColumn("__lost", F.lit(False))
    outcome = F.when(F.coalesce(F.col(required), F.lit("")) == "", "missing_required").when(F.col("__lost"), "unknown_owner").when(F.col("clash").isNotNull(), "conflict")
    told = written(told.withColumn("outcome", outcome).drop("__lost"), "insert-judged")
    claimed = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("value"))) for i, k in enumerate(keys)]))
    claims = told.where("outcome IS NULL").select(F.col(order).alias("row"), F.explode(claimed).alias("c")).select("row", "c.kind", "c.value")
    accepted = accepted_in_order(claims)
    # The first key of a refused row that an earlier accepted row holds; rows that claim nothing are accepted.
    holders = claims.join(accepted, "row").select(F.col("row").alias("holder"), "kind", "value")
    held = claims.join(holders, ["kind", "value"]).where("holder < row").groupBy("row").agg(F.min("kind").alias("kind")).select(F.col("row").alias("__row"), F.col("kind").alias("__kind"))
    out = told.join(held, F.col(order) == F.col("__row"), "left")
    taken = F.get(F.array(*map(F.lit, keys)), F.col("__kind"))
    return out.select(
        *incoming.columns, F.coalesce("outcome", F.when(taken.isNotNull(), "conflict").otherwise("accepted")).alias("outcome"),
        F.when(F.col("outcome").isNull(), taken).when(F.col("outcome") == "conflict", F.col("clash")).alias("clash"), F.when(F.col("outcome") == "conflict", F.col("existing_id")).alias("existing_id"),
    )


def stored(accepted: DataFrame, now: Column | None = None) -> DataFrame:
    """Accepted rows with the store's defaults: created_at and updated_at now, bc_status not_pushed, each where null or absent."""
    now = F.current_timestamp() if now is None else now
    given = lambda c, v: F.coalesce(F.col(c), v) if c in accepted.columns else v
    return accepted.withColumns({"created_at": given("created_at", now), "updated_at": given("updated_at", now), "bc_status": given("bc_status", F.lit("not_pushed"))})


def violations(records: DataFrame, unique: str) -> DataFrame:
    """Values of a unique column that occur more than once."""
    return records.where(F.col(unique).isNotNull()).groupBy(unique).agg(F.count("*").alias("n")).where("n > 1")


def patch(records: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Only sent keys change: ``changes`` has the key and a map ``sent``; a sent null sets null."""
    c = changes.select(F.col(key).alias("__key"), "sent")
    joined = records.join(c, F.col(key) == F.col("__key"), "left")
    new = {k: F.when(F.coalesce(F.map_contains_key("sent", k), F.lit(False)), F.try_element_at("sent", F.lit(k))).otherwise(F.col(k)) for k in columns}
    return joined.withColumns(new).select(*records.columns)


def delete(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return records.join(ids.select(key), key, "left_anti").select(*records.columns)


def upsert(records: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rewrite with the incoming rows in place of those of the same key (plain files know no MERGE)."""
    return delete(records, incoming, key).unionByName(incoming.select(*records.columns))


def mark_pushed(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """not_pushed to pushed, once: adds ``outcome`` ok, conflict (already pushed) or untouched."""
    asked = ids.select(F.col(key).alias("__key")).distinct()
    joined = records.join(asked, F.col(key) == F.col("__key"), "left")
    outcome = F.when(F.col("__key").isNull(), "untouched").when(F.col("bc_status") == "pushed", "conflict").otherwise("ok")
    return joined.withColumn("outcome", outcome).withColumn("bc_status", F.when(F.col("outcome") == "ok", "pushed").otherwise(F.col("bc_status"))).select(*records.columns, "outcome")


def erp_payload(records: DataFrame, mapping: dict[str, str], joined: tuple[str, ...] = (), groups: dict[str, str] | None = None) -> DataFrame:
    """The ERP's fields: blanks null (left out of JSON), values cut to the ERP's widths, cut fields listed."""
    whole = {erp: F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c, erp in mapping.items() if c in records.columns}
    if joined:
        parts = F.array(*[F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in joined])
        whole["Address_2"] = F.nullif(F.array_join(F.array_compact(parts), ", "), F.lit(""))
    cut = F.array_compact(F.array(*[F.when(F.length(v) > ERP_WIDTHS[erp], erp) for erp, v in whole.items() if erp in ERP_WIDTHS]))
    fields = {erp: fit_width(v, ERP_WIDTHS[erp]) if erp in ERP_WIDTHS else v for erp, v in whole.items()}
    extra = {k: F.lit(v) for k, v in (groups or {}).items() if v}
    return records.select("id", F.lit("").alias("No"), *[v.alias(k) for k, v in (fields | extra).items()], cut.alias("truncated_fields"))


def payload_json(payload: DataFrame) -> DataFrame:
    own = [c for c in payload.columns if c not in ("id", "truncated_fields")]
    return payload.select("id", F.to_json(F.struct(*own), {"ignoreNullFields": "true"}).alias("body"), "truncated_fields")


def filters(records: DataFrame, **equal: str | int) -> DataFrame:
    for c, v in equal.items():
        records = records.where(F.col(c) == F.lit(v))
    return records


def newest_per(records: DataFrame, by: str, order: str, key: str = "id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order), F.desc(key))
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
