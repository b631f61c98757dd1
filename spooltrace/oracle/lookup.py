"""Building blocks of the oracle SQL: output columns as independent look-ups.

An oracle states what each output column holds, one column at a time, as a
scalar look-up from a base row. It shares neither join order nor structure
with the Spark plans it checks.
"""

from __future__ import annotations


def by_id(table: str, column: str, key: str) -> str:
    """Column of the row of ``table`` whose id is ``key``."""
    return f"(SELECT z.{column} FROM x_{table} z WHERE z.id = {key})"


def of_unit(table: str, column: str, unit: str = "u.id") -> str:
    """Column of the satellite row of a unit."""
    return f"(SELECT z.{column} FROM x_{table} z WHERE z.product_tracking_id = {unit})"


def report(columns: dict[str, str], base: str, where: list[str] | None = None) -> str:
    """SELECT of the columns in order of name."""
    body = ",\n  ".join(f"{expr} AS {name}" for name, expr in sorted(columns.items()))
    tail = "\nWHERE " + " AND ".join(where) if where else ""
    return f"SELECT {body}\nFROM {base}{tail}"


def plain(alias: str, *names: str) -> dict[str, str]:
    return {n: f"{alias}.{n}" for n in names}


# the chain from a unit to its harvest, request and ordered sku
HARVEST = {n: by_id("product_harvest", n, "u.harvest_id") for n in
           ("id", "request_id", "print_date", "printed_by", "lid_id", "filament_mounting_id")}
REQUEST = {n: by_id("product_requests", n, HARVEST["request_id"]) for n in
           ("id", "sku_id", "status", "requested_at", "lot_number")}
UNITS = "x_product_tracking u"


def stage(column: str = "stage_name", key: str = "u.current_stage_id") -> str:
    return by_id("lifecycle_stages", column, key)


def sku(column: str, key: str) -> str:
    return by_id("product_skus", column, key)


def type_name(sku_key: str) -> str:
    return by_id("product_types", "name", sku("product_type_id", sku_key))


def user(key: str) -> str:
    return by_id("users", "display_name", key)


def place(key: str, column: str = "location_name") -> str:
    return by_id("storage_locations", column, key)


def present(*keys: str) -> list[str]:
    """The rows of an inner join are those whose keys lead somewhere."""
    return [f"{k} IS NOT NULL" for k in keys]
