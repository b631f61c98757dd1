"""Oracle SQL (DuckDB) for the catalogue queries, over seeds and rows derived from the supplied tables."""

import re

from spooltrace.oracle.sql_materials import SQL as _M
from spooltrace.oracle.sql_operations import SQL as _G
from spooltrace.oracle.sql_sales import SQL as _H

TABLES = """
xc_product_types AS (SELECT * FROM x_product_types UNION ALL
  SELECT 1000 + min(p_partkey), p_type, min(p_size) <= 40 FROM part GROUP BY p_type),
xc_product_skus AS (SELECT * FROM x_product_skus UNION ALL
  SELECT 1000 + p_partkey, 1 + p_size % 4, 'P' || p_partkey, p_name || ' ' || p_partkey, p_partkey % 2 = 0, p_partkey % 10 = 0,
    1 + p_size % 5, p_retailprice < 1000 FROM part),
xc_product_print_specs AS (SELECT sku_id FROM x_product_print_specs UNION ALL SELECT 1000 + p_partkey FROM part),
xc_storage_locations AS (SELECT * FROM x_storage_locations UNION ALL
  SELECT 1000 + s_suppkey, s_name, 'Partner', 'Nation ' || s_nationkey, s_acctbal > 0 FROM supplier),
xc_printers AS (SELECT * FROM x_printers UNION ALL SELECT 1000 + s_suppkey, 'Printer of ' || s_name, 'Idle', s_acctbal > 0 FROM supplier),
xc_issue_reasons AS (SELECT * FROM x_issue_reasons UNION ALL
  SELECT 1000 + min(event_id), 'EVENT_' || upper(event_type), event_type, 'Events', CASE WHEN min(event_id) % 2 = 0 THEN 'B-Ware' END,
    count(*), TRUE FROM events GROUP BY event_type),
xc_issue_contexts AS (SELECT * FROM x_issue_contexts UNION ALL SELECT 1000 + r_regionkey, r_name FROM region),
xc_issue_reason_contexts AS (SELECT * FROM x_issue_reason_contexts UNION ALL
  SELECT 1000 + min(event_id), 1000 + min(event_id), 1000 + min(event_id) % 5 FROM events GROUP BY event_type),
xc_sku_bom AS (SELECT * FROM x_sku_bom UNION ALL
  SELECT 1000 + p_partkey, 1001 + p_partkey, 1 + p_size % 3 FROM part WHERE p_partkey % 10 = 0 UNION ALL
  SELECT 1000 + p_partkey, 1010 + p_partkey, 2 FROM part WHERE p_partkey % 100 = 0)
""".strip()

_NAMES = re.findall(r"^xc_(\w+) AS", TABLES, re.M)


def _over_catalogue(body: str) -> str:
    body = re.sub(r"\bx_(" + "|".join(_NAMES) + r")\b", r"xc_\1", body).strip()
    if body.startswith(", RECURSIVE "):
        return f", RECURSIVE {TABLES}, " + body[len(", RECURSIVE "):]
    return f", {TABLES}\n{body}"


SQL = {n: _over_catalogue(body) for n, body in {
    **{n: _M[n] for n in ("storage_locations", "printers")},
    **{n: _G[n] for n in ("requestable_skus", "reasons", "contexts", "reasons_for_context")},
    **{n: _H[n] for n in ("active_skus", "orderable_types", "product_types", "bom_expand", "skus_with_specs_flag")},
}.items()}

_EVERY = """SELECT w.context_code, r.id, r.reason_code, r.reason_label, r.category, r.default_outcome
FROM xc_issue_reason_contexts l, xc_issue_reasons r, xc_issue_contexts w WHERE r.id = l.reason_id AND w.id = l.context_id"""
SQL["reasons_for_every_outcome"] = f", {TABLES}\n{_EVERY}"
SQL["reasons_for_quarantine"] = (f", {TABLES}\n{_EVERY} AND r.is_active AND w.context_code = 'AdHoc' "
                                 "AND COALESCE(r.default_outcome, 'Quarantine') = 'Quarantine'")
