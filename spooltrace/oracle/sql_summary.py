"""Oracle SQL (DuckDB) for what a family of transitions applied."""

from spooltrace.oracle import sql_edits, sql_transitions
from spooltrace.oracle.prelude import AS_OF_SQL

_K = sql_transitions.SQL | sql_edits.SQL


def _rows(operation: str, key: str, record: str, result: str, where: str = "TRUE") -> str:
    body = _K[key].strip()
    inner = f"WITH nothing AS (SELECT 1) {body}" if body.startswith(",") else body
    return (f"SELECT '{operation}' AS operation, CAST({record} AS BIGINT) AS record_id, CAST({result} AS VARCHAR) AS result "
            f"FROM ({inner}) y WHERE {where}")


_EDIT = "field_name || '=' || new_value"
_FAMILIES = {
    "apply_orders": [
        _rows("create", "apply_order_create", "id", "status"), _rows("re-create", "apply_recreate_orders", "id", "notes"),
        _rows("cancel", "apply_order_cancel", "id", "notes", f"status = 'Canceled' AND updated_at = {AS_OF_SQL}"),
        _rows("line", "apply_order_line_diff_audit", "record_id", _EDIT)],
    "apply_mounts": [
        _rows("mount", "apply_mount", "id", "remaining_weight"),
        _rows("unmount", "apply_unmount", "id", "status", f"unmounted_at = {AS_OF_SQL}"),
        _rows("acclimatize", "apply_acclimatize", "id", "status"), _rows("restore", "apply_restore_mount_audit", "record_id", _EDIT),
        _rows("weight", "apply_weight_update", "record_id", _EDIT), _rows("delete", "apply_delete_acclimatization", "record_id", _EDIT)],
    "apply_sku_specs": [
        _rows("create", "apply_sku_create", "id", "sku"), _rows("rejected", "apply_sku_create_rejected", "NULL", "sku || ': ' || why"),
        _rows("update", "apply_sku_update_audit", "record_id", _EDIT), _rows("specs", "apply_print_specs_audit", "record_id", _EDIT)],
    "apply_materials": [
        _rows("lid", "apply_new_lids", "id", "serial_number"), _rows("seal", "apply_new_seals", "id", "serial_number"),
        _rows("spool", "apply_new_spools", "id", "serial_number"), _rows("customer", "apply_new_customers", "id", "customer_name"),
        _rows("rejected", "apply_new_lids_rejected", "NULL", "serial_number || ': ' || why"),
        _rows("rejected", "apply_new_seals_rejected", "NULL", "serial_number || ': ' || why"),
        _rows("rejected", "apply_new_customers_rejected", "NULL", "customer_name || ': ' || why")],
}
SQL = {key: " UNION ALL ".join(parts) for key, parts in _FAMILIES.items()}
