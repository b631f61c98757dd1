"""Name -> query wiring used by ``__spark_entry__`` and ``bench.py``.

Each entry takes (spark, sf_dir), derives the domain tables from the
supplied Parquet (``Tables``) and runs one library operator on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spooltrace.plans import materials as M
from spooltrace.plans import operations as G
from spooltrace.plans import etl as E
from spooltrace.plans import generic as CG
from spooltrace.plans import legacy as I
from spooltrace.plans import transitions as K
from spooltrace.plans import transitions_edits as KE
from spooltrace.plans import transitions_summary as KS
from spooltrace.operators.constraints import command_report, constraint_report
from spooltrace.sources import seeds as S
from spooltrace.sources import staging as A
from spooltrace.plans import sales as H
from spooltrace.plans import scalars as FX
from spooltrace.plans import views
from spooltrace.session import materialize
from spooltrace.sources.catalogue import Catalogue
from spooltrace.sources.fixtures import AS_OF, CUTOFF, Tables

Query = Callable[[SparkSession, str], DataFrame]


def _q(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir), **kw)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _catalogue(f, *args, **kw):
    """A query over the catalogue in use: seeds and rows derived from the supplied tables."""
    return lambda spark, sf: f(Catalogue(Tables(spark, sf)), *args, **kw)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "v_product_lifecycle": _q(views.v_product_lifecycle),
        "v_filament_status": _q(views.v_filament_status),
        "v_lid_inventory": _q(views.v_lid_inventory),
        "v_product_status": _q(views.v_product_status),
        "v_seal_inventory": _q(views.v_seal_inventory),
        "v_material_usage_summary": _q(views.v_material_usage_summary),
        "v_unified_legacy_prints": _q(views.v_unified_legacy_prints, cutoff=CUTOFF),
        "q_approved_not_shipped": _q(views.q_approved_not_shipped),
        "q_pending_initial_qc": _q(views.q_pending_initial_qc),
        "q_failed_initial_qc": _q(views.q_failed_initial_qc),
        "q_waiting_treatment": _q(views.q_waiting_treatment),
        "q_in_treatment": _q(views.q_in_treatment),
        "q_treatment_failures": _q(views.q_treatment_failures),
        "q_low_inventory_spools": _q(views.q_low_inventory_spools),
        "q_product_status_v1": _q(views.q_product_status_v1),
        "product_status_tracker": _q(views.product_status_tracker),
    }
    q.update({
        "filaments_in_storage": _q(M.filaments_in_storage),
        "mountable_filaments": _q(M.mountable_filaments),
        "acclimatized_ready": _q(M.acclimatized_ready, as_of=AS_OF),
        "acclimatizing_restorable": _q(M.acclimatizing_restorable),
        "available_printers": _q(M.available_printers),
        "mounted_filaments": _q(M.mounted_filaments),
        "mounts_with_weight": _q(M.mounts_with_weight, required_weight=986),
        "request_mount_candidates": _q(M.request_mount_candidates),
        "filament_current_weight": _q(M.filament_current_weight),
        "filament_list": _q(M.filament_list),
        "open_mounts": _q(M.open_mounts),
        "unmounted_mounts": _q(M.unmounted_mounts),
        "weight_health_report": _q(M.weight_health_report),
        "filament_inventory": _q(M.filament_inventory),
        "lid_inventory": _q(M.lid_inventory),
        "seal_inventory": _q(M.seal_inventory),
        "available_lids": _q(M.available_lids),
        "available_seals": _q(M.available_seals),
        "all_lids": _q(M.all_lids),
        "all_seals": _q(M.all_seals),
        "material_usage_summary": _q(M.material_usage_summary),
        "filament_lot_units": _q(M.filament_lot_units),
        "lid_remaining": _q(M.lid_remaining),
        "seal_remaining": _q(M.seal_remaining),
        "material_feasibility": lambda spark, sf: M.material_feasibility(
            Tables(spark, sf), M.pending_demand(Tables(spark, sf))),
        "storage_locations": _catalogue(M.storage_locations_sorted),
        "printers": _catalogue(M.printers_sorted),
        "users": _q(M.users_sorted),
    })

    def adhoc_shelves(db):
        after = E.Versions(db)  # the tables as the ad-hoc quarantines leave them
        out = K.apply_quarantine(db, K.quarantine_commands(db), AS_OF)
        for name in ("product_tracking", "quarantined_products"):
            after.put(name, out[name])
        return G.shelf_options(db, G.needs_storage_adhoc(after), "AdHoc Quarantine")

    q.update({
        "requestable_skus": _catalogue(G.requestable_skus),
        "pending_requests": _q(G.pending_requests),
        "harvested_products": _q(G.harvested_products),
        "printed_pending_qc": _q(G.printed_pending_qc),
        "completed_qc": _q(G.completed_qc),
        "completed_post_treatment_qc": _q(G.completed_post_treatment_qc),
        "qc_evaluation": _q(G.qc_evaluation),
        "treatment_candidates": _q(G.treatment_candidates),
        "needs_storage_harvest": _q(G.needs_storage_harvest),
        "needs_storage_treatment": _q(G.needs_storage_treatment),
        "needs_storage_adhoc": _q(G.needs_storage_adhoc),
        "shipped_batches": _q(G.shipped_batches),
        "batch_products": _q(G.batch_products),
        "stored_products": _q(G.stored_products),
        "shelf_options": lambda spark, sf: G.shelf_options(
            Tables(spark, sf), G.needs_storage_harvest(Tables(spark, sf)), "Post-Harvest QC"),
        "shelf_stage_mismatch": _q(G.shelf_stage_mismatch),
        "mismatch_fixes": _q(G.mismatch_fixes),
        "inspection_sample": _q(G.inspection_sample, seed=7),
        "inspection_all": _q(G.inspection_sample, inspect_all=True),
        "treatment_qc_evaluation": lambda spark, sf: G.treatment_qc_evaluation(
            Tables(spark, sf), G.treatment_inputs(Tables(spark, sf))),
        "expiring_soon": _q(G.expiring_soon, as_of=AS_OF),
        "expired": _q(G.expired, as_of=AS_OF),
        "qm_review": _q(G.qm_review),
        "qm_post_treatment": _q(G.qm_post_treatment),
        "quarantined": _q(G.quarantined),
        "investigated": _q(G.investigated),
        "quarantine_search": _q(G.quarantine_search),
        "quarantine_search_unit": _q(G.quarantine_search, unit=18),
        "quarantine_search_lot": _q(G.quarantine_search, lot="0012"),
        "quarantine_search_batch": _q(G.quarantine_search, batch=141),
        "quarantine_search_mount": _q(G.quarantine_search, mount=21),
        "audit_entries": _q(G.audit_entries),
        "previous_stage": _q(G.previous_stage),
        "reasons": _catalogue(G.reasons),
        "contexts": _catalogue(G.contexts),
        "reasons_for_context": _catalogue(G.reasons_for_context, outcome="B-Ware"),
        "reasons_for_every_outcome": _catalogue(G.reasons_for_context, include_inactive=True),
        "reasons_for_quarantine": _catalogue(G.reasons_for_context, context_code="AdHoc", outcome="Quarantine"),
        "label_data": _q(G.label_data, stage_code="Printed"),
        "label_templates": _q(G.label_templates, stage_code="Printed"),
        "label_data_after_qc": _q(G.label_data, stage_code="HarvestQCComplete"),
        "label_templates_after_qc": _q(G.label_templates, stage_code="HarvestQCComplete"),
        "shelf_options_after_treatment": lambda spark, sf: G.shelf_options(
            Tables(spark, sf), G.needs_storage_treatment(Tables(spark, sf)), "Post-Treatment QC"),
        "shelf_options_adhoc": lambda spark, sf: adhoc_shelves(Tables(spark, sf)),
        "stored_product": _q(G.stored_products, unit=9),
        "record_by_id": _q(I.record_by_id, table="treatment_batch_products", record_id=9),
        "label_id_series": lambda spark, sf: G.label_id_series(G.label_requests(Tables(spark, sf))),
        "effective_access": lambda spark, sf: G.effective_access(
            Tables(spark, sf), G.user_memberships(Tables(spark, sf))),
        "qm_bulk_eligible": _q(G.qm_bulk_eligible),
    })
    q.update({
        "active_skus": _catalogue(H.active_skus),
        "orderable_types": _catalogue(H.orderable_types),
        "customers": _q(H.customers_sorted),
        "product_types": _catalogue(H.product_types_sorted),
        "sales_ready_qty": _q(H.sales_ready_qty, as_of=AS_OF),
        "processing_orders": _q(H.processing_orders_flat),
        "sales_inventory": _q(H.sales_inventory, as_of=AS_OF),
        "sales_summary": _q(H.sales_summary, as_of=AS_OF),
        "sales_summary_by_sku": _q(H.sales_summary, as_of=AS_OF, sku="GEB-CSmTCS"),
        "sales_summary_by_status": _q(H.sales_summary, as_of=AS_OF, status="B-Ware"),
        "sales_summary_by_operator": _q(H.sales_summary, as_of=AS_OF, operator="Op 0008"),
        "canceled_orders": _q(H.canceled_orders),
        "canceled_order_items": _q(H.canceled_order_items),
        "unit_requirements": _q(H.unit_requirements),
        "bom_expand": _catalogue(H.bom_expand),
        "order_components": _q(H.order_components),
        "fifo_pick": _q(H.fifo_pick, as_of=AS_OF, sku_id=1, limit=5),
        "fifo_allocate": lambda spark, sf: H.fifo_allocate(Tables(spark, sf), AS_OF)[1],
        "fifo_allocation_units": lambda spark, sf: H.fifo_allocate(Tables(spark, sf), AS_OF)[0],
        "shipment_sku_items": _q(H.shipment_sku_items, as_of=AS_OF),
        "active_shipments": _q(H.active_shipments),
        "shipment_products": _q(H.shipment_products),
        "shipment_non_serialized": lambda spark, sf: H.shipment_non_serialized(
            Tables(spark, sf), H.shipment_sku_items(Tables(spark, sf), AS_OF)),
        "open_orders": _q(H.open_orders),
        "skus_with_specs_flag": _catalogue(H.skus_with_specs_flag),
        "package_estimate": _q(H.package_estimate),
        "package_totals": _q(H.package_totals),
    })
    for name in ["active_filaments", "archived_filaments", "in_use_filaments", "filaments_with_mount", "low_filaments",
                 "not_acclimatizing", "needs_storage_v1", "qc_passed_v1", "printed_without_qc", "product_record"]:
        q[name] = _q(getattr(I, name))

    for name in FX.NAMES:
        q[name] = _q(getattr(FX, name))
    q.update({
        "assign_ids": _q(CG.assign_ids),
        "global_row_number": _q(CG.global_row_number),
        "merge_upsert": lambda spark, sf: CG.merge_upsert(Tables(spark, sf))[0],
        "merge_outcome": _q(CG.merge_outcome),
        "insert_missing": _q(CG.insert_missing),
        "earliest_per_key": _q(CG.earliest_per_key),
        "next_tracking_id": _q(CG.next_tracking_id),
        "ensure_default_rows": _q(CG.ensure_default_rows),
        "load_staging": _q(CG.load_staging),
        "export_csv": _q(CG.export_csv),
        "stage_headers": _q(CG.stage_headers),
        "stage_dedupe_columns": _q(CG.stage_dedupe_columns),
        "user_lookup": _q(CG.user_lookup),
        "xl_staging_schema": _q(CG.xl_staging_schema),
        "stage_drop_empty": _q(CG.stage_drop_empty),
    })

    def pipe(key, until):
        return lambda spark, sf: E.etl_pipeline(Tables(spark, sf), CUTOFF, AS_OF, until=until)[key]

    def harvest_map(spark, sf):
        db = Tables(spark, sf)
        return E.etl_harvest_map(E.etl_harvest(db, CUTOFF)[2])

    def pipeline_outcome(spark, sf):
        db = Tables(spark, sf)
        return E.pipeline_outcome(db, E.etl_pipeline(db, CUTOFF, AS_OF))

    def tracking_after_e8(db):
        unified = views.v_unified_legacy_prints(db, CUTOFF)
        _, _, cand = E.etl_harvest(db, CUTOFF, unified)
        return E.etl_tracking(db, CUTOFF, E.etl_harvest_map(cand), AS_OF, unified)[0]

    def after_e8(spark, sf, step):
        db = Tables(spark, sf)  # one, so that the sheet is written once
        return step(db, tracking_after_e8(db), CUTOFF)

    def treatment(spark, sf):
        return after_e8(spark, sf, E.etl_treatment_batches)

    def harvest_clone(spark, sf):
        db = Tables(spark, sf)
        harvest_after_e5 = E.etl_harvest(db, CUTOFF)[0]
        return E.etl_harvest_clone(db, harvest_after_e5, CUTOFF)

    q.update({
        "etl_new_shelves": _q(E.etl_new_shelves),
        "ensure_default_locations": _q(E.ensure_default_locations),
        "fallback_user": lambda spark, sf: E.fallback_user(Tables(spark, sf).users),
        "etl_harvest": lambda spark, sf: E.etl_harvest(Tables(spark, sf), CUTOFF)[1],
        "etl_harvest_map": harvest_map,
        "etl_tracking": lambda spark, sf: tracking_after_e8(Tables(spark, sf)),
        "etl_quality_control": lambda spark, sf: after_e8(spark, sf, E.etl_quality_control)[0],
        "etl_post_treatment": lambda spark, sf: after_e8(spark, sf, E.etl_post_treatment)[0],
        "etl_consistency_rules": lambda spark, sf: E.etl_consistency_rules(
            Tables(spark, sf), Tables(spark, sf).product_tracking, AS_OF),
        "etl_pipeline": pipeline_outcome,
        "pipeline_users": pipe("users", "filaments"),
        "pipeline_storage_locations": pipe("storage_locations", "filaments"),
        "pipeline_filaments": pipe("filaments", "filaments"),
        "pipeline_filament_mounting": pipe("filament_mounting", "filament_mounting"),
        "pipeline_filament_acclimatization": pipe("filament_acclimatization", "filament_acclimatization"),
        "pipeline_product_harvest": pipe("product_harvest", "product_harvest"),
        "pipeline_harvest_map": pipe("etl_harvest_map", "product_harvest"),
        "pipeline_product_tracking": pipe("product_tracking", "consistency_rules"),
        "pipeline_product_quality_control": pipe("product_quality_control", "product_quality_control"),
        "pipeline_treatment_batches": pipe("treatment_batches", "treatment_batch"),
        "pipeline_treatment_batch_products": pipe("treatment_batch_products", "treatment_batch"),
        "pipeline_post_treatment_inspections": pipe("post_treatment_inspections", "post_treatment_inspections"),
        "etl_filaments": lambda spark, sf: E.etl_filaments(Tables(spark, sf), CUTOFF, AS_OF)[0],
        "etl_filaments_by_serial": lambda spark, sf: E.etl_filaments_by_serial(Tables(spark, sf), AS_OF)[0],
        "etl_acclimatization": lambda spark, sf: E.etl_acclimatization(Tables(spark, sf), AS_OF)[0],
        "etl_mounting": lambda spark, sf: E.etl_mounting(Tables(spark, sf), AS_OF),
        "etl_harvest_clone": lambda spark, sf: harvest_clone(spark, sf)["mapped"],
        "etl_harvest_clone_unmapped": lambda spark, sf: harvest_clone(spark, sf)["unmapped"],
        "etl_treatment_batches": lambda spark, sf: treatment(spark, sf)["treatment_batches"],
        "etl_treatment_received": lambda spark, sf: treatment(spark, sf)["treatment_batches"].where(
            "received_at IS NOT NULL"),
        "etl_treatment_products": lambda spark, sf: treatment(spark, sf)["new_batch_products"],
    })

    def harvest(spark, sf):
        db = Tables(spark, sf)
        return K.apply_harvest(db, K.harvest_commands(db), AS_OF)

    def next_seq_after_harvest(spark, sf):
        from spooltrace.operators.merge import next_seq_for_lot
        db = Tables(spark, sf)
        new = harvest(spark, sf)
        pending = db.product_requests.where("status = 'Pending'")
        cols = ["harvest_id", "product_code"]
        units = db.product_tracking.select(*cols).unionByName(new["product_tracking"].select(*cols))
        harvests = db.product_harvest.select("id", "request_id").unionByName(new["product_harvest"].select("id", "request_id"))
        return next_seq_for_lot(K.lot_codes(units, harvests, db.product_requests, pending), pending)

    def qc(spark, sf):
        db = Tables(spark, sf)
        return K.apply_qc(db, K.qc_commands(db), AS_OF)

    def tbatch(spark, sf):
        db = Tables(spark, sf)
        return K.apply_treatment_batch(db, K.treatment_batch_commands(db), AS_OF)

    def ptqc(spark, sf):
        db = Tables(spark, sf)
        cmd = K.post_treatment_commands(db)
        return K.apply_post_treatment_qc(db, cmd.drop("batch_id"), 1, AS_OF, batch_ids=cmd.select("batch_id"))

    def storage(spark, sf):
        db = Tables(spark, sf)
        return K.apply_storage(db, K.storage_assignments(db), 1, AS_OF)

    def ship_status(spark, sf):
        db = Tables(spark, sf)
        return K.apply_shipment_status(db, K.shipment_status_commands(db), 1, AS_OF)

    def users_two_rounds(spark, sf):
        db = Tables(spark, sf)
        first = materialize(K.apply_users(db, db.users, K.login_commands(db, 1)))
        return K.apply_users(db, first, K.login_commands(db, 2))

    def qc_edit(spark, sf):
        db = Tables(spark, sf)
        return K.apply_qc_edit(db, K.qc_edit_commands(db), AS_OF)

    def commands_check(spark, sf):
        db = Tables(spark, sf)
        return command_report(K.qc_commands(db), K.post_treatment_commands(db), K.quarantine_commands(db),
                              db.issue_reasons, K.investigation_commands(db), K.customer_commands(db))

    def spool_diff(spark, sf):
        from spooltrace.operators.merge import field_diff
        db = Tables(spark, sf)
        new = E.etl_filaments(db, CUTOFF, AS_OF)[0]
        return field_diff(db.filaments, new, "id", ["serial_number", "lot_number", "location_id", "weight_grams",
                                                    "received_at", "received_by", "qc_result"],
                          date_fields=["received_at"])

    def stage_change(spark, sf):
        db = Tables(spark, sf)
        return K.apply_stage_change(db.product_tracking, K.stage_commands(db), AS_OF)

    q.update({
        "apply_stage_change": lambda spark, sf: stage_change(spark, sf)["product_tracking"],
        "apply_stage_change_history": lambda spark, sf: stage_change(spark, sf)["product_status_history"],
        "apply_status_change": lambda spark, sf: K.apply_status_change(
            Tables(spark, sf).product_tracking, Tables(spark, sf).product_statuses,
            K.status_commands(Tables(spark, sf)), AS_OF),
        "apply_expiry": lambda spark, sf: K.apply_expiry(Tables(spark, sf), AS_OF)["product_tracking"],
        "apply_expiry_history": lambda spark, sf: K.apply_expiry(Tables(spark, sf), AS_OF)["product_status_history"],
        "apply_field_changes": lambda spark, sf: K.apply_field_changes(
            Tables(spark, sf).filaments, "filaments", K.filament_change_commands(Tables(spark, sf)), AS_OF)["filaments"],
        "apply_field_changes_audit": lambda spark, sf: K.apply_field_changes(
            Tables(spark, sf).filaments, "filaments", K.filament_change_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_requests": lambda spark, sf: K.apply_requests(
            Tables(spark, sf).product_requests, K.request_commands(Tables(spark, sf)), AS_OF, batch_start=1),
        "apply_qm_decision": lambda spark, sf: K.apply_qm_decision(
            Tables(spark, sf), K.qm_decisions(Tables(spark, sf)), AS_OF, comment="failed review")["product_tracking"],
        "apply_qm_decision_history": lambda spark, sf: K.apply_qm_decision(
            Tables(spark, sf), K.qm_decisions(Tables(spark, sf)), AS_OF,
            comment="failed review")["product_status_history"],
        "apply_investigation": lambda spark, sf: K.apply_investigation(
            Tables(spark, sf).product_investigations, K.investigation_commands(Tables(spark, sf)), AS_OF),
        "apply_quarantine": lambda spark, sf: K.apply_quarantine(
            Tables(spark, sf), K.quarantine_commands(Tables(spark, sf)), AS_OF)["new_quarantines"],
        "apply_quarantine_reasons": lambda spark, sf: K.apply_quarantine(
            Tables(spark, sf), K.quarantine_commands(Tables(spark, sf)), AS_OF)["quarantined_product_reasons"],
        "apply_quarantine_tracking": lambda spark, sf: K.apply_quarantine(
            Tables(spark, sf), K.quarantine_commands(Tables(spark, sf)), AS_OF)["product_tracking"],
        "apply_quarantine_resolution": lambda spark, sf: K.apply_quarantine_resolution(
            Tables(spark, sf), K.resolution_commands(Tables(spark, sf)), AS_OF)["product_investigations"],
        "apply_quarantine_resolution_quarantine": lambda spark, sf: K.apply_quarantine_resolution(
            Tables(spark, sf), K.resolution_commands(Tables(spark, sf)), AS_OF)["quarantined_products"],
        "apply_quarantine_resolution_tracking": lambda spark, sf: K.apply_quarantine_resolution(
            Tables(spark, sf), K.resolution_commands(Tables(spark, sf)), AS_OF)["product_tracking"],
        "apply_harvest_records": lambda spark, sf: harvest(spark, sf)["product_harvest"],
        "apply_qc_history": lambda spark, sf: qc(spark, sf)["product_status_history"],
        "apply_treatment_batch_history": lambda spark, sf: tbatch(spark, sf)["product_status_history"],
        "apply_post_treatment_qc_history": lambda spark, sf: ptqc(spark, sf)["product_status_history"],
        "apply_post_treatment_qc_reasons": lambda spark, sf: ptqc(spark, sf)["post_treatment_inspection_reasons"],
        "apply_storage_quarantine": lambda spark, sf: storage(spark, sf)["quarantined_products"],
        "apply_shipment_status_history": lambda spark, sf: ship_status(spark, sf)["product_status_history"],
        "apply_shipment_tracking": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["product_tracking"],
        "apply_shipment_history": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["product_status_history"],
        "apply_shipment_orders": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["orders"],
        "apply_qc_edit_history": lambda spark, sf: qc_edit(spark, sf)["product_status_history"],
        "apply_quarantine_history": lambda spark, sf: K.apply_quarantine(
            Tables(spark, sf), K.quarantine_commands(Tables(spark, sf)), AS_OF)["product_status_history"],
        "apply_quarantine_resolution_history": lambda spark, sf: K.apply_quarantine_resolution(
            Tables(spark, sf), K.resolution_commands(Tables(spark, sf)), AS_OF)["product_status_history"],
        "apply_harvest_undo_records": lambda spark, sf: K.apply_harvest_undo(
            Tables(spark, sf), K.harvest_undo_commands(Tables(spark, sf)), AS_OF)["product_harvest"],
        "apply_remove_from_batch_history": lambda spark, sf: K.apply_remove_from_batch(
            Tables(spark, sf), K.remove_from_batch_commands(Tables(spark, sf)), AS_OF)["product_status_history"],
        "apply_delete_acclimatization_table": lambda spark, sf: K.apply_delete_acclimatization(
            Tables(spark, sf), K.delete_acclimatization_commands(Tables(spark, sf)), AS_OF)["filament_acclimatization"],
        "apply_harvest": lambda spark, sf: harvest(spark, sf)["product_tracking"],
        "apply_harvest_usage": lambda spark, sf: harvest(spark, sf)["material_usage"],
        "apply_harvest_requests": lambda spark, sf: harvest(spark, sf)["product_requests"],
        "next_seq_for_lot": lambda spark, sf: next_seq_after_harvest(spark, sf),
        "apply_qc": lambda spark, sf: qc(spark, sf)["product_quality_control"],
        "apply_qc_reasons": lambda spark, sf: qc(spark, sf)["product_quality_control_reasons"],
        "apply_qc_usage": lambda spark, sf: qc(spark, sf)["material_usage"],
        "apply_qc_tracking": lambda spark, sf: qc(spark, sf)["product_tracking"],
        "apply_qc_quarantine": lambda spark, sf: qc(spark, sf)["quarantined_products"],
        "apply_qc_mounts": lambda spark, sf: qc(spark, sf)["filament_mounting"],
        "apply_treatment_batch": lambda spark, sf: tbatch(spark, sf)["treatment_batches"],
        "apply_treatment_batch_links": lambda spark, sf: tbatch(spark, sf)["treatment_batch_products"],
        "apply_treatment_batch_tracking": lambda spark, sf: tbatch(spark, sf)["product_tracking"],
        "apply_post_treatment_qc": lambda spark, sf: ptqc(spark, sf)["post_treatment_inspections"],
        "apply_post_treatment_qc_tracking": lambda spark, sf: ptqc(spark, sf)["product_tracking"],
        "apply_post_treatment_qc_quarantine": lambda spark, sf: ptqc(spark, sf)["quarantined_products"],
        "apply_post_treatment_qc_batches": lambda spark, sf: ptqc(spark, sf)["treatment_batches"],
        "apply_storage": lambda spark, sf: storage(spark, sf)["product_tracking"],
        "apply_storage_history": lambda spark, sf: storage(spark, sf)["product_status_history"],
        "apply_shipment_status": lambda spark, sf: ship_status(spark, sf)["shipments"],
        "apply_shipment_status_tracking": lambda spark, sf: ship_status(spark, sf)["product_tracking"],
        "apply_order_cancel": lambda spark, sf: K.apply_order_cancel(
            Tables(spark, sf), K.cancel_commands(Tables(spark, sf)), AS_OF)["orders"],
        "apply_order_cancel_audit": lambda spark, sf: K.apply_order_cancel(
            Tables(spark, sf), K.cancel_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_order_line_diff": lambda spark, sf: K.apply_order_line_diff(
            Tables(spark, sf), K.line_diff_commands(Tables(spark, sf)), 1, AS_OF)["order_items"],
        "apply_order_line_diff_audit": lambda spark, sf: K.apply_order_line_diff(
            Tables(spark, sf), K.line_diff_commands(Tables(spark, sf)), 1, AS_OF)["audit_log"],
        "apply_recreate_orders": lambda spark, sf: K.apply_recreate_orders(
            Tables(spark, sf), K.recreate_commands(Tables(spark, sf)), 1, AS_OF)["orders"],
        "apply_recreate_order_items": lambda spark, sf: K.apply_recreate_orders(
            Tables(spark, sf), K.recreate_commands(Tables(spark, sf)), 1, AS_OF)["order_items"],
        "apply_shipment": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["shipments"],
        "apply_shipment_units": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["shipment_unit_items"],
        "apply_shipment_sku_items": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["shipment_sku_items"],
        "apply_shipment_orders_audit": lambda spark, sf: K.apply_shipment(Tables(spark, sf), AS_OF)["audit_log"],
        "apply_mount": lambda spark, sf: K.apply_mount(Tables(spark, sf), K.mount_commands(Tables(spark, sf)), AS_OF),
        "apply_unmount": lambda spark, sf: K.apply_unmount(
            Tables(spark, sf).filament_mounting, K.unmount_commands(Tables(spark, sf)), AS_OF),
        "apply_weight_update": lambda spark, sf: K.apply_weight_update(
            Tables(spark, sf), K.weight_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_weight_update_mounts": lambda spark, sf: K.apply_weight_update(
            Tables(spark, sf), K.weight_commands(Tables(spark, sf)), AS_OF)["filament_mounting"],
        "apply_weight_update_spools": lambda spark, sf: K.apply_weight_update(
            Tables(spark, sf), K.weight_commands(Tables(spark, sf)), AS_OF)["filaments"],
        "apply_reasons": lambda spark, sf: K.apply_reasons(Tables(spark, sf), *K.reason_commands(Tables(spark, sf)))[
            "issue_reasons"],
        "apply_reason_contexts": lambda spark, sf: K.apply_reasons(
            Tables(spark, sf), *K.reason_commands(Tables(spark, sf)))["issue_reason_contexts"],
        "apply_users": lambda spark, sf: users_two_rounds(spark, sf),
        "apply_new_lids": lambda spark, sf: K.apply_new_lids(Tables(spark, sf), K.lid_commands(Tables(spark, sf)),
                                                              AS_OF)["lids"],
        "apply_new_lids_rejected": lambda spark, sf: K.apply_new_lids(
            Tables(spark, sf), K.lid_commands(Tables(spark, sf)), AS_OF)["rejected"],
        "apply_new_customers": lambda spark, sf: K.apply_new_customers(
            Tables(spark, sf), K.customer_commands(Tables(spark, sf)))["customers"],
        "apply_new_customers_rejected": lambda spark, sf: K.apply_new_customers(
            Tables(spark, sf), K.customer_commands(Tables(spark, sf)))["rejected"],
        "apply_qc_edit": lambda spark, sf: qc_edit(spark, sf)["product_quality_control"],
        "apply_qc_edit_audit": lambda spark, sf: qc_edit(spark, sf)["audit_log"],
        "apply_qc_edit_tracking": lambda spark, sf: qc_edit(spark, sf)["product_tracking"],
        "apply_qc_edit_quarantine": lambda spark, sf: qc_edit(spark, sf)["quarantined_products"],
        "apply_print_specs": lambda spark, sf: K.apply_print_specs(
            Tables(spark, sf), K.spec_commands(Tables(spark, sf)), AS_OF)["product_print_specs"],
        "apply_print_specs_audit": lambda spark, sf: K.apply_print_specs(
            Tables(spark, sf), K.spec_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_harvest_undo": lambda spark, sf: K.apply_harvest_undo(
            Tables(spark, sf), K.harvest_undo_commands(Tables(spark, sf)), AS_OF)["product_requests"],
        "apply_harvest_undo_audit": lambda spark, sf: K.apply_harvest_undo(
            Tables(spark, sf), K.harvest_undo_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_harvest_undo_tracking": lambda spark, sf: K.apply_harvest_undo(
            Tables(spark, sf), K.harvest_undo_commands(Tables(spark, sf)), AS_OF)["product_tracking"],
        "apply_remove_from_batch": lambda spark, sf: K.apply_remove_from_batch(
            Tables(spark, sf), K.remove_from_batch_commands(Tables(spark, sf)), AS_OF)["treatment_batch_products"],
        "apply_remove_from_batch_tracking": lambda spark, sf: K.apply_remove_from_batch(
            Tables(spark, sf), K.remove_from_batch_commands(Tables(spark, sf)), AS_OF)["product_tracking"],
        "apply_remove_from_batch_audit": lambda spark, sf: K.apply_remove_from_batch(
            Tables(spark, sf), K.remove_from_batch_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_acclimatize": lambda spark, sf: K.apply_acclimatize(
            Tables(spark, sf), K.acclimatize_commands(Tables(spark, sf)), AS_OF),
        "apply_delete_acclimatization": lambda spark, sf: K.apply_delete_acclimatization(
            Tables(spark, sf), K.delete_acclimatization_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_restore_mount": lambda spark, sf: K.apply_restore_mount(
            Tables(spark, sf), K.restore_mount_commands(Tables(spark, sf)), AS_OF)["filament_mounting"],
        "apply_restore_mount_audit": lambda spark, sf: K.apply_restore_mount(
            Tables(spark, sf), K.restore_mount_commands(Tables(spark, sf)), AS_OF)["audit_log"],
        "apply_sku_create": lambda spark, sf: K.apply_sku_create(
            Tables(spark, sf), K.sku_create_commands(Tables(spark, sf)))["new_skus"],
        "apply_sku_create_rejected": lambda spark, sf: K.apply_sku_create(
            Tables(spark, sf), K.sku_create_commands(Tables(spark, sf)))["rejected"],
        "apply_sku_update": lambda spark, sf: K.apply_sku_update(
            Tables(spark, sf), K.sku_activity_changes(Tables(spark, sf)), AS_OF)["product_skus"],
        "apply_sku_update_audit": lambda spark, sf: K.apply_sku_update(
            Tables(spark, sf), K.sku_activity_changes(Tables(spark, sf)), AS_OF)["audit_log"],
        "seed_group_rights": lambda spark, sf: S.seed_group_rights(
            Tables(spark, sf).group_area_rights, Tables(spark, sf).application_areas,
            S.region_group_rows(Tables(spark, sf).src("region")), admin_group="NATION_0"),
        "command_report": lambda spark, sf: commands_check(spark, sf),
        "field_diff": lambda spark, sf: spool_diff(spark, sf),
        "constraint_report": _q(constraint_report),
        "stage_region": lambda spark, sf: A.stage_region(
            Tables(spark, sf).raw_production_sheet, Tables.RAW_START_ROW, Tables.RAW_START_COL),
        "staging_profile": lambda spark, sf: A.staging_profile(Tables(spark, sf).stg_excel_data),
        "content_digest": lambda spark, sf: A.content_digest(Tables(spark, sf).stg_excel_data),
    })

    def edit(run, key):
        return lambda spark, sf: run(Tables(spark, sf))[key]

    def created(db):
        return KE.apply_order_create(db, *KE.order_create_commands(db), AS_OF)

    def storage_edit(db):
        return KE.apply_storage_edit(db, KE.storage_edit_commands(db), AS_OF)

    def spools(db):
        return KE.apply_new_spools(db, KE.spool_commands(db), AS_OF)

    def seals(db):
        return KE.apply_new_seals(db, KE.seal_commands(db), AS_OF)

    def seal_edit(db):
        return KE.apply_seal_edit(db, KE.seal_edit_commands(db), AS_OF)

    def post_edit(db):
        return KE.apply_post_treatment_edit(db, KE.post_treatment_edit_commands(db), AS_OF)

    q.update({
        "apply_post_treatment_edit": edit(post_edit, "post_treatment_inspections"),
        "apply_post_treatment_edit_audit": edit(post_edit, "audit_log"),
        "apply_post_treatment_edit_tracking": edit(post_edit, "product_tracking"),
        "apply_post_treatment_edit_history": edit(post_edit, "product_status_history"),
        "apply_post_treatment_edit_quarantine": edit(post_edit, "quarantined_products"),
        "apply_order_create": edit(created, "orders"),
        "apply_order_create_items": edit(created, "order_items"),
        "apply_request_cancel": lambda spark, sf: KE.apply_request_cancel(
            Tables(spark, sf).product_requests, KE.request_cancel_commands(Tables(spark, sf))),
        "apply_storage_edit": edit(storage_edit, "product_tracking"),
        "apply_storage_edit_history": edit(storage_edit, "product_status_history"),
        "apply_storage_edit_audit": edit(storage_edit, "audit_log"),
        "apply_new_spools": edit(spools, "filaments"),
        "apply_new_spools_rejected": edit(spools, "rejected"),
        "apply_new_seals": edit(seals, "seals"),
        "apply_new_seals_rejected": edit(seals, "rejected"),
        "apply_seal_edit": edit(seal_edit, "seals"),
        "apply_seal_edit_audit": edit(seal_edit, "audit_log"),
    })
    q.update({
        "apply_orders": _q(KS.applied_orders, as_of=AS_OF), "apply_mounts": _q(KS.applied_mounts, as_of=AS_OF),
        "apply_sku_specs": _q(KS.applied_skus, as_of=AS_OF), "apply_materials": _q(KS.applied_materials, as_of=AS_OF),
    })
    return q


def oracle_sql() -> dict[str, str]:
    from spooltrace.oracle import (sql_catalogue, sql_constraints, sql_edits, sql_etl, sql_generic, sql_legacy, sql_materials, sql_operations, sql_sales,
                                   sql_scalars, sql_summary, sql_transitions, sql_views)
    from spooltrace.oracle.prelude import with_prelude

    bodies: dict[str, str] = {}
    bodies.update(sql_views.SQL)
    bodies.update(sql_materials.SQL)
    bodies.update(sql_operations.SQL)
    bodies.update(sql_sales.SQL)
    bodies.update(sql_legacy.SQL)
    bodies.update(sql_etl.SQL)
    bodies.update(sql_transitions.SQL)
    bodies.update(sql_scalars.SQL)
    bodies.update(sql_generic.SQL)
    bodies.update(sql_edits.SQL)
    bodies.update(sql_summary.SQL)
    bodies.update(sql_catalogue.SQL)
    bodies.update(sql_constraints.SQL)
    return {k: with_prelude(v) for k, v in bodies.items()}
