"""Scalar expressions (F1-F34) as ``Column -> Column`` built from native functions.

Everything here compiles to Catalyst expressions and stays inside
whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (vocabularies and rules of the modelled plant).
# ---------------------------------------------------------------------------
FAIL_WORDS = ["FAIL", "FAILED", "NO", "NEIN", "N", "FALSE", "0", "REJECT", "REJECTED"]
PASS_WORDS = ["OK", "PASS", "PASSED", "GOOD", "ACCEPT", "ACCEPTED", "JA", "YES", "Y", "TRUE", "1"]
# inspection result -> business status
QC_TO_BUSINESS = [
    ("Passed", "A-Ware"),
    ("B-Ware", "B-Ware"),
    ("Quarantine", "In Quarantine"),
    ("In Quarantine", "In Quarantine"),
    ("Waste", "Waste"),
]
ACCESS_LEVEL_RANK = [("Read", 1), ("Write", 2), ("Admin", 3)]
ISO_DATE_RE = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,7})?)?)?\s*$"
EXCEL_BASE = "1899-12-30"

c = F.col


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F7
def blank_to_null(x) -> Column:
    return F.nullif(F.trim(_c(x)), F.lit(""))


# Loose shapes, as for dates below: a cast that fails costs an exception per row, so it is only tried where it can hold
# (the cast still decides). Integer text has one run of digits; a date has separators that no number has.
_ONE_RUN_OF_DIGITS = r"^\D*\d+\D*$"
_DATE_LIKE = r"\d[.\-/]\d+[.\-/]\d"


def _try_bigint(x: Column) -> Column:
    return F.when(x.rlike(_ONE_RUN_OF_DIGITS), x.try_cast("bigint"))


def _try_serial(x: Column) -> Column:
    return F.when(~x.rlike(_DATE_LIKE), x.try_cast("double"))


# F2
def parse_bigint_strict(x) -> Column:
    """Plain integer text (spaces allowed around) -> bigint, else NULL."""
    return _try_bigint(_c(x))


# F1
def parse_bigint(x) -> Column:
    """Plain, then with thousands commas removed, then via float -> decimal(38,0); first non-null."""
    raw = blank_to_null(x)
    as_float = raw.try_cast("double")
    via_float = F.when(as_float.isNotNull() & ~F.isnan(as_float),
                       F.round(as_float, 0).try_cast("decimal(38,0)").try_cast("bigint"))
    return F.coalesce(_try_bigint(raw), _try_bigint(F.replace(raw, F.lit(","), F.lit(""))), via_float)


# F3
def parse_decimal_comma(x, precision: int, scale: int) -> Column:
    return F.replace(_c(x), F.lit(","), F.lit(".")).try_cast(f"decimal({precision},{scale})")


# Loose shape of each text format: parsing is only attempted when the text has that shape, which
# avoids a failed-parse exception per row for the other formats (the parser still decides).
_FORMAT_SHAPES = {
    "dd.MM.yyyy": r"^\s*\d{1,2}\.\d{1,2}\.\d{4}\s*$",
    "dd-MM-yyyy": r"^\s*\d{1,2}-\d{1,2}-\d{4}\s*$",
    "MM/dd/yyyy": r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$",
    "dd/MM/yyyy": r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$",
}


def _try_ts(x: Column, fmt: str) -> Column:
    parsed = F.try_to_timestamp(x, F.lit(fmt)).cast("timestamp_ntz")
    shape = _FORMAT_SHAPES.get(fmt)
    return F.when(x.rlike(shape), parsed) if shape else parsed


# F33
def parse_ts_generic(x) -> Column:
    """Style-less conversion, restricted to ISO date/datetime text (a bare number is not a year)."""
    x = _c(x)
    return F.when(x.rlike(ISO_DATE_RE), F.trim(x).try_cast("timestamp_ntz"))


def parse_date_generic(x) -> Column:
    return parse_ts_generic(x).cast("date")


MAX_SERIAL = 2958465  # fixed value: the spreadsheet serial of 9999-12-31


def serial_out_of_range(x) -> Column:
    """True where numeric text is too large or small for a spreadsheet date."""
    return F.coalesce(F.abs(_try_serial(_c(x))) > MAX_SERIAL, F.lit(False))


def excel_serial(x, offset: int = -2) -> Column:
    """Numeric text -> base date + int(value) + offset days (truncating like an int cast).

    Serials beyond +-``MAX_SERIAL`` (9999-12-31) are no dates and give NULL; ``serial_out_of_range`` finds them.
    """
    v = _try_serial(_c(x))
    days = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MAX_SERIAL), v.cast("int") + F.lit(offset))
    base = F.lit(EXCEL_BASE).cast("timestamp_ntz")
    return F.when(days.isNotNull(), F.timestamp_add("DAY", days, base))


# F4
def parse_date_multi(x, serial_offset: int = -2) -> Column:
    """dd.MM.yyyy, dd-MM-yyyy, MM/dd/yyyy, dd/MM/yyyy, spreadsheet serial, ISO; first that parses."""
    x = _c(x)
    return F.coalesce(_try_ts(x, "dd.MM.yyyy"), _try_ts(x, "dd-MM-yyyy"), _try_ts(x, "MM/dd/yyyy"),
                      _try_ts(x, "dd/MM/yyyy"), excel_serial(x, serial_offset), parse_ts_generic(x))


# F5
def parse_date_de(x) -> Column:
    x = _c(x)
    return F.coalesce(_try_ts(x, "dd.MM.yyyy"), parse_ts_generic(x))


# F6
def clean_key(x) -> Column:
    return F.upper(F.trim(F.translate(_c(x), " \t", "  ")))


# F8
def lot_prefix(x) -> Column:
    x = _c(x)
    return F.left(F.when(F.instr(x, "-") > 0, F.substring_index(x, "-", 1)).otherwise(x), F.lit(100))


# F34
def clip_text(x, n: int) -> Column:
    return F.left(_c(x), F.lit(n))


# F9
def pass_fail(x) -> Column:
    u = F.upper(F.trim(F.coalesce(_c(x), F.lit(""))))
    return F.when(u.isin(*FAIL_WORDS), "FAIL").otherwise("PASS")


# F10
def qc_result_matrix(status_qc, second_rate) -> Column:
    s, r = _c(status_qc), _c(second_rate)
    return (F.when(s.isNull() | (s == "FAIL"),
                   F.when(r == "NO", "Waste").when(r == "YES", "B-Ware").otherwise("Waste"))
            .when(s == "PASS", F.when(r == "YES", "B-Ware").otherwise("Passed"))
            .otherwise("Passed"))


# F11
def post_treat_flags(visual_chk, surface, sterilization) -> dict[str, Column]:
    v = F.coalesce(_c(visual_chk) == "PASS", F.lit(False))
    return {
        "visual_pass": v,
        "surface_treated": F.coalesce(_c(surface) == "YES", F.lit(False)),
        "sterilized": F.coalesce(_c(sterilization) == "YES", F.lit(False)),
        "qc_result": F.when(v, "Passed").otherwise("B-Ware"),
    }


# F13
def treatment_status(in_treat) -> Column:
    t = _c(in_treat)
    return F.when(t == "AT GEB", "Inspected").when(t.isin("AT BBF", "YES"), "Shipped")


# F14
def treatment_notes(key, operator) -> Column:
    op = F.nullif(_c(operator), F.lit(""))
    return F.left(F.concat(F.lit("LegacyTreatmentID="), F.coalesce(_c(key), F.lit("")),
                           F.when(op.isNotNull(), F.concat(F.lit("; Operator="), op)).otherwise(F.lit(""))),
                  F.lit(255))


# F15
def base36(n) -> Column:
    n = _c(n)
    return F.when(n < 0, F.raise_error(F.lit("base36: n must be non-negative"))).otherwise(
        F.upper(F.conv(n.cast("string"), 10, 36)))


# F16
def lot_number(ts, batch_no) -> Column:
    yy = F.lpad((F.year(_c(ts)) % 100).cast("string"), 2, "0")
    cc = base36(batch_no)
    return F.concat(yy, F.when(F.length(cc) < 2, F.lpad(cc, 2, "0")).otherwise(cc))


# F17
def product_code(lot, seq) -> Column:
    lot = _c(lot)
    return F.when(lot.isNull() | (F.length(lot) < 4),
                  F.raise_error(F.lit("Request lot_number (YYCC) is missing/invalid"))).otherwise(
        F.format_string("%s%04d", lot, _c(seq).cast("long")))


# F18
def _initials_part(word: Column) -> Column:
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    raw = F.when(F.length(letters) == 1, F.concat(letters, letters)).otherwise(F.left(letters, F.lit(2)))
    return F.when(F.length(letters) == 0, F.lit("Xx")).otherwise(
        F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 1))))


def name_initials(display_name) -> Column:
    parts = F.split(F.trim(_c(display_name)), r"\s+")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    empty = _c(display_name).isNull() | (F.trim(_c(display_name)) == "")
    return F.when(empty, F.lit("XxXx")).otherwise(F.concat(_initials_part(first), _initials_part(last)))


# F19
def ready_at(moved_at) -> Column:
    return F.timestamp_add("DAY", F.lit(2), _c(moved_at))


# F20
def harvest_qc_rule(weight, pressure, avg_weight, buffer) -> Column:
    avg = F.coalesce(_c(avg_weight).cast("double"), F.lit(0.0))
    tol = F.coalesce(_c(buffer).cast("double"), F.lit(0.0))
    w, p = _c(weight).cast("double"), _c(pressure).cast("double")
    return (F.when(p >= 6, "Waste")
            .when((w > 0) & ((w < avg - tol) | (w > avg + tol)), "B-Ware")
            .otherwise("Passed"))


# F21
def treatment_qc_rule(prior_result, surface_required, surface_treated, sterilized, quarantine, visual_pass) -> Column:
    def t(x):
        return F.coalesce(_c(x), F.lit(False))
    return (F.when(~t(sterilized) | ~t(visual_pass), "Waste")
            .when(t(surface_required) & ~t(surface_treated), "Waste")
            .when(t(quarantine), "Quarantine")
            .when((_c(prior_result) == "A-Ware") & t(surface_treated) & t(sterilized) & t(visual_pass), "Passed")
            .otherwise("B-Ware"))


# F22
def business_status(inspection_result, default: str) -> Column:
    r = _c(inspection_result)
    out = None
    for k, v in QC_TO_BUSINESS:
        out = F.when(r == k, v) if out is None else out.when(r == k, v)
    return out.otherwise(F.lit(default))


# F24
def qm_target_stage(resolution, stage_name) -> Column:
    r, s = _c(resolution), _c(stage_name)
    return (F.when(r == "Waste", "Discarded Product")
            .when(s == "Harvest QC Complete; Pending Storage", "QM Approved for Treatment; Pending Treatment")
            .when((r == "B-Ware") & (s == "Returned / Post-Treatment QC; Pending Storage"), "Internal Use/Client")
            .when(s == "Returned / Post-Treatment QC; Pending Storage", "QM Approved For Sales; Pending Sales")
            .otherwise(s))


# F25
def resolution_status(resolution) -> dict[str, Column]:
    r = _c(resolution)
    inv = F.when(r == "Passed", "Cleared A-Ware").when(r == "B-Ware", "Cleared B-Ware").otherwise("Disposed")
    return {"investigation_status": inv,
            "quarantine_status": F.when(inv == "Disposed", "Disposed").otherwise("Released")}


# F26
def resolution_note(ts, resolution, comment) -> Column:
    base = F.concat(F.lit("[Resolution "), F.date_format(_c(ts), "yyyy-MM-dd HH:mm"), F.lit("]: "), _c(resolution))
    cm = _c(comment)
    return F.when(cm.isNotNull() & (cm != ""), F.concat(base, F.lit(" — "), cm)).otherwise(base)


def append_note(old, note) -> Column:
    o = _c(old)
    return F.when(o.isNull() | (o == ""), _c(note)).otherwise(F.concat(o, F.lit("\r"), _c(note)))


# F27
def weight_health(w) -> Column:
    w = _c(w)
    return F.when(w.isNull(), F.lit(None).cast("string")).when(w < 500, "Critical").when(w < 2500, "Low").otherwise("OK")


# F28
def label_expiry(print_date) -> dict[str, Column]:
    exp = F.add_months(_c(print_date).cast("date"), 24)
    return {"expiry_date": F.date_format(exp, "yyyy-MM-dd"),
            "expiry_label": F.concat(F.month(exp).cast("string"), F.lit(" / "), F.year(exp).cast("string"))}


# F29
def required_weight(avg, buffer) -> Column:
    return F.coalesce(_c(avg) + _c(buffer) + F.lit(10), F.lit(0)).cast("decimal(10,2)")


# F30
def expanded_qty(qty, is_bundle, pack_qty, override) -> Column:
    return F.when(F.coalesce(_c(is_bundle), F.lit(False)) & ~F.coalesce(_c(override), F.lit(False)),
                  _c(qty) * _c(pack_qty)).otherwise(_c(qty))


# F31
def level_rank(level) -> Column:
    lv = _c(level)
    out = None
    for k, v in ACCESS_LEVEL_RANK:
        out = F.when(lv == k, v) if out is None else out.when(lv == k, v)
    return out.otherwise(0)


def has_level(user_level, required) -> Column:
    return level_rank(user_level) >= level_rank(required)


# F32
def reason_matches_outcome(default_outcome, outcome) -> Column:
    if outcome is None:
        return F.lit(True)
    o = _c(outcome) if not isinstance(outcome, str) else F.lit(outcome)
    return _c(default_outcome).isNull() | (_c(default_outcome) == o)


# F12
def legacy_status_name(qc, second_rate) -> Column:
    q, r = _c(qc), _c(second_rate)
    return (F.when(q == "FAIL", "Waste").when((q == "PASS") & (r == "YES"), "B-Ware")
            .when((q == "PASS") & (r == "NO"), "A-Ware"))
