"""Staging helpers (A1-A3, A5-A8, A14): header normalization, profiling, change digest, sinks.

Header work is metadata only (``toDF``); profiling and the digest are one
aggregate pass each. Writers go to Parquet/CSV directories.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spooltrace.operators.ranking import row_number_within

c = F.col


def normalize_header(name: str) -> str:
    """A1: newline->space, trim, lower, double space->one (one pass), space/'-'->'_', drop '[' and ']'."""
    s = str(name).replace("\n", " ").strip().lower()
    s = s.replace("  ", " ")
    s = s.replace(" ", "_").replace("-", "_")
    return s.replace("[", "").replace("]", "")


def dedupe_headers(names: list[str]) -> list[str]:
    """A2: repeated headers become x, x_1, x_2 ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}_{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    assert len(set(out)) == len(out), "duplicate headers after renaming"
    return out


def normalize_header_text(col: Column) -> Column:
    """A1 as an expression."""
    s = F.lower(F.btrim(F.replace(col, F.lit("\n"), F.lit(" ")), F.lit(" \t\r\n\x0b\x0c")))
    s = F.replace(s, F.lit("  "), F.lit(" "))
    return F.translate(F.translate(s, " -", "__"), "[]", "")


def header_cells(cells: DataFrame) -> DataFrame:
    """The header of every sheet of a cell table (sheet, row_no, position, value): its first row with two filled cells.

    (sheet, position, raw_header, normalized); blank header cells name no column and are left out.
    """
    filled = cells.where(F.btrim(F.coalesce("value", F.lit(""))) != "")
    rows = filled.groupBy("sheet", "row_no").count().where(c("count") >= 2)
    head = rows.groupBy(c("sheet").alias("_s")).agg(F.min("row_no").alias("_row"))
    found = filled.join(head, (c("sheet") == c("_s")) & (c("row_no") == c("_row")))
    return found.select("sheet", "position", F.btrim("value", F.lit(" \t\r\n\x0b\x0c")).alias("raw_header"),
                        normalize_header_text(c("value")).alias("normalized"))


def number_repeats(headers: DataFrame) -> DataFrame:
    """A2 on ``header_cells``: (sheet, position, final_name, clash): repeats become x, x_1, x_2 ... by position.

    Numbering is range-partitioned, so a name that fills much of a sheet is not one task. ``clash`` marks names that are
    still not unique in their sheet because the sheet itself holds such a numbered name.
    """
    ranked = row_number_within(headers.select("sheet", "position", "normalized"), ["sheet", "normalized"], ["position"], col="_n")
    named = ranked.select("sheet", "position", F.when(c("_n") == 1, c("normalized")).otherwise(
        F.concat("normalized", F.lit("_"), (c("_n") - 1).cast("string"))).alias("final_name"))
    often = named.groupBy(c("sheet").alias("_s"), c("final_name").alias("_f")).count().where(c("count") > 1)
    met = named.join(often, (c("sheet") == c("_s")) & (c("final_name") == c("_f")), "left")
    return met.select("sheet", "position", "final_name", c("_s").isNotNull().alias("clash"))


def stage_headers(df: DataFrame) -> DataFrame:
    """A1 + A2 on a DataFrame's column names."""
    return df.toDF(*dedupe_headers([normalize_header(x) for x in df.columns]))


def stage_drop_empty(df: DataFrame) -> DataFrame:
    """A3: drop 'Unnamed*' columns and all-null rows."""
    keep = [x for x in df.columns if not re.match(r"(?i)^unnamed", x)]
    return df.select(*keep).na.drop(how="all")


def xl_staging_schema(columns: list[str]) -> T.StructType:
    """All-string schema for a staging sheet."""
    return T.StructType([T.StructField(x, T.StringType(), True) for x in columns])


def read_staging(spark: SparkSession, path: str, columns: list[str], fmt: str = "csv") -> DataFrame:
    """Read a staging drop with the all-string schema."""
    reader = spark.read.schema(xl_staging_schema(columns))
    return reader.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else reader.parquet(path)


def load_staging(df: DataFrame, path: str, truncate: bool = True) -> None:
    """A5: replace (or append to) a staging table; empty input is an error."""
    if df.isEmpty():
        raise ValueError("refusing to stage an empty extract")
    df.write.mode("overwrite" if truncate else "append").parquet(path)


CSV_OPTIONS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str) -> None:
    """Write rows as CSV with a header (cell text kept as is, spaces included)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def content_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table: (rows, sum and xor of the first 60 bits of each row's md5).

    A row is hashed as its cells' texts with a separator; a NULL differs from
    an empty text. Unchanged content gives the same digest regardless of row
    order or partitioning, so re-staging can be skipped by comparing digests.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c(f"`{x}`").cast("string")), F.lit("")) for x in df.columns])
    h = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
                  F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def load_if_changed(df: DataFrame, path: str, stored: DataFrame | None) -> DataFrame | None:
    """Stage ``df`` unless its digest equals the ``stored`` one; returns the new digest, or None if skipped."""
    new = content_digest(df)
    if stored is not None and not stored.intersect(new).isEmpty():
        return None
    load_staging(df, path)
    return new


def staging_profile(df: DataFrame, top: int = 20) -> DataFrame:
    """Row count, column count and null count per column (top ``top`` by nulls)."""
    nulls = df.agg(*[F.sum(c(x).isNull().cast("long")).alias(x) for x in df.columns],
                   F.count(F.lit(1)).alias("__rows"))
    stacked = nulls.select(
        F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), c(f"`{x}`").alias("null_count"))
                            for x in df.columns])).alias("s"), c("__rows").alias("row_count"))
    return (stacked.select("s.column_name", F.coalesce(c("s.null_count"), F.lit(0)).alias("null_count"), "row_count",
                           F.lit(len(df.columns)).cast("long").alias("column_count"))
            .orderBy(c("null_count").desc(), c("column_name")).limit(top))


def stage_region(raw: DataFrame, start_row: int, start_col: int) -> DataFrame:
    """A4: the table whose header sits at (start_row, start_col) of a raw cell drop (row_no, c1..cn).

    Like the sheet reader it replaces: the region ends after as many rows as
    there are non-empty rows from the header down, and at the last column
    holding a value; the header row is read once (one row to the driver),
    blank headers become 'Unnamed' and are dropped with all-empty rows (A3),
    and names are normalized (A1) and de-duplicated (A2).
    """
    cols = sorted([x for x in raw.columns if x.startswith("c") and x[1:].isdigit()], key=lambda x: int(x[1:]))
    cols = [x for x in cols if int(x[1:]) >= start_col]
    below = raw.where(c("row_no") >= start_row)
    nonempty = F.greatest(*[(F.coalesce(c(x), F.lit("")) != "") for x in cols])
    stats = below.agg(F.sum(nonempty.cast("long")).alias("n"),
                      F.max(F.greatest(*[F.when(F.coalesce(c(x), F.lit("")) != "", F.lit(int(x[1:]))) for x in cols]))
                      .alias("last")).first()
    n_rows = int(stats["n"] or 0)
    last_col = int(stats["last"] or start_col)
    end_row = max(start_row + n_rows - 1, start_row)
    if end_row - (start_row - 1) < 1:
        raise ValueError("empty region")
    use = [x for x in cols if int(x[1:]) <= last_col]
    header = raw.where(c("row_no") == start_row).select(*use).first()
    names = []
    for i, x in enumerate(use):
        v = header[x] if header is not None else None
        names.append(str(v).strip() if v not in (None, "") else f"Unnamed: {i}")
    # positional temporary names: sheet headers may differ only in case, which Spark does not tell apart
    tmp = [f"_p{i}" for i in range(len(use))]
    body = (raw.where((c("row_no") > start_row) & (c("row_no") <= end_row + 1)).select(*use).toDF(*tmp)
            .na.drop(how="all"))
    keep = [i for i, n in enumerate(names) if not re.match(r"^Unnamed", n)]
    final = dedupe_headers([normalize_header(names[i]) for i in keep])
    return body.select(*[c(tmp[i]).alias(final[j]) for j, i in enumerate(keep)])
