"""Secret scans with multipart credential linking.

Base findings are the leftmost non-overlapping matches of three patterns in
the whole text. The method adds weak parts (bare upper-case identifiers, mixed
tokens, endpoints): a weak part alone proves nothing, so it is reported only if
complementary parts lie within ``scope`` code points of it in the same
document:

* a weak identifier (``weak_id``) needs a secret part (assign, hex or weak secret),
* a weak secret (``weak_secret``) needs an identifier (access or weak id) or an endpoint,
* an endpoint needs both an identifier and a secret part.

The linking is an interval join: every part is summarised per (document, role,
bin of ``scope`` code points) by its smallest start and largest end, and a weak
part probes the bins its scope reaches. A bin answers "how near is the nearest
part" exactly, so neither the summary nor the join lists pairs of parts.

Native functions only. Texts are touched once: ``split`` and
``regexp_extract_all`` with the same pattern give the gaps and the matches,
whose lengths add up to positions. Only lengths are shuffled.

Defined results: null text is read as empty (no findings); repeated rows are
reported row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spooltrace.llm.common import at, materialize, positional

# fixed values: base patterns, with letters of the keywords in either case
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"  # the whole run, 20 characters or more
HEX = "[0-9a-f]{24,}"
MIN_ASSIGN_VALUE = 6
# candidates of the method: one pass, so an endpoint and the tokens inside it are one part
WEAK = "(?:https?|wss?|s3|jdbc:[a-z0-9]+)://[^\\x00-\\x20\"'<>]+|[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 256


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _match_lengths(text: Column, pattern: str, value_group: int | None = None, label: Column | None = None) -> Column:
    """Array of (gap before, match length, value length, matched text if asked for), in order of position."""
    gaps = F.split(text, pattern, -1)
    found = _matches(text, pattern)
    values = found if value_group is None else _matches(text, pattern, value_group)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("val"))
    parts = F.transform(zipped, lambda z: F.struct(
        F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("len"), F.length(z["val"]).alias("val"),
        _weak_kind(z["hit"]).alias("kind") if label is None else label.alias("kind")))
    none = F.array().cast("array<struct<gap:int,len:int,val:int,kind:string>>")
    return F.when(text.rlike(pattern), F.filter(parts, lambda p: p["len"].isNotNull())).otherwise(none)


def _weak_kind(hit: Column) -> Column:
    """Kind of a weak candidate; null for tokens that look like no credential part."""
    return (F.when(hit.contains("://"), F.lit("endpoint"))
            .when(hit.rlike("^[A-Z0-9]+$") & hit.rlike("[0-9]") & hit.rlike("[A-Z]"), F.lit("weak_id"))
            .when((F.length(hit) >= 24) & hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]"),
                  F.lit("weak_secret")))


def _positions(keyed: DataFrame, lengths: str) -> DataFrame:
    """(rid, kind, start, end, val) rows from the gap and match lengths of one pattern."""
    rows = keyed.where(F.size(lengths) > 0).select("rid", F.posexplode(lengths).alias("i", "m"))
    w = Window.partitionBy("rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(w)
    return rows.select("rid", F.col("m.kind").alias("kind"), (end - F.col("m.len")).cast("long").alias("start"),
                       end.cast("long").alias("end"), F.col("m.val").alias("val"))


def base_spans(keyed: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of the base findings; ``keyed`` comes from ``scan``."""
    assign = _positions(keyed, "assign_m").where(F.col("val") >= MIN_ASSIGN_VALUE)
    out = assign.unionByName(_positions(keyed, "access_m")).unionByName(_positions(keyed, "hex_m"))
    return out.drop("val")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, match lengths per pattern), written once; ``rid`` keys the rows of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        _match_lengths(text, ASSIGN, 2, F.lit("assign")).alias("assign_m"),
        _match_lengths(text, ACCESS, None, F.lit("access")).alias("access_m"),
        _match_lengths(text, HEX, None, F.lit("hex")).alias("hex_m"),
        _match_lengths(text, WEAK).alias("weak_m")), "secrets")


def _role(kind: Column) -> Column:
    return (F.when(kind.isin("access", "weak_id"), F.lit("id")).when(kind == "endpoint", F.lit("endpoint"))
            .otherwise(F.lit("secret")))


def _outside_base(base: DataFrame, weak: DataFrame) -> DataFrame:
    """Weak candidates that overlap no base finding, by running extremes along the document."""
    both = (base.withColumn("strong", F.lit(True))
            .unionByName(weak.withColumn("strong", F.lit(False))))
    up = Window.partitionBy("rid").orderBy("start", F.desc("strong")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("strong")).rowsBetween(Window.unboundedPreceding, -1)
    marked = (both.withColumn("before", F.max(F.when(F.col("strong"), F.col("end"))).over(up))
              .withColumn("after", F.min(F.when(F.col("strong"), F.col("start"))).over(down)))
    free = (F.coalesce(F.col("before") <= F.col("start"), F.lit(True))
            & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    return marked.where(~F.col("strong") & free).select("rid", "kind", "start", "end")


def link_weak_parts(base: DataFrame, weak: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with complementary parts within ``scope`` code points (interval join on position bins)."""
    weak = _outside_base(base, weak)
    parts = base.unionByName(weak).withColumn("role", _role(F.col("kind")))
    bins = F.explode(F.sequence(F.expr(f"start div {scope}"), F.expr(f"(end - 1) div {scope}")))
    anchors = (parts.select("rid", "role", "start", "end", bins.alias("bin"))
               .groupBy("rid", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last")))
    reach = F.explode(F.sequence(F.expr(f"greatest(start - {scope}, 0) div {scope}"),
                                 F.expr(f"(end - 1 + {scope}) div {scope}")))
    probes = (weak.withColumn("role", _role(F.col("kind"))).select("rid", "kind", "start", "end", "role",
                                                                     reach.alias("bin")))
    a, p = anchors.alias("a"), probes.alias("p")
    near = (F.when(F.col("p.bin") < F.expr(f"p.start div {scope}"), F.col("p.start") - F.col("a.last") <= scope)
            .when(F.col("p.bin") > F.expr(f"(p.end - 1) div {scope}"), F.col("a.first") - F.col("p.end") <= scope)
            .otherwise(F.lit(True)))
    met = (p.join(a, (F.col("p.rid") == F.col("a.rid")) & (F.col("p.bin") == F.col("a.bin"))
                  & (F.col("p.role") != F.col("a.role")) & near)
           .groupBy("p.rid", "p.kind", "p.start", "p.end", "p.role")
           .agg(F.max((F.col("a.role") == "id").cast("int")).alias("ids"),
                F.max((F.col("a.role") == "secret").cast("int")).alias("secrets"),
                F.max((F.col("a.role") == "endpoint").cast("int")).alias("ends")))
    linked = (F.when(F.col("role") == "id", F.col("secrets") == 1)
              .when(F.col("role") == "secret", (F.col("ids") == 1) | (F.col("ends") == 1))
              .otherwise((F.col("ids") == 1) & (F.col("secrets") == 1)))
    return met.where(linked).select("rid", "kind", "start", "end")


def find_secrets(keyed: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rid, kind, start, end) of base findings and linked weak parts; ``keyed`` comes from ``scan``."""
    base = base_spans(keyed)
    weak = _positions(keyed, "weak_m").where("kind IS NOT NULL").drop("val")
    return base.unionByName(link_weak_parts(base, weak, scope))


def secrets_query(docs: DataFrame) -> DataFrame:
    """Digest per document: counts of base findings, their hash, and all spans."""
    keyed = scan(docs)
    spans = find_secrets(keyed)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    is_base = F.col("kind").isin("assign", "access", "hex")

    def joined(c: Column) -> Column:
        return F.concat_ws(",", F.transform(F.sort_array(c), lambda x: x["s"]))

    per_doc = spans.groupBy("rid").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        joined(F.collect_list(F.when(is_base, span))).alias("base"), joined(F.collect_list(span)).alias("spans"))
    zero = F.lit(0).cast("long")
    return keyed.select("rid", "doc_id").join(per_doc, "rid", "left").select(
        "doc_id", *[F.coalesce(F.col(f"n_{k}"), zero).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mark``; all rows and columns, of any name, stay."""
    text_at = at(docs, text_col)
    keyed = materialize(positional(docs).withColumn("_rid", F.monotonically_increasing_id()), "redact")
    # scan the keyed copy: its own key is carried through instead of a new one
    found = find_secrets(scan(keyed.withColumn("_doc", F.col("_rid")), "_doc", text_at).withColumn("rid", F.col("doc_id")))
    # merge overlapping spans along the document
    w = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = (found.withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    lists = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    text = F.col(text_at)

    def pieces(s: Column) -> Column:
        kept = F.transform(s, lambda x, i: F.substring(
            text, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)).cast("int") + 1,
            (x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))).cast("int")))
        rest = F.substring(text, F.element_at(s, -1)["end"].cast("int") + 1, F.length(text))
        return F.concat(F.array_join(kept, mark), F.lit(mark), rest)

    joined = keyed.join(lists, keyed["_rid"] == lists["rid"], "left")
    new = F.when(F.col("_spans").isNull(), text).otherwise(pieces(F.col("_spans")))
    return joined.select(*[new.alias(c) if c == text_at else keyed[c] for c in keyed.drop("_rid").columns]).toDF(*docs.columns)


_SQL_WEAK = WEAK.replace("'", "''")
_SQL_ASSIGN = ASSIGN.replace("'", "''")


def _sql_positions(name: str, pattern: str, group: int) -> str:
    return f"""
{name}_l AS (SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals,
    string_split_regex(t, '{pattern}') AS gaps FROM d),
{name}_e AS (SELECT rid, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap,
    generate_subscripts(hits, 1) AS i FROM {name}_l WHERE len(hits) > 0),
{name}_p AS (SELECT rid, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e,
    length(hit) AS n FROM {name}_e)"""


SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_sql_positions('a', _SQL_ASSIGN, 2)},
{_sql_positions('k', ACCESS, 0)},
{_sql_positions('h', HEX, 0)},
{_sql_positions('w', _SQL_WEAK, 0)},
base AS (
    SELECT rid, 1 AS k, 'assign' AS kind, e - n AS s, e, 'secret' AS role FROM a_p WHERE length(val) >= {MIN_ASSIGN_VALUE}
    UNION ALL SELECT rid, 2, 'access', e - n, e, 'id' FROM k_p
    UNION ALL SELECT rid, 3, 'hex', e - n, e, 'secret' FROM h_p),
weak0 AS (
    SELECT rid, CASE WHEN contains(hit, '://') THEN 6
        WHEN regexp_full_match(hit, '[A-Z0-9]+') AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') THEN 4
        WHEN length(hit) >= 24 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]')
            AND regexp_matches(hit, '[a-z]') THEN 5 END AS k, e - n AS s, e FROM w_p),
weak AS (
    SELECT rid, k, CASE k WHEN 4 THEN 'weak_id' WHEN 5 THEN 'weak_secret' ELSE 'endpoint' END AS kind, s, e,
        CASE k WHEN 4 THEN 'id' WHEN 5 THEN 'secret' ELSE 'endpoint' END AS role
    FROM weak0 WHERE k IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = weak0.rid AND b.s < weak0.e AND b.e > weak0.s)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
near AS (
    SELECT w.rid, w.k, w.kind, w.s, w.e, w.role, bool_or(p.role = 'id') AS ids, bool_or(p.role = 'secret') AS secs,
        bool_or(p.role = 'endpoint') AS ends
    FROM weak w JOIN parts p ON p.rid = w.rid AND p.role <> w.role AND p.s - w.e <= {SCOPE} AND w.s - p.e <= {SCOPE}
    GROUP BY ALL),
linked AS (
    SELECT rid, k, kind, s, e FROM near
    WHERE CASE role WHEN 'id' THEN secs WHEN 'secret' THEN ids OR ends ELSE ids AND secs END),
agg AS (
    SELECT rid, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base_spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS all_spans
    FROM (SELECT rid, k, kind, s, e FROM base UNION ALL SELECT rid, k, kind, s, e FROM linked) GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
    coalesce(all_spans, '') AS spans
FROM d LEFT JOIN agg USING (rid)
"""
