"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Sources share all words by weight; a target stops at ``MOST_COPIES`` times what its source has, and the rest is shared again by weight. A document of a source whose target is r times
its words is expected r + a (g - mean g) times: g is its preference from 0 to 1, the mean is weighted by words, so that the words expected are the target, and a is as large as
the bounds 0 and MOST_COPIES allow, at most ``LEAN``. The whole part of that number is taken for certain. The fraction p is left to a sample: documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u being uniform and made from the id, and a fixed number with the lowest ranks is taken once more.

Numbers are fixed for strata of a source: documents of like size, ``CLASSES`` of them for each doubling. From the largest class down, each takes as many as its words need, together with what
the classes before left over, so a source ends near its target. Expected numbers are whole multiples of 1 / ``UNIT`` and are summed as integers, so results depend on no order.

No stratum is sorted by one task. Ranks fall into cells of about ``CELL`` documents, cells are counted, and only the cell where the sample ends is put into order. Tables of a row for each
stratum or cell end are broadcast up to ``BROADCAST_ROWS`` rows; larger ones are joined on salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST_COPIES = 3
WEIGHTS = (1.0, 2.0, 3.0)
LEAN = 0.5
UNIT = 1 << 20
CLASSES = 4
#: Powers of two are the only whole numbers on a class's edge; this keeps their logarithms from falling short of it.
NUDGE = 1e-9
CELL = 1024
SEED = 13
BROADCAST_ROWS = 100_000
SALTS = 64
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken")


def _small(table: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[str], bool]:
    """A written table, and whether it is small enough to be broadcast."""
    table = written(table, name)
    return table, keys, table.count() <= BROADCAST_ROWS


def _joined(rows: DataFrame, small: tuple[DataFrame, list[str], bool], how: str = "inner") -> DataFrame:
    """Adds the columns of a row for each stratum: broadcast if few, else joined with copies of it, so that a hot stratum is spread over ``SALTS`` keys."""
    table, keys, few = small
    if few:
        return rows.join(F.broadcast(table), keys, how)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_u", "size"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size and more) with target. The level is the highest that any number of stopped sources gives, as stopping too few or too many lowers it."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = F.max("_level").over(Window.partitionBy())
    filled = weighed.withColumn("_level", left / F.sum("_weight").over(after))
    return filled.withColumn("target", F.least("_cap", level * F.col("_weight"))).drop("_weight", "_cap", "_level")


def _lean(docs: DataFrame, prefer: Column | None) -> Column:
    """The preference in units: ``prefer``, from 0 to 1, or one that grows with the document's size."""
    g = F.col("size") / (F.col("size") + 256) if prefer is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(prefer.cast("double"), F.lit(0.0)), F.lit(0.0))))
    return F.floor(g * UNIT).cast("long")


def _numbers(strata: DataFrame, sources: DataFrame) -> DataFrame:
    """_source, _class, n (documents with a fraction) with _take: how many of them a stratum's sample has. A source's strata, at most a few hundred, are gone through from the largest down."""
    row = F.struct(F.col("_class"), F.col("n"), (F.col("_pw").cast("double") / UNIT).alias("w"), F.try_divide(F.col("_nw"), F.col("n")).alias("mean"))
    each = strata.groupBy("_source").agg(F.sort_array(F.collect_list(row), asc=False).alias("_rows"), F.sum("_ew").alias("_ew"))
    each = each.join(sources.select("_source", "target"), "_source")
    # What whole multiples of a unit leave out of the target is given to the first stratum.
    start = F.struct((F.col("target") - F.col("_ew").cast("double") / UNIT).alias("carry"), F.array().cast("array<struct<_class:int,n:bigint,_take:bigint>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        take = F.least(r["n"], F.greatest(F.lit(0).cast("long"), F.floor((r["w"] + state["carry"]) / r["mean"] + 0.5).cast("long")))
        here = F.struct(r["_class"].alias("_class"), r["n"].alias("n"), take.alias("_take"))
        return F.struct((state["carry"] + r["w"] - take * r["mean"]).alias("carry"), F.concat(state["out"], F.array(here)).alias("out"))

    ordered = F.filter(F.col("_rows"), lambda r: r["n"] > 0)
    return each.select("_source", F.inline(F.aggregate(ordered, start, step)["out"]))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, text: str = "text", doc_id: str = "doc_id", source: str = "source", prefer: Column | None = None, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with size (words), source_size, target and taken: the words that the mix takes of the document, which is its size times the copies taken. ``keep``: the columns to
    return (all but the text if None).

    Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, after all others; a null id counts as empty text; rows that repeat an id share
    a rank and are told apart by size, equal ones in any order, so the result is the same table; a source without words has target 0; an empty table stays empty; without any word all targets are
    0; columns of ``docs`` named like an added one are replaced (``source`` is never one).
    """
    cols = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in ADDED]
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(code, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    name = F.col(f"`{source}`").cast("string")
    rows = docs.withColumn("size", size).select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "size", u.alias("_u"), name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("_source"), _lean(docs, prefer).alias("_g"),
    )
    rows = written(rows, "mix_rows")
    totals = rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.sum(_exact(F.col("size")) * _exact(F.col("_g"))).alias("_gw"))
    r, mean = F.try_divide(F.col("target"), F.col("source_size")), F.try_divide(F.col("_gw").cast("double"), F.col("source_size")) / UNIT
    lean = F.least(F.lit(LEAN), F.coalesce(r / F.nullif(mean, F.lit(0.0)), F.lit(LEAN)), F.coalesce((most - r) / F.nullif(1 - mean, F.lit(0.0)), F.lit(LEAN)))
    found = targets(totals, weights, most).withColumns({"_r": F.when(F.col("source_size") > 0, r), "_mean": F.when(F.col("source_size") > 0, mean)})
    found = found.withColumn("_lean", F.when(F.col("source_size") > 0, lean)).select("_source", "source_size", "target", "_r", "_mean", "_lean")
    sources = _small(found, ["_source"], "mix_sources")

    expected = F.floor((F.col("_r") + F.col("_lean") * (F.col("_g") / UNIT - F.col("_mean"))) * UNIT).cast("long")
    expected = F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least(F.lit(most * UNIT).cast("long"), expected))).otherwise(F.lit(0).cast("long"))
    laid = _joined(rows.drop("source"), sources).withColumn("_e", expected)
    p = F.pmod(F.col("_e"), F.lit(UNIT))
    laid = laid.withColumns({"_p": p, "_copies": F.floor(F.col("_e") / UNIT).cast("long"), "_class": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES + NUDGE)).otherwise(0).cast("int")})
    odds = (F.col("_u") / (1 - F.col("_u"))) * (F.lit(float(UNIT)) - F.col("_p")) / F.nullif(F.col("_p"), F.lit(0))
    laid = laid.withColumn("_q", odds)

    fraction, words = F.when(F.col("_p") > 0, F.col("size")), F.col("size")
    strata = laid.groupBy("_source", "_class").agg(
        F.count(fraction).alias("n"), F.sum(_exact(words) * _exact(F.col("_e"))).alias("_ew"), F.coalesce(F.sum(_exact(words) * _exact(F.col("_p"))), F.lit(0)).alias("_pw"), F.coalesce(F.sum(fraction), F.lit(0)).alias("_nw"),
    )
    taking = _small(_numbers(strata, sources[0]), ["_source", "_class"], "mix_strata")

    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("long")
    drawn = _joined(laid, taking, "left").withColumn("_cell", F.when(F.col("_p") > 0, F.floor(F.col("_q") / (1 + F.col("_q")) * cells).cast("long")))
    counts = drawn.where("_p > 0").groupBy("_source", "_class", "_cell").agg(F.count("*").alias("_n"), F.first("_take").alias("_take"))
    upto = F.sum("_n").over(Window.partitionBy("_source", "_class").orderBy("_cell"))
    ends = counts.withColumn("_upto", upto).where("_upto >= _take and _upto - _n < _take").select("_source", "_class", F.col("_cell").alias("_end"), (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_more"))
    marked = _joined(drawn, _small(ends, ["_source", "_class"], "mix_ends"), "left")
    last = (F.col("_cell") == F.col("_end")) & (F.col("_more") < F.lit(1 << 62))
    out = lambda d, more: d.select(*[F.col(f"_row.`{c}`") for c in cols], "size", "source_size", "target", (F.col("size") * (F.col("_copies") + more)).alias("taken"))
    inside = out(marked.where(F.coalesce(~last, F.lit(True))), F.when(F.col("_cell") < F.col("_end"), 1).otherwise(0))
    ranked = marked.where(last).withColumn("_rank", F.row_number().over(Window.partitionBy("_source", "_class").orderBy("_q", "size", F.col(f"_row.`{doc_id}`") if doc_id in cols else "_u")))
    return inside.unionByName(out(ranked, F.when(F.col("_rank") <= F.col("_more"), 1).otherwise(0)))


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed with the sources' weights 1, 2, 3 in turn."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


OP13_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
g AS (SELECT *, CAST(floor(CAST(size AS DOUBLE) / CAST(size + 256 AS DOUBLE) * {UNIT}) AS BIGINT) AS g FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(CAST(size AS HUGEINT) * g) AS gw FROM g GROUP BY source),
s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, {MOST_COPIES}.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1 WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)),
s3 AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM s2),
s4 AS (SELECT *, target / source_size AS r, CAST(gw AS DOUBLE) / source_size / {UNIT} AS mean FROM s3 WHERE source_size > 0),
s5 AS (SELECT *, least({LEAN}, r / mean, ({MOST_COPIES} - r) / (1 - mean)) AS lean FROM s4),
e AS MATERIALIZED (
  SELECT g.*, s3.source_size, s3.target, CASE WHEN size > 0 THEN greatest(0, least({MOST_COPIES * UNIT}, CAST(floor((r + lean * (CAST(g AS DOUBLE) / {UNIT} - mean)) * {UNIT}) AS BIGINT))) ELSE 0 END AS e
  FROM g JOIN s3 ON g.source IS NOT DISTINCT FROM s3.source LEFT JOIN s5 ON g.source IS NOT DISTINCT FROM s5.source),
p AS MATERIALIZED (
  SELECT *, e % {UNIT} AS p, e // {UNIT} AS copies, CASE WHEN size > 0 THEN CAST(floor(log2(CAST(size AS DOUBLE)) * {CLASSES} + {NUDGE}) AS INTEGER) ELSE 0 END AS class FROM e),
q AS MATERIALIZED (SELECT *, (u / (1 - u)) * ({UNIT}.0::DOUBLE - p) / p AS q FROM p WHERE p > 0),
h AS (SELECT source, class, count(*) AS n, sum(CAST(size AS HUGEINT) * p)::DOUBLE / {UNIT} AS w, sum(size)::DOUBLE / count(*) AS mean FROM q GROUP BY source, class),
c AS (SELECT source, any_value(target) - sum(CAST(size AS HUGEINT) * e)::DOUBLE / {UNIT} AS carry FROM p GROUP BY source),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS k FROM h),
t AS (
  WITH RECURSIVE f AS (
    SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS INTEGER) AS class, CAST(0 AS BIGINT) AS take, carry FROM c
    UNION ALL
    SELECT source, k, class, take, carry + w - take * mean FROM (
      SELECT o.source, o.k, o.class, o.w, o.mean, f.carry, least(o.n, greatest(0, CAST(floor((o.w + f.carry) / o.mean + 0.5) AS BIGINT))) AS take
      FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source AND o.k = f.k + 1))
  SELECT * FROM f WHERE k > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY q, size, doc_id) AS rank FROM q)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * p.copies AS BIGINT) AS taken FROM p WHERE p.p = 0
UNION ALL
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * (r.copies + CASE WHEN r.rank <= t.take THEN 1 ELSE 0 END) AS BIGINT)
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source AND r.class = t.class
"""
