"""Queries for pyramid levels and their statistics."""

from pyspark.sql import functions as F

from hexweave.operators import pyramid as p
from hexweave.operators.joins import clip_to_mask
from hexweave.plans import inputs as t
from hexweave.plans.inputs import parent_sql
from hexweave.plans.registry import query

# Per aggregate: value column, finest SQL, one-step rollup SQL.
_FORMS = {
    "COUNT": (None, "COUNT(*) AS count", "CAST(SUM(count) AS BIGINT) AS count"),
    "SUM": ("carbon", "SUM(carbon) AS carbon", "SUM(carbon) AS carbon"),
    "MIN": ("carbon", "MIN(carbon) AS carbon", "MIN(carbon) AS carbon"),
    "MAX": ("carbon", "MAX(carbon) AS carbon", "MAX(carbon) AS carbon"),
    "AVG": (
        "carbon", "AVG(carbon) AS carbon, COUNT(*) AS w, COUNT(carbon) AS m",
        "SUM(carbon * m) / SUM(m) AS carbon, CAST(SUM(w) AS BIGINT) AS w, CAST(SUM(m) AS BIGINT) AS m",
    ),
    "COUNT_DISTINCT": ("species", "COUNT(DISTINCT species) AS species", "MAX(species) AS species"),
}
_DIGITS = {"SUM": 2, "AVG": 8}


def _shown(agg: str) -> str:
    value = _FORMS[agg][0] or "count"
    shown = f"ROUND({value}, {_DIGITS[agg]}) AS {value}" if agg in _DIGITS else value
    return shown + (f", w AS {p.WEIGHT}, m AS {p.own_weight('carbon')}" if agg == "AVG" else "")


def _finest_sql(agg: str) -> str:
    return f"SELECT h8 AS h, h0, {_FORMS[agg][1]} FROM value_hex GROUP BY 1, 2"


def _parents_sql(agg: str) -> str:
    steps, last = [f"l8 AS ({_finest_sql(agg)})"], 8
    for r in (7, 6, 5):
        steps.append(f"l{r} AS (SELECT {parent_sql('h', r)} AS h, h0, {_FORMS[agg][2]} FROM l{last} GROUP BY 1, 2)")
        last = r
    union = " UNION ALL ".join(f"SELECT {r} AS res, h, h0, {_shown(agg)} FROM l{r}" for r in (7, 6, 5))
    return ", " + ", ".join(steps) + " " + union


def _round(df, agg):
    value = _FORMS[agg][0] or "count"
    return df.withColumn(value, F.round(value, _DIGITS[agg])) if agg in _DIGITS else df


def _values(agg):
    return [_FORMS[agg][0]] if _FORMS[agg][0] else []


def _finest(spark, sf, agg):
    return p.finest_level(t.value_hex(spark, sf), agg, _values(agg), "h8")


def _levels(spark, sf, agg):
    level, out = _finest(spark, sf, agg), None
    for r in (7, 6, 5):
        level = p.parent_level(level, r, agg, _values(agg))
        shown = level.withColumn("res", F.lit(r))
        out = shown if out is None else out.unionByName(shown)
    return out


for _agg in p.AGGS:

    @query(f"pyramid_finest_{_agg.lower()}", "value_hex", f"SELECT h, h0, {_shown(_agg)} FROM ({_finest_sql(_agg)})")
    def _run_finest(spark, sf, agg=_agg):
        return _round(_finest(spark, sf, agg), agg)

    @query(f"pyramid_parent_{_agg.lower()}", "value_hex", _parents_sql(_agg))
    def _run_parents(spark, sf, agg=_agg):
        return _round(_levels(spark, sf, agg), agg)


@query("pyramid_distinct_exact", "value_hex", " UNION ALL ".join(
    f"SELECT {r} AS res, {parent_sql('h8', r)} AS h, COUNT(DISTINCT species) AS n_distinct FROM value_hex GROUP BY 1, 2"
    for r in (5, 6, 7, 8)))
def pyramid_distinct_exact(spark, sf):
    return p.distinct_levels(t.value_hex(spark, sf), "h8", "species", 8, 5)


@query("pyramid_distinct_sketch", "value_hex", " UNION ALL ".join(
    f"SELECT {r} AS res, {parent_sql('h8', r)} AS h, COUNT(DISTINCT species) AS n_distinct, TRUE AS sketch_is_close "
    "FROM value_hex GROUP BY 1, 2" for r in (5, 6, 7, 8)))
def pyramid_distinct_sketch(spark, sf):
    values = t.value_hex(spark, sf)
    sketch = p.sketch_levels(values, "h8", "species", 8, 5, "sketch")
    both = p.distinct_levels(values, "h8", "species", 8, 5).join(sketch, ["res", "h"])
    close = F.abs(F.col("sketch") / F.col("n_distinct") - 1) < 0.1
    return both.select("res", "h", "n_distinct", close.alias("sketch_is_close"))


@query("detect_resolution", "value_hex land_grid", """
    SELECT 8 AS value_res, 10 AS land_res, COUNT(*) AS n FROM value_hex""")
def detect_resolution(spark, sf):
    values = t.value_hex(spark, sf)
    found = p.detect_resolution(values, "h8"), p.detect_resolution(t.land_grid(spark, sf), "h10")
    return values.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(found[0]).alias("value_res"), F.lit(found[1]).alias("land_res"), "n"
    )


_STATS = ", " + ", ".join(
    f"s{r} AS (SELECT {parent_sql('h8', r)} AS h, SUM(carbon) AS carbon FROM value_hex GROUP BY 1)" for r in (5, 6, 7, 8)
) + ", stats AS (" + " UNION ALL ".join(
    f"SELECT {r} AS res, MIN(carbon) AS low, MAX(carbon) AS high, AVG(carbon) AS mean FROM s{r}" for r in (5, 6, 7, 8)
) + ")"


def _sum_levels(spark, sf):
    level = _finest(spark, sf, "SUM")
    out = level.withColumn("res", F.lit(8))
    for r in (7, 6, 5):
        level = p.parent_level(level, r, "SUM", ["carbon"])
        out = out.unionByName(level.withColumn("res", F.lit(r)))
    return out


@query("value_stats", "value_hex", f"""{_STATS}
    SELECT res, 'carbon' AS "column", ROUND(low, 2) AS min, ROUND(high, 2) AS max, ROUND(mean, 3) AS mean FROM stats""")
def value_stats(spark, sf):
    stats = p.value_stats(_sum_levels(spark, sf), ["carbon"])
    return stats.select(
        "res", "column", F.round("min", 2).alias("min"), F.round("max", 2).alias("max"), F.round("mean", 3).alias("mean")
    )


@query("suggest_scale", "occurrence_hex points", """
    SELECT class, CASE WHEN AVG(v) > 0 AND MAX(v) / AVG(v) > 10 THEN 'log' ELSE 'linear' END AS scale FROM (
      SELECT class, pow(abs(lat) + 1, 6) AS v FROM points UNION ALL SELECT class || ' flat', 1 FROM points) GROUP BY 1""")
def suggest_scale(spark, sf):
    pts = t.points(spark, sf)
    skewed = pts.select("class", F.pow(F.abs("lat") + 1, F.lit(6)).alias("v"))
    flat = pts.select(F.concat("class", F.lit(" flat")).alias("class"), F.lit(1.0).alias("v"))
    stats = skewed.unionByName(flat).groupBy("class").agg(F.max("v").alias("high"), F.avg("v").alias("mean"))
    return stats.select("class", p.suggest_scale("high", "mean").alias("scale"))


@query("pyramid_masked", "value_hex mask_hex", """
    SELECT h8 AS h, h0, ROUND(AVG(carbon), 8) AS carbon, COUNT(*) AS __pyramid_weight, COUNT(carbon) AS __n_carbon FROM value_hex v WHERE EXISTS (
      SELECT 1 FROM mask_hex m WHERE m.h8 = v.h8 AND m.h0 = v.h0 AND region = 'ASIA') GROUP BY 1, 2""")
def pyramid_masked(spark, sf):
    inside = clip_to_mask(t.value_hex(spark, sf), t.mask_hex(spark, sf), 8, F.col("region") == "ASIA")
    return p.finest_level(inside, "AVG", ["carbon"], "h8").withColumn("carbon", F.round("carbon", 8))


_STOPS = ", ".join(f"({f}::DOUBLE, '{c}')" for f, c in p.RAMP)


@query("ramp_stops", "value_hex", f"""{_STATS}, stops AS (SELECT * FROM (VALUES {_STOPS}) s(fraction, color))
    SELECT res, 'linear' AS scale, fraction, color, ROUND(low + fraction * (CASE WHEN high = low THEN 1 ELSE high - low END), 2) AS value
    FROM stats CROSS JOIN stops UNION ALL
    SELECT res, 'log', fraction, color, ROUND(lo * pow((CASE WHEN hi > lo THEN hi ELSE lo * 10 END) / lo, fraction), 2) FROM (
      SELECT res, CASE WHEN high = low THEN low + 1 ELSE high END AS hi,
             CASE WHEN low > 0 THEN low WHEN high > 0 THEN high / 1000 ELSE 1 END AS lo FROM stats) CROSS JOIN stops""")
def ramp_stops(spark, sf):
    stats = p.value_stats(_sum_levels(spark, sf), ["carbon"]).select("res", "min", "max")
    out = None
    for scale in ("linear", "log"):
        stops = p.ramp_stops(stats, "min", "max", scale).select(
            "res", F.lit(scale).alias("scale"), "fraction", "color", F.round("value", 2).alias("value")
        )
        out = stops if out is None else out.unionByName(stops)
    return out


@query("ramp_bin", "value_hex", """
    , sums AS (SELECT h8, SUM(carbon) AS c FROM value_hex GROUP BY 1), s AS (SELECT MIN(c) AS low, MAX(c) AS high FROM sums)
    SELECT CAST(greatest(0, least(5, floor((c - low) / (high - low) * 5))) AS INT) AS bin, COUNT(*) AS n FROM sums, s GROUP BY 1""")
def ramp_bin(spark, sf):
    sums = t.value_hex(spark, sf).groupBy("h8").agg(F.sum("carbon").alias("c"))
    low, high = sums.agg(F.min("c")).scalar(), sums.agg(F.max("c")).scalar()
    return sums.groupBy(p.ramp_bin(F.col("c"), low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("ramp_bin_log", "value_hex", """
    , sums AS (SELECT h8, SUM(carbon) + 1 AS c FROM value_hex GROUP BY 1), s AS (SELECT MIN(c) AS low, MAX(c) AS high FROM sums)
    SELECT CAST(greatest(0, least(5, floor(ln(c / low) / ln(high / low) * 5))) AS INT) AS bin, COUNT(*) AS n FROM sums, s GROUP BY 1""")
def ramp_bin_log(spark, sf):
    sums = t.value_hex(spark, sf).groupBy("h8").agg((F.sum("carbon") + 1).alias("c"))
    low, high = sums.agg(F.min("c")).scalar(), sums.agg(F.max("c")).scalar()
    return sums.groupBy(p.ramp_bin(F.col("c"), low, high, "log").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
