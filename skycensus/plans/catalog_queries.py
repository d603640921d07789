"""Queries of the catalog operators, filters and label frames, and DuckDB SQL written out by hand for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.operators import catalog
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, ORB, ORBX, query, r6, rounded

c = F.col


@query(f"""WITH {ORBX}, n AS (SELECT desig, CASE WHEN h <= 33 THEN h END AS h, CASE WHEN h_b <= 33 THEN h_b END AS h_b, CASE WHEN h_c <= 33 THEN h_c END AS h_c FROM orb),
 f AS (SELECT *, CASE WHEN h IS NOT NULL AND h_b IS NOT NULL AND h_c IS NOT NULL THEN h + h_b + h_c - greatest(h, h_b, h_c) - least(h, h_b, h_c) ELSE greatest(h, h_b, h_c) END AS fused FROM n)
 SELECT desig, round(h, 6) AS h_mpc, round(fused, 6) AS h, round(greatest(coalesce(abs(h-h_b), 0.011), coalesce(abs(h-h_c), 0.012)), 6) AS h_diff_abs_max FROM f WHERE fused IS NULL OR abs(fused + 9.99) > 1e-9""")  # fmt: skip
def h_fusion(spark, sf_dir):
    rows = fx.orbits_with_edges(spark, sf_dir).withColumns({k: F.lit(None).cast("double") for k in ("a_b", "e_b", "i_b")})
    return rounded(catalog.fuse_h(catalog.differences(rows)).select("desig", "h_mpc", "h", "h_diff_abs_max"))


#: Two other catalogs of the objects: the first with small differences and a flag that is wrong for some, the second with a magnitude.
OTHERS = f"""{FINAL}, c1 AS (SELECT desig, a + (desig % 9)*0.0001 AS a, e + (desig % 7)*0.00005 AS e, i + (desig % 5)*0.001 AS i, CASE WHEN desig % 31 = 0 THEN 40.0 ELSE h + (desig % 7)/64.0 END AS h, CASE WHEN desig % 13 = 0 THEN 0 WHEN num_opps > 1 THEN 1 ELSE 0 END AS multi FROM final WHERE desig % 4 <> 0),
 c2 AS (SELECT desig, h - (desig % 11)/64.0 AS h FROM final WHERE desig % 3 <> 0),
 cmp AS (SELECT f.*, c1.a AS a_b, c1.e AS e_b, c1.i AS i_b, CASE WHEN c1.h <= 33 THEN c1.h END AS h_b, c2.h AS h_c, c1.multi IS NOT NULL AND c1.multi <> CASE WHEN f.num_opps > 1 THEN 1 ELSE 0 END AS multi_disagree, f.desig * 3 AS number FROM final f LEFT JOIN c1 USING (desig) LEFT JOIN c2 USING (desig)),
 d AS (SELECT *, coalesce(abs(h-h_b), 0.011) AS h_diff, coalesce(abs(a-a_b), 0) AS a_diff, coalesce(abs(e-e_b), 0) AS e_diff, coalesce(abs(i-i_b), 0) AS i_diff, coalesce(abs(h-h_c), 0.012) AS h_diff_c, greatest(coalesce(abs(h-h_b), 0.011), coalesce(abs(h-h_c), 0.012)) AS h_diff_abs_max FROM cmp)"""


def compared(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    k = c("desig")
    first = final.filter("desig % 4 <> 0").select(k, (c("a") + (k % 9) * 0.0001).alias("a"), (c("e") + (k % 7) * 0.00005).alias("e"), (c("i") + (k % 5) * 0.001).alias("i"), F.when(k % 31 == 0, 40.0).otherwise(c("h") + (k % 7) / 64).alias("h"), F.when(k % 13 == 0, 0).otherwise((c("num_opps") > 1).cast("int")).alias("multi"))
    first = first.unionByName(first.filter("desig % 50 = 1").withColumn("h", c("h") + 1))  # some twice; the least h counts
    second = final.filter("desig % 3 <> 0").select(k, (c("h") - (k % 11) / 64).alias("h"))
    return catalog.differences(catalog.compared(final.withColumn("number", k * 3), first, second))


@query(f"WITH {OTHERS} SELECT desig, multi_disagree, {r6(h_diff='h_diff', a_diff='a_diff', e_diff='e_diff', i_diff='i_diff', h_diff_c='h_diff_c', h_diff_abs_max='h_diff_abs_max', h_b='h_b', h_c='h_c')} FROM d")
def catalog_compare(spark, sf_dir):
    return rounded(compared(spark, sf_dir).select("desig", "multi_disagree", "h_diff", "a_diff", "e_diff", "i_diff", "h_diff_c", "h_diff_abs_max", "h_b", "h_c"))


@query(f"WITH {FINAL} SELECT desig, desig % 43 = 0 OR (desig % 47 = 0 AND arc_length IS NOT NULL AND desig % 2 = 0) AS filtered_out FROM final")
def catalog_flags(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    always = final.filter("desig % 43 = 0").select("desig")
    held = final.filter("desig % 47 = 0").select("desig", (c("arc_length") + c("desig") % 2).alias("arc_length"))  # of odd keys the arc has changed
    return catalog.flagged(final, always.unionByName(always), held).select("desig", "filtered_out")


@query(f"WITH {ORB}, v AS (SELECT desig, max(num_opps + desig % 5 - 2) AS n FROM orb WHERE desig % 41 = 0 GROUP BY desig) SELECT desig, greatest(num_opps, n)::BIGINT AS num_opps FROM orb LEFT JOIN v USING (desig)")
def opposition_override(spark, sf_dir):
    orb = fx.orbits(spark, sf_dir)
    over = orb.filter("desig % 41 = 0").selectExpr("desig", "num_opps + desig % 5 - 2 as num_opps")
    return catalog.raise_only(orb.select("desig", "num_opps"), over, "desig", "num_opps")


@query(f"WITH {FINAL}, f AS (SELECT desig, coalesce(CASE WHEN desig % 41 = 0 THEN 11.0 + (desig % 5) WHEN desig % 53 = 0 THEN 12.5 END, h) AS h FROM final) SELECT desig, round(h, 6) AS h FROM f")
def h_corrections(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    fixes = final.filter("desig % 53 = 0").select("desig", F.lit(12.5).alias("h"), F.lit(1).alias("line_no")).unionByName(final.filter("desig % 41 = 0").select("desig", F.lit(9.0).alias("h"), F.lit(2).alias("line_no")))
    fixes = fixes.unionByName(final.filter("desig % 41 = 0").select("desig", (11.0 + c("desig") % 5).alias("h"), F.lit(3).alias("line_no")))
    return rounded(catalog.corrected(final, fixes).select("desig", "h"))


@query(f"""WITH {FINAL}, v AS (SELECT desig, CASE WHEN desig % 41 = 0 THEN greatest(num_opps, num_opps + desig % 5 - 2) ELSE num_opps END AS num_opps, CASE WHEN desig % 37 = 0 THEN CASE WHEN nights IS NULL OR nights < 6 THEN 6 ELSE nights END ELSE nights END AS nights, arc_length FROM final)
 SELECT desig, num_opps, nights, CASE WHEN num_opps >= 2 THEN NULL ELSE arc_length END AS arc_length, CASE WHEN num_opps >= 4 THEN 1 ELSE 0 END::BIGINT AS is_past_threshold, num_opps - 1 AS num_opps_minus_one FROM v""")  # fmt: skip
def catalog_overrides(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    opps = final.filter("desig % 41 = 0").selectExpr("desig", "num_opps + desig % 5 - 2 as num_opps")
    nights = final.filter("desig % 37 = 0").selectExpr("desig", "6L as nights")
    rows = catalog.raise_only(final, nights.unionByName(nights), "desig", "nights")
    rows = catalog.targets(catalog.raise_only(rows, opps, "desig", "num_opps", null_too=False))
    return rounded(rows.select("desig", "num_opps", "nights", "arc_length", "is_past_threshold", "num_opps_minus_one"))


@query(f"WITH {FINAL} SELECT desig, replace(name, ' ', '') [1:4] || ' ' || replace(name, ' ', '')[5:] AS name, {r6(n='360/pow(a, 1.5)/365.2569', perihelion='a*(1-e)', aphelion='a*(1+e)', epoch='57000.0 + desig % 3000 + 2400000.5')} FROM final")
def external_elements(spark, sf_dir):
    rows = fx.final(spark, sf_dir).select("desig", F.concat(F.lit("'"), F.replace("name", F.lit(" "), F.lit("")), F.lit("'")).alias("name"), "a", "e", (57000.0 + c("desig") % 3000).alias("epoch_mjd"))
    return rounded(catalog.external_elements(rows).select("desig", "name", "n", "perihelion", "aphelion", "epoch"))


def _training(name: str, kind: str, where: str) -> None:
    def run(spark, sf_dir):
        rows = compared(spark, sf_dir)
        known, dual = rows.filter("desig % 53 = 0").select("desig"), rows.filter("desig % 59 = 7").select("number")
        return catalog.training_filter(rows, known, dual, kind).select("desig")

    query(f"WITH {OTHERS} SELECT desig FROM d WHERE {where} AND NOT multi_disagree AND desig % 53 <> 0 AND NOT number IN (SELECT desig * 3 FROM final WHERE desig % 59 = 7)", name)(run)


_training("training_filter", "notebook", "(arc_length >= 20 OR arc_length IS NULL OR q < 1.3) AND num_obs >= 16 AND NOT filtered_out AND a_diff < 0.0005 AND e_diff < 0.00015 AND i_diff < 0.003 AND (ext < 0.1 OR ext IS NULL OR q < 1.3) AND (u < 9 OR q < 1.3)")
_training("training_filter_tuner", "tuner", "(arc_length >= 20 OR arc_length IS NULL) AND num_obs >= 16 AND h_diff_abs_max < 0.3 AND a_diff < 0.0005 AND e_diff < 0.00015 AND i_diff < 0.003 AND ext < 0.1 AND u < 9")
_training("training_filter_neo", "neo", "q < 1.3 AND (arc_length >= 3 OR arc_length IS NULL) AND num_obs >= 16 AND h_diff_abs_max < 0.4 AND a_diff < 0.0008 AND e_diff < 0.00025 AND i_diff < 0.004 AND ext < 0.25")


@query(f"WITH {FINAL} SELECT desig, q FROM final WHERE h IS NOT NULL AND prob IS NOT NULL AND u IS NOT NULL")
def null_pruning(spark, sf_dir):
    """Columns over a tenth null go (arc_length), rows with a null in the others that have some go too."""
    rows = fx.final(spark, sf_dir)
    names = catalog.filled_columns(rows, ["h", "prob", "u", "arc_length"])
    return rows.na.drop("any", subset=names).select("desig", "q")


@query(f"WITH {FINAL} SELECT desig, CASE WHEN desig % 3 = 0 THEN name ELSE (desig * 3)::VARCHAR || ' ' || name END AS label FROM final WHERE NOT contains(name, '-')")
def composed_labels(spark, sf_dir):
    rows = fx.final(spark, sf_dir).filter(~c("name").contains("-"))
    return rows.select("desig", F.concat_ws(" ", F.when(c("desig") % 3 != 0, (c("desig") * 3).cast("string")), "name").alias("label"))


@query(f"WITH {FINAL}, t AS (SELECT desig, CASE desig % 4 WHEN 0 THEN (desig % 10)::VARCHAR WHEN 1 THEN '' WHEN 2 THEN 'E' END AS u FROM final) SELECT desig, coalesce(try_cast(nullif(u, '') AS DOUBLE), 10.0) AS u FROM t")
def coerced_u(spark, sf_dir):
    k = c("desig")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 10).cast("string"))).when(k % 4 == 1, "").when(k % 4 == 2, "E")
    return fx.final(spark, sf_dir).select("desig", text.alias("u")).select("desig", catalog.coerced("u", 10.0).alias("u"))


@query(f"""WITH {FINAL}, b AS (SELECT CASE WHEN a < 2.5 THEN 'inner' WHEN a < 2.8 THEN 'middle' ELSE 'outer' END AS belt, floor(h)::BIGINT AS h_floor, num_opps, CASE WHEN try_cast(substring(name, 1, 4) AS INT) <= 2030 THEN try_cast(substring(name, 1, 4) AS INT) END AS yr FROM final WHERE e < 0.2 AND a BETWEEN 1.9 AND 3.2 AND h IS NOT NULL)
 SELECT belt, h_floor, count(*)::BIGINT AS n, round(avg(yr), 6) AS mean_year, round(avg(num_opps), 6) AS mean_opps, round(100*avg(CASE WHEN num_opps = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share FROM b GROUP BY ALL""")  # fmt: skip
def belt_stats(spark, sf_dir):
    belt, year = F.when(c("a") < 2.5, "inner").when(c("a") < 2.8, "middle").otherwise("outer"), F.substring("name", 1, 4).try_cast("int")
    rows = fx.final(spark, sf_dir).filter((c("e") < 0.2) & c("a").between(1.9, 3.2) & c("h").isNotNull())
    return rounded(rows.groupBy(belt.alias("belt"), F.floor("h").alias("h_floor")).agg(F.count("*").alias("n"), F.avg(F.when(year <= 2030, year)).alias("mean_year"), F.avg("num_opps").alias("mean_opps"), (100 * F.avg((c("num_opps") == 1).cast("double"))).alias("single_share")))


USABLE = "u0 AS (SELECT * FROM final WHERE NOT coalesce(ref[1:5] = 'E2026', false) AND nights IS NOT NULL)"
POSITIVE = f"""{FINAL}, {USABLE}, s AS (SELECT desig, 1 AS source, 1.0 AS weight FROM u0 WHERE prob > 0.985 AND num_opps BETWEEN 2 AND 3 AND nights <= 10
 UNION ALL SELECT desig, 2, 1.0 FROM u0 WHERE prob > 0.975 AND num_opps = 1 AND nights < 4 UNION ALL SELECT desig, 3, 0.2 FROM u0 WHERE prob > 0.975 AND num_opps = 1 AND nights >= 4 AND ext >= 0.01
 UNION ALL SELECT desig, 4, 1.0 FROM final WHERE desig % 47 = 0 AND desig % 2 = 0 AND arc_length IS NOT NULL UNION ALL SELECT desig, 5, 1.0 FROM final WHERE desig % 43 = 0 AND desig % 3 <> 0
 UNION ALL SELECT desig, 6, 1.0 FROM u0 WHERE v_max - v_min > 3 AND v_max - v_avg > 0.5 AND v_avg - v_min > 1.5 AND v_second_max - v_second_min > 1.5 AND arc_length BETWEEN 7 AND 30 AND nights <= 4 AND q BETWEEN 1.6 AND 3.5
 UNION ALL SELECT desig, 7, 5.0 FROM u0 WHERE prob > 0.98 AND num_opps BETWEEN 2 AND 3 AND longest_opp_arc < 5 AND nights <= 7 UNION ALL SELECT desig, 8, 0.4 FROM u0 WHERE prob > 0.975 AND num_opps = 1 AND u = 9),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY desig ORDER BY weight DESC, source) = 1),
 pos AS (SELECT desig, source::BIGINT AS source, weight::DOUBLE AS weight FROM b JOIN final USING (desig) WHERE NOT coalesce(arc_length >= 12 AND nights >= 5 AND num_opps = 1, false) AND NOT coalesce(second_nights > 1, false))"""
NEGATIVE = """n0 AS (SELECT * FROM u0 WHERE prob < 0.6 AND num_opps < 3), n1 AS (SELECT desig, 1 AS source, 5000.0 AS target FROM n0 WHERE nights >= 5 AND num_opps = 1 UNION ALL SELECT desig, 2, 5000 FROM n0
 UNION ALL SELECT desig, 3, 7000 FROM n0 WHERE nights >= 4 OR (nights = 3 AND arc_length BETWEEN 11 AND 22) UNION ALL SELECT desig, 4, 2000 FROM u0 WHERE num_opps >= 3 UNION ALL SELECT desig, 5, 500 FROM u0 WHERE num_opps >= 4 AND longest_opp_arc < 6
 UNION ALL SELECT desig, 6, 8000 FROM n0 WHERE nights = 4 AND u < 9 UNION ALL SELECT desig, 7, 500 FROM u0 WHERE prob < 0.97 AND num_opps = 3
 UNION ALL SELECT desig, 8, NULL FROM n0 WHERE v_second_max - v_second_min < 0.8 AND arc_length BETWEEN 11 AND 17 AND nights BETWEEN 3 AND 5 AND prob < 0.4 AND rms < 0.09 UNION ALL SELECT desig, 9, 2000 FROM u0 WHERE second_nights = 2),
 n2 AS (SELECT desig, source, coalesce(target::DOUBLE / count(*) OVER (PARTITION BY source), 1.0) AS weight FROM n1),
 neg AS (SELECT desig, source::BIGINT AS source, round(weight, 6) AS weight FROM n2 QUALIFY row_number() OVER (PARTITION BY desig ORDER BY weight DESC, source) = 1)"""


def _positive(spark, sf_dir):
    final = fx.final(spark, sf_dir)
    unless = final.filter("desig % 47 = 0").select("desig", "arc_length", F.when(c("desig") % 2 == 0, "a Mislinkage").otherwise("photometry").alias("reason"))
    named = final.filter("desig % 43 = 0").select("desig", F.when(c("desig") % 3 != 0, "MISL").alias("reason"))
    return catalog.positives(final, final, unless.unionByName(unless), named)


@query(f"WITH {POSITIVE} SELECT * FROM pos")
def label_positive(spark, sf_dir):
    return rounded(_positive(spark, sf_dir))


@query(f"WITH {FINAL}, {USABLE}, {NEGATIVE} SELECT * FROM neg")
def label_negative(spark, sf_dir):
    return rounded(catalog.negatives(fx.final(spark, sf_dir)))


@query(f"WITH {POSITIVE}, {NEGATIVE} SELECT desig, source, weight, 1::BIGINT AS label, NULL::DOUBLE AS note FROM pos UNION ALL SELECT desig, source, weight, 0, 0.5 FROM neg")
def label_union(spark, sf_dir):
    """Both classes as one bag; an object may be in each. The note that positives lack is null."""
    neg = catalog.negatives(fx.final(spark, sf_dir)).withColumns({"label": F.lit(0), "note": F.lit(0.5)})
    return rounded(catalog.bag_union(_positive(spark, sf_dir).withColumn("label", F.lit(1)), neg))


COMETS = f"""{FINAL}, k AS (SELECT desig, ['P', 'D', 'A', 'C'][(desig % 4)::INT + 1] AS kind, 'K' || lpad(desig::VARCHAR, 6, '0') AS packed, q, e, (1990 + desig % 30)::DOUBLE AS y, (1 + desig % 12)::DOUBLE AS mo, 1 + (desig % 280)/10.0 AS d FROM final),
 m AS (SELECT CASE WHEN desig % 4 = 1 THEN 'D' ELSE 'P' END || 'K' || lpad(desig::VARCHAR, 6, '0') AS full_packed, 12.0 + desig % 8 AS mag FROM final WHERE desig % 5 <> 0)"""


@query(f"""WITH {COMETS}, j AS (SELECT k.*, q/(1-e) AS a, CASE WHEN desig % 97 = 0 THEN 15.35 ELSE mag END AS h, CASE WHEN mo <= 2 THEN y - 1 ELSE y END AS y2, CASE WHEN mo <= 2 THEN mo + 12 ELSE mo END AS m2 FROM k LEFT JOIN m ON full_packed = kind || packed WHERE kind IN ('P', 'D', 'A'))
 SELECT desig, {r6(a='a', period='sqrt(a*a*a)', h='h::DOUBLE', tp='floor(365.25*(y2+4716)) + floor(30.6001*(m2+1)) + d::DOUBLE + 2 - floor(y2/100) + floor(floor(y2/100)/4) - 1524.5')}, CASE WHEN desig % 89 = 0 THEN 1 END::BIGINT AS num_opps FROM j""")  # fmt: skip
def comet_elements(spark, sf_dir):
    """Types P, D and A, elements, magnitudes joined by the composed key, named cells overridden, oppositions only of those listed."""
    k, final = c("desig"), fx.final(spark, sf_dir)
    packed = F.concat(F.lit("K"), F.lpad(k.cast("string"), 6, "0"))
    comets = final.select("desig", F.element_at(F.array(*map(F.lit, "PDAC")), (k % 4 + 1).cast("int")).alias("kind"), packed.alias("packed"), "q", "e", (1990 + k % 30).cast("double").alias("y"), (1 + k % 12).cast("double").alias("mo"), (1 + (k % 280) / 10).alias("d"))
    mags = final.filter("desig % 5 <> 0").select(F.concat(F.when(k % 4 == 1, "D").otherwise("P"), packed).alias("full_packed"), (12.0 + k % 8).alias("mag"))
    rows = comets.filter(c("kind").isin("P", "D", "A")).join(mags, F.concat("kind", "packed") == c("full_packed"), "left")
    named = final.filter("desig % 97 = 0").select("desig", F.lit(15.35).alias("_mag"))
    listed = final.filter("desig % 89 = 0").select("desig", F.lit(1).alias("num_opps"))
    rows = rows.join(named, "desig", "left").join(listed, "desig", "left").withColumn("a", c("q") / (1 - c("e")))
    return rounded(rows.select("desig", "a", F.sqrt(F.pow("a", F.lit(3))).alias("period"), F.coalesce("_mag", "mag").alias("h"), orbit.julian_day(c("y"), c("mo"), c("d")).alias("tp"), "num_opps"))


@query(f"""WITH {FINAL}, n AS (SELECT desig AS note, CASE WHEN desig % 2 = 0 THEN (desig % 400)::VARCHAR || 'P/' || name ELSE name END AS wanted, CASE WHEN desig % 3 = 0 THEN 'asteroidal' WHEN desig % 5 = 0 THEN 'other' ELSE 'cometary' END AS kind, desig % 4 = 0 AS dagger FROM final WHERE desig % 17 = 0 UNION ALL SELECT -1, 'no such', 'cometary', false),
 j AS (SELECT n.*, f.prob, CASE WHEN dagger AND f.desig IS NOT NULL THEN 1 ELSE f.num_opps END AS num_opps, CASE WHEN dagger THEN f.quantile_opps - 1 ELSE f.quantile_opps - f.num_opps END AS delta_q,
  CASE WHEN f.desig IS NOT NULL THEN (SELECT sum(exp(-(f.expected-1)) * pow(f.expected-1, j) / factorial(j::INT)) FROM range(0, 13) r(j) WHERE j <= CASE WHEN n.dagger THEN 0 ELSE f.num_opps - 1 END) END AS s_ev FROM n LEFT JOIN final f ON f.name = wanted OR f.name = regexp_replace(wanted, '^[0-9]+[PDAI]/', ''))
 SELECT note, CASE WHEN kind <> 'cometary' THEN 'asteroidal' WHEN num_opps > 1 THEN 'comets of many' ELSE 'comets of one' END AS section, num_opps, {r6(delta_q='delta_q', s_ev='s_ev')},
  row_number() OVER (PARTITION BY CASE WHEN kind <> 'cometary' THEN 'asteroidal' WHEN num_opps > 1 THEN 'comets of many' ELSE 'comets of one' END ORDER BY CASE WHEN kind = 'cometary' AND num_opps > 1 THEN round(s_ev, 9) END NULLS LAST, CASE WHEN kind <> 'cometary' OR num_opps IS NULL OR num_opps <= 1 THEN prob END DESC NULLS LAST, note) AS place FROM j""")  # fmt: skip
def results_report(spark, sf_dir):
    """Rows of the results table: notes looked up by name, with or without a comet's number; daggered ones as if of one opposition; three sections in order, unknown kinds in the asteroidal one."""
    from pyspark.sql import Window

    k, final = c("desig"), fx.final(spark, sf_dir)
    notes = final.filter("desig % 17 = 0").select(k.alias("note"), F.when(k % 2 == 0, F.concat((k % 400).cast("string"), F.lit("P/"), "name")).otherwise(c("name")).alias("name"), F.when(k % 3 == 0, "asteroidal").when(k % 5 == 0, "other").otherwise("cometary").alias("kind"), (k % 4 == 0).alias("dagger"))
    notes = notes.unionByName(spark.sql("SELECT -1L AS note, 'no such' AS name, 'cometary' AS kind, false AS dagger"))
    data = final.select("name", "prob", "num_opps", "quantile_opps", "expected", k.alias("line_no"), k.alias("found"))
    rows = catalog.looked_up(notes, data)
    n = F.when(c("dagger") & c("found").isNotNull(), 1).otherwise(c("num_opps"))
    rows = rows.withColumn("num_opps", n).withColumns({"delta_q": c("quantile_opps") - c("num_opps"), "s_ev": orbit.poisson_cdf(c("num_opps") - 1, c("expected") - 1)})
    rows = rows.withColumn("section", F.when(c("kind") != "cometary", "asteroidal").when(c("num_opps") > 1, "comets of many").otherwise("comets of one"))
    many = c("section") == "comets of many"
    order = Window.partitionBy("section").orderBy(F.when(many, F.round("s_ev", 9)).asc_nulls_last(), F.when(~many, c("prob")).desc_nulls_last(), "note")
    return rounded(rows.withColumn("place", F.row_number().over(order)).select("note", "section", "num_opps", "delta_q", "s_ev", "place"))


@query(f"WITH {FINAL} SELECT (desig * 3)::BIGINT AS item FROM final WHERE desig % 59 = 7")
def json_list_scan(spark, sf_dir):
    """A JSON array of the keys, written by a grouped sum and read back."""
    text = fx.final(spark, sf_dir).filter("desig % 59 = 7").agg(F.to_json(F.collect_list(c("desig") * 3)).alias("value"))
    return text.select(F.explode(F.from_json("value", "array<bigint>")).alias("item"))


@query(f"WITH {FINAL} SELECT name, round(expected, 6) AS expected, nights FROM final")
def keyed_json_scan(spark, sf_dir):
    """JSON objects of statistics by name, a file's worth of names each, read back as rows."""
    from skycensus.sources.files import keyed_json

    one = F.struct("name", F.struct("expected", "nights"))
    text = fx.final(spark, sf_dir).groupBy((c("desig") % 8).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value"))
    return rounded(keyed_json(text, "expected double, nights bigint", "name"))


@query(f"WITH {FINAL} SELECT desig, '    ' || ['P', 'D', 'A', 'C'][(desig % 4)::INT + 1] || name AS value FROM final WHERE desig % 4 < 3 AND desig % 5 <> 0")
def kept_lines(spark, sf_dir):
    from skycensus.sources.files import kept_lines as keep

    k = c("desig")
    text = F.concat(F.when(k % 5 == 0, "   ").otherwise("    "), F.element_at(F.array(*map(F.lit, "PDAC")), (k % 4 + 1).cast("int")), "name")
    return keep(fx.final(spark, sf_dir).select("desig", text.alias("value")))
