"""Queries of the ranked lists. Their SQL predicates are written out by hand and share nothing with the specs of the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycensus.functions import orbit
from skycensus.operators import lists
from skycensus.plans import fixtures as fx
from skycensus.plans.base import FINAL, query, rounded

READY = f"""{FINAL}, p AS (SELECT desig, (SELECT sum(exp(-(expected-1)) * pow(expected-1, j) / factorial(j::INT)) FROM range(0, 13) r(j) WHERE j <= num_opps-1) AS cdf FROM final),
 f AS (SELECT final.*, round(cdf, 9) AS poisson, quantile_opps - num_opps AS delta_q, quantile_opps - num_opps - 15.5*ext AS priority, quantile_opps - num_opps - ext*(10-3.8)/0.4 AS audit_priority, desig*7919 % 10007 AS draw, try_cast(substring(name, 1, 4) AS INT) AS yr FROM final JOIN p USING (desig))"""
A8 = "(arc_length >= 8 OR arc_length IS NULL)"
A7 = "(arc_length > 7 OR arc_length IS NULL)"
COMBINED = f"{A8} AND num_obs >= 6 AND (num_obs >= 7 OR nights >= 5) AND delta_q > 0.3*quantile_opps AND prob > 0.9 AND q > 1.1 AND period < 20"
#: Name: predicate, order, direction, rows.
WHERE = {
    "combined": (COMBINED, "priority", "DESC", 25),
    "combined_tight": (COMBINED + " AND (ext BETWEEN 0 AND 0.9 OR nights IS NULL)", "priority", "DESC", 25),
    "uncertain": (COMBINED + " AND (u BETWEEN 8 AND 9 OR arc_length < 13)", "priority", "DESC", 25),
    "distant": (f"{A8} AND num_obs >= 6 AND a > 5.4 AND num_opps < 9 AND prob > 0.65 AND (ext BETWEEN 0 AND 0.5 OR nights IS NULL) AND period < 20", "poisson", "ASC", 20),
    "distant_all": (f"{A8} AND num_obs >= 6 AND a > 5.4 AND (ext BETWEEN 0 AND 0.9 OR nights IS NULL) AND period < 20", "poisson", "ASC", 20),
    "distant_strict": (f"{A8} AND num_obs >= 6 AND a > 5.4 AND num_opps < 7 AND prob > 0.88 AND (ext BETWEEN 0 AND 0.9 OR nights IS NULL) AND period < 20", "poisson", "ASC", 20),
    "comets": ("num_opps >= 2 AND prob > 0.5 AND q > 1.1 AND tj < 3.05 AND a BETWEEN 1.1 AND 9 AND NOT a BETWEEN 4.9 AND 5.5 AND poisson < 0.05 AND delta_q > -4 AND ext BETWEEN 0 AND 0.6 AND period < 40", "poisson", "ASC", 15),
    "comets_below_3": ("num_opps >= 2 AND prob > 0.5 AND q > 1.1 AND tj < 3 AND a BETWEEN 1.1 AND 9 AND NOT a BETWEEN 4.9 AND 5.5 AND poisson < 0.07 AND delta_q > -4 AND ext BETWEEN 0 AND 0.6 AND period < 40", "poisson", "ASC", 15),
    "asteroids_multi": ("num_opps >= 2 AND prob > 0.5 AND q > 1.1 AND tj >= 3 AND a BETWEEN 1.1 AND 9 AND NOT a BETWEEN 4.9 AND 5.5 AND poisson < 0.07 AND delta_q > -4 AND ext BETWEEN 0 AND 0.6 AND period < 40", "poisson", "ASC", 10),
    "by_prob": ("arc_length > 7 AND num_opps = 1 AND num_obs > 7 AND prob > 0.999 AND a > 1.1 AND (ext BETWEEN 0 AND 0.07 OR nights IS NULL) AND period < 20", "prob", "DESC", 30),
    "by_prob_strict": ("arc_length > 7 AND num_opps = 1 AND num_obs > 7 AND prob > 0.9993 AND a > 1.1 AND (ext BETWEEN 0 AND 0.15 OR nights IS NULL) AND period < 20", "prob", "DESC", 30),
    "tight_ext": (f"{A7} AND a BETWEEN 1.15 AND 20 AND ext BETWEEN 0 AND 0.002", "delta_q", "DESC", 25),
    "tightest_ext": (f"{A7} AND a BETWEEN 1.05 AND 20 AND ext BETWEEN 0 AND 0.0005", "delta_q", "DESC", 30),
    "by_ext": (f"{A7} AND a BETWEEN 1.05 AND 20 AND delta_q > 0.3*quantile_opps AND q > 1.1 AND delta_q BETWEEN 3.5 AND 1000", "ext", "ASC", 25),
    "by_ext_all": (f"{A7} AND a BETWEEN 1.05 AND 20 AND delta_q BETWEEN 3.5 AND 1000", "ext", "ASC", 30),
    "by_ext_certain": (f"{A7} AND a BETWEEN 1.05 AND 20 AND u IS DISTINCT FROM 9 AND delta_q BETWEEN 3.6 AND 1000 AND delta_q > 0.4*quantile_opps", "ext", "ASC", 30),
    "comets_by_ext": (f"{A7} AND a BETWEEN 1.05 AND 20 AND NOT a BETWEEN 4.9 AND 5.5 AND tj < 3.05 AND num_opps <= 13 AND prob BETWEEN 0.85 AND 1000 AND delta_q BETWEEN 2.8 AND 1000", "ext", "ASC", 30),
    "comets_by_ext_strict": (f"{A7} AND a BETWEEN 1.05 AND 20 AND NOT a BETWEEN 4.9 AND 5.5 AND tj < 3.03 AND num_opps <= 13 AND prob BETWEEN 0.85 AND 1000 AND delta_q BETWEEN 2.8 AND 1000", "ext", "ASC", 30),
    "asteroid_single": ("arc_length > 11 AND num_obs > 7 AND prob > 0.98 AND tj > 3.05 AND ext < 0.07 AND period < 20", "delta_q", "DESC", 20),
    "asteroid_many_obs": ("arc_length > 11 AND num_obs > 16 AND prob > 0.98 AND tj > 3.05 AND ext < 0.07 AND period < 20", "delta_q", "DESC", 10),
    "asteroid_by_expected": ("arc_length > 11 AND num_obs > 7 AND prob > 0.99 AND tj > 3.05 AND ext < 0.15 AND period < 20", "expected", "DESC", 20),
    "recent": ("arc_length > 7 AND num_obs > 5 AND prob > 0.995 AND yr >= 2025 AND period < 20", "delta_q", "DESC", 10),
    "recent_strict": ("arc_length > 9 AND num_obs > 6 AND prob > 0.997 AND yr >= 2025 AND period < 20", "delta_q", "DESC", 10),
    "recent_years": ("yr >= 2025 AND yr <= 2026 AND ext < 0.1 AND prob > 0.999", "delta_q", "DESC", 20),
    "transition": ("(arc_length > 11 OR arc_length IS NULL) AND num_obs > 7 AND ext < 0.5 AND a BETWEEN 4.05 AND 5.05 AND tj < 3.05 AND prob > 0.8 AND period < 20", "poisson", "ASC", 10),
    "faint_deficit": (f"{A7} AND a BETWEEN 1.05 AND 20 AND ext BETWEEN 0 AND 0.65 AND prob > 0.999 AND v_avg - v_min < 3 AND delta_q BETWEEN 3 AND 1000", "v_avg", "ASC", 30),
    "faint_single": ("(arc_length >= 3 OR arc_length IS NULL) AND a BETWEEN 1.05 AND 20 AND num_opps = 1 AND ext BETWEEN 0 AND 0.9 AND prob > 0.99 AND v_avg - v_min < 2.5 AND yr > 1992 AND delta_q BETWEEN 1 AND 1000", "v_avg", "ASC", 30),
    "faint_certain": ("(arc_length >= 3 OR arc_length IS NULL) AND a BETWEEN 1.05 AND 20 AND num_opps = 1 AND ext BETWEEN 0 AND 0.6 AND prob > 0.9998 AND v_avg - v_min < 2.5 AND u IS DISTINCT FROM 9 AND yr > 1992 AND delta_q BETWEEN 1 AND 1000", "v_avg", "ASC", 30),
    "faint_comets": (f"{A7} AND a BETWEEN 1.05 AND 8 AND q BETWEEN 1.05 AND 20 AND tj BETWEEN 2 AND 3.03 AND num_opps BETWEEN 0 AND 1.5 AND prob BETWEEN 0.75 AND 1 AND ext BETWEEN 0 AND 0.6 AND v_avg - v_min < 3 AND delta_q BETWEEN 0.9 AND 1000", "v_avg", "ASC", 30),
    "four_nighters": ("arc_length > 7 AND num_obs > 7 AND prob > 0.9988 AND a > 1.1 AND ext > 0.15 AND nights > 3 AND period < 20", "delta_q", "DESC", 20),
    "high_ext": ("arc_length > 7 AND num_obs > 7 AND prob > 0.9999 AND ext > 0.15 AND ext < 0.6 AND period < 20", "ext", "ASC", 20),
    "comets_multi": ("num_opps >= 3 AND prob > 0.99 AND q > 1.1 AND tj < 3.01 AND a BETWEEN 1.1 AND 10 AND NOT a BETWEEN 4.9 AND 5.5 AND delta_q > -3 AND ext BETWEEN 0 AND 0.25 AND period < 20", "poisson", "ASC", 20),
    "comets_single": ("arc_length > 7 AND NOT a BETWEEN 5 AND 5.4 AND num_obs > 7 AND prob > 0.9 AND tj < 3.01 AND (ext BETWEEN 0 AND 0.15 OR nights IS NULL) AND period < 20", "prob", "DESC", 20),
    "comets_by_quantile": ("arc_length > 7 AND NOT a BETWEEN 5 AND 5.4 AND q > 0.9 AND num_obs > 7 AND prob > 0.9 AND tj < 3.01 AND (ext BETWEEN 0 AND 0.05 OR nights IS NULL) AND period < 20", "quantile_opps", "DESC", 20),
    "comets_outer": ("arc_length > 7 AND NOT a BETWEEN 5 AND 5.4 AND a > 4 AND a < 10 AND num_obs > 7 AND prob > 0.7 AND tj < 3.05 AND (ext BETWEEN 0 AND 0.15 OR nights IS NULL) AND period < 20", "delta_q", "DESC", 20),
    "comets_since": ("NOT a BETWEEN 5 AND 5.4 AND period < 20 AND arc_length > 14 AND num_obs > 7 AND tj < 3.01 AND prob > 0.8 AND tp > 2450000 AND a BETWEEN 1.1 AND 10 AND ext < 0.15", "delta_q", "DESC", 20),
    "comets_since_outer": ("NOT a BETWEEN 5 AND 5.4 AND period < 20 AND arc_length > 14 AND a > 4 AND num_obs > 7 AND tj < 3.05 AND prob > 0.7 AND tp > 2450000 AND ext < 0.15", "delta_q", "DESC", 20),
    "comets_since_inner": ("NOT a BETWEEN 5 AND 5.4 AND period < 20 AND arc_length > 14 AND a < 4 AND num_obs > 7 AND tj < 3.02 AND prob > 0.7 AND tp > 2450000 AND ext < 0.15", "delta_q", "DESC", 20),
    "neo_comets": ("arc_length > 7 AND num_opps = 1 AND num_obs > 7 AND tj < 3.02 AND q < 1.3 AND period < 20", "prob", "DESC", 30),
    "trojans": ("arc_length > 7 AND a BETWEEN 5 AND 5.4 AND num_obs > 7 AND prob > 0.98 AND (ext BETWEEN 0 AND 0.15 OR nights IS NULL) AND period < 20", "delta_q", "DESC", 5),
    "above_probability": ("prob > 0.97 AND h IS NOT NULL", "prob", "DESC", None),
    "over_observed": ("expected > 1 AND expected < 1.5 AND num_obs > 13 AND q >= 1.3", "poisson", "DESC", None),
    "filtered_audit": (COMBINED + " AND filtered_out AND (ext BETWEEN 0 AND 0.9 OR nights IS NULL)", "audit_priority", "DESC", 25),
    "decision_space": (f"{A7} AND a BETWEEN 1.15 AND 20 AND ext BETWEEN 0 AND 0.002 AND num_opps = 1", "delta_q", "DESC", None),
    "sample_mislinked": ("ext > 0.8 AND prob > 0.999 AND u < 9 AND num_opps > 1 AND NOT starts_with(name, '2010')", "draw", "ASC", 5),
    "sample_uncertain": ("ext > 0.8 AND prob > 0.999 AND arc_length < 6 AND NOT starts_with(name, '2010')", "draw", "ASC", 5),
    "sample_long_arc": ("ext > 0.8 AND prob > 0.999 AND arc_length > 25 AND NOT starts_with(name, '2010')", "draw", "ASC", 1_000_000_000),
    "sample_secure": ("ext < 0.001 AND prob > 0.998 AND num_opps = 1 AND NOT starts_with(name, '2010')", "draw", "ASC", 5),
}


def final(spark, sf_dir):
    poisson = F.round(orbit.poisson_cdf(F.col("num_opps") - 1, F.col("expected") - 1), 9)
    return lists.prepared(fx.final(spark, sf_dir).withColumn("poisson", poisson))


def _list(name: str) -> None:
    where, order, way, rows = WHERE[name]
    limit = f" ORDER BY f.{order} {way} NULLS LAST, desig LIMIT {rows}" if rows else ""
    sql = f"WITH {READY} SELECT desig, round({order}::DOUBLE, 6) + 0.0 AS {order} FROM f WHERE {where}{limit}"

    def run(spark, sf_dir):
        spec = lists.specs()[name]
        return rounded(lists.candidate_list(final(spark, sf_dir), spec).select("desig", F.col(spec.order).cast("double").alias(spec.order)))

    query(sql, f"list_{name}")(run)


for _name in WHERE:
    _list(_name)


@query(f"WITH {FINAL} SELECT count(*)::BIGINT AS n FROM final WHERE ext > 0.8")
def high_ext_count(spark, sf_dir):
    return fx.final(spark, sf_dir).filter("ext > 0.8").agg(F.count("*").alias("n"))


@query(f"WITH {READY} SELECT desig, round(delta_q, 6) AS delta_q FROM f WHERE name IN (SELECT name FROM final WHERE desig % 29 = 0) ORDER BY f.delta_q DESC, desig LIMIT 30", "list_named")
def list_named(spark, sf_dir):
    names = fx.final(spark, sf_dir).filter("desig % 29 = 0").select("name")
    rows = final(spark, sf_dir).join(names, "name", "left_semi")
    return rounded(lists.candidate_list(rows, lists.Spec([], limit=30)).select("desig", "delta_q"))


@query(f"""WITH {READY} SELECT desig, CASE WHEN known THEN 'active' WHEN filtered_out THEN 'false positive' ELSE 'background' END AS label, tj < 3.05 AS cometary, round(delta_q, 6) + 0.0 AS dq,
 round(ln(greatest(1e-15, least(1-1e-15, prob)) / (1 - greatest(1e-15, least(1-1e-15, prob)))), 6) + CASE WHEN prob IS NOT NULL THEN 0.0 END AS logit_prob FROM f WHERE {A7} AND a BETWEEN 1.15 AND 20 AND ext BETWEEN 0 AND 0.002 AND num_opps = 1""")  # fmt: skip
def decision_space(spark, sf_dir):
    """The population of the decision space with its label group and side of the Tisserand split."""
    rows = lists.candidate_list(final(spark, sf_dir), lists.specs()["decision_space"])
    label = F.when(F.col("known"), "active").when(F.col("filtered_out"), "false positive").otherwise("background")
    return rounded(rows.select("desig", label.alias("label"), (F.col("tj") < 3.05).alias("cometary"), F.col("delta_q").alias("dq"), orbit.logit(F.col("prob")).alias("logit_prob")))


@query(f"""WITH {FINAL}, pop AS (SELECT name FROM final WHERE {A7} AND a BETWEEN 1.15 AND 20 AND ext BETWEEN 0 AND 0.002 AND num_opps = 1) SELECT name, 'active' AS label, name IN (SELECT name FROM pop) AS present FROM final WHERE known UNION ALL SELECT name, 'false positive', name IN (SELECT name FROM pop) FROM final WHERE filtered_out AND NOT known""")
def decision_space_labels(spark, sf_dir):
    """Which labelled objects the population's filter lets through."""
    every = fx.final(spark, sf_dir)
    inside = lists.candidate_list(final(spark, sf_dir), lists.specs()["decision_space"]).select("name", F.lit(True).alias("_in"))
    wanted = every.filter(F.col("known") | F.col("filtered_out")).select("name", F.when(F.col("known"), "active").otherwise("false positive").alias("label"))
    return wanted.join(inside, "name", "left").select("name", "label", F.coalesce("_in", F.lit(False)).alias("present"))
