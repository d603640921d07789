"""Ranked candidate lists: predicate, order with nulls last and the key to part ties, limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


@dataclass
class Spec:
    """`order` ranks the rows that pass all of `where`; where a list is cut before it is sorted, `order` is what it is cut by."""

    where: list[Column]
    order: str = "delta_q"
    descending: bool = True
    limit: int = 20


def _in(name: str, least: float, most: float) -> Column:
    return c(name).between(least, most)


def _or_null(x: Column, name: str) -> Column:
    return x | c(name).isNull()


def _ext(most: float) -> Column:
    """ext in 0 .. most, or nights unknown."""
    return _in("ext", 0, most) | c("nights").isNull()


def _year() -> Column:
    return F.substring("name", 1, 4).try_cast("int")


def specs() -> dict[str, Spec]:
    arc7, arc8, arc11, arc3 = _or_null(c("arc_length") > 7, "arc_length"), _or_null(c("arc_length") >= 8, "arc_length"), _or_null(c("arc_length") > 11, "arc_length"), _or_null(c("arc_length") >= 3, "arc_length")
    short, obs7, trojan = c("period") < 20, c("num_obs") > 7, _in("a", 5, 5.4)
    base = [arc8, c("num_obs") >= 6, (c("num_obs") >= 7) | (c("nights") >= 5), c("delta_q") > 0.3 * c("quantile_opps"), c("prob") > 0.9, c("q") > 1.1, short]
    comet = [c("num_opps") >= 2, ~trojan, c("prob") > 0.5, c("q") > 1.1, _in("a", 1.1, 9), ~_in("a", 4.9, 5.5), c("delta_q") > -4, _in("ext", 0, 0.6), c("period") < 40]
    single, wide, dim = c("num_opps") == 1, _in("a", 1.05, 20), c("v_avg") - c("v_min")
    out = {
        "combined": Spec(base, "priority", limit=25),
        "combined_tight": Spec([*base, _ext(0.9)], "priority", limit=25),
        "uncertain": Spec([*base, _in("u", 8, 9) | (c("arc_length") < 13)], "priority", limit=25),
        "distant": Spec([arc8, c("num_obs") >= 6, c("a") > 5.4, c("num_opps") < 9, c("prob") > 0.65, _ext(0.5), short], "poisson", False),
        "distant_all": Spec([arc8, c("num_obs") >= 6, c("a") > 5.4, _ext(0.9), short], "poisson", False),
        "distant_strict": Spec([arc8, c("num_obs") >= 6, c("a") > 5.4, c("num_opps") < 7, c("prob") > 0.88, _ext(0.9), short], "poisson", False),
        "comets": Spec([*comet, c("tj") < 3.05, c("poisson") < 0.05], "poisson", False, 15),
        "comets_below_3": Spec([*comet, c("tj") < 3, c("poisson") < 0.07], "poisson", False, 15),
        "asteroids_multi": Spec([*comet, c("tj") >= 3, c("poisson") < 0.07], "poisson", False, 10),
        "by_prob": Spec([c("arc_length") > 7, single, obs7, c("prob") > 0.999, c("a") > 1.1, _ext(0.07), short], "prob", limit=30),
        "by_prob_strict": Spec([c("arc_length") > 7, single, obs7, c("prob") > 0.9993, c("a") > 1.1, _ext(0.15), short], "prob", limit=30),
        "tight_ext": Spec([arc7, _in("a", 1.15, 20), _in("ext", 0, 0.002)], limit=25),
        "tightest_ext": Spec([arc7, wide, _in("ext", 0, 0.0005)], limit=30),
        "by_ext": Spec([arc7, wide, c("delta_q") > 0.3 * c("quantile_opps"), c("q") > 1.1, _in("delta_q", 3.5, 1000)], "ext", False, 25),
        "by_ext_all": Spec([arc7, wide, _in("delta_q", 3.5, 1000)], "ext", False, 30),
        "by_ext_certain": Spec([arc7, wide, ~c("u").eqNullSafe(9), _in("delta_q", 3.6, 1000), c("delta_q") > 0.4 * c("quantile_opps")], "ext", False, 30),
        "comets_by_ext": Spec([arc7, wide, ~_in("a", 4.9, 5.5), c("tj") < 3.05, c("num_opps") <= 13, _in("prob", 0.85, 1000), _in("delta_q", 2.8, 1000)], "ext", False, 30),
        "comets_by_ext_strict": Spec([arc7, wide, ~_in("a", 4.9, 5.5), c("tj") < 3.03, c("num_opps") <= 13, _in("prob", 0.85, 1000), _in("delta_q", 2.8, 1000)], "ext", False, 30),
        "asteroid_single": Spec([c("arc_length") > 11, obs7, c("prob") > 0.98, c("tj") > 3.05, c("ext") < 0.07, short]),
        "asteroid_many_obs": Spec([c("arc_length") > 11, c("num_obs") > 16, c("prob") > 0.98, c("tj") > 3.05, c("ext") < 0.07, short], limit=10),
        "asteroid_by_expected": Spec([c("arc_length") > 11, obs7, c("prob") > 0.99, c("tj") > 3.05, c("ext") < 0.15, short], "expected"),
        "recent": Spec([c("arc_length") > 7, c("num_obs") > 5, c("prob") > 0.995, _year() >= 2025, short], limit=10),
        "recent_strict": Spec([c("arc_length") > 9, c("num_obs") > 6, c("prob") > 0.997, _year() >= 2025, short], limit=10),
        "recent_years": Spec([_year() >= 2025, _year() <= 2026, c("ext") < 0.1, c("prob") > 0.999]),
        "transition": Spec([arc11, obs7, c("ext") < 0.5, _in("a", 4.05, 5.05), c("tj") < 3.05, c("prob") > 0.8, short], "poisson", False, 10),
        "faint_deficit": Spec([arc7, wide, _in("ext", 0, 0.65), c("prob") > 0.999, dim < 3, _in("delta_q", 3, 1000)], "v_avg", False, 30),
        "faint_single": Spec([arc3, wide, _in("num_opps", 1, 1), _in("ext", 0, 0.9), c("prob") > 0.99, dim < 2.5, _year() > 1992, _in("delta_q", 1, 1000)], "v_avg", False, 30),
        "faint_certain": Spec([arc3, wide, _in("num_opps", 1, 1), _in("ext", 0, 0.6), c("prob") > 0.9998, dim < 2.5, ~c("u").eqNullSafe(9), _year() > 1992, _in("delta_q", 1, 1000)], "v_avg", False, 30),
        "faint_comets": Spec([arc7, _in("a", 1.05, 8), _in("q", 1.05, 20), _in("tj", 2, 3.03), _in("num_opps", 0, 1.5), _in("prob", 0.75, 1), _in("ext", 0, 0.6), dim < 3, _in("delta_q", 0.9, 1000)], "v_avg", False, 30),
        "four_nighters": Spec([c("arc_length") > 7, obs7, c("prob") > 0.9988, c("a") > 1.1, c("ext") > 0.15, c("nights") > 3, short]),
        "high_ext": Spec([c("arc_length") > 7, obs7, c("prob") > 0.9999, c("ext") > 0.15, c("ext") < 0.6, short], "ext", False),
        "comets_multi": Spec([c("num_opps") >= 3, c("prob") > 0.99, c("q") > 1.1, c("tj") < 3.01, _in("a", 1.1, 10), ~_in("a", 4.9, 5.5), c("delta_q") > -3, _in("ext", 0, 0.25), short], "poisson", False),
        "comets_single": Spec([c("arc_length") > 7, ~trojan, obs7, c("prob") > 0.9, c("tj") < 3.01, _ext(0.15), short], "prob"),
        "comets_by_quantile": Spec([c("arc_length") > 7, ~trojan, c("q") > 0.9, obs7, c("prob") > 0.9, c("tj") < 3.01, _ext(0.05), short], "quantile_opps"),
        "comets_outer": Spec([c("arc_length") > 7, ~trojan, c("a") > 4, c("a") < 10, obs7, c("prob") > 0.7, c("tj") < 3.05, _ext(0.15), short]),
        "comets_since": Spec([~trojan, short, c("arc_length") > 14, obs7, c("tj") < 3.01, c("prob") > 0.8, c("tp") > 2450000, _in("a", 1.1, 10), c("ext") < 0.15]),
        "comets_since_outer": Spec([~trojan, short, c("arc_length") > 14, c("a") > 4, obs7, c("tj") < 3.05, c("prob") > 0.7, c("tp") > 2450000, c("ext") < 0.15]),
        "comets_since_inner": Spec([~trojan, short, c("arc_length") > 14, c("a") < 4, obs7, c("tj") < 3.02, c("prob") > 0.7, c("tp") > 2450000, c("ext") < 0.15]),
        "neo_comets": Spec([c("arc_length") > 7, single, obs7, c("tj") < 3.02, c("q") < 1.3, short], "prob", limit=30),
        "trojans": Spec([c("arc_length") > 7, trojan, obs7, c("prob") > 0.98, _ext(0.15), short], limit=5),
        "above_probability": Spec([c("prob") > 0.97, c("h").isNotNull()], "prob", limit=1_000_000_000),
        "over_observed": Spec([c("expected") > 1, c("expected") < 1.5, c("num_obs") > 13, c("q") >= 1.3], "poisson", limit=1_000_000_000),
        "filtered_audit": Spec([*base, c("filtered_out"), _ext(0.9)], "audit_priority", limit=25),
        "decision_space": Spec([arc7, _in("a", 1.15, 20), _in("ext", 0, 0.002), single], limit=1_000_000_000),
    }
    clear = ~c("name").startswith("2010")
    for name, where in (
        ("sample_mislinked", [c("ext") > 0.8, c("prob") > 0.999, c("u") < 9, c("num_opps") > 1]), ("sample_uncertain", [c("ext") > 0.8, c("prob") > 0.999, c("arc_length") < 6]),
        ("sample_long_arc", [c("ext") > 0.8, c("prob") > 0.999, c("arc_length") > 25]), ("sample_secure", [c("ext") < 0.001, c("prob") > 0.998, single]),
    ):
        out[name] = Spec([*where, clear], "draw", False, 1_000_000_000 if name == "sample_long_arc" else 5)  # this one is shown whole
    return out


def prepared(final: DataFrame) -> DataFrame:
    """final with delta_q, both priorities and draw, an arithmetic draw by key for samples."""
    delta = c("quantile_opps") - c("num_opps")
    return final.withColumns({"delta_q": delta, "priority": delta - 15.5 * c("ext"), "audit_priority": delta - c("ext") * (10 - 3.8) / 0.4, "draw": (c("desig") * 7919) % 10_007})


def candidate_list(final: DataFrame, spec: Spec) -> DataFrame:
    """The rows of a list; a limit beyond any table is none."""
    rows = final
    for x in spec.where:
        rows = rows.filter(x)
    if spec.limit >= 1_000_000_000:
        return rows
    by = c(spec.order).desc_nulls_last() if spec.descending else c(spec.order).asc_nulls_last()
    return rows.orderBy(by, "desig").limit(spec.limit)
