"""Registered queries of a run's own checks: warnings, and the dictionary of features with what its columns hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.dictionary import Feature, FeatureDictionary
from tidemark.plans import study
from tidemark.plans.features import _HOUR, timeframe
from tidemark.plans.queries import SQL, context, hourly, query
from tidemark.plans.queries import matched_controls as controls_of_wide_bars

_EVENTS = SQL["matched_controls"][: SQL["matched_controls"].index(", pool AS")]
_N = "CAST(count(*) AS DOUBLE)"


@query(f"WITH found AS (SELECT symbol, session, count(*) AS found FROM ({SQL['matched_controls']}) GROUP BY 1, 2), n AS (SELECT symbol, session, count(*) AS episodes FROM ({_EVENTS} SELECT symbol, session FROM ev) GROUP BY 1, 2), r AS (SELECT symbol, session, episodes, coalesce(found, 0) / (episodes * 3) AS rate FROM n LEFT JOIN found USING (symbol, session)) SELECT symbol, session, 'few_episodes' AS warning, CAST(episodes AS DOUBLE) AS value FROM r WHERE episodes < 30 UNION ALL SELECT symbol, session, 'unmatched', round(rate, 6) FROM r WHERE rate < 0.95")
def run_warnings(spark, sf_dir):
    events = context(hourly(spark, sf_dir)).where("high - low > 9500")
    return study.run_warnings(events, controls_of_wide_bars(spark, sf_dir), ["symbol", "session"], 3)


_DOCUMENTED = {"score": "order", "entangled": "order", "width_atr": "ribbon", "slope_atr": "slope"}
_HELD = " UNION ALL ".join(f"SELECT '{n}' AS name, '{f}' AS family, count({n}) AS present, round(min({n}), 5) AS least, round(max({n}), 5) AS most FROM f" for n, f in _DOCUMENTED.items())


@query(f"{_HOUR}, f AS (SELECT {', '.join(_DOCUMENTED)} FROM one_f) {_HELD}")
def feature_dictionary(spark, sf_dir):
    """The documented features beside what the matrix holds of each: one aggregate and a small join."""
    documented = FeatureDictionary(Feature(n, "1h", f, "share", n) for n, f in _DOCUMENTED.items())
    rows = documented.select(timeframe(spark, sf_dir, 1), ["symbol", "t"], "double")
    cells = [F.struct(F.lit(n).alias("name"), F.count(n).alias("present"), F.round(F.min(n), 5).alias("least"), F.round(F.max(n), 5).alias("most")) for n in documented.names]
    held = rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return F.broadcast(documented.table(spark).select("name", "family")).join(held, "name")
