"""Column functions, and the registration of the reusable ones for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfspark import rules


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_functions(category_rules) -> list[str]:
    from zoneinfo import available_timezones

    from shelfspark.functions.clock import CLOSE_TIME, DEFAULT_TIMEZONE, OPEN_TIME
    from shelfspark.functions.geo import EARTH_RADIUS_KM

    blank = r"[\\s\\x1c-\\x1f\\x85\\p{Z}]"
    number = _quote(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    table = ", ".join(
        f"named_struct('rank', {-i}, 'slug', {_quote(slug)}, 'words', array({', '.join(map(_quote, words))}))"
        for i, (slug, words) in enumerate(category_rules))
    leaves = " ".join(f"WHEN NOT crumbs AND sf_category_text(try_element_at(path, -1)) IN ({', '.join(map(_quote, words))}) "
                      f"THEN named_struct('slug', {_quote(slug)}, 'confidence', {rules.TERMINAL_CONFIDENCE}D)"
                      for slug, words in rules.TERMINAL_CATEGORIES.items())
    days = ", ".join(map(_quote, rules.WEEKDAYS))
    minute = lambda t: f"(try_cast(substr({t}, 1, 2) AS INT) * 60 + try_cast(substr({t}, 4, 2) AS INT))"
    start, end = minute("p.open"), minute("p.close")
    hours = ("STRUCT<version INT, kind STRING, timezone STRING, weekly MAP<STRING, ARRAY<STRUCT<open: STRING, close: STRING>>>, "
             "temporarilyClosed BOOLEAN>")
    return [
        f"""sf_squeeze(s STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(s, '{blank}+', ' '), '^ | $', '')""",
        rf"""normalize_text(s STRING) RETURNS STRING RETURN sf_squeeze(regexp_replace(
            lower(regexp_replace(nfkc(s), '^{blank}+|{blank}+$', '')), '[^\\p{{L}}\\p{{N}}_.+/\\-{blank[1:-1]}]', ' '))""",
        """slugify(s STRING) RETURNS STRING RETURN coalesce(nullif(left(regexp_replace(regexp_replace(lower(nfkd(s)), '[^a-z0-9]+', '-'),
            '^-+|-+$', ''), 120), ''), 'product')""",
        f"""parse_money(s STRING) RETURNS DECIMAL(14,2) RETURN CASE WHEN replace(replace(s, ' ', ''), ',', '.') RLIKE {number}
            THEN try_cast(replace(replace(s, ' ', ''), ',', '.') AS DECIMAL(14,2)) END""",
        f"""haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {2 * EARTH_RADIUS_KM}D * atan2(
            sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)),
            sqrt(1 - (power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))""",
        "sf_category_text(s STRING) RETURNS STRING RETURN sf_squeeze(translate(lower(s), 'șşțţ', 'sstt'))",
        f"""sf_votes(t STRING) RETURNS STRUCT<hits: INT, rank: INT, slug: STRING> RETURN array_max(transform(array({table}),
            r -> named_struct('hits', size(filter(r.words, w -> contains(t, w))), 'rank', r.rank, 'slug', r.slug)))""",
        f"""sf_category(path ARRAY<STRING>, crumbs BOOLEAN, p STRUCT<hits: INT, rank: INT, slug: STRING>, t STRUCT<hits: INT, rank: INT, slug: STRING>)
            RETURNS STRUCT<slug: STRING, confidence: DOUBLE> RETURN CASE
            WHEN crumbs AND p.hits > 0 THEN named_struct('slug', p.slug, 'confidence', round(least(0.99D, 0.84D + 0.05D * p.hits), 2))
            WHEN t.hits > 0 THEN named_struct('slug', t.slug, 'confidence', round(least(0.90D, 0.62D + 0.07D * t.hits), 2)) {leaves}
            WHEN NOT crumbs AND p.hits >= 2 THEN named_struct('slug', p.slug, 'confidence', round(least(0.79D, 0.62D + 0.07D * p.hits), 2))
            ELSE named_struct('slug', CAST(NULL AS STRING), 'confidence', 0.0D) END""",
        """map_category(path ARRAY<STRING>, title STRING, crumbs BOOLEAN) RETURNS STRUCT<slug: STRING, confidence: DOUBLE> RETURN
            sf_category(path, crumbs, sf_votes(sf_category_text(array_join(path, ' '))), sf_votes(sf_category_text(coalesce(title, ''))))""",
        f"""sf_open_at(today ARRAY<STRUCT<open: STRING, close: STRING>>, before ARRAY<STRUCT<open: STRING, close: STRING>>, m INT) RETURNS BOOLEAN RETURN
            exists(today, p -> CASE WHEN {start} = {end} THEN {start} = 0 WHEN {end} > {start} THEN m >= {start} AND m < {end} ELSE m >= {start} END)
            OR exists(before, p -> CASE WHEN {start} = {end} THEN {start} = 0 WHEN {end} > {start} THEN false ELSE m < {end} END)""",
        f"""sf_zone(zone STRING) RETURNS STRING RETURN CASE WHEN coalesce(nullif(zone, ''), '{DEFAULT_TIMEZONE}') IN
            ({', '.join(map(_quote, sorted(available_timezones())))}) THEN coalesce(nullif(zone, ''), '{DEFAULT_TIMEZONE}') END""",
        f"""sf_valid_hours(h {hours}) RETURNS BOOLEAN RETURN coalesce(h.version = 1 AND (h.kind = 'online_only' OR
            ((h.kind IS NULL OR h.kind = 'schedule') AND h.weekly IS NOT NULL AND
             forall(map_values(map_filter(h.weekly, (d, _) -> d IN ({days}))), d -> d IS NULL OR forall(d, p ->
                coalesce(p.open RLIKE {_quote(OPEN_TIME)} AND p.close RLIKE {_quote(CLOSE_TIME)}, false))))), false)""",
        f"""sf_state(h {hours}, today ARRAY<STRUCT<open: STRING, close: STRING>>, before ARRAY<STRUCT<open: STRING, close: STRING>>, m INT) RETURNS STRING RETURN
            CASE WHEN NOT sf_valid_hours(h) THEN 'unknown' WHEN h.kind = 'online_only' THEN 'online_only' WHEN h.temporarilyClosed THEN 'temporarily_closed'
            WHEN sf_zone(h.timezone) IS NULL OR today IS NULL OR before IS NULL THEN 'unknown' WHEN sf_open_at(today, before, m) THEN 'open' ELSE 'closed' END""",
        f"""sf_local(h {hours}, at TIMESTAMP) RETURNS TIMESTAMP RETURN from_utc_timestamp(at, coalesce(sf_zone(h.timezone), 'UTC'))""",
        f"""open_state(h {hours}, at TIMESTAMP) RETURNS STRING RETURN sf_state(h,
            try_element_at(h.weekly, array({days})[weekday(sf_local(h, at))]),
            try_element_at(h.weekly, array({days})[pmod(weekday(sf_local(h, at)) + 6, 7)]),
            hour(sf_local(h, at)) * 60 + minute(sf_local(h, at)))""",
    ]


def register_sql(spark: SparkSession, category_rules=rules.CATEGORY_RULES) -> None:
    """normalize_text, slugify, parse_money, map_category, haversine_km and open_state for SQL text."""
    from shelfspark.functions import text

    spark.udf.register("nfkc", text._nfkc)
    spark.udf.register("nfkd", text._nfkd)
    for body in _sql_functions(category_rules):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
