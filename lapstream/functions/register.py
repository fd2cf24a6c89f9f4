"""SQL names for column functions, as temporary SQL functions of a session: they stay expressions of the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scalars as S


def _either(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(column: str, table: dict, default) -> str:
    return f"CASE upper({column}) " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default!r} END"


def _millis(text: str) -> str:
    zoned = rf"{text} RLIKE r'(Z|[+-]\d\d:?\d\d)$'"
    return f"coalesce(unix_millis(CASE WHEN {zoned} THEN try_to_timestamp({text}) ELSE try_to_timestamp(concat({text}, 'Z')) END), 0)"


def definitions() -> dict[str, str]:
    """Name to signature and body."""
    worst = " ".join(f"WHEN contains(code, '{c}') THEN '{c}'" for c in S.SEVERITY)
    outcome = f"CASE WHEN result IN ({_either(S.POSITIVE_RESULTS)}) THEN '1' WHEN result IN ({_either(S.NEGATIVE_RESULTS)}) THEN '0' ELSE 'EXCLUDED' END"
    reason = f"CASE WHEN result IN ({_either(S.POSITIVE_RESULTS + S.NEGATIVE_RESULTS)}) THEN '' WHEN startswith(result, 'UNRESOLVED_') OR result = 'WEATHER_SURVIVAL_STOP' THEN result WHEN coalesce(result, '') = '' THEN 'MISSING_RESULT' ELSE concat('UNMAPPED_RESULT_', result) END"
    known = lambda x: f"coalesce(nullif(trim({x}), ''), '{S.GREEN}')"
    green = lambda x: f"{known(x)} = '{S.GREEN}'"
    mixed = r"regexp_replace(regexp_replace(regexp_replace(trim(text), r'^(\d{4}-\d\d-\d\d) ', '$1T'), 'Z$', '+00:00'), r'([+-]\d\d)(\d\d)$', '$1:$2')"
    return {
        "canonical_status": f"(code STRING) RETURNS STRING RETURN CASE {worst} ELSE '{S.GREEN}' END",
        "normalize_or_green": f"(code STRING) RETURNS STRING RETURN coalesce(nullif(trim(code), ''), '{S.GREEN}')",
        "is_caution": f"(code STRING) RETURNS BOOLEAN RETURN coalesce(code IN ({_either(S.CAUTION)}), false)",
        "is_green": f"(code STRING) RETURNS BOOLEAN RETURN {green('code')}",
        "parse_event_time": f"(text STRING) RETURNS BIGINT RETURN {_millis('text')}",
        "parse_mixed_ts": f"(text STRING) RETURNS BIGINT RETURN {_millis(mixed)}",
        "normalize_label": "(value STRING) RETURNS STRING RETURN CASE WHEN value IS NULL OR trim(value) IN ('', '<NA>') OR lower(trim(value)) = 'nan' THEN '' ELSE upper(replace(trim(value), ' ', '_')) END",
        "year_of_race": r"(race STRING) RETURNS INT RETURN try_cast(regexp_extract(race, r'^(\d{4}) :: ', 1) AS INT)",
        "strip_year_prefix": r"(race STRING) RETURNS STRING RETURN regexp_replace(race, r'^\d{4} :: ', '')",
        "with_year_prefix": "(year INT, race STRING) RETURNS STRING RETURN concat_ws(' :: ', CAST(year AS STRING), race)",
        "clean_lap": f"(lap_time DOUBLE, pit_in DOUBLE, pit_out DOUBLE, status STRING) RETURNS BOOLEAN RETURN coalesce(lap_time > 0 AND pit_in IS NULL AND pit_out IS NULL AND {green('status')}, false)",
        "accurate_or_pit": "(accurate BOOLEAN, pit_in DOUBLE, pit_out DOUBLE) RETURNS BOOLEAN RETURN coalesce(accurate, false) OR pit_in IS NOT NULL OR pit_out IS NOT NULL",
        "select_pit_loss": f"(status STRING, green DOUBLE, vsc DOUBLE, sc DOUBLE) RETURNS DOUBLE RETURN CASE {known('status')} WHEN '4' THEN sc WHEN '6' THEN vsc WHEN '7' THEN vsc WHEN '{S.GREEN}' THEN green END",
        "clip_ratio": "(x DOUBLE, missing DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN greatest(lo, least(hi, coalesce(CASE WHEN NOT isnan(x) AND abs(x) < double('Infinity') THEN x END, missing)))",
        "exclusion_reason": f"(result STRING) RETURNS STRING RETURN {reason}",
        "format_lap_time": "(seconds DOUBLE) RETURNS STRING RETURN CASE WHEN seconds IS NOT NULL THEN format_string('%d:%02d.%03d', floor(CAST(round(seconds * 1000) AS BIGINT) / 60000), floor(CAST(round(seconds * 1000) AS BIGINT) / 1000) % 60, CAST(round(seconds * 1000) AS BIGINT) % 1000) END",
        "compound_max_stint": f"(compound STRING) RETURNS DOUBLE RETURN CAST({_case('compound', S.MAX_STINT, 30.0)} AS DOUBLE)",
        "next_compound": f"(compound STRING) RETURNS STRING RETURN {_case('compound', S.NEXT_COMPOUND, 'MEDIUM')}",
        "outcome_of": f"(result STRING) RETURNS STRING RETURN {outcome}",
    }


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` in this session; returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
