"""DuckDB SQL that says the same as a query of this subpackage, over the same tables."""

from __future__ import annotations

from lobule.llm.queries import POSITION, PROFILE


def vectors(names: list[str]) -> str:
    def pick(column: str) -> str:
        return ", ".join(f"max({column}) FILTER (feature = '{n}') AS {column}_{i}" for i, n in enumerate(names))

    fine = " AND ".join(f'isfinite("{n}") AND "{n}" BETWEEN valid_min_{i} AND valid_max_{i}' for i, n in enumerate(names))
    values = ", ".join(f'("{n}" - center_{i}) / scale_{i} AS v{i}' for i, n in enumerate(names))
    return f"limits AS (SELECT {', '.join(pick(c) for c in ('center', 'scale', 'valid_min', 'valid_max'))} FROM feature_scale), cells AS (SELECT row_id, ascini_position, {values} FROM full_concat_clusters, limits WHERE {fine})"


def distance(a: str, b: str, n: int) -> str:
    return " + ".join(f"({a}.v{i} - {b}.v{i}) * ({a}.v{i} - {b}.v{i})" for i in range(n))


def neighbours(which: str, tail: str) -> str:
    names = PROFILE + POSITION
    return f"""WITH {vectors(names)}, pairs AS (SELECT q.row_id AS query_id, c.row_id AS neighbour_id, {distance('q', 'c', len(names))} AS square
      FROM cells q JOIN cells c ON q.row_id <> c.row_id WHERE {which}),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY square, neighbour_id) AS place FROM pairs QUALIFY place <= 10) {tail}"""


ORACLE = {
    "p1_found": neighbours("q.row_id IN (SELECT row_id FROM probe_cells)", "SELECT DISTINCT least(query_id, neighbour_id) AS row_id_a, greatest(query_id, neighbour_id) AS row_id_b FROM top"),
    "p1_neighbours": neighbours("q.row_id % 100 = 0", "SELECT query_id, neighbour_id, CAST(place AS INTEGER) AS place, round(sqrt(square), 6) AS distance FROM top"),
    "p2_groups": f"""WITH {vectors(PROFILE)}, near AS (SELECT a.row_id, b.row_id AS other, {distance('a', 'b', len(PROFILE))} AS square FROM cells a JOIN cells b ON {distance('a', 'b', len(PROFILE))} <= 6.25),
    degrees AS (SELECT row_id, min(other) AS class, round(sum(exp(-4 * square / 6.25)) - 1, 6) AS degree FROM near GROUP BY row_id),
    means AS (SELECT class, avg(ascini_position) FILTER (isfinite(ascini_position)) AS mean, count(*) AS size FROM degrees JOIN cells USING (row_id) GROUP BY class),
    numbers AS (SELECT class, size, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, class) AS INTEGER) AS group_no FROM means),
    ranked AS (SELECT row_id, class, row_number() OVER (PARTITION BY class ORDER BY degree DESC, row_id) AS n FROM degrees QUALIFY n <= 5)
    SELECT group_no, size, list(row_id ORDER BY n) AS typical_cells FROM ranked JOIN numbers USING (class) GROUP BY group_no, size""",
    "p5_torn": "SELECT 'cells' AS tab, count(*) AS records, 0 AS torn FROM full_concat_clusters UNION ALL SELECT 'mito', count(*), 0 FROM fig5_ivm_control_group_mitochondria_properties",
    "p6_sound": "SELECT count(*) AS documents, 0 AS torn, 0 AS overfull FROM documents WHERE text IS NOT NULL AND text <> ''",
    "p2_found": f"""WITH {vectors(PROFILE)},
    classes AS (SELECT a.row_id, min(b.row_id) AS class FROM cells a JOIN cells b ON {distance('a', 'b', len(PROFILE))} <= 6.25 GROUP BY a.row_id),
    means AS (SELECT class, avg(ascini_position) FILTER (isfinite(ascini_position)) AS mean FROM classes JOIN cells USING (row_id) GROUP BY class),
    numbers AS (SELECT class, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, class) AS INTEGER) AS group_no FROM means)
    SELECT row_id, group_no FROM classes JOIN numbers USING (class)""",
    "p3_found": r"""WITH counted AS (SELECT DISTINCT * EXCLUDE (row_id, loaded_at) FROM fig5_ivm_control_group_mitochondria_properties, (SELECT valid_min, valid_max FROM feature_scale WHERE feature = 'ratio_01_00')
      WHERE regexp_full_match(cell_label, '\s*CL\d+TS\d+R\d+Z\d+_\d+\s*', 'i') AND upper(regexp_replace(PV_CV, '\s', '', 'g')) IN ('PV', 'CV') AND isfinite(ratio_01_00) AND ratio_01_00 BETWEEN valid_min AND valid_max),
    named AS (SELECT 'CL' || regexp_extract(cell_label, 'CL0*(\d+)TS0*(\d+)R', 1, 'i') AS liver_code, 'TS' || regexp_extract(cell_label, 'CL0*(\d+)TS0*(\d+)R', 2, 'i') AS tile_section, upper(regexp_replace(PV_CV, '\s', '', 'g')) AS zone, ratio_01_00 FROM counted),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY liver_code, tile_section, zone ORDER BY ratio_01_00) AS rank, count(*) OVER (PARTITION BY liver_code, tile_section, zone) AS n FROM named)
    SELECT liver_code, tile_section, r.zone, pct FROM ranked r JOIN tmrm_limits l ON r.zone = l.zone AND rank = CAST(ceil(pct * n / 100.0) AS BIGINT) WHERE n >= 150 AND (ratio_01_00 < lower_limit OR ratio_01_00 > upper_limit)""",
    "p5_found": r"""WITH RECURSIVE links AS (SELECT regexp_replace(upper(regexp_replace(code_a, '[\s-]', '', 'g')), '^([A-Z]+)0*(\d+)$', '\1\2') AS a, regexp_replace(upper(regexp_replace(code_b, '[\s-]', '', 'g')), '^([A-Z]+)0*(\d+)$', '\1\2') AS b
      FROM specimen_links WHERE link_kind IN ('same_animal', 'reimaged', 'renamed') AND status = 'confirmed'),
    raw AS (SELECT 'cells' AS tab, row_id, coalesce(nullif(regexp_extract(labels, '(?:CNT|STV|WD)_(L\d+)L\d+a\d+s\d+_\d+', 1, 'i'), ''), nullif(regexp_extract(labels, '([A-Z]+[ -]*\d+)TS\d+', 1, 'i'), '')) AS raw FROM full_concat_clusters
      UNION ALL SELECT 'mito', row_id, coalesce(nullif(regexp_extract(cell_label, '([A-Z]+[ -]*\d+)TS\d+', 1, 'i'), ''), liver_id) FROM fig5_ivm_control_group_mitochondria_properties),
    coded AS (SELECT tab, row_id, regexp_replace(upper(regexp_replace(raw, '[\s-]', '', 'g')), '^([A-Z]+)0*(\d+)$', '\1\2') AS code FROM raw WHERE raw IS NOT NULL),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached AS (SELECT a AS code, a AS other FROM both_ways UNION SELECT r.code, e.b FROM reached r JOIN both_ways e ON r.other = e.a),
    animals AS (SELECT code, min(other) AS entity FROM reached GROUP BY code)
    SELECT tab, row_id, coalesce(entity, coded.code) AS entity FROM coded LEFT JOIN animals USING (code)""",
}
