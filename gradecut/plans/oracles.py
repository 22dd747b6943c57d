"""Reference SQL for the registered queries, written the plain way: self-joins, whole
products and recursive queries that the Spark side avoids."""

from __future__ import annotations

from gradecut.params import COUNTY_BY_PREFIX, COUNTY_NAMES, KNOTS_2025, Z_80

OFFERS = """
offers AS (
  SELECT CAST(year AS INTEGER) AS year, county, school, spec_id, course_label, 5 AS seats,
         occupied, vocational,
         CASE WHEN occupied >= 2 THEN sum_h // occupied END AS last_media_h
  FROM (SELECT year(o_orderdate) AS year, r_name AS county, n_name AS school,
               concat(p_brand, '/', CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END) AS spec_id,
               CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'Shared'
                    ELSE concat(p_brand, '/', CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END) END AS course_label,
               count(*) AS occupied, p_brand LIKE 'Brand#5%' AS vocational,
               CAST(sum(100 + CAST(round(l_extendedprice * 100) AS BIGINT) % 901) AS BIGINT) AS sum_h
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3, 4, 5, 7) t)"""

CANDIDATES = """
marks AS (
  SELECT l_orderkey * 10 + l_linenumber AS candidate_id, o_custkey AS school_id, r_name AS county,
         n_name AS school, l_partkey, l_linenumber AS line,
         CASE WHEN l_discount <= 0.095 THEN 100 + CAST(round(l_extendedprice * 100) AS BIGINT) % 901 END AS romana_h,
         CASE WHEN l_returnflag = 'N' THEN 100 + (l_orderkey * 13) % 901 END AS materna_h,
         100 + (l_partkey * 37 + l_suppkey * 11) % 901 AS matematica_h,
         500 + CAST(l_quantity AS BIGINT) * 10 AS school_media_h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
candidates AS (
  SELECT *, CASE WHEN materna_h IS NULL THEN (romana_h + matematica_h) // 2
                 ELSE (romana_h + materna_h + matematica_h) // 3 END
            + CASE WHEN l_partkey % 997 = 0 THEN 1 ELSE 0 END AS media_h
  FROM marks)"""

USABLE = "NOT (occupied < seats) AND NOT vocational AND last_media_h IS NOT NULL"


def phi(z: str) -> str:
    """The tabulated normal distribution function, spelt out."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (
        f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t}"
        f" + 0.254829592) * {t}"
    )
    erf = f"(1.0 - ({poly}) * exp(-({x} * {x})))"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} < 0 THEN 0.5 * (1.0 - {erf}) ELSE 0.5 * (1.0 + {erf}) END)"


def hypot(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


def band(p: str) -> str:
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= 0.9 THEN 'sigur' WHEN {p} >= 0.7 THEN 'probabil' "
        f"WHEN {p} >= 0.3 THEN 'incert' WHEN {p} >= 0.1 THEN 'putin probabil' ELSE 'improbabil' END"
    )


def model(target: int, where: str = "TRUE", suffix: str = "", fixed_prior: bool = False) -> str:
    """CTEs ending in ``model{suffix}``: the fit of every county on the offers in ``where``."""
    s = suffix
    sigma_short = "coalesce(sigma_e, 0.25)" if fixed_prior else "greatest(0.25, coalesce(sigma_e, 0.25))"
    tau_short = "0.2" if fixed_prior else "greatest(0.2, coalesce(rms, 0.2))"
    return f"""
hist{s} AS (SELECT * FROM offers WHERE {where}),
uniq{s} AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY county, year, school, course_label) AS copies FROM hist{s})
  WHERE copies = 1),
delta{s} AS (
  SELECT c.county, c.year, c.school, c.course_label, c.last_media_h - p.last_media_h AS delta_h
  FROM uniq{s} c JOIN uniq{s} p ON p.county = c.county AND p.school = c.school
       AND p.course_label = c.course_label AND p.year = c.year - 1
  WHERE NOT (c.occupied < c.seats) AND NOT (p.occupied < p.seats) AND NOT c.vocational AND NOT p.vocational
        AND c.last_media_h IS NOT NULL AND p.last_media_h IS NOT NULL),
shift{s} AS (
  SELECT county, year, median(delta_h) / 100 AS shift, count(*) AS spec_count FROM delta{s} GROUP BY ALL),
resid{s} AS (
  SELECT d.county, d.delta_h / 100 AS d, d.delta_h / 100 - s.shift AS r
  FROM delta{s} d JOIN shift{s} s ON d.county = s.county AND d.year = s.year),
mid{s} AS (SELECT county, median(d) AS dm, median(r) AS rm, count(*) AS n FROM resid{s} GROUP BY ALL),
mad{s} AS (
  SELECT x.county, any_value(n) AS n, 1.4826 * median(abs(r - rm)) AS sigma_all,
         1.4826 * median(abs(d - dm)) AS pooled_all
  FROM resid{s} x JOIN mid{s} m ON x.county = m.county GROUP BY x.county),
smid{s} AS (SELECT county, median(shift) AS sm FROM shift{s} GROUP BY ALL),
stat{s} AS (
  SELECT x.county, count(*) AS k, 1.4826 * median(abs(shift - sm)) AS tau_all,
         sqrt(avg(shift * shift) FILTER (spec_count >= 8)) AS rms
  FROM shift{s} x JOIN smid{s} m ON x.county = m.county GROUP BY x.county),
base{s} AS (SELECT county, max(year) AS base_year FROM hist{s} GROUP BY ALL),
parts{s} AS (
  SELECT b.county, base_year, coalesce(k, 0) AS k, rms,
         CASE WHEN n >= 8 THEN sigma_all END AS sigma_e,
         CASE WHEN k >= 3 THEN tau_all END AS tau_e,
         CASE WHEN k >= 3 THEN pooled_all * sqrt(k / greatest(1, k - 1)) END AS pooled
  FROM base{s} b LEFT JOIN mad{s} m ON b.county = m.county LEFT JOIN stat{s} t ON b.county = t.county),
spread{s} AS (
  SELECT county, base_year, k, pooled,
         CASE WHEN pooled IS NULL THEN {sigma_short} ELSE coalesce(sigma_e, 0.25) END AS sigma,
         CASE WHEN pooled IS NULL THEN {tau_short} ELSE coalesce(tau_e, 0.2) END AS tau,
         CASE WHEN pooled IS NULL THEN 'prior' ELSE 'estimated' END AS evidence
  FROM parts{s}),
model{s} AS (
  SELECT *, {target} AS target_year,
         greatest(0.02, coalesce(pooled, {hypot('tau', 'sigma')})) AS step_sd,
         greatest(0.02, coalesce(pooled, {hypot('tau', 'sigma')})) * sqrt({target} - base_year) AS sd
  FROM spread{s})"""


COURSES = """
courses AS (
  SELECT o.county, o.school, o.spec_id, o.seats, o.occupied, o.vocational, o.last_media_h,
         m.base_year, m.step_sd, m.sd,
         CASE WHEN vocational THEN 'unavailable' WHEN occupied < seats THEN 'open'
              WHEN last_media_h IS NULL THEN 'unavailable' ELSE 'estimate' END AS kind
  FROM offers o JOIN model m ON o.county = m.county AND o.year = m.base_year)"""

SPEC = "concat(p_brand, '/', CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END)"

KNOTS = "knots(x, r, rs, m, ms) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"CAST({v} AS DOUBLE)" for v in row) + ")" for row in KNOTS_2025
) + """),
segs AS (
  SELECT x AS lo, lead(x) OVER w AS hi, r AS r0, lead(r) OVER w AS r1, rs AS rs0, lead(rs) OVER w AS rs1,
         m AS m0, lead(m) OVER w AS m1, ms AS ms0, lead(ms) OVER w AS ms1
  FROM knots WINDOW w AS (ORDER BY x))"""


def seg_join(alias: str, x: str) -> str:
    """Join of the segment that holds ``x`` after clamping it to the table."""
    c = f"least(10.0, greatest(6.0, {x}))"
    return (
        f"JOIN segs {alias} ON {alias}.hi IS NOT NULL AND {c} >= {alias}.lo "
        f"AND ({c} < {alias}.hi OR ({alias}.hi = 10 AND {c} = 10))"
    )


def seg_value(alias: str, x: str, field: str) -> str:
    c = f"least(10.0, greatest(6.0, {x}))"
    return f"({alias}.{field}0 + ({c} - {alias}.lo) / ({alias}.hi - {alias}.lo) * ({alias}.{field}1 - {alias}.{field}0))"


ELIGIBLE = (
    "romana_h IS NOT NULL AND matematica_h IS NOT NULL AND media_h IS NOT NULL "
    "AND school_media_h IS NOT NULL AND materna_h IS NULL"
)

EFFECTS = f"""
resid_rows AS (
  SELECT school_id, romana_h / 100 - {seg_value('g', 'school_media_h / 100', 'r')} AS er,
         matematica_h / 100 - {seg_value('g', 'school_media_h / 100', 'm')} AS em
  FROM candidates {seg_join('g', 'school_media_h / 100')} WHERE {ELIGIBLE}),
effects AS (
  SELECT school_id, count(*) AS n, CASE WHEN count(*) < 20 THEN 0.0 ELSE sum(er) / (count(*) + 30) END AS romana,
         CASE WHEN count(*) < 20 THEN 0.0 ELSE sum(em) / (count(*) + 30) END AS matematica
  FROM resid_rows GROUP BY school_id)"""

STUDENTS = """
pupils AS (
  SELECT candidate_id, school_id, county, school, l_partkey, CAST(5 + line % 4 AS INTEGER) AS current_grade,
         school_media_h, materna_h IS NOT NULL AS mt, media_h,
         CASE WHEN line % 4 = 3 AND l_partkey % 3 <> 0 THEN romana_h / 100 END AS mock_r,
         CASE WHEN line % 4 = 3 AND l_partkey % 5 <> 0 THEN matematica_h / 100 END AS mock_m
  FROM candidates)"""


def _subject(field: str, mock: str, offset: str) -> str:
    """Mean and spread columns of one subject in the ``points`` row."""
    mean = f"least(10.0, greatest(1.0, {seg_value('g', 'x', field)} + coalesce({offset}, 0.0)))"
    measured = f"({seg_value('g', 'x', field + 's')} * {seg_value('g', 'x', field + 's')})"
    slope = f"(({seg_value('h', 'xhi', field)} - {seg_value('l', 'xlo', field)}) / (xhi - xlo))"
    var = (
        f"(0.55 * {measured} + drift + pow({slope} * 0.3, 2) * greatest(0.0, 1.0 / years - 0.25))"
    )
    return f"{mean} AS mean_{field}, {measured} AS meas_{field}, {var} AS var_{field}, {mock} AS seen_{field}"


def _combined(field: str) -> str:
    weight = f"(0.2025 / (var_{field} + 0.2025))"
    return (
        f"CASE WHEN seen_{field} IS NULL THEN mean_{field} ELSE {weight} * mean_{field} + "
        f"(1 - {weight}) * (seen_{field} + 0.35) END AS raw_{field}, "
        f"sqrt(CASE WHEN seen_{field} IS NULL THEN var_{field} ELSE var_{field} * 0.2025 / (var_{field} + 0.2025) END"
        f" + 0.45 * meas_{field}) AS sd_{field}"
    )


PREDICTED = f"""
points AS (
  SELECT *, least(10.0, x + 0.125) AS xhi, greatest(1.0, x - 0.125) AS xlo
  FROM (SELECT *, current_grade - 4 AS years,
          list_avg(list_transform(generate_series(5, current_grade),
              lambda g: least(1000, greatest(100, school_media_h + (g - 6) * 7)) / 100)) AS x,
          list_sum(list_transform([5, 6, 7],
              lambda k: pow(0.25 * ((least(k, current_grade) - 4) / (current_grade - 4)), 2))) AS drift,
          least(1000, greatest(100, school_media_h + (current_grade - 6) * 7)) / 100 AS naive
        FROM pupils WHERE NOT mt) t),
subject AS (
  SELECT p.*, {_subject('r', 'mock_r', 'e.romana')}, {_subject('m', 'mock_m', 'e.matematica')}
  FROM points p LEFT JOIN effects e ON p.school_id = e.school_id
  {seg_join('g', 'x')} {seg_join('h', 'xhi')} {seg_join('l', 'xlo')}),
merged AS (SELECT *, {_combined('r')}, {_combined('m')} FROM subject),
predicted AS (
  SELECT *, (raw_r + raw_m) / 2 AS raw, sqrt(sd_r * sd_r + sd_m * sd_m + 2 * 0.443 * sd_r * sd_m) / 2 AS media_sd
  FROM merged)"""


def clamp(v: str) -> str:
    return f"least(10.0, greatest(1.0, {v}))"


ORACLES: dict[str, str] = {}

ORACLES["verify_media"] = f"""
WITH {CANDIDATES}
SELECT CASE WHEN romana_h IS NULL OR matematica_h IS NULL OR media_h IS NULL THEN 'incomplete'
            WHEN (CASE WHEN materna_h IS NULL THEN (romana_h + matematica_h) // 2
                       ELSE (romana_h + materna_h + matematica_h) // 3 END) = media_h THEN 'ok'
            ELSE 'mismatch' END AS status,
       CASE WHEN materna_h IS NULL THEN 2 ELSE 3 END AS papers, count(*) AS n
FROM candidates GROUP BY 1, 2"""
ORACLES["stream_verify"] = ORACLES["verify_media"]

ORACLES["truncate_parse_format"] = """
WITH t AS (
  SELECT o_orderkey, o_totalprice / 7 AS v, CAST(o_custkey % 13 AS VARCHAR) AS whole,
         CAST(o_orderkey % 1000 AS VARCHAR) AS frac, (o_orderkey * 7 + o_orderkey % 1000) % 901 + 100 AS avg_h
  FROM orders),
c AS (
  SELECT *, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'empty'
                 WHEN o_orderkey % 17 = 0 THEN 'bad' ELSE 'mark' END AS what,
         CAST(whole AS BIGINT) * 100 + CAST(rpad(substr(frac, 1, 2), 2, '0') AS BIGINT) AS h
  FROM t),
d AS (
  SELECT *, CASE WHEN what = 'mark' AND h BETWEEN 100 AND 1000 THEN h END AS cell_h,
         what = 'bad' OR (what = 'mark' AND NOT h BETWEEN 100 AND 1000) AS refused,
         CASE WHEN CAST(whole AS BIGINT) BETWEEN 1 AND 10
                   AND NOT (whole = '10' AND regexp_matches(frac, '[1-9]')) THEN h END AS typed_h
  FROM c)
SELECT o_orderkey, trunc(CAST(v AS DECIMAL(28, 10)) * 100) / 100.0 AS truncated, cell_h, refused, typed_h,
       CASE WHEN cell_h IS NULL THEN '' ELSE concat(CAST(cell_h // 100 AS VARCHAR), '.',
            lpad(CAST(cell_h % 100 AS VARCHAR), 2, '0')) END AS shown,
       avg_h AS grade_h, CAST(floor(avg_h / 25 + 0.5) AS BIGINT) * 25 AS knot_h,
       round((avg_h / 100 - 1) / 9 * 100, 6) AS position
FROM d"""

_PREFIXES = "prefixes(p, c) AS (VALUES " + ", ".join(f"('{p}', '{c}')" for p, c in COUNTY_BY_PREFIX.items()) + ")"
_NAMES = "names(c, name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in COUNTY_NAMES.items()) + ")"
ORACLES["exam_results_parse"] = f"""
WITH {CANDIDATES}, {_PREFIXES}, {_NAMES}
SELECT p.c AS county, n.name AS county_name, line % 2 = 0 AS urban, p.c IS NULL AS refused, count(*) AS n,
       CAST(sum(romana_h) AS BIGINT) AS romana_h, CAST(sum(materna_h) AS BIGINT) AS materna_h,
       CAST(sum(school_media_h) AS BIGINT) AS school_media_h
FROM candidates LEFT JOIN prefixes p ON lpad(CAST(school_id % 55 AS VARCHAR), 2, '0') = p.p
LEFT JOIN names n ON n.c = p.c GROUP BY ALL"""

ORACLES["text_normalize"] = r"""
WITH c AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
           translate(nfc_normalize(text), 'ŞşŢţ', 'ȘșȚț'),
           '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'),
           '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'),
           '[\s\x{0B}\x{2028}\x{2029}]+', ' ', 'g')) AS clean
  FROM documents)
SELECT doc_id, md5(clean) AS digest, CAST(length(clean) AS INTEGER) AS length FROM c"""

ORACLES["text_search"] = """
SELECT needle, doc_id, lang
FROM documents, (VALUES ('eter'), ('écha'), ('über')) n(needle)
WHERE contains(strip_accents(lower(text)), strip_accents(lower(needle)))"""

ORACLES["part_search"] = """
SELECT p_partkey, p_name FROM part
WHERE p_brand = 'Brand#12' AND contains(lower(concat_ws(' ', p_name, p_type)), 'ring')"""

_FAULTY = f"""
WITH {OFFERS},
bad AS (
  SELECT CAST(CASE WHEN occupied % 7 = 3 THEN year + 200 ELSE year + 10 END AS INTEGER) AS year,
         substr(county, 1, 2) AS county, school AS school_code,
         CASE WHEN occupied % 7 = 1 THEN concat(school, CASE WHEN year % 2 = 0 THEN chr(10) ELSE ' ' END) ELSE school END AS school_name,
         CASE WHEN course_label = 'Shared' THEN 'Shared' ELSE spec_id END AS spec_id,
         CASE WHEN occupied % 7 = 2 THEN '' ELSE course_label END AS spec_label,
         CASE WHEN vocational THEN 'vocationala' WHEN occupied % 7 = 4 THEN 'alta' ELSE 'teoretica' END AS track,
         CASE WHEN occupied % 7 = 5 THEN -1 ELSE 5 END AS seats,
         CASE WHEN occupied % 7 = 6 THEN last_media_h + 1000 ELSE last_media_h END AS last_media_h,
         vocational OR occupied % 7 = 0 AS vocational
  FROM offers),
named AS (SELECT *, concat(CAST(year AS VARCHAR), '/', county) AS dataset FROM bad)"""
ORACLES["contract_violations"] = f"""{_FAULTY},
v AS (
  SELECT dataset, 'year' AS rule, 'outside 2000..2100' AS message FROM named WHERE NOT year BETWEEN 2000 AND 2100
  UNION ALL SELECT dataset, 'trimmed', 'white space at an end' FROM named WHERE regexp_matches(school_name, '^\\s|\\s$')
  UNION ALL SELECT dataset, 'text', 'expected non-empty text' FROM named WHERE spec_label = ''
  UNION ALL SELECT dataset, 'seats', 'expected a count' FROM named WHERE seats < 0
  UNION ALL SELECT dataset, 'track', 'unknown track' FROM named WHERE track = 'alta'
  UNION ALL SELECT dataset, 'vocational', 'does not follow from the track' FROM named
            WHERE track <> 'alta' AND vocational <> (track = 'vocationala')
  UNION ALL SELECT dataset, 'mark', 'outside 1..10' FROM named WHERE NOT last_media_h BETWEEN 100 AND 1000
  UNION ALL SELECT dataset, 'unique', concat('occurs ', CAST(count(*) AS VARCHAR), ' times') FROM named
            GROUP BY dataset, school_code, spec_id HAVING count(*) > 1)
SELECT dataset, rule, message, count(*) AS n FROM v GROUP BY ALL"""

ORACLES["nested_sources"] = f"""{_FAULTY}
SELECT year AS dataset_year, county AS dataset_county, count(*) AS n,
       CAST(sum(CASE WHEN last_media_h <= 1000 THEN last_media_h END) AS BIGINT) AS total_h,
       CAST(count(DISTINCT school_code) AS INTEGER) AS n_sources,
       string_agg(DISTINCT concat('https://example.org/', school_code), ',' ORDER BY concat('https://example.org/', school_code)) AS sources
FROM named GROUP BY 1, 2"""

ORACLES["publish_and_read"] = f"""
WITH {OFFERS}
SELECT CAST(year + 10 AS INTEGER) AS year, substr(county, 1, 2) AS county, count(*) AS n,
       CAST(sum(last_media_h) AS BIGINT) AS total_h
FROM offers GROUP BY 1, 2"""

ORACLES["publish_history"] = f"""
WITH {OFFERS},
early AS (SELECT count(*) AS n, CAST(sum(last_media_h) AS BIGINT) AS total_h FROM offers WHERE year <= 1998),
whole AS (SELECT count(*) AS n, CAST(sum(last_media_h) AS BIGINT) AS total_h FROM offers)
SELECT step, outcome, CAST(version AS BIGINT) AS version, generation,
       CASE WHEN version = 1 THEN early.n ELSE whole.n END AS n,
       CASE WHEN version = 1 THEN early.total_h ELSE whole.total_h END AS total_h, stored
FROM (VALUES (1, 'published', 1, 'g1', 'g1'), (2, 'refused', 1, 'g1', 'g1'), (3, 'refused', 1, 'g1', 'g1'),
             (4, 'failed', 1, 'g1', 'g1'), (5, 'published', 2, 'g5', 'g1 g5'), (6, 'lost the race', 2, 'g5', 'g1 g5'),
             (7, 'abandoned', 2, 'g5', 'g1 g5 g7'), (8, 'expired', 2, 'g5', 'g5')) AS t(step, outcome, version, generation, stored),
     early, whole"""

ORACLES["index_reconcile"] = f"""
WITH {OFFERS},
listed AS (
  SELECT year, county, count(*) AS listed_rows FROM offers
  WHERE NOT (county = 'ASIA' AND year = 1999) GROUP BY ALL),
found AS (
  SELECT year, county, count(*) AS found_rows FROM offers
  WHERE NOT (county = 'EUROPE' AND year = 1997) AND NOT (county = 'AFRICA' AND vocational) GROUP BY ALL)
SELECT year, county, CASE WHEN listed_rows IS NULL THEN 'unlisted' WHEN found_rows IS NULL THEN 'missing'
       ELSE 'row_count' END AS rule, listed_rows, found_rows
FROM listed FULL JOIN found USING (year, county)
WHERE listed_rows IS DISTINCT FROM found_rows"""

ORACLES["dataset_index"] = f"""
WITH {OFFERS}
SELECT year, county, concat(CAST(year AS VARCHAR), '/', county, '.json') AS path, count(*) AS row_count,
       'official' AS provenance
FROM offers GROUP BY year, county"""

ORACLES["dataset_totals"] = f"""
WITH {OFFERS}
SELECT year, county, count(*) AS row_count, CAST(sum(seats) AS BIGINT) AS total_seats FROM offers GROUP BY year, county"""

ORACLES["snapshot_equality"] = f"""
WITH {OFFERS},
a AS (SELECT year, county, course_label,
             CASE WHEN occupied % 9 = 0 THEN last_media_h + 1 ELSE last_media_h END AS last_media_h
      FROM offers WHERE occupied % 10 <> 0),
b AS (SELECT year, county, course_label, last_media_h FROM offers),
d AS (SELECT *, 'published' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
      UNION ALL SELECT *, 'source' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT *, count(*) AS copies FROM d GROUP BY ALL"""

ORACLES["county_coverage"] = f"""
WITH {OFFERS}
SELECT DISTINCT a.year, a.school, b.course_label
FROM (SELECT DISTINCT year, school FROM offers) a JOIN (SELECT DISTINCT school, course_label FROM offers) b USING (school)
WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.year = a.year AND o.school = a.school
                  AND o.course_label = b.course_label AND NOT (occupied < seats))"""

ORACLES["unique_courses"] = f"""
WITH {OFFERS}
SELECT year, county, school, spec_id, last_media_h, occupied FROM (
  SELECT *, count(*) OVER (PARTITION BY county, year, school, course_label) AS copies FROM offers) WHERE copies = 1"""

ORACLES["yoy_deltas"] = f"""
WITH {OFFERS}, {model(2002)}
SELECT county, year, lower(school) AS school, lower(course_label) AS label, delta_h FROM delta"""

ORACLES["county_shifts"] = f"""
WITH {OFFERS}, {model(2002)}
SELECT county, year, round(shift, 6) AS shift, spec_count FROM shift"""

_FIT = (
    "county, target_year, base_year, round(sigma, 6) AS sigma, round(tau, 6) AS tau, round(sd, 6) AS sd, "
    "evidence, CAST(k AS INTEGER) AS n_shifts"
)
ORACLES["fit_cutoff_model"] = f"""
WITH {OFFERS}, {model(2002, suffix='_l')}, {model(2002, 'year >= 2000', '_s')}
SELECT 'long' AS history, {_FIT} FROM model_l UNION ALL SELECT 'short', {_FIT} FROM model_s"""

ORACLES["robust_scale"] = f"""
WITH {CANDIDATES},
g AS (SELECT school, romana_h - matematica_h AS gap FROM candidates),
m AS (SELECT school, median(gap) AS mid FROM g GROUP BY school)
SELECT g.school, any_value(mid) AS median, round(1.4826 * median(abs(gap - mid)), 6) AS robust_scale
FROM g JOIN m ON g.school = m.school GROUP BY g.school"""

ORACLES["history_guards"] = f"""
WITH {OFFERS}, y AS (SELECT DISTINCT county, year FROM offers)
SELECT county AS dataset, concat(CAST(year AS VARCHAR), '.year') AS path, 'epoch' AS rule,
       'not comparable with 2001' AS message FROM y WHERE year < 1998
UNION ALL SELECT county, concat(CAST(year AS VARCHAR), '.year'), 'target', 'target 2001 is not after it'
FROM y WHERE year >= 2001"""


def _scored(request: str, sd: str, spread: str | None) -> str:
    """CTE ``scored``: the keyed lookup of ``request`` rows with prediction columns."""
    total = sd if spread is None else hypot(sd, spread)
    return f"""
looked AS (
  SELECT q.*, c.kind AS k0, c.vocational, c.last_media_h, {sd} AS psd, {total} AS tsd
  FROM {request} q LEFT JOIN courses c ON q.county = c.county AND q.school = c.school AND q.spec_id = c.spec_id),
kinds AS (
  SELECT *, coalesce(k0, 'unavailable') AS kind,
         CASE WHEN k0 IS NULL THEN 'no-history' WHEN k0 <> 'unavailable' THEN NULL
              WHEN vocational THEN 'vocational' ELSE 'no-cutoff' END AS reason,
         CASE WHEN k0 = 'estimate' THEN last_media_h / 100 END AS cutoff FROM looked),
scored AS (
  SELECT *, CASE WHEN kind = 'estimate' THEN coalesce({phi('((media - cutoff) / tsd)')}, 0.5) END AS probability,
         cutoff - {Z_80} * psd AS interval_low, cutoff + {Z_80} * psd AS interval_high FROM kinds)"""


ORACLES["score_candidates"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES},
asked AS (SELECT candidate_id, county, school, {SPEC} AS spec_id, media_h / 100 AS media
          FROM candidates JOIN part ON l_partkey = p_partkey),
{_scored('asked', 'c.sd', None)}
SELECT candidate_id, county, school, spec_id, kind, reason, round(probability, 6) AS probability,
       round(cutoff, 6) AS cutoff, round(interval_low, 6) AS interval_low, round(interval_high, 6) AS interval_high,
       round(CASE kind WHEN 'estimate' THEN probability WHEN 'open' THEN -0.5 ELSE -1.0 END, 6) AS rank_value,
       {band('probability')} AS band,
       round(CASE WHEN kind = 'estimate' THEN coalesce(least(100.0, greatest(0.0,
         (media - interval_low) / (interval_high - interval_low) * 100)), 0.0) END, 6) AS fill
FROM scored"""

_PRODUCT = f"""
pairs AS (
  SELECT q.county, q.media_h, c.school, c.spec_id, c.seats, c.kind, c.last_media_h,
         CASE WHEN c.kind = 'estimate' THEN coalesce({phi('((q.media_h / 100 - c.last_media_h / 100) / c.sd)')}, 0.5) END AS p
  FROM (SELECT DISTINCT county, media_h FROM candidates) q JOIN courses c ON q.county = c.county)"""

ORACLES["answer_summary"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES}, {_PRODUCT},
s AS (
  SELECT county, media_h, count(*) FILTER (kind = 'estimate') AS answerable,
         count(*) FILTER (kind = 'estimate' AND p >= 0.5) AS clears,
         count(*) FILTER (kind = 'estimate' AND p >= 0.3 AND p < 0.7) AS tight,
         count(*) FILTER (kind = 'open') AS open, count(*) FILTER (kind = 'unavailable') AS aside
  FROM pairs GROUP BY county, media_h)
SELECT c.candidate_id, c.county, c.media_h, answerable, clears, tight, open, aside
FROM candidates c JOIN s ON c.county = s.county AND c.media_h IS NOT DISTINCT FROM s.media_h"""

ORACLES["answer_topk"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES}, {_PRODUCT},
top AS (
  SELECT *, row_number() OVER (PARTITION BY county, media_h ORDER BY last_media_h DESC, school, spec_id) AS rn
  FROM pairs WHERE kind = 'estimate' AND p >= 0.5)
SELECT c.candidate_id, c.county, c.media_h, CAST(rn AS INTEGER) AS position, t.school AS course_school,
       t.spec_id AS course_spec_id, t.last_media_h AS cutoff_h
FROM candidates c
LEFT JOIN top t ON c.county = t.county AND c.media_h IS NOT DISTINCT FROM t.media_h AND t.rn <= 3"""

ORACLES["answer_list"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES},
ask AS (SELECT county, CAST(sum(media_h) AS BIGINT) // count(media_h) AS media_h FROM candidates GROUP BY county),
scored AS (
  SELECT q.county, q.media_h / 100 AS media, c.*,
         CASE WHEN c.kind = 'estimate' THEN {phi('((q.media_h / 100 - c.last_media_h / 100) / c.sd)')} END AS p
  FROM ask q JOIN courses c ON q.county = c.county),
placed AS (
  SELECT *, CASE WHEN kind = 'unavailable' THEN 'aside' WHEN kind = 'open' THEN 'open'
                 WHEN p >= 0.5 THEN 'above' ELSE 'below' END AS bucket FROM scored)
SELECT county, media, bucket, row_number() OVER (PARTITION BY county, bucket ORDER BY
         CASE bucket WHEN 'above' THEN -last_media_h WHEN 'below' THEN last_media_h WHEN 'open' THEN -seats ELSE 0 END,
         school, spec_id) - 1 AS position,
       school, spec_id, round(p, 6) AS probability,
       round(CASE WHEN kind = 'estimate' THEN least(100.0, greatest(0.0, (last_media_h / 100 - 1) / 9 * 100)) END, 6) AS cutoff_pos
FROM placed"""

_HISTORY = """
alone AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY county, year, school, course_label) AS copies FROM offers)
  WHERE copies = 1),
saved AS (SELECT *, concat(county, '/', school, '/', spec_id) AS saved_id FROM offers WHERE year = 2001),
found AS (
  SELECT saved_id, year, county, school, spec_id, course_label, last_media_h FROM saved
  UNION ALL
  SELECT s.saved_id, a.year, a.county, a.school, a.spec_id, a.course_label, a.last_media_h
  FROM saved s JOIN alone a ON a.county = s.county AND a.school = s.school AND a.course_label = s.course_label
  WHERE a.year <> 2001 AND a.year >= 1998),
ranked AS (SELECT *, row_number() OVER (PARTITION BY saved_id ORDER BY year DESC) - 1 AS history_rank FROM found)"""
ORACLES["course_history"] = f"""
WITH {OFFERS}, {_HISTORY}
SELECT saved_id, year, spec_id, last_media_h, history_rank FROM ranked"""

# A snapshot with two rows breaks 'rows'; a second snapshot of another course breaks 'history'.
ORACLES["saved_histories"] = f"""
WITH {OFFERS}, {_HISTORY},
sizes AS (SELECT saved_id, max(history_rank) AS last FROM ranked GROUP BY saved_id)
SELECT CASE length(saved_id) % 4 WHEN 1 THEN 'rows' ELSE 'history' END AS rule, count(*) AS n
FROM sizes WHERE length(saved_id) % 4 IN (1, 2) AND last >= 1 GROUP BY 1
UNION ALL
SELECT 'cap' AS rule, count(*) AS n
FROM (SELECT county FROM saved GROUP BY county HAVING count(DISTINCT saved_id) > 500) HAVING count(*) > 0"""

_BINS = f"""
elig AS (SELECT *, CAST(floor(school_media_h / 25 + 0.5) AS BIGINT) * 25 AS bin_h FROM candidates WHERE {ELIGIBLE}),
bins AS (SELECT bin_h, count(*) AS n FROM elig GROUP BY bin_h),
seq AS (SELECT *, row_number() OVER (ORDER BY bin_h) AS i FROM bins),
fold AS (
  SELECT i, bin_h, CASE WHEN n >= 2500 THEN 0 ELSE n END AS carry, n >= 2500 AS emits FROM seq WHERE i = 1
  UNION ALL
  SELECT s.i, s.bin_h, CASE WHEN f.carry + s.n >= 2500 THEN 0 ELSE f.carry + s.n END, f.carry + s.n >= 2500
  FROM fold f JOIN seq s ON s.i = f.i + 1),
knot_of AS (
  SELECT b.bin_h, coalesce((SELECT min(f.bin_h) FROM fold f WHERE f.emits AND f.bin_h >= b.bin_h),
                           (SELECT max(f.bin_h) FROM fold f WHERE f.emits)) AS knot_h
  FROM bins b),
fitted AS (
  SELECT knot_h / 100 AS x, count(*) AS n, avg(romana_h) / 100 AS r, stddev_pop(romana_h) / 100 AS rs,
         avg(matematica_h) / 100 AS m, stddev_pop(matematica_h) / 100 AS ms
  FROM elig JOIN knot_of USING (bin_h) WHERE knot_h IS NOT NULL GROUP BY knot_h)"""
ORACLES["calibrate_bins"] = f"""
WITH {CANDIDATES}
SELECT CAST(floor(school_media_h / 25 + 0.5) AS BIGINT) * 25 AS bin_h, count(*) AS n,
       round(avg(romana_h) / 100, 6) AS romana, round(stddev_pop(romana_h) / 100, 6) AS romana_sd,
       round(avg(matematica_h) / 100, 6) AS matematica, round(stddev_pop(matematica_h) / 100, 6) AS matematica_sd
FROM candidates WHERE {ELIGIBLE} GROUP BY 1"""
ORACLES["calibrate_knots"] = f"""
WITH RECURSIVE {CANDIDATES}, {_BINS}
SELECT x AS school_media, n, round(r, 6) AS romana, round(rs, 6) AS romana_sd, round(m, 6) AS matematica,
       round(ms, 6) AS matematica_sd FROM fitted"""
ORACLES["residual_rho"] = f"""
WITH RECURSIVE {CANDIDATES}, {_BINS},
segs AS (
  SELECT x AS lo, lead(x) OVER w AS hi, r AS r0, lead(r) OVER w AS r1, m AS m0, lead(m) OVER w AS m1
  FROM fitted WINDOW w AS (ORDER BY x)),
ends AS (SELECT min(x) AS a, max(x) AS b FROM fitted),
placed AS (SELECT *, least(b, greatest(a, school_media_h / 100)) AS c FROM elig, ends),
res AS (
  SELECT romana_h / 100 - CASE WHEN a = b THEN r0 ELSE r0 + (c - lo) / (hi - lo) * (r1 - r0) END AS er,
         matematica_h / 100 - CASE WHEN a = b THEN m0 ELSE m0 + (c - lo) / (hi - lo) * (m1 - m0) END AS em
  FROM placed JOIN segs ON (a = b) OR (hi IS NOT NULL AND c >= lo AND (c < hi OR (hi = b AND c = b))))
SELECT count(*) AS n, round(corr(er, em), 6) AS subject_rho FROM res"""

ORACLES["group_effects"] = f"""
WITH {CANDIDATES}, {KNOTS}, {EFFECTS}
SELECT c_custkey AS school_id, coalesce(n, 0) AS n, round(round(coalesce(romana, 0.0), 9), 6) AS romana,
       round(round(coalesce(matematica, 0.0), 9), 6) AS matematica
FROM customer LEFT JOIN effects ON c_custkey = school_id"""

ORACLES["predict_marks"] = f"""
WITH {CANDIDATES}, {KNOTS}, {EFFECTS}, {STUDENTS}, {PREDICTED}
SELECT candidate_id, current_grade, error, school_mean, horizon_years, romana_basis, romana_sd, matematica_sd, media_sd,
       CASE WHEN error IS NULL THEN romana_mean END AS romana_mean, CASE WHEN error IS NULL THEN romana_low END AS romana_low,
       CASE WHEN error IS NULL THEN romana_high END AS romana_high,
       CASE WHEN error IS NULL THEN matematica_mean END AS matematica_mean,
       CASE WHEN error IS NULL THEN media_mean END AS media_mean, CASE WHEN error IS NULL THEN media_low END AS media_low,
       CASE WHEN error IS NULL THEN media_high END AS media_high
FROM (SELECT u.candidate_id, u.current_grade,
       CASE WHEN u.mt THEN 'mother-tongue candidates are not supported' END AS error,
       round(round(x, 9), 6) AS school_mean, CAST(CASE WHEN NOT u.mt THEN 8 - u.current_grade END AS INTEGER) AS horizon_years,
       round(round({clamp('raw_r')}, 9), 6) AS romana_mean, round(round(sd_r, 9), 6) AS romana_sd,
       round(round({clamp(f'raw_r - sd_r * {Z_80}')}, 9), 6) AS romana_low, round(round({clamp(f'raw_r + sd_r * {Z_80}')}, 9), 6) AS romana_high,
       CASE WHEN u.mt THEN NULL WHEN u.mock_r IS NULL THEN 'school' ELSE 'school+simulare' END AS romana_basis,
       round(round({clamp('raw_m')}, 9), 6) AS matematica_mean, round(round(sd_m, 9), 6) AS matematica_sd,
       round(round({clamp('raw')}, 9), 6) AS media_mean, round(round(media_sd, 9), 6) AS media_sd,
       round(round({clamp(f'raw - media_sd * {Z_80}')}, 9), 6) AS media_low, round(round({clamp(f'raw + media_sd * {Z_80}')}, 9), 6) AS media_high
FROM (SELECT candidate_id, current_grade, mt, mock_r, NULL::DOUBLE AS x, NULL::DOUBLE AS raw_r, NULL::DOUBLE AS sd_r,
             NULL::DOUBLE AS raw_m, NULL::DOUBLE AS sd_m, NULL::DOUBLE AS raw, NULL::DOUBLE AS media_sd
      FROM pupils WHERE mt
      UNION ALL SELECT candidate_id, current_grade, mt, mock_r, x, raw_r, sd_r, raw_m, sd_m, raw, media_sd FROM predicted) u)"""

ORACLES["student_guards"] = f"""
WITH {CANDIDATES}, {STUDENTS},
e AS (
  SELECT CASE
    WHEN l_partkey % 11 = 7 THEN 'current grade is not one of 5..8'
    WHEN mt THEN 'mother-tongue candidates are not supported'
    WHEN l_partkey % 11 = 1 THEN 'at least one yearly mark is required'
    WHEN l_partkey % 11 = 2 AND current_grade = 8 THEN 'a yearly mark is for a grade outside 5..8'
    WHEN l_partkey % 11 = 2 THEN 'a yearly mark is for a future grade'
    WHEN l_partkey % 11 = 3 THEN 'two marks for one grade'
    WHEN l_partkey % 11 = 4 THEN 'a yearly mark is outside 1..10'
    WHEN l_partkey % 11 = 5 AND current_grade < 8 THEN 'mock marks exist only in the exam grade'
    WHEN l_partkey % 11 = 6 AND mock_r * 4 > 10 THEN 'mock romana is outside 1..10' END AS error
  FROM pupils)
SELECT error, count(*) AS n FROM e GROUP BY error"""

ORACLES["chained_score"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES}, {KNOTS}, {EFFECTS}, {STUDENTS}, {PREDICTED},
asked AS (
  SELECT candidate_id, county, school, {SPEC} AS spec_id, {clamp('raw')} AS media, media_sd,
         2002 + 8 - current_grade AS admission_year
  FROM predicted JOIN part ON l_partkey = p_partkey),
{_scored('asked', 'c.step_sd * sqrt(q.admission_year - c.base_year)', 'q.media_sd')}
SELECT candidate_id, county, school, spec_id, CAST(admission_year AS INTEGER) AS admission_year, NULL AS error, kind, reason,
       round(probability, 6) AS probability, round(interval_low, 6) AS interval_low,
       round(interval_high, 6) AS interval_high, {band('probability')} AS band
FROM scored
UNION ALL SELECT candidate_id, county, school, {SPEC}, CAST(2002 + 8 - current_grade AS INTEGER),
       'mother-tongue candidates are not supported', NULL, NULL, NULL, NULL, NULL, NULL
FROM pupils JOIN part ON l_partkey = p_partkey WHERE mt"""

ORACLES["chained_summary"] = f"""
WITH {OFFERS}, {model(2002)}, {COURSES}, {CANDIDATES}, {KNOTS}, {EFFECTS}, {STUDENTS}, {PREDICTED},
q AS (SELECT row_number() OVER () AS id, candidate_id, county, {clamp('raw')} AS media, media_sd FROM predicted),
pairs AS (
  SELECT q.id, q.candidate_id, q.county, c.kind,
         CASE WHEN c.kind = 'estimate' THEN (q.media - c.last_media_h / 100) / {hypot('c.sd', 'q.media_sd')} END AS z
  FROM q JOIN courses c ON q.county = c.county),
scored AS (SELECT *, CASE WHEN kind = 'estimate' THEN {phi('z')} END AS p FROM pairs)
SELECT any_value(candidate_id) AS candidate_id, any_value(county) AS county, NULL AS error,
       count(*) FILTER (kind = 'estimate') AS answerable,
       count(*) FILTER (kind = 'estimate' AND p >= 0.5) AS clears,
       count(*) FILTER (kind = 'estimate' AND p >= 0.3 AND p < 0.7) AS tight,
       count(*) FILTER (kind = 'open') AS open, count(*) FILTER (kind = 'unavailable') AS aside
FROM scored GROUP BY id
UNION ALL SELECT candidate_id, county, 'mother-tongue candidates are not supported', NULL, NULL, NULL, NULL, NULL
FROM pupils WHERE mt"""

ORACLES["forecast_metrics"] = f"""
WITH {CANDIDATES}, {KNOTS}, {EFFECTS}, {STUDENTS}, {PREDICTED},
e AS (SELECT current_grade, {clamp('raw')} - media_h / 100 AS err, naive - media_h / 100 AS nerr,
             media_h / 100 BETWEEN {clamp(f'raw - media_sd * {Z_80}')} AND {clamp(f'raw + media_sd * {Z_80}')} AS hit
      FROM predicted WHERE media_h IS NOT NULL)
SELECT current_grade, count(*) AS n, round(avg(err), 6) AS bias, round(avg(abs(err)), 6) AS mae,
       round(sqrt(avg(err * err)), 6) AS rmse, round(avg(CAST(hit AS DOUBLE)), 6) AS coverage,
       round(avg(abs(nerr)), 6) AS naive_mae
FROM e GROUP BY current_grade"""


def _pairs(model_name: str, name: str = "pairs", prefix: str = "") -> str:
    return f"""
alone AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY county, year, school, course_label) AS copies FROM offers)
  WHERE copies = 1 AND {USABLE}),
{name} AS (
  SELECT {prefix} b.county, b.last_media_h / 100 AS cutoff, a.last_media_h / 100 AS outcome, b.last_media_h AS cutoff_h,
         a.last_media_h AS outcome_h, m.sd
  FROM alone b JOIN {model_name} m ON b.county = m.county AND b.year = m.base_year
  JOIN alone a ON a.county = b.county AND a.school = b.school AND a.course_label = b.course_label AND a.year = 2001)"""


SAMPLES = f"""
tries AS (
  SELECT p.*, o.off, {phi('(o.off / 100 / p.sd)')} AS prob,
         CAST(cutoff_h + o.off >= outcome_h AS DOUBLE) AS y, CAST(o.off >= 0 AS DOUBLE) AS hard
  FROM pairs p, (VALUES (-80), (-40), (0), (40), (80)) o(off)
  WHERE cutoff_h + o.off BETWEEN 100 AND 1000)"""

ORACLES["brier_reliability"] = f"""
WITH {OFFERS}, {model(2001, 'year < 2001')}, {_pairs('model')}, {SAMPLES}
SELECT CAST(floor(prob * 5) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 6) AS predicted, round(avg(y), 6) AS observed
FROM tries WHERE prob < 1 GROUP BY 1 HAVING count(*) >= 20"""

_ERRORS = f"""count(*) AS n, round(avg(cutoff - outcome), 6) AS bias, round(avg(abs(cutoff - outcome)), 6) AS mae,
       round(sqrt(avg((cutoff - outcome) * (cutoff - outcome))), 6) AS rmse,
       round(avg(CAST(outcome BETWEEN cutoff - {Z_80} * sd AND cutoff + {Z_80} * sd AS DOUBLE)), 6) AS coverage"""
_BRIER = """count(*) AS samples, round(avg(pow(prob - y, 2)), 6) AS brier, round(avg(pow(hard - y, 2)), 6) AS baseline_brier"""

ORACLES["backtest"] = f"""
WITH {OFFERS}, {model(2001, 'year < 2001')}, {_pairs('model')}, {SAMPLES},
e AS (SELECT county, {_ERRORS} FROM pairs GROUP BY county),
b AS (SELECT county, {_BRIER} FROM tries GROUP BY county)
SELECT e.*, b.samples, b.brier, b.baseline_brier FROM e JOIN b ON e.county = b.county"""

ORACLES["estimator_compare"] = f"""
WITH {OFFERS}, {model(2001, 'year BETWEEN 1999 AND 2000', '_a', True)}, {model(2001, 'year BETWEEN 1999 AND 2000', '_b')},
both_models AS (SELECT 'fixed_prior' AS estimator, county, base_year, sd FROM model_a
                UNION ALL SELECT 'floored', county, base_year, sd FROM model_b),
{_pairs('both_models', prefix='m.estimator,')}, {SAMPLES},
e AS (SELECT estimator, {_ERRORS} FROM pairs GROUP BY estimator),
b AS (SELECT estimator, {_BRIER} FROM tries GROUP BY estimator)
SELECT e.*, b.samples, b.brier, b.baseline_brier FROM e JOIN b ON e.estimator = b.estimator"""

ORACLES["forecast_audit"] = f"""
WITH {OFFERS}, {model(2001, 'year < 2001')}, {model(2002, suffix='_n')}, {_pairs('model')},
s AS (SELECT county, count(*) AS matched, count(*) FILTER (outcome BETWEEN cutoff - {Z_80} * sd AND cutoff + {Z_80} * sd) AS covered,
             CAST(sum(abs(outcome_h - cutoff_h)) AS BIGINT) AS err FROM pairs GROUP BY county),
c AS (
  SELECT m.county, coalesce(matched, 0) AS matched, coalesce(covered, 0) AS covered, coalesce(err, 0) AS err
  FROM model m LEFT JOIN s ON m.county = s.county),
t AS (
  SELECT c.county, matched, covered, err, n.sd AS next_sd, h.shift AS observed_shift
  FROM c JOIN model_n n ON c.county = n.county LEFT JOIN shift_n h ON h.county = c.county AND h.year = 2001
  UNION ALL SELECT 'ALL', CAST(sum(matched) AS BIGINT), CAST(sum(covered) AS BIGINT), CAST(sum(err) AS BIGINT), NULL, NULL FROM c)
SELECT county, matched, covered, round(err / 100, 6) AS absolute_error,
       CASE WHEN matched > 0 THEN round(covered / matched, 6) END AS coverage,
       CASE WHEN matched > 0 THEN round(err / 100 / matched, 6) END AS mae,
       round(next_sd, 6) AS next_sd, round(observed_shift, 6) AS observed_shift FROM t"""

ORACLES["minority_share"] = f"""
WITH {CANDIDATES}
SELECT county, count(*) AS candidates, count(materna_h) AS third_paper, round(count(materna_h) / count(*), 6) AS share
FROM candidates GROUP BY county"""

ORACLES["record_inflation"] = f"""
WITH {CANDIDATES}, g AS (SELECT county, (school_media_h - media_h) / 100 AS gap FROM candidates WHERE media_h IS NOT NULL)
SELECT county, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 0.1), 6) AS q10,
       round(quantile_cont(gap, 0.5), 6) AS q50, round(quantile_cont(gap, 0.9), 6) AS q90
FROM g GROUP BY county"""

ORACLES["even_sample"] = f"""
WITH {CANDIDATES},
formed AS (
  SELECT CASE WHEN materna_h IS NULL THEN CASE WHEN (romana_h + matematica_h) % 2 = 0 THEN 'two_exact' ELSE 'two_truncating' END
              WHEN (romana_h + materna_h + matematica_h) % 3 = 0 THEN 'three_exact' ELSE 'three_truncating' END AS form,
         romana_h, materna_h, matematica_h, media_h
  FROM candidates WHERE romana_h IS NOT NULL AND matematica_h IS NOT NULL),
keyed AS (SELECT form, romana_h, materna_h, matematica_h, max(media_h) AS media_h FROM formed GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form ORDER BY romana_h, materna_h, matematica_h) - 1 AS r,
         count(*) OVER (PARTITION BY form) AS n,
         CASE WHEN form LIKE '%exact' THEN 110 ELSE 220 END AS k FROM keyed)
SELECT form, romana_h, materna_h, matematica_h, media_h FROM ranked
WHERE n <= k OR r IN (SELECT floor(i * (n / k)) FROM range(220) t(i) WHERE i < k)"""

ORACLES["backtest_sample"] = f"""
WITH {CANDIDATES},
ranked AS (
  SELECT county, school_media_h, romana_h, matematica_h, media_h,
         row_number() OVER (PARTITION BY county ORDER BY school_media_h, romana_h, matematica_h, media_h) - 1 AS r,
         count(*) OVER (PARTITION BY county) AS n
  FROM candidates WHERE {ELIGIBLE})
SELECT county, school_media_h, romana_h, matematica_h, media_h FROM ranked
WHERE n <= 400 OR r IN (SELECT floor(i * (n / 400)) FROM range(400) t(i))"""

_SIZED = """
sized AS (SELECT url, 2024 AS year, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS county,
                 octet_length(encode(html)) AS bytes FROM pages)"""
ORACLES["representative_pick"] = f"""
WITH {_SIZED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY year, county ORDER BY bytes DESC, url) - 1 AS pick_rank,
         count(*) OVER (PARTITION BY year, county) AS n,
         count(*) FILTER (bytes >= 512) OVER (PARTITION BY year, county) AS big FROM sized),
groups AS (SELECT DISTINCT year, county, n, big FROM ranked),
wanted AS (
  SELECT year, county, 0 AS ord, 0 AS r FROM groups
  UNION ALL SELECT year, county, 1, CASE WHEN big > 0 THEN big - 1 ELSE n - 1 END FROM groups
  UNION ALL SELECT year, county, 2, n // 2 FROM groups
  UNION ALL SELECT year, county, 2 + k, least(n - 1, CAST(floor(k * (n / 6.0) + 0.5) AS BIGINT)) FROM groups, range(1, 6) t(k)
  UNION ALL SELECT year, county, 100 + k, k FROM groups, range(0, 5) t(k)),
firsts AS (SELECT year, county, r, min(ord) AS ord FROM wanted GROUP BY ALL),
chosen AS (SELECT *, row_number() OVER (PARTITION BY year, county ORDER BY ord) AS i FROM firsts)
SELECT url, year, county, CAST(bytes AS BIGINT) AS bytes, pick_rank FROM ranked q
WHERE n <= 5 OR EXISTS (SELECT 1 FROM chosen c WHERE c.year = q.year AND c.county = q.county AND c.i <= 5 AND c.r = q.pick_rank)"""

ORACLES["last_write_wins"] = """
SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

_ENCODE = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) > 126 THEN url_encode(c) ELSE c END), '')"
ORACLES["extract_links"] = f"""
WITH a AS (
  SELECT page_id, regexp_extract(lower(url), '^(https?://[^/?#]*)', 1) AS origin,
         regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
         regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', 2) AS texts
  FROM pages),
b AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(texts) AS text, unnest(range(len(hrefs))) AS position FROM a),
c AS (
  SELECT page_id, concat(origin, {_ENCODE.format('href')}) AS url,
         trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '\\s+', ' ', 'g')) AS text,
         position
  FROM b WHERE href LIKE '/%')
SELECT page_id, url, arg_min(text, position) AS text, CAST(min(position) AS INTEGER) AS position FROM c GROUP BY page_id, url"""

ORACLES["page_urls"] = """
WITH p AS (
  SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1) AS q,
         regexp_extract(url, '://([^/]*)', 1) AS host FROM pages),
s AS (
  SELECT *, regexp_replace(regexp_replace(lower(concat(
         regexp_replace(regexp_extract(regexp_replace(regexp_replace(bare, '^https?://[^/]*', ''), '/+$', ''), '([^/]*)$', 1), '(?i)\\.[a-z0-9]+$', ''),
         ' ', q)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS raw FROM p)
SELECT page_id, url AS canonical, regexp_extract(bare, '^(.*/)', 1) AS directory, host,
       CASE WHEN raw = '' THEN 'index' ELSE regexp_replace(substr(raw, 1, 48), '-+$', '') END AS slug,
       substr(sha1(url), 1, 16) AS cache_key, substr(sha1(url), 1, 6) AS short_hash,
       host = 'example.com' OR host LIKE '%.example.com' AS same_site
FROM s"""

ORACLES["first_pages"] = """
SELECT regexp_replace(url, '#.*$', '') AS canonical_url, min(page_id) AS page_id, arg_min(md5(html), page_id) AS body
FROM pages GROUP BY 1"""
ORACLES["stream_pages"] = "SELECT DISTINCT regexp_replace(url, '#.*$', '') AS canonical_url FROM pages"

_TREE = """
nodes AS (SELECT page_id % 5 AS c, page_id // 5 AS j FROM pages),
walk AS (
  SELECT c, j, 0 AS depth, 0 AS place FROM nodes WHERE j = 0
  UNION ALL
  SELECT n.c, n.j, w.depth + 1, 0 FROM walk w JOIN nodes n ON n.c = w.c AND (n.j = 2 * w.j + 1 OR n.j = 2 * w.j + 2)),
reached AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY depth, j) AS i FROM walk),
kept AS (SELECT c AS crawl, concat('https://site.example.com/2024/c', c, '/', j, '.html') AS url, depth, i, j,
                count(*) OVER (PARTITION BY c) > 20 AS truncated FROM reached)"""
ORACLES["discover"] = """
SELECT c AS crawl, 2024 AS year, concat('c', c) AS county,
       concat('https://site.example.com/2024/c', c, '/0.html') AS url, 'https://site.example.com/2024/' AS year_url
FROM (SELECT DISTINCT page_id % 5 AS c FROM pages)"""
ORACLES["descend"] = f"WITH RECURSIVE {_TREE} SELECT crawl, url, CAST(depth AS INTEGER) AS depth FROM kept"
ORACLES["descend_capped"] = f"""
WITH RECURSIVE {_TREE} SELECT crawl, url, CAST(depth AS INTEGER) AS depth, truncated FROM kept WHERE i <= 20"""
ORACLES["page_record"] = f"""
WITH RECURSIVE {_TREE}
SELECT 2024 AS year, concat('C', crawl) AS county, CAST((i - 1) // 40 AS INTEGER) AS part, count(*) FILTER (depth = 0) AS n_links, count(*) AS n_pages,
       md5(string_agg(url, chr(10) ORDER BY i)) AS digest
FROM kept GROUP BY crawl, (i - 1) // 40"""
ORACLES["scoped_pages"] = f"""
WITH RECURSIVE {_TREE}
SELECT url, concat(substr(sha1(url), 1, 16), '.html') AS file,
       CAST(octet_length(encode(html)) + octet_length(encode(concat(
         '<a href="', 2 * j + 1, '.html#top">next <b>', 2 * j + 1, '</b></a><a href="', 2 * j + 2,
         '.html#top">next <b>', 2 * j + 2, '</b></a><a href="../">up</a>'))) AS BIGINT) AS bytes
FROM (SELECT k.url, k.crawl, p.page_id // 5 AS j, p.html FROM kept k
      JOIN pages p ON k.crawl = p.page_id % 5 AND k.url = concat('https://site.example.com/2024/c', p.page_id % 5, '/', p.page_id // 5, '.html')
      WHERE k.crawl = 1)"""

ORACLES["stage_names"] = f"""
WITH {_SIZED},
p AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^[^?#]*(\\?[^#]+)', 1) AS q FROM sized),
s AS (
  SELECT *, regexp_replace(regexp_replace(lower(concat(
         regexp_replace(regexp_extract(regexp_replace(regexp_replace(bare, '^https?://[^/]*', ''), '/+$', ''), '([^/]*)$', 1), '(?i)\\.[a-z0-9]+$', ''),
         ' ', q)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS raw FROM p),
n AS (SELECT url, bytes, concat(county, '-', year, '-', CASE WHEN raw = '' THEN 'index' ELSE regexp_replace(substr(raw, 1, 48), '-+$', '') END) AS stem,
             url LIKE 'https%' AS existing FROM s),
taken AS (SELECT DISTINCT stem FROM n WHERE existing),
r AS (SELECT *, row_number() OVER (PARTITION BY existing, stem ORDER BY bytes DESC, url) AS i FROM n)
SELECT url, CASE WHEN existing THEN concat(stem, '.html')
                 WHEN i = 1 AND stem NOT IN (SELECT stem FROM taken) THEN concat(stem, '.html')
                 ELSE concat(stem, '-', substr(sha1(url), 1, 6), '.html') END AS file, existing
FROM r"""

ORACLES["discovery_failures"] = """
SELECT DISTINCT page_id % 5 + 100 AS crawl, 1999 AS year, concat('c', page_id % 5) AS county,
       'https://site.example.com/2024/ https://site.example.com/2023/' AS seen
FROM pages"""
ORACLES["harvest_summary"] = f"""
WITH RECURSIVE {_TREE}
SELECT 2024 AS year, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(new_files) AS BIGINT) AS new_files,
       CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS stopped, count(*) AS crawls
FROM (SELECT crawl, count(*) AS pages, count(*) FILTER (j % 3 <> 0) AS new_files FROM kept GROUP BY crawl)"""
ORACLES["harvest_summary_whole"] = ORACLES["harvest_summary"]
ORACLES["sql_functions"] = f"""
WITH {CANDIDATES},
a AS (SELECT county, ((CASE WHEN materna_h IS NULL THEN (romana_h + matematica_h) // 2
                            ELSE (romana_h + materna_h + matematica_h) // 3 END) - 550) / 100 AS z FROM candidates),
p AS (SELECT county, {phi('z')} AS p FROM a)
SELECT county, CASE WHEN p IS NULL THEN NULL ELSE {band('p')} END AS band, count(*) AS n FROM p GROUP BY 1, 2"""

ORACLES["contract_json"] = f"""
WITH {OFFERS}
SELECT CAST(year + 10 AS INTEGER) AS year, substr(county, 1, 2) AS county, school AS school_code, spec_id,
       course_label AS spec_label, CASE WHEN vocational THEN 'vocationala' ELSE 'teoretica' END AS track,
       CAST(seats AS INTEGER) AS seats, CAST(last_media_h AS BIGINT) AS last_media_h, 'official' AS provenance
FROM offers"""
ORACLES["archive_parse"] = f"""
WITH {OFFERS},
o AS (SELECT *, occupied % 9 AS odd FROM offers)
SELECT CAST(year AS INTEGER) AS year, substr(county, 1, 2) AS county, school AS school_code,
       concat(chr(536), 'coala ', school) AS school_name, spec_id,
       concat(course_label, CASE odd WHEN 2 THEN concat(' (bilingv: Englez', chr(259), ')') WHEN 7 THEN ' (dual)' ELSE '' END) AS spec_label,
       CASE WHEN vocational THEN 'vocationala' WHEN odd <> 5 THEN 'teoretica' END AS track,
       CAST(seats AS INTEGER) AS seats, CAST(last_media_h AS BIGINT) AS last_media_h,
       CASE WHEN odd = 1 THEN 'j: not the county of the file' WHEN odd = 4 THEN 'fi: only day classes are read'
            WHEN odd = 5 AND NOT vocational THEN 'f: no such track' WHEN odd = 3 THEN 'nlo: not a count'
            WHEN odd = 8 THEN 'um: key is absent' END AS error
FROM o"""

ORACLES["results_csv"] = ORACLES["exam_results_parse"]
ORACLES["first_mismatches"] = f"""
WITH {CANDIDATES}
SELECT county, candidate_id, romana_h, materna_h, matematica_h, media_h FROM candidates
WHERE media_h <> CASE WHEN materna_h IS NULL THEN (romana_h + matematica_h) // 2
                      ELSE (romana_h + materna_h + matematica_h) // 3 END
ORDER BY county, candidate_id LIMIT 10"""
ORACLES["school_directory"] = f"""
WITH {CANDIDATES},
d AS (SELECT c_custkey AS code FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7')
SELECT 'result' AS what, school_id AS code, count(*) AS n FROM candidates WHERE school_id IN (SELECT code FROM d) GROUP BY 2
UNION ALL SELECT 'observed', code, count(*) FROM d WHERE code IN (SELECT school_id FROM candidates) GROUP BY code"""
ORACLES["romanian_order"] = """
WITH n AS (
  SELECT c_custkey, n_regionkey AS region, CASE c_custkey % 4 WHEN 0 THEN lower(n_name)
         WHEN 1 THEN translate(lower(n_name), 'ast', 'ășț') WHEN 2 THEN translate(lower(n_name), 'ai', 'âî')
         ELSE translate(lower(n_name), 'e', 'a') END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, replace(replace(replace(replace(replace(name, 'ă', 'a~'), 'â', 'a~~'), 'î', 'i~'), 'ș', 's~'), 'ț', 't~') AS letters FROM n)
SELECT region, c_custkey, name, row_number() OVER (PARTITION BY region ORDER BY letters, c_custkey) - 1 AS place FROM k"""
ORACLES["index_violations"] = f"""
WITH {OFFERS},
i AS (SELECT CAST(year + 10 AS INTEGER) AS year, substr(county, 1, 2) AS county, count(*) % 5 AS odd FROM offers GROUP BY 1, 2)
SELECT concat(CAST(year AS VARCHAR), '/', county, '.json') AS dataset,
       CASE odd WHEN 1 THEN 'path' WHEN 2 THEN 'provenance' WHEN 3 THEN 'count' ELSE 'unique' END AS rule, 1::BIGINT AS n
FROM i WHERE odd > 0"""
ORACLES["county_index"] = f"""
WITH {OFFERS},
i AS (SELECT year, county, count(*) AS n FROM offers GROUP BY year, county)
SELECT county, string_agg(concat(CAST(year AS VARCHAR), ':', CAST(year AS VARCHAR), '/', county, '.json:', CAST(n AS VARCHAR)), ' '
                          ORDER BY year DESC) AS datasets
FROM i GROUP BY county"""
ORACLES["normalized_roundtrip"] = f"""
WITH {OFFERS}
SELECT CAST(year + 10 AS INTEGER) AS year, substr(county, 1, 2) AS county, count(*) AS n,
       CAST(sum(last_media_h) AS BIGINT) AS total_h, 0::BIGINT AS out_of_order
FROM offers GROUP BY 1, 2"""
ORACLES["history_facts"] = f"""
WITH {OFFERS}, {_HISTORY}
SELECT saved_id, year, spec_id, CASE WHEN year % 2 = 0 THEN 'official' ELSE 'synthetic' END AS provenance,
       concat('HTTPS://example.org/', CAST(year AS VARCHAR), ' http://x.org') AS sources,
       concat(CAST(year AS VARCHAR), '-07-15') AS published_on
FROM ranked"""
ORACLES["audit_json"] = f"""
WITH audit AS ({ORACLES["forecast_audit"]})
SELECT max(matched) FILTER (county = 'ALL')::BIGINT AS matched, count(*) FILTER (county <> 'ALL') AS groups,
       string_agg(concat(county, ':', CAST(matched AS VARCHAR)), ' ' ORDER BY county) FILTER (county <> 'ALL') AS reports
FROM audit"""
