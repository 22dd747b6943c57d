"""Registered queries that write from the given tables and read back: files, generations, streams, stored fits.

Operators that came later than ``workloads`` are here as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.operators import calibration, contracts, cutoff, evaluate, robust
from gradecut.params import CalibrationParams
from gradecut.plans import views
from gradecut.plans.oracles import _BINS, _FIT, CANDIDATES, OFFERS, model
from gradecut.plans.oracles import ORACLES as _BASE
from gradecut.plans.views import table
from gradecut.plans.workloads import GENERATED_AT, MIN_COUNT, publishable, rounded
from gradecut.schemas import EXAM_SAMPLE
from gradecut.session import cut_lineage, shared_path
from gradecut.sources import archive, exams, fits, pages, publication, shortlists, sinks
from gradecut.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _snapshot_files(spark: SparkSession, sf_dir: str, folder: str, lost: str | None = None) -> None:
    """Raw allocation snapshots with their sidecars; files of another kind lie beside them.

    Some records are refused for what they say, some are listed twice, one snapshot's sidecar names
    another, and the one called ``lost`` has none.
    """
    odd, mark = F.col("occupied") % 6, F.col("last_media_h")
    offers = views.offers(spark, sf_dir).withColumn("dir", F.upper(F.substring("county", 1, 2)))
    whole = F.call_function("div", mark, F.lit(100))
    record = F.struct(
        F.col("dir").alias("j"), F.col("spec_id").alias("c"), F.col("school").alias("l"), F.col("school").alias("lc"),
        F.col("course_label").alias("sp"), F.lit("ro").alias("lp"), F.lit("-").alias("lb"),
        F.col("seats").cast("string").alias("nlt"), F.col("occupied").cast("string").alias("nlo"),
        F.when(odd == 1, "Seral").otherwise("Zi").alias("fi"), F.lit("Real").alias("p"),
        F.when(F.col("vocational"), "Vocațională").otherwise("Teoretică").alias("f"), F.lit("Liceal").alias("n"),
        F.coalesce(F.format_string("%d.%02d", whole, mark % 100), F.lit("-")).alias("um"),
    )
    listed = offers.select("year", "dir", record.alias("r"), F.explode(F.sequence(F.lit(1), F.when(odd == 2, 2).otherwise(1))))
    named = listed.withColumn("file", F.concat_ws("-", F.col("year").cast("string"), "dir"))
    texts = named.groupBy("file", "year", "dir").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("text"))
    texts = cut_lineage(texts)
    other = F.when(F.col("file") == "1997-AS", "XX").otherwise(F.col("dir"))
    url = F.concat(F.lit(f"https://{archive.SITE}/"), "year", F.lit("/repartizare/"), other, F.lit("/data/specialization.json\n"))
    beside = texts.filter(F.col("file") != F.lit(lost or "")).select(F.concat("file", F.lit(".json.url")), url)
    notes = texts.select(F.concat(F.lit("notes-"), "file", F.lit(".json")), F.lit("[]"))
    files = texts.select(F.concat("file", F.lit(".json")).alias("file"), "text").union(beside).union(notes)
    sinks.write_named_texts(files, folder)


@query
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots read from files with their sidecars: accepted records, refusals, repeats, and a snapshot without sidecar."""
    folder = shared_path(spark, "archive")
    _snapshot_files(spark, sf_dir, folder)
    parsed = cut_lineage(archive.parse_records(archive.read_snapshots(spark, folder)))
    kept = archive.offers_of(parsed).groupBy(F.concat_ws("-", F.col("year").cast("string"), "county").alias("what"))
    kept = kept.agg(F.lit("accepted").alias("message"), F.count(F.lit(1)).alias("n"))
    broken = archive.record_violations(parsed).groupBy(F.regexp_replace("dataset", "[.]json$", "").alias("what"), "message")
    broken = broken.agg(F.count(F.lit(1)).alias("n"))
    bare = shared_path(spark, "archive")
    _snapshot_files(spark, sf_dir, bare, lost="1998-EU")
    try:
        archive.read_snapshots(spark, bare)
        said = "nothing"
    except ValueError as error:
        said = str(error)
    lost = spark.range(1).select(F.lit("1998-EU").alias("what"), F.lit(said).alias("message"), F.lit(1).cast("bigint").alias("n"))
    return kept.unionByName(broken).unionByName(lost)


ORACLES["archive_files"] = f"""
WITH {OFFERS},
o AS (SELECT *, concat(CAST(year AS VARCHAR), '-', upper(substr(county, 1, 2))) AS what, occupied % 6 AS odd FROM offers)
SELECT what, 'accepted' AS message, CAST(sum(CASE odd WHEN 2 THEN 2 ELSE 1 END) AS BIGINT) AS n
FROM o WHERE what <> '1997-AS' AND odd <> 1 GROUP BY what
UNION ALL SELECT what, 'fi: only day classes are read', count(*) FROM o WHERE what <> '1997-AS' AND odd = 1 GROUP BY what
UNION ALL SELECT what, 'source_url: belongs to another snapshot', CAST(sum(CASE odd WHEN 2 THEN 2 ELSE 1 END) AS BIGINT)
FROM o WHERE what = '1997-AS' GROUP BY what
UNION ALL SELECT what, 'the course is listed again', count(*) FROM o WHERE odd = 2 GROUP BY what
UNION ALL SELECT '1998-EU', '1 snapshots without a URL sidecar: 1998-EU.json', 1"""


@query
def exam_sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified sample written as one CSV of two-decimal marks and read back as exact decimals."""
    folder = shared_path(spark, "sample")
    names = dict(zip(("romana_h", "materna_h", "matematica_h", "media_h"), EXAM_SAMPLE.fieldNames(), strict=True))
    sinks.write_csv_sample(sinks.media_sample(views.candidates(spark, sf_dir)), folder, names)
    back = exams.read_sample(spark, folder, EXAM_SAMPLE)
    return back.select(*[(F.col(theirs) * 100).cast("bigint").alias(ours) for ours, theirs in names.items()])


ORACLES["exam_sample_file"] = f"SELECT romana_h, materna_h, matematica_h, media_h FROM ({_BASE['even_sample']}) AS s"


@query
def directory_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools of one locality from a directory file whose header follows a preamble."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    schools = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    county = F.when(F.col("c_custkey") % 5 == 0, "OTHER").otherwise(F.col("r_name"))
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit("Şcoala "), "c_custkey"), county, "n_name", F.lit("x"))
    head = ["Lista,,,,", "la zi,,,,", "Cod SIIIR unitate,Denumire lunga unitate,Judet PJ,Localitate unitate,alt"]
    lines = spark.createDataFrame([(h,) for h in head], "line string").union(schools.select(row))
    folder = shared_path(spark, "directory")
    lines.write.text(folder)
    wanted = nation.filter("n_name = 'NATION_7'").select("r_name").first()["r_name"]
    return exams.read_directory(spark, folder, wanted, "NATION_7")


ORACLES["directory_file"] = """
SELECT CAST(c_custkey AS VARCHAR) AS code, concat(chr(536), 'coala ', c_custkey) AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND c_custkey % 5 <> 0"""


@query
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration written as text lines with its correlation, read back."""
    knots, rho = calibration.calibrate(views.candidates(spark, sf_dir), params=CalibrationParams(min_count=MIN_COUNT))
    folder = shared_path(spark, "calibration")
    sinks.write_calibration(knots, rho, folder)
    lines = spark.read.parquet(f"{folder}/knots").select("line")
    noted = F.format_string("rho %.4f n=%d", F.round("subject_rho", 4), "n")
    return lines.union(spark.read.parquet(f"{folder}/rho").select(noted.alias("line")))


ORACLES["calibration_report"] = f"""
WITH RECURSIVE {CANDIDATES}, {_BINS}
SELECT printf('%.2f %.3f %.3f %.3f %.3f n=%d', x, r, rs, m, ms, n) AS line FROM fitted
UNION ALL SELECT printf('rho %.4f n=%d', round(subject_rho, 4), n) FROM ({_BASE['residual_rho']}) AS c"""


@query
def record_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by year and county after one county's records of one year were replaced."""
    offers = views.offers(spark, sf_dir)
    each = cut_lineage(offers.groupBy("year", F.lower("county").alias("county")).agg(F.count(F.lit(1)).alias("n")))
    folder = shared_path(spark, "records")
    sinks.upsert_records(each, folder)
    again = each.filter("county = 'asia' AND year IN (1996, 1998)").withColumn("n", -F.col("n"))
    sinks.upsert_records(again.unionByName(again.limit(1).selectExpr("2040 AS year", "county", "0L AS n")), folder)
    return spark.read.parquet(folder).select(F.col("year").cast("int").alias("year"), "county", "n")


ORACLES["record_updates"] = f"""
WITH {OFFERS}
SELECT year, upper(county) AS county, CASE WHEN county = 'ASIA' AND year IN (1996, 1998) THEN -count(*) ELSE count(*) END AS n
FROM offers GROUP BY year, county
UNION ALL SELECT 2040, 'ASIA', 0"""


@query
def shortlist_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults in saved shortlists by owner, place and message, and how much the sound ones hold."""
    odd = F.col("occupied") % 7
    mark = F.when(odd == 3, F.col("last_media_h") / 100 + 20).otherwise(F.col("last_media_h") / 100)
    row = F.struct(
        "year", F.col("county").alias("county"), F.col("school").alias("schoolCode"), F.col("school").alias("schoolName"),
        F.col("spec_id").alias("specId"), F.col("course_label").alias("specLabel"), F.lit("").alias("profile"),
        F.lit("teoretica").alias("filiera"), F.lit("ro").alias("limba"), F.col("seats").cast("int").alias("seats"),
        mark.alias("lastMedia"), "vocational",
    )
    shot = F.struct(
        F.lit(1).alias("schemaVersion"), "year", F.when(odd != 2, F.col("county")).alias("county"),
        F.lit(GENERATED_AT).alias("generatedAt"), F.lit("official").alias("provenance"), F.array().cast("array<string>").alias("sources"),
        F.array(row).alias("rows"),
    )
    one = F.to_json(F.struct(F.array(shot).alias("snapshots")))
    one = F.when(odd == 1, F.regexp_replace(one, '"seats":5', '"seats":"5"')).otherwise(one)
    one = F.when(odd == 4, F.lit('{"snapshots":"none"}')).otherwise(one)
    owner = F.when(F.col("school").rlike("[02468]$"), F.col("county")).otherwise(F.concat("school", F.col("year").cast("string")))
    offers = views.offers(spark, sf_dir).select(owner.alias("owner"), "school", one.alias("one"))
    docs = offers.groupBy("owner").agg(F.array_sort(F.collect_list("one")).alias("all"), F.max("school").alias("school"))
    text = F.concat(F.lit("["), F.array_join("all", ","), F.lit("]"))
    broken = F.when(F.col("owner") == "NATION_71996", F.substring(text, 1, 40)).when(F.col("owner") == "NATION_71997", F.lit("{}"))
    raw = cut_lineage(docs.select("owner", F.coalesce(broken, text).alias("raw")))
    faults = cut_lineage(shortlists.shortlist_faults(raw, "owner"))
    place = F.regexp_replace("path", r"\[\d+\]", "[]")
    counted = faults.groupBy("owner", place.alias("place"), "message").agg(F.count(F.lit(1)).alias("n"))
    kept = pages.read_shortlist(shortlists.sound_shortlists(raw, faults, "owner"), owner="owner")
    kept = kept.groupBy("owner").agg(F.lit("$").alias("place"), F.lit("sound").alias("message"), F.count(F.lit(1)).alias("n"))
    return counted.unionByName(kept)


ORACLES["shortlist_faults"] = f"""
WITH {OFFERS},
o AS (SELECT *, occupied % 7 AS odd, CASE WHEN regexp_matches(school, '[02468]$') THEN county ELSE concat(school, CAST(year AS VARCHAR)) END AS owner
      FROM offers),
j AS (SELECT * FROM o WHERE owner NOT IN ('NATION_71996', 'NATION_71997')),
f AS (
  SELECT owner, '$[].snapshots[].rows[].seats' AS place, 'expected a whole number' AS message FROM j WHERE odd = 1
  UNION ALL SELECT owner, '$[].snapshots[].county', 'missing' FROM j WHERE odd = 2
  UNION ALL SELECT owner, '$[].snapshots[].rows[].lastMedia', 'not a mark from 1 to 10 in hundredths' FROM j WHERE odd = 3 AND last_media_h IS NOT NULL
  UNION ALL SELECT owner, '$[].snapshots', 'expected an array' FROM j WHERE odd = 4
  UNION ALL SELECT owner, '$', 'more than 500 saved courses' FROM j GROUP BY owner HAVING count(*) > 500
  UNION ALL SELECT DISTINCT owner, '$', CASE owner WHEN 'NATION_71996' THEN 'not JSON' ELSE 'expected an array' END
  FROM o WHERE owner IN ('NATION_71996', 'NATION_71997'))
SELECT owner, place, message, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT owner, '$', 'sound', count(*) FROM j WHERE owner NOT IN (SELECT owner FROM f) GROUP BY owner"""


@query
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from a published generation, found by reading the changed datasets only, and the folders read."""
    offers = cut_lineage(publishable(spark, sf_dir))
    root = shared_path(spark, "published")
    publication.publish(offers, root, GENERATED_AT, "g1")
    here = (F.col("county") == "AS") & F.col("year").isin(2006, 2009)
    edited = offers.filter(~((F.col("county") == "EU") & (F.col("year") == 2007) & F.col("vocational")))
    mark = F.when(here & (F.col("occupied_seats") % 3 == 0), F.col("last_media_h") + 1).otherwise(F.col("last_media_h"))
    edited = edited.withColumn("last_media_h", mark)
    edited = cut_lineage(edited.unionByName(offers.filter("county = 'AM' AND year = 2011").withColumn("county", F.lit("ZZ"))))
    changed = publication.changed_datasets(edited, root)
    read = {f.rsplit("/", 2)[0] + "/" + f.rsplit("/", 2)[1] for f in publication.read_datasets(spark, root, changed).inputFiles()}
    off = publication.differences(edited, root).groupBy("year", "county", "only_in").agg(F.sum("copies").alias("n"))
    folders = spark.range(1).select(
        F.lit(None).cast("int").alias("year"), F.lit("folders").alias("county"), F.lit("read").alias("only_in"), F.lit(len(read)).cast("bigint").alias("n")
    )
    return off.unionByName(folders)


ORACLES["snapshot_digests"] = f"""
WITH {OFFERS},
p AS (SELECT year + 10 AS year, upper(substr(county, 1, 2)) AS county, school, spec_id, occupied, last_media_h, vocational FROM offers),
c AS (
  SELECT year, county, school, spec_id, last_media_h FROM p WHERE county = 'AS' AND year IN (2006, 2009) AND occupied % 3 = 0 AND last_media_h IS NOT NULL),
d AS (
  SELECT year, county, 'published' AS only_in FROM c UNION ALL SELECT year, county, 'source' FROM c
  UNION ALL SELECT year, county, 'published' FROM p WHERE county = 'EU' AND year = 2007 AND vocational
  UNION ALL SELECT year, 'ZZ', 'source' FROM p WHERE county = 'AM' AND year = 2011)
SELECT CAST(year AS INTEGER) AS year, county, only_in, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT NULL, 'folders', 'read', count(DISTINCT concat(county, year)) FILTER (county <> 'ZZ') FROM d"""


@query
def selected_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of the prices paid in each nation, by selection that holds at most 500 values."""
    # Orders meet their customers before the lines, so the largest table moves at most once.
    placed = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    paid = table(spark, sf_dir, "lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    paid = paid.select("c_nationkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    asked = {"lowest": 0.0, "low": 0.1, "middle": 0.5, "high": 0.9, "highest": 1.0}
    return rounded(robust.grouped_quantiles(paid, ["c_nationkey"], "price", asked, held=500))


ORACLES["selected_quantiles"] = """
WITH p AS (SELECT c_nationkey, l_extendedprice * (1 - l_discount) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, round(min(price), 6) AS lowest, round(quantile_cont(price, 0.1), 6) AS low, round(median(price), 6) AS middle,
       round(quantile_cont(price, 0.9), 6) AS high, round(max(price), 6) AS highest
FROM p GROUP BY c_nationkey"""


@query
def selected_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and scaled median deviation of the order totals of each priority, by selection."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    return rounded(robust.selected_scale(orders, ["o_orderpriority"], "o_totalprice", held=200))


ORACLES["selected_scales"] = """
WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS middle FROM orders GROUP BY 1)
SELECT o_orderpriority, round(any_value(middle), 6) AS median, round(1.4826 * median(abs(o_totalprice - middle)), 6) AS robust_scale
FROM orders JOIN m USING (o_orderpriority) GROUP BY 1"""


@query
def stream_last_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of every customer from orders that arrive in no order, over several triggers and a restart."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    folder = shared_path(spark, "writes")
    keys = ["o_custkey"]
    for part in (2, 0, 3, 1):  # newer ones before older ones, as keys rise with time
        turn = F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == part
        orders.filter(turn).coalesce(2).write.mode("append").parquet(f"{folder}/arrived")
        if part in (0, 1):  # the query is stopped and started again between the two
            arriving = streams.read_arriving(spark, f"{folder}/arrived", orders.schema, per_trigger=1)
            streams.run_last_writes(arriving, keys, "o_orderkey", f"{folder}/out", f"{folder}/state")
    return streams.read_last_writes(spark, keys, f"{folder}/out")


ORACLES["stream_last_writes"] = _BASE["last_write_wins"]


HOLDOUTS = (1998, 1999, 2000, 2001)


@query
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest of four holdout years, all fitted in one plan."""
    offers = cut_lineage(views.offers(spark, sf_dir))
    return rounded(evaluate.rolling_backtest(offers, HOLDOUTS, views.VIEW_COLS, group=["county"]))


ORACLES["rolling_backtest"] = " UNION ALL ".join(
    f"SELECT {y} AS holdout_year, t.* FROM ({_BASE['backtest'].replace('2001', str(y))}) AS t" for y in HOLDOUTS
)


@query
def incremental_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models after three deliveries: the past, one year of two counties, and a correction of an earlier year."""
    whole = cut_lineage(views.offers(spark, sf_dir))
    folder, cols = shared_path(spark, "fits"), views.VIEW_COLS
    past = F.col("year") <= 2000
    early = F.col("county").isin("ASIA", "EUROPE")
    faulty = whole.withColumn("last_media_h", F.when(F.col("year") == 1997, 500).otherwise(F.col("last_media_h")))
    first = faulty.filter(past)
    fits.deliver(first, first, folder, 2002, cols)
    second = faulty.filter(past | early)
    fits.deliver(second, second.filter("year = 2001"), folder, 2002, cols)
    third = whole.filter(past | early)
    models = fits.deliver(third, third.filter("year = 1997"), folder, 2002, cols)
    return rounded(
        models.select(
            "county", "target_year", "base_year", "sigma", "tau", "sd", "evidence", F.size("observed_shifts").alias("n_shifts")
        )
    )


ORACLES["incremental_refit"] = f"""
WITH {OFFERS}, {model(2002, "year <= 2000 OR county IN ('ASIA', 'EUROPE')")}
SELECT {_FIT} FROM model"""


@query
def observed_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly shifts that every county's fit carries, one row each."""
    fit = cutoff.fit_cutoff_model(cut_lineage(views.offers(spark, sf_dir)), 2002, views.VIEW_COLS)
    each = fit.select("county", F.explode("observed_shifts").alias("s"))
    return rounded(each.select("county", "s.year", "s.shift", "s.spec_count"))


ORACLES["observed_shifts"] = _BASE["county_shifts"]


@query
def header_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of datasets, spoilt in each way that follows from their row counts, by the rule they break."""
    offers = publishable(spark, sf_dir)
    headers = sinks.headers_of(offers, GENERATED_AT).join(offers.groupBy("year", "county").agg(F.count("*").alias("rows")), ["year", "county"])
    odd = F.col("rows") % 7
    spoilt = headers.select(
        F.when(odd == 1, F.col("year") + 100).otherwise(F.col("year")).alias("year"),
        F.when(odd == 2, F.lower("county")).otherwise(F.col("county")).alias("county"),
        F.when(odd == 3, 2).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(odd == 4, "yesterday").otherwise(F.col("generated_at")).alias("generated_at"),
        F.when(odd == 5, "synthetic").otherwise(F.col("provenance")).alias("provenance"),
        F.when(odd == 6, F.array(F.lit(""))).otherwise(F.col("sources")).alias("sources"),
    )
    return contracts.header_violations(spoilt).groupBy("dataset", "rule").agg(F.count(F.lit(1)).alias("n"))


ORACLES["header_faults"] = f"""
WITH {OFFERS},
d AS (SELECT year + 10 AS year, upper(substr(county, 1, 2)) AS county, count(*) % 7 AS odd FROM offers GROUP BY 1, 2)
SELECT concat(CAST(CASE odd WHEN 1 THEN year + 100 ELSE year END AS VARCHAR), '/', CASE odd WHEN 2 THEN lower(county) ELSE county END) AS dataset,
       CASE odd WHEN 1 THEN 'year' WHEN 2 THEN 'county' WHEN 3 THEN 'version' WHEN 4 THEN 'timestamp' ELSE 'sources' END AS rule,
       CAST(1 AS BIGINT) AS n
FROM d WHERE odd > 0"""
