"""The registered queries. Each reads whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradecut.functions import keys, marks, sql, text, urls
from gradecut.operators import (
    answers,
    calibration,
    contracts,
    cutoff,
    evaluate,
    links,
    matching,
    pupils,
    ranking,
    robust,
    sets,
)
from gradecut.params import CalibrationParams
from gradecut.plans import views
from gradecut.plans.views import VIEW_COLS, spread_table, table
from gradecut.session import cut_lineage, shared_path
from gradecut.sources import archive, contract, exams, pages as page_sources, publication, sinks
from gradecut.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGET_YEAR = 2002
HOLDOUT_YEAR = 2001
EPOCH_YEAR = 1998
MIN_COUNT = 2500
TOP_N = 3
CAPPED = 20
RECORD_PART = 40
NEEDLES = ("eter", "écha", "über")
GENERATED_AT = "2002-01-01T00:00:00Z"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, settled: bool = False) -> DataFrame:
    """Doubles to six decimals, so that engines agree on the last bits.

    ``settled`` rounds to nine decimals first: values that are exact halves at the sixth
    decimal then are so again, whatever their last bits were.
    """
    kinds = dict(df.dtypes)

    def to(value: Column, scale: float) -> Column:
        # Half away from zero; a built-in round would go through decimal text on every value.
        size = F.floor(F.abs(value) * scale + 0.5) / scale
        return F.when(value < 0, 0.0 - size).otherwise(size)

    def short(name: str) -> Column:
        value = to(F.col(name), 1e9) if settled else F.col(name)
        return to(value, 1e6).alias(name)

    return df.select(*[short(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _offers(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """The offers once per query: the operators below read them two or three times."""
    return cut_lineage(views.offers(spark, sf_dir, placed=placed))


def _asked(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    results = views.candidates(spark, sf_dir, placed=placed)
    return results.select("candidate_id", "county", "media_h", (F.col("media_h") / 100).alias("media"))


# --- mark arithmetic and text ---------------------------------------------------------


@query
def verify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.media_counters(views.candidates(spark, sf_dir))


@query
def truncate_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    whole = (cust % 13).cast("string")
    cell = (
        F.when(key % 11 == 0, "-")
        .when(key % 13 == 0, " n/a ")
        .when(key % 17 == 0, F.concat(whole, F.lit("x")))
        .otherwise(F.concat(F.lit(" "), whole, F.lit(","), (key % 1000).cast("string"), F.lit(" ")))
    )
    typed = F.concat(whole, F.lit("."), (key % 1000).cast("string"))
    df = orders.select("o_orderkey", "o_totalprice", cell.alias("cell"), typed.alias("typed"))
    cell_h = marks.parse_media_cell(F.col("cell"), on_error="null")
    average = (F.col("o_orderkey") * 7 + F.col("o_orderkey") % 1000) % 901 + 100
    return df.select(
        "o_orderkey",
        marks.truncate_two_decimals(F.col("o_totalprice") / 7).alias("truncated"),
        cell_h.alias("cell_h"),
        marks.media_cell_error(F.col("cell")).isNotNull().alias("refused"),
        marks.parse_media_input(F.col("typed")).alias("typed_h"),
        marks.format_media_h(cell_h).alias("shown"),
        marks.to_hundredths(average / 100).alias("grade_h"),
        marks.snap_to_grid_h(average, 25).alias("knot_h"),
        F.round(marks.scale_position(average / 100), 6).alias("position"),
    )


def _digits(number: Column, width: int) -> Column:
    """A number with leading zeros; the formatter is slow and only needed for what padding would cut or misplace."""
    padded = F.lpad(number.cast("string"), width, "0")
    return F.when(number.between(0, 10**width - 1), padded).otherwise(F.format_string(f"%0{width}d", number))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a sheet has them: prefixes, noise in doubles, blanks, dashes."""
    results = views.candidates(spark, sf_dir)
    noisy = lambda c: ((F.col(c) / 100) + 0.0000000000001).cast("string")
    return results.select(
        F.concat(F.lit(" "), _digits(F.col("school_id") % 55, 2), _digits(F.col("school_id"), 8)).alias("school_code"),
        F.when(F.col("line") % 2 == 0, " Urban ").otherwise("RURAL").alias("setting"),
        F.coalesce(noisy("romana_h"), F.lit("-")).alias("romana_h"),
        F.coalesce(noisy("materna_h"), F.lit("")).alias("materna_h"),
        noisy("matematica_h").alias("matematica_h"),
        noisy("media_h").alias("media_h"),
        noisy("school_media_h").alias("school_media_h"),
    )


def _parsed_totals(parsed: DataFrame) -> DataFrame:
    sums = ("romana_h", "materna_h", "school_media_h")
    totals = parsed.groupBy("county", "urban", F.col("error").isNotNull().alias("refused")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums]
    )
    return totals.select("county", keys.county_name(F.col("county")).alias("county_name"), "urban", "refused", "n", *sums)


@query
def exam_results_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet-style text back to typed results."""
    return _parsed_totals(exams.results_of(_sheet(spark, sf_dir), strict=False))


@query
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet as a CSV file among other columns, its headings in any case and spacing."""
    sheet = _sheet(spark, sf_dir)
    named = [F.col(ours).alias(f" {theirs.title()} ") for ours, theirs in exams.RESULT_HEADINGS.items()]
    folder = shared_path(spark, "results")
    sheet.select(F.lit("x").alias("NR"), *reversed(named)).write.option("header", True).csv(folder)
    return _parsed_totals(exams.read_results(spark, folder, strict=False))


@query
def first_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the first results whose average cannot be reproduced."""
    wrong = evaluate.with_media_status(views.candidates(spark, sf_dir)).filter("status = 'mismatch'")
    return ranking.first_n(wrong, [F.col("county"), F.col("candidate_id")], 10).select(
        "county", "candidate_id", "romana_h", "materna_h", "matematica_h", "media_h"
    )


@query
def school_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one country's customers as schools, and how many of them have results."""
    nation = table(spark, sf_dir, "nation").filter("n_name = 'NATION_7'").select("n_nationkey")
    schools = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    directory = cut_lineage(schools.select(F.col("c_custkey").alias("code")))
    results = views.candidates(spark, sf_dir).withColumnRenamed("school_id", "school_code")
    kept = exams.restrict_to_schools(results, directory)
    seen = exams.observed_schools(directory, results).select(F.lit("observed").alias("what"), F.col("code"))
    return (
        kept.select(F.lit("result").alias("what"), F.col("school_code").alias("code"))
        .unionByName(seen)
        .groupBy("what", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def romanian_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with and without diacritics in Romanian alphabetical order, per region."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.lower("n_name").alias("_name"))
    plain, kind = F.col("_name"), F.col("c_custkey") % 4
    name = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.translate(plain, "ast", "ășț"))
        .when(kind == 2, F.translate(plain, "ai", "âî"))
        .otherwise(F.translate(plain, "e", "a"))
    )
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("region"), name.alias("name")
    )
    ranked = ranking.rank_within(named, ["region"], [text.ro_order(F.col("name")), F.col("c_custkey")], "place", "_size")
    return ranked.select("region", "c_custkey", "name", "place")


@query
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.normalize_text(F.col("text"))
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))
    return docs.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("length"))


@query
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    hits = [F.when(text.matches_search(F.col("text"), n), n) for n in NEEDLES]
    return docs.select(F.explode(F.array_compact(F.array(*hits))).alias("needle"), "doc_id", "lang")


@query
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track and text filter of a listing, on parts."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_type", F.col("p_brand").alias("track")
    )
    return contracts.text_filter(parts, "RING", "Brand#12", ["p_name", "p_type"]).select(
        "p_partkey", "p_name"
    )


# --- contracts, index, sets -----------------------------------------------------------


def _contract_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers in the published shape, with faults that follow from the data."""
    offers = views.offers(spark, sf_dir)
    odd = F.col("occupied") % 7
    return offers.select(
        F.when(odd == 3, F.col("year") + 200).otherwise(F.col("year") + 10).alias("year"),
        F.substring("county", 1, 2).alias("county"),
        F.col("school").alias("school_code"),
        F.when(odd == 1, F.concat(F.col("school"), F.when(F.col("year") % 2 == 0, "\n").otherwise(" ")))
        .otherwise(F.col("school"))
        .alias("school_name"),
        F.when(F.col("course_label") == "Shared", "Shared").otherwise(F.col("spec_id")).alias("spec_id"),
        F.when(odd == 2, "").otherwise(F.col("course_label")).alias("spec_label"),
        F.lit("").alias("profile"),
        F.when(F.col("vocational"), "vocationala").when(odd == 4, "alta").otherwise("teoretica").alias("track"),
        F.lit("ro").alias("limba"),
        F.when(odd == 5, -1).otherwise(F.col("seats")).alias("seats"),
        F.col("occupied").cast("int").alias("occupied_seats"),
        F.when(odd == 6, F.col("last_media_h") + 1000).otherwise(F.col("last_media_h")).alias("last_media_h"),
        (F.col("vocational") | (odd == 0)).alias("vocational"),
    )


@query
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = _contract_offers(spark, sf_dir)
    dataset = F.concat_ws("/", F.col("year").cast("string"), "county")
    broken = contracts.row_violations(offers).unionByName(
        contracts.duplicate_violations(offers, dataset, ["school_code", "spec_id"])
    )
    return broken.groupBy("dataset", "rule", "message").agg(F.count(F.lit(1)).alias("n"))


@query
def index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of one snapshot against data that changed since: more rows, a lost set, a new one."""
    offers = _offers(spark, sf_dir)
    index = sinks.build_index(offers.filter(~((F.col("county") == "ASIA") & (F.col("year") == 1999))), VIEW_COLS)
    changed = offers.filter(
        ~((F.col("county") == "EUROPE") & (F.col("year") == 1997))
        & ~((F.col("county") == "AFRICA") & F.col("vocational"))
    )
    return contracts.reconcile_index(index, changed, VIEW_COLS)


@query
def dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.build_index(views.offers(spark, sf_dir), VIEW_COLS)


@query
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dataset_totals(views.offers(spark, sf_dir), VIEW_COLS)


@query
def snapshot_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between two snapshots, copies counted."""
    offers = _offers(spark, sf_dir)
    row = ["year", "county", "course_label", "last_media_h"]
    edited = offers.withColumn(
        "last_media_h",
        F.when(F.col("occupied") % 9 == 0, F.col("last_media_h") + 1).otherwise(F.col("last_media_h")),
    ).filter(F.col("occupied") % 10 != 0)
    return sets.snapshot_difference(edited.select(*row), offers.select(*row))


@query
def county_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools without a filled course in a year: expected keys against present ones."""
    offers = _offers(spark, sf_dir)
    key = ["year", "school", "course_label"]
    schools = offers.select("year", "school").distinct()
    expected = schools.join(offers.select("school", "course_label").distinct(), "school")
    filled = offers.filter(~keys.has_vacancies(F.col("occupied"), F.col("seats")))
    return sets.missing_groups(expected, filled, key)


@query
def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents and back: parts, rows and a checksum per dataset."""
    offers = _contract_offers(spark, sf_dir).withColumns(
        {
            "last_media_h": F.when(F.col("last_media_h") <= 1000, F.col("last_media_h")),
            "provenance": F.lit("official"),
            "source": F.concat(F.lit("https://example.org/"), F.col("school_code")),
        }
    )
    flat = sinks.flatten_datasets(sinks.nest_datasets(offers, GENERATED_AT, rows_per_part=50))
    return flat.groupBy("dataset_year", "dataset_county").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("last_media_h").alias("total_h"),
        F.max(F.size("sources")).alias("n_sources"),
        F.max(F.array_join("sources", ",")).alias("sources"),
    )


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers in the published shape, without faults."""
    return views.offers(spark, sf_dir).select(
        (F.col("year") + 10).alias("year"),
        F.upper(F.substring("county", 1, 2)).alias("county"),
        F.col("school").alias("school_code"),
        F.col("school").alias("school_name"),
        "spec_id",
        F.col("course_label").alias("spec_label"),
        F.lit("").alias("profile"),
        F.when(F.col("vocational"), "vocationala").otherwise("teoretica").alias("track"),
        F.lit("ro").alias("limba"),
        F.col("seats").cast("int").alias("seats"),
        F.col("occupied").cast("int").alias("occupied_seats"),
        "last_media_h",
        "vocational",
        F.lit("official").alias("provenance"),
        F.lit("https://example.org/results").alias("source"),
    )


@query
def publish_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published generation read back by its pointer."""
    offers = publishable(spark, sf_dir)
    root = shared_path(spark, "published")
    sinks.publish(cut_lineage(offers), root, GENERATED_AT, "g1")
    return sinks.read_published(spark, root).groupBy(F.col("year").cast("int").alias("year"), "county").agg(
        F.count(F.lit(1)).alias("n"), F.sum("last_media_h").alias("total_h")
    )


@query
def publish_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is readable, and which generations are stored, after each of eight publications and clean-ups."""
    offers = cut_lineage(publishable(spark, sf_dir))
    root = shared_path(spark, "published")
    steps = []

    def note(outcome: str) -> None:
        newest = publication.versions(spark, root).orderBy(F.desc("version")).first()
        n, total = publication.read_published(spark, root).agg(F.count(F.lit(1)), F.sum("last_media_h")).first()
        stored = " ".join(publication.stored_generations(spark, root))
        steps.append((len(steps) + 1, outcome, newest["version"], newest["generation"], n, total, stored))

    def attempt(rows: DataFrame, generation: str, base: int | None = None) -> None:
        try:
            publication.publish(rows, root, GENERATED_AT, generation, base)
            note("published")
        except publication.ConflictError:
            note("lost the race")
        except contracts.ContractError:
            note("refused")
        except PySparkException:
            note("failed")

    attempt(offers.filter("year <= 2008"), "g1")
    attempt(offers.withColumn("seats", F.when(F.col("occupied_seats") == 1, -1).otherwise(F.col("seats"))), "g2")
    attempt(offers.unionByName(offers.filter("vocational")), "g3")
    late = F.when(F.col("year") == 2010, F.raise_error(F.lit("the source is gone"))).otherwise(F.col("last_media_h"))
    attempt(offers.withColumn("last_media_h", late), "g4")
    base = publication.last_number(spark, root)  # two publishers start from here
    attempt(offers, "g5", base)
    attempt(offers.filter("vocational"), "g6", base)
    publication.write_generation(offers.filter("vocational"), root, GENERATED_AT, "g7")  # and is never heard of again
    note("abandoned")
    publication.expire(spark, root, keep=1, grace_seconds=-60)
    note("expired")
    kind = "step int, outcome string, version bigint, generation string, n bigint, total_h bigint, stored string"
    return spark.createDataFrame(steps, kind)


@query
def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with faults that follow from its counts, by the rule they break."""
    index = cut_lineage(sinks.build_index(publishable(spark, sf_dir)))
    odd = F.col("row_count") % 5
    faulty = index.filter(odd != 4).select(
        "year",
        "county",
        F.when(odd == 1, "elsewhere.json").otherwise(F.col("path")).alias("path"),
        F.when(odd == 3, -F.col("row_count")).otherwise(F.col("row_count")).alias("row_count"),
        F.when(odd == 2, "guess").otherwise(F.col("provenance")).alias("provenance"),
    )
    twice = index.filter(odd == 4)
    broken = contracts.index_violations(faulty.unionByName(twice).unionByName(twice))
    return broken.groupBy("dataset", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def county_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each county's datasets, newest first."""
    listed = sinks.index_by_county(sinks.build_index(views.offers(spark, sf_dir), VIEW_COLS))
    entry = lambda d: F.concat_ws(":", d["year"].cast("string"), d["path"], d["row_count"].cast("string"))
    return listed.select("county", F.array_join(F.transform("datasets", entry), " ").alias("datasets"))


@query
def normalized_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history united from two parts, written in its fixed order and read back."""
    offers = cut_lineage(publishable(spark, sf_dir))
    early = offers.filter("year < 2006").drop("provenance")
    history = sets.union_history([early, offers.filter("year >= 2006")]).withColumn(
        "provenance", F.coalesce("provenance", F.lit("official"))
    )
    folder = shared_path(spark, "normalized")
    sinks.write_normalized(history, folder)
    file, key = F.col("_metadata.file_path"), F.struct("school_code", "spec_id")
    read = spark.read.parquet(folder).select(
        "*", file.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    in_file = Window.partitionBy("_file").orderBy("_block", "_at")
    placed = read.withColumn("_late", F.lag(key).over(in_file) > key)
    return placed.groupBy(F.col("year").cast("int").alias("year"), "county").agg(
        F.count(F.lit(1)).alias("n"), F.sum("last_media_h").alias("total_h"), F.count_if("_late").alias("out_of_order")
    )


@query
def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers written as the contract's JSON documents and read back, marks exact."""
    offers = cut_lineage(publishable(spark, sf_dir))
    folder = shared_path(spark, "contract")
    contract.dataset_json(offers, sinks.headers_of(offers, GENERATED_AT)).select("document").write.text(folder)
    read = spark.read.text(folder).select(contract.parse_dataset(F.col("value")).alias("d"))
    rows = read.select(F.col("d.provenance").alias("provenance"), F.explode("d.rows").alias("r"))
    return rows.select(
        "r.year", "r.county", "r.school_code", "r.spec_id", "r.spec_label", "r.track", "r.seats", "r.last_media_h", "provenance"
    )


@query
def archive_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw allocation records, some of them faulty in each way that follows from the data."""
    odd, mark = F.col("occupied") % 9, F.col("last_media_h")
    raw = views.offers(spark, sf_dir).select(
        F.when(odd == 1, "XX").otherwise(F.substring("county", 1, 2)).alias("j"),
        F.col("spec_id").alias("c"),
        F.concat(F.lit(" \u015ecoala  "), F.col("school"), F.lit("\u00a0")).alias("l"),
        F.col("school").alias("lc"),
        F.col("course_label").alias("sp"),
        F.lit("ro").alias("lp"),
        F.when(odd == 2, "Englez\u0103").otherwise("-").alias("lb"),
        F.col("seats").cast("string").alias("nlt"),
        F.when(odd == 3, "x").otherwise(F.col("occupied").cast("string")).alias("nlo"),
        F.when(odd == 4, "Seral").otherwise("Zi").alias("fi"),
        F.lit("Real").alias("p"),
        F.when(F.col("vocational"), "VOCATIONALA").when(odd == 5, "alta").otherwise("Teoretic\u0103").alias("f"),
        F.when(odd != 6, "Liceal").alias("n"),
        F.when(odd == 7, "DA").alias("d"),
        F.format_string("%d.%02d", F.call_function("div", mark, F.lit(100)), mark % 100).alias("um"),
        (odd != 8).alias("um_given"),
        F.lit("-").alias("file"),
        F.col("year").cast("int").alias("year"),
        F.substring("county", 1, 2).alias("county"),
    ).withColumn("um", F.when(F.col("um").rlike("^[0-9]"), F.col("um")))
    site = F.concat(F.lit(f"https://{archive.SITE}/"), F.col("year").cast("string"), F.lit("/repartizare/"), F.col("county"))
    parsed = archive.parse_records(raw.withColumn("source_url", F.concat(site, F.lit("/data/specialization.json"))))
    return parsed.select("year", "county", "school_code", "school_name", "spec_id", "spec_label", "track", "seats", "last_media_h", "error")


# --- matching and the cutoff model ----------------------------------------------------


@query
def unique_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = matching.unique_courses(views.offers(spark, sf_dir), VIEW_COLS)
    return kept.select("year", "county", "school", "spec_id", "last_media_h", "occupied")


@query
def yoy_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = matching.yearly_deltas(views.offers(spark, sf_dir), VIEW_COLS)
    return deltas.filter("delta_h is not null").select(
        "county", "year", F.col("id_school").alias("school"), F.col("id_course_label").alias("label"), "delta_h"
    )


@query
def county_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cutoff.county_shifts(views.offers(spark, sf_dir), VIEW_COLS))


@query
def fit_cutoff_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All years (spreads estimated) and the last three (priors still in force)."""
    offers = _offers(spark, sf_dir)
    fits = None
    for name, first in (("long", 0), ("short", 2000)):
        window = offers.filter(F.col("year") >= first)
        fit = cutoff.fit_cutoff_model(window, TARGET_YEAR, VIEW_COLS).withColumn("history", F.lit(name))
        fits = fit if fits is None else fits.unionByName(fit)
    return rounded(
        fits.select(
            "history", "county", "target_year", "base_year", "sigma", "tau", "sd", "evidence",
            F.size("observed_shifts").alias("n_shifts"),
        )
    )


@query
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.candidates(spark, sf_dir).select("school", (F.col("romana_h") - F.col("matematica_h")).alias("gap_h"))
    return rounded(robust.robust_scale(results, "gap_h", ["school"]))


@query
def history_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = views.offers(spark, sf_dir)
    return contracts.history_violations(offers, 2001, VIEW_COLS, EPOCH_YEAR)


@query
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate against the course of their own part: one keyed lookup each."""
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    asked = views.with_course(views.candidates(spark, sf_dir, placed=placed), spark, sf_dir).select(
        "candidate_id", "county", "school", "spec_id", (F.col("media_h") / 100).alias("media")
    )
    scored = cutoff.score_requests(asked, offers, models, VIEW_COLS)
    fill = marks.scale_position(F.col("media"), F.col("interval_low"), F.col("interval_high"))
    return rounded(
        scored.select(
            "candidate_id", "county", "school", "spec_id", "kind", "reason", "probability", "cutoff",
            "interval_low", "interval_high", "rank_value", "band",
            F.when(F.col("kind") == "estimate", fill).alias("fill"),
        )
    )


@query
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    return answers.summaries(_asked(spark, sf_dir, placed), offers, models, VIEW_COLS).drop("media")


@query
def answer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    return answers.best_courses(_asked(spark, sf_dir, placed), offers, models, TOP_N, VIEW_COLS).drop("media")


@query
def answer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ordered list for the average candidate of every county."""
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    average = _asked(spark, sf_dir, placed).groupBy("county").agg(
        F.call_function("div", F.sum("media_h"), F.count("media_h")).alias("media_h")
    )
    asked = average.select("county", (F.col("media_h") / 100).alias("media"))
    scored = cutoff.score_courses(asked, offers, models, VIEW_COLS)
    listed = cutoff.answer_list(scored, ["county", "media"], VIEW_COLS)
    return rounded(listed.select("county", "media", "bucket", "position", "school", "spec_id", "probability", "cutoff_pos"))


@query
def course_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable history of every course on offer in the latest year."""
    offers = _offers(spark, sf_dir)
    saved = offers.filter(F.col("year") == HOLDOUT_YEAR).withColumn(
        "saved_id", F.concat_ws("/", "county", "school", "spec_id")
    )
    history = matching.course_history(saved, offers, VIEW_COLS, epoch_year=EPOCH_YEAR)
    return history.select("saved_id", "year", "spec_id", "last_media_h", F.col("history_rank").cast("bigint").alias("history_rank"))


@query
def history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course histories with provenance, citable sources and publication date of each year."""
    offers = _offers(spark, sf_dir)
    saved = offers.filter(F.col("year") == HOLDOUT_YEAR).withColumn(
        "saved_id", F.concat_ws("/", "county", "school", "spec_id")
    )
    history = matching.course_history(saved, offers, VIEW_COLS, epoch_year=EPOCH_YEAR)
    year = F.col("year").cast("string")
    datasets = offers.select("county", "year").distinct().select(
        "county",
        "year",
        F.when(F.col("year") % 2 == 0, "official").otherwise("synthetic").alias("provenance"),
        F.array(F.concat(F.lit("HTTPS://example.org/"), year), F.lit("a note"), F.lit("http://x.org")).alias("sources"),
        F.concat(year, F.lit("-07-15T10:00:00Z")).alias("generated_at"),
    )
    facts = matching.historical_facts(history, datasets, VIEW_COLS)
    return facts.select("saved_id", "year", "spec_id", "provenance", F.array_join("sources", " ").alias("sources"), "published_on")


@query
def saved_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories saved as snapshots, some of them spoilt, checked again; a county saves at most 500."""
    offers = _offers(spark, sf_dir)
    saved = offers.filter(F.col("year") == HOLDOUT_YEAR).withColumn(
        "saved_id", F.concat_ws("/", "county", "school", "spec_id")
    )
    history = matching.course_history(saved, offers, VIEW_COLS, epoch_year=EPOCH_YEAR)
    spoilt = F.length("saved_id") % 4
    snapshots = history.select(
        "saved_id", *offers.columns, F.col("history_rank").alias("place")
    ).withColumns(
        {
            "row_total": F.when((spoilt == 1) & (F.col("place") == 1), 2).otherwise(1),
            "course_label": F.when((spoilt == 2) & (F.col("place") == 1), "Other").otherwise(F.col("course_label")),
        }
    )
    broken = contracts.saved_violations(cut_lineage(snapshots), VIEW_COLS, EPOCH_YEAR, owner="county")
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# --- calibration and marks ------------------------------------------------------------


@query
def calibrate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = calibration.calibrate_bins(calibration.mark_sums(views.candidates(spark, sf_dir)))
    return rounded(calibration.with_moments(bins).select("bin_h", "n", *calibration.KNOT_FIELDS))


@query
def calibrate_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = calibration.mark_sums(views.candidates(spark, sf_dir))
    return rounded(calibration.calibrate_knots(sums, params=CalibrationParams(min_count=MIN_COUNT)))


@query
def residual_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = views.candidates(spark, sf_dir)
    _, rho = calibration.calibrate(results, params=CalibrationParams(min_count=MIN_COUNT))
    return rounded(rho)


@query
def group_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a school, those without results included."""
    directory = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("school_id"))
    knots = calibration.knots_2025(spark)
    effects = calibration.group_effects(views.candidates(spark, sf_dir), knots, directory=directory)
    # Shrinking divides by n + 30, often a power of two: exact halves do occur.
    return rounded(effects, settled=True)


def _predicted(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    placed = views.placed_lines(spark, sf_dir) if placed is None else placed
    knots = calibration.knots_2025(spark)
    effects = cut_lineage(calibration.group_effects(views.candidates(spark, sf_dir, placed=placed), knots))
    return pupils.predict_marks(views.students(spark, sf_dir, placed), knots, effects)


@query
def predict_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = _predicted(spark, sf_dir)
    return rounded(
        predicted.select(
            "candidate_id", "current_grade", "error", "school_mean", "horizon_years",
            "romana_mean", "romana_sd", "romana_low", "romana_high", "romana_basis",
            "matematica_mean", "matematica_sd", "media_mean", "media_sd", "media_low", "media_high",
        ),
        settled=True,
    )


@query
def student_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records spoilt in every way the guards know, counted by the first reason."""
    pupil = F.col("l_partkey") % 11
    spoilt = views.students(spark, sf_dir).withColumns(
        {
            "school_record": F.when(pupil == 1, F.slice("school_record", 1, 0))
            .when(pupil == 2, F.transform("school_record", lambda e: F.struct((e["grade"] + 1).alias("grade"), e["media"].alias("media"))))
            .when(pupil == 3, F.concat("school_record", "school_record"))
            .when(pupil == 4, F.transform("school_record", lambda e: F.struct(e["grade"].alias("grade"), (e["media"] + 9).alias("media"))))
            .otherwise(F.col("school_record")),
            "mock_romana": F.when(pupil == 5, 5.0).when(pupil == 6, F.col("mock_romana") * 4).otherwise(F.col("mock_romana")),
            "current_grade": F.when(pupil == 7, 4).otherwise(F.col("current_grade")),
        }
    )
    mock = {s: F.col(f"mock_{s}") for s in pupils.SUBJECTS}
    error = pupils.record_error(
        F.col("current_grade"), F.col("school_record"), F.col("takes_mother_tongue"), mock
    )
    return spoilt.select(error.alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def chained_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated averages scored against each pupil's course in their own admission year.

    A pupil whose record is refused keeps a row with the reason and no answer.
    """
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    predicted = views.with_course(_predicted(spark, sf_dir, placed), spark, sf_dir)
    year = keys.target_year(F.to_date(F.lit("2001-10-15")), F.col("current_grade"), F.lit(HOLDOUT_YEAR))
    asked = predicted.select(
        "candidate_id", "county", "school", "spec_id",
        F.col("media_mean").alias("media"), "media_sd", year.cast("int").alias("admission_year"), "error",
    )
    scored = cutoff.score_requests(
        asked, offers, models, VIEW_COLS, media_sd="media_sd", target_year="admission_year"
    )
    answer = ("kind", "reason", "probability", "interval_low", "interval_high", "band")
    return rounded(
        scored.select(
            "candidate_id", "county", "school", "spec_id", "admission_year", "error",
            *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in answer],
        )
    )


@query
def chained_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many courses each pupil's estimated average clears, spread included; refused records
    keep a row with the reason."""
    placed = views.placed_lines(spark, sf_dir)
    offers = _offers(spark, sf_dir, placed)
    models = cutoff.fit_cutoff_model(offers, TARGET_YEAR, VIEW_COLS)
    predicted = _predicted(spark, sf_dir, placed).select(
        "candidate_id", "county", "error", F.col("media_mean").alias("media"), "media_sd"
    )
    counted = answers.summaries(predicted, offers, models, VIEW_COLS, media_sd="media_sd")
    counts = ("answerable", "clears", "tight", "open", "aside")
    return counted.select(
        "candidate_id", "county", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in counts]
    )


# --- evaluation -----------------------------------------------------------------------


@query
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against published averages, and the naive reading, by school grade."""
    scored = _predicted(spark, sf_dir).filter("error is null and media is not null")
    metrics = evaluate.error_metrics(
        scored, F.col("media_mean"), F.col("media"), F.col("media_low"), F.col("media_high"),
        pupils.latest_mark(F.col("school_record")), ["current_grade"],
    )
    return rounded(metrics)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = _offers(spark, sf_dir)
    past = offers.filter(F.col("year") < HOLDOUT_YEAR)
    models = cutoff.fit_cutoff_model(past, HOLDOUT_YEAR, VIEW_COLS)
    return evaluate.holdout_pairs(offers, HOLDOUT_YEAR, models, VIEW_COLS)


@query
def brier_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = evaluate.offset_samples(_pairs(spark, sf_dir))
    return rounded(
        evaluate.reliability_table(samples, F.col("probability"), F.col("admitted"), min_n=20)
    )


@query
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.backtest(_offers(spark, sf_dir), HOLDOUT_YEAR, VIEW_COLS, group=["county"]))


@query
def forecast_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = evaluate.forecast_audit(_offers(spark, sf_dir), HOLDOUT_YEAR, VIEW_COLS)
    return rounded(audit.withColumn("county", F.coalesce("county", F.lit("ALL"))))


@query
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit as one JSON document, read again."""
    audit = evaluate.forecast_audit(_offers(spark, sf_dir), HOLDOUT_YEAR, VIEW_COLS)
    report = sinks.audit_report(audit, VIEW_COLS)
    value = lambda path: F.get_json_object("report", path)
    reports = F.from_json(value("$.reports"), "array<struct<county:string,matched:bigint>>")
    return report.select(
        value("$.matched").cast("bigint").alias("matched"),
        value("$.groups").cast("bigint").alias("groups"),
        F.array_join(F.transform(reports, lambda r: F.concat_ws(":", r["county"], r["matched"].cast("string"))), " ").alias("reports"),
    )


@query
def estimator_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.compare_estimators(_offers(spark, sf_dir), HOLDOUT_YEAR, VIEW_COLS))


@query
def minority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.minority_share(views.candidates(spark, sf_dir)))


@query
def record_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.record_inflation(views.candidates(spark, sf_dir)))


# --- sampling and picks ---------------------------------------------------------------


@query
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified sample of published averages."""
    return sinks.media_sample(views.candidates(spark, sf_dir))


@query
def backtest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced eligible results, copies kept, per county."""
    eligible = calibration.eligible_results(views.candidates(spark, sf_dir)).select(
        "county", "school_media_h", "romana_h", "matematica_h", "media_h"
    )
    return ranking.even_sample(eligible, ["county"], ["school_media_h", "romana_h", "matematica_h"], 400)


def _sized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "url",
        F.lit(2024).alias("year"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("county"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )


@query
def representative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pick_representative(_sized_pages(spark, sf_dir), ["year", "county"], 5)


@query
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.last_write_wins(orders, ["o_custkey"], "o_orderkey")


# --- pages and links ------------------------------------------------------------------


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(spread_table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select("page_id", "url", "text", "position")


@query
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form, directory, host, slug and hashes of every stored address."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.canonical_url(url).alias("canonical"),
        urls.directory_of(url).alias("directory"),
        urls.host_of(url).alias("host"),
        urls.page_slug(url).alias("slug"),
        urls.cache_key(url).alias("cache_key"),
        urls.short_hash(url).alias("short_hash"),
        urls.same_site(urls.host_of(url), F.lit("example.com")).alias("same_site"),
    )


@query
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses after dropping fragments, each once, with the body that came first."""
    pages = table(spark, sf_dir, "pages").select(
        urls.canonical_url(F.col("url"), keep_fragment=False).alias("url"), "page_id", F.md5("html").alias("body")
    )
    return links.dedupe_pages(pages, order="page_id").select("canonical_url", "page_id", "body")


def _crawled(
    spark: SparkSession, sf_dir: str, max_pages: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    store = views.page_store(spark, sf_dir)
    found = cut_lineage(links.extract_links(store))
    crawls = cut_lineage(views.crawls(spark, sf_dir))
    starts = links.discover(found, crawls).select("crawl", "url", F.col("position").alias("place"))
    stored = store.select("url")
    return crawls, starts, links.descend(found, starts, max_pages, pages=stored)


@query
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(links.extract_links(views.page_store(spark, sf_dir)))
    return links.discover(found, views.crawls(spark, sf_dir)).select(
        "crawl", "year", "county", "url", "year_url"
    )


@query
def discovery_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls for a year the site never had, with what their seed page offered instead."""
    found = cut_lineage(links.extract_links(views.page_store(spark, sf_dir)))
    known = views.crawls(spark, sf_dir)
    absent = known.select((F.col("crawl") + 100).alias("crawl"), "seed", F.lit(1999).alias("year"), "county")
    crawls = known.unionByName(absent)
    reached = links.discover(found, crawls)
    failed = links.discovery_failures(found, crawls, reached)
    seen = F.array_join(F.transform("links_seen", lambda e: e["url"]), " ")
    return failed.select("crawl", "year", "county", seen.alias("seen"))


def _harvest(spark: SparkSession, sf_dir: str, max_pages: int | None) -> DataFrame:
    crawls, _, reached = _crawled(spark, sf_dir, max_pages)
    reached = cut_lineage(reached)
    number = F.regexp_extract("url", "([0-9]+)[.]html$", 1).cast("int")
    before = reached.filter(number % 3 == 0).select("url", F.concat(F.sha1("url"), F.lit(".html")).alias("file"))
    picks = reached.join(crawls, "crawl").select("crawl", "county", "year", "url", F.col("depth").alias("pick_rank"))
    staged = links.stage_names(picks, before)
    files = staged.groupBy("crawl").agg(F.count_if(~F.col("existing")).alias("new_files"))
    pages = reached.groupBy("crawl").agg(F.count(F.lit(1)).alias("pages"), F.bool_or("truncated").alias("truncated"))
    results = crawls.join(pages, "crawl", "left").join(files, "crawl", "left").select(
        "year", "pages", "new_files", "truncated", F.when(F.col("pages").isNull(), "nothing found").alias("error")
    )
    return links.harvest_summary(results)


@query
def harvest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per year of the crawls, the files newly staged, and the crawls that failed or stopped."""
    return _harvest(spark, sf_dir, None)


@query
def harvest_summary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per year of a crawl that follows everything, and the files newly staged."""
    return _harvest(spark, sf_dir, None)


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions registered for SQL, used from SQL."""
    sql.register_functions(spark)
    views.candidates(spark, sf_dir).createOrReplaceTempView("gradecut_results")
    return spark.sql("""
        SELECT county, chance_band(normal_cdf((exam_average_h(romana_h, matematica_h, materna_h) - 550) / 100D)) AS band,
               count(*) AS n
        FROM gradecut_results GROUP BY 1, 2""")


@query
def descend(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reached = _crawled(spark, sf_dir)
    return reached.select("crawl", "url", "depth")


@query
def descend_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of every crawl in breadth-first order, and whether it had more."""
    _, _, reached = _crawled(spark, sf_dir, CAPPED)
    return reached.select("crawl", "url", "depth", "truncated")


@query
def page_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls, _, reached = _crawled(spark, sf_dir)
    records = links.page_record(reached, crawls, F.lit(GENERATED_AT), per_part=RECORD_PART)
    folder = shared_path(spark, "records")
    sinks.upsert_records(records, folder)
    stored = spark.read.parquet(folder)
    return stored.select(
        F.col("year").cast("int").alias("year"),
        "county",
        "part",
        F.size("county_links").cast("bigint").alias("n_links"),
        F.size("pages").cast("bigint").alias("n_pages"),
        F.md5(F.array_join("pages", "\n")).alias("digest"),
    )


@query
def stage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names for every page, the secure ones being staged already."""
    pages = _sized_pages(spark, sf_dir)
    staged = pages.filter(F.col("url").startswith("https")).select(
        "url", F.concat(urls.staged_name(F.col("county"), F.col("year"), F.col("url")), F.lit(".html")).alias("file")
    )
    return links.stage(pages, 0, staged, everything=True).select("url", "file", "existing")


@query
def scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on record for one county, read back through the manifest."""
    crawls, _, reached = _crawled(spark, sf_dir)
    records = cut_lineage(links.page_record(reached, crawls, F.lit(GENERATED_AT)))
    store = views.page_store(spark, sf_dir)
    file = F.concat(urls.cache_key(F.col("url")), F.lit(".html"))
    manifest = store.select("url", file.alias("file"))
    bodies = store.select(file.alias("file"), "html")
    found = page_sources.stored_pages(manifest, bodies, records, 2024, "c1")
    return found.select("url", "file", F.octet_length("html").cast("bigint").alias("bytes"))


# --- streams --------------------------------------------------------------------------


@query
def stream_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "lineitem").schema
    lines = streams.read_arriving(spark, f"{sf_dir}/lineitem*.parquet", schema)
    counts = streams.running_verification(views.candidates(spark, sf_dir, lines))
    folder = shared_path(spark, "verify")
    streams.run_counts(counts, f"{folder}/out", f"{folder}/state")
    return streams.read_counts(spark, f"{folder}/out")


@query
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "pages").schema
    pages = streams.read_arriving(spark, f"{sf_dir}/pages*.parquet", schema)
    # The pages carry no time; they count as fetched one a second, from the second after the epoch
    # (a stream takes the epoch itself for late).
    bare = pages.select(
        urls.canonical_url(F.col("url"), keep_fragment=False).alias("url"), F.timestamp_seconds(F.col("page_id") + 1).alias("fetched_at")
    )
    folder = shared_path(spark, "pages")
    first = streams.first_seen_pages(bare, fetched_at="fetched_at", horizon="30 days")
    streams.run_available(first.select("canonical_url"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")
