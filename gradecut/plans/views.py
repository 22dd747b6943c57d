"""Offers, candidates, students and a page store, derived from star-schema tables.

Every view reads whole tables, names the columns it needs and leaves join strategies to
the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.functions.marks import exam_average_h
from gradecut.operators.columns import OfferCols
from gradecut.session import cut_lineage

VIEW_COLS = OfferCols(
    identity=("school", "course_label"),
    key=("school", "spec_id"),
    occupied="occupied",
    name="school",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row. One that arrives in fewer splits than there
    are cores is dealt out once; a table of many splits is left as it is."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def price_mark_h(price: Column) -> Column:
    """A mark in hundredths spread over the whole scale by the cents of a price."""
    return F.round(price * 100).cast("bigint") % 901 + 100


def _lines_by_region(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None
) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem") if lines is None else lines
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("county"))
    # Orders meet their places before the lines, so the largest table moves at most once.
    placed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "county", F.col("n_name").alias("school"))
    )
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


PLACED = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_quantity",
    "o_custkey", "o_orderdate", "county", "school",
)


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the place of their order, joined once and written to the shared folder.

    For queries that derive several of the views below from them.
    """
    return cut_lineage(_lines_by_region(spark, sf_dir).select(*PLACED))


def _course_columns(brand: Column, size: Column) -> tuple[Column, Column]:
    spec = F.concat(brand, F.lit("/"), F.when(size > 25, "L").otherwise("S"))
    label = F.when(brand.isin("Brand#11", "Brand#12"), "Shared").otherwise(spec)
    return spec, label


def offers(
    spark: SparkSession, sf_dir: str, seats: int = 5, min_occupied: int = 2, placed: DataFrame | None = None
) -> DataFrame:
    """Course offers per year: county=region, school=nation, course=brand and size class.

    ``placed`` takes the result of ``placed_lines`` instead of joining anew, here and below.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    spec, label = _course_columns(F.col("p_brand"), F.col("p_size"))
    lines = _lines_by_region(spark, sf_dir) if placed is None else placed
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    grouped = rows.groupBy(
        F.year("o_orderdate").alias("year"),
        "county",
        "school",
        spec.alias("spec_id"),
        label.alias("course_label"),
        F.col("p_brand").startswith("Brand#5").alias("vocational"),
    ).agg(
        F.count(F.lit(1)).alias("occupied"),
        F.sum(price_mark_h(F.col("l_extendedprice"))).alias("sum_h"),
    )
    mark = F.when(
        F.col("occupied") >= min_occupied, F.call_function("div", F.col("sum_h"), F.col("occupied"))
    )
    return grouped.select(
        "year",
        "county",
        "school",
        "spec_id",
        "course_label",
        F.lit(seats).alias("seats"),
        "occupied",
        "vocational",
        mark.alias("last_media_h"),
    )


def candidates(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, placed: DataFrame | None = None
) -> DataFrame:
    """Exam results: two common papers, a third for some, and the school record.

    ``lines`` may be a stream of line items instead of the stored table.
    """
    romana = F.when(F.col("l_discount") <= 0.095, price_mark_h(F.col("l_extendedprice")))
    materna = F.when(F.col("l_returnflag") == "N", (F.col("l_orderkey") * 13) % 901 + 100)
    matematica = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 901 + 100
    base = _lines_by_region(spark, sf_dir, lines) if placed is None else placed
    rows = base.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"),
        F.col("o_custkey").alias("school_id"),
        "county",
        "school",
        "l_partkey",
        F.col("l_linenumber").alias("line"),
        romana.alias("romana_h"),
        materna.alias("materna_h"),
        matematica.alias("matematica_h"),
        (F.col("l_quantity").cast("bigint") * 10 + 500).alias("school_media_h"),
    )
    average = exam_average_h(F.col("romana_h"), F.col("matematica_h"), F.col("materna_h"))
    slip = F.when(F.col("l_partkey") % 997 == 0, 1).otherwise(0)
    return rows.withColumn("media_h", average + slip)


def students(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """Pupils in grades 5 to 8 with yearly marks so far and, in grade 8, a mock exam."""
    base = candidates(spark, sf_dir, placed=placed).withColumn("current_grade", (F.col("line") % 4 + 5).cast("int"))
    yearly = F.transform(
        F.sequence(F.lit(5), F.col("current_grade")),
        lambda grade: F.struct(
            grade.alias("grade"),
            (
                F.greatest(
                    F.lit(100), F.least(F.lit(1000), F.col("school_media_h") + (grade - 6) * 7)
                )
                / 100.0
            ).alias("media"),
        ),
    )
    eighth = F.col("current_grade") == 8
    return base.select(
        "candidate_id",
        "school_id",
        "county",
        "school",
        "l_partkey",
        "current_grade",
        yearly.alias("school_record"),
        F.col("materna_h").isNotNull().alias("takes_mother_tongue"),
        F.when(eighth & (F.col("l_partkey") % 3 != 0), F.col("romana_h") / 100.0).alias("mock_romana"),
        F.when(eighth & (F.col("l_partkey") % 5 != 0), F.col("matematica_h") / 100.0).alias(
            "mock_matematica"
        ),
        (F.col("media_h") / 100.0).alias("media"),
    )


def with_course(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the course a row's part stands for, as ``spec_id``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    spec, _ = _course_columns(F.col("p_brand"), F.col("p_size"))
    return df.join(
        part.select("p_partkey", spec.alias("spec_id")), F.col("l_partkey") == F.col("p_partkey")
    ).drop("p_partkey")


SITE = "https://site.example.com/"
CRAWLS = 5


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages filed under a small site: five counties, each page linking to two
    further ones, reached through a root page and a year page."""
    pages = spread_table(spark, sf_dir, "pages")
    county, place = F.col("page_id") % CRAWLS, F.call_function("div", F.col("page_id"), F.lit(CRAWLS))
    anchor = lambda n: F.format_string('<a href="%d.html#top">next <b>%d</b></a>', n, n)
    body = F.concat(
        F.col("html"), anchor(place * 2 + 1), anchor(place * 2 + 2), F.lit('<a href="../">up</a>')
    )
    filed = pages.select(
        F.format_string(SITE + "2024/c%d/%d.html", county, place).alias("url"),
        F.lit(2024).alias("year"),
        F.format_string("c%d", county).alias("county"),
        body.alias("html"),
    )
    # At most five anchors, whatever the number of pages.
    counties = pages.select(county.alias("_c")).distinct()
    link = F.format_string('<a href="c%d/0.html">County %d</a>', F.col("_c"), F.col("_c"))
    year_page = counties.agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("html")).select(
        F.lit(SITE + "2024/").alias("url"), F.lit(2024).alias("year"), F.lit("").alias("county"), "html"
    )
    root = counties.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(SITE).alias("url"),
        F.lit(2024).alias("year"),
        F.lit("").alias("county"),
        F.format_string('<a href="/2024/">Archive of %d</a><a href="/2023/">Older</a>', F.col("_n")).alias("html"),
    )
    return filed.unionByName(year_page).unionByName(root)


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per county of ``page_store``."""
    pages = table(spark, sf_dir, "pages")
    number = (F.col("page_id") % CRAWLS).alias("crawl")
    return pages.select(number).distinct().select(
        "crawl",
        F.lit(SITE).alias("seed"),
        F.lit(2024).alias("year"),
        F.format_string("c%d", F.col("crawl")).alias("county"),
    )
