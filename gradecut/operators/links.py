"""Links of stored pages: extraction, discovery, descent below a directory, page records."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.functions import urls
from gradecut.functions.marks import ANY_SPACE
from gradecut.operators.ranking import pick_representative, rank_within
from gradecut.session import cut_lineage, shared_path

# A start tag runs to the first ``>`` outside quotes; a value is quoted or has no space.
_INSIDE = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_TAG = rf"<a(?=\s){_INSIDE}>"
_ANCHOR = rf"(?is){_TAG}.*?</a\s*>"
# Other attributes, whole, up to the one that is named href.
_OTHERS = rf"""(?:[\s/]++|(?!href\s*=)[^\s=/"'>]++(?:\s*=\s*{_VALUE})?)*+"""
_HREF = rf"""(?is)^<a(?=\s){_OTHERS}href\s*=\s*({_VALUE})"""
_CONTENT = rf"(?is)^{_TAG}(.*)</a\s*>$"
_NO_PAGE = r"(?i)^(?:#|(?:javascript|mailto|tel):)"


def extract_links(
    pages: DataFrame, url: str = "url", html: str = "html", keep: Sequence[str] = ()
) -> DataFrame:
    """Same-site links of every page: source, target without fragment, text and place.

    Each target counts once per page, with the text and place of its first anchor. All of
    it happens inside the page's own row, so nothing is shuffled.
    """
    anchors = F.filter(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0)), lambda a: a.rlike(_HREF))
    source = F.col(url)

    def link(anchor: Column, position: Column) -> Column:
        value = F.regexp_extract(anchor, _HREF, 1)
        href = F.nullif(F.regexp_replace(value, """^["']|["']$""", ""), F.lit(""))
        # What names no page never reaches the resolver.
        wanted = F.when(~href.rlike(_NO_PAGE), href)
        content = F.regexp_extract(anchor, _CONTENT, 1)
        text = F.regexp_replace(F.regexp_replace(content, "<[^>]*>", " "), "(?i)&nbsp;", " ")
        return F.struct(
            urls.resolve_url(wanted, source, keep_fragment=False).alias("url"),
            position.alias("position"),
            F.trim(F.regexp_replace(text, ANY_SPACE + "+", " ")).alias("text"),
        )

    same = lambda u: urls.same_site(urls.host_of(u), urls.host_of(source))
    found = F.filter(
        F.transform(anchors, link), lambda x: x["url"].isNotNull() & same(x["url"])
    )
    # Sorted by target and place, the first of each run of equal targets is the one to keep.
    pages = pages.withColumn("_found", F.array_sort(found))
    first = F.filter(
        "_found", lambda x, i: (i == 0) | (F.get("_found", i - 1)["url"] != x["url"])
    )
    # The outer form keeps the optimizer from evaluating the array a second time as a filter.
    return (
        pages.select(*keep, source.alias("source"), F.explode_outer(first).alias("_l"))
        .select(*keep, "source", "_l.url", "_l.text", "_l.position")
        .filter(F.col("url").isNotNull())
    )


def dedupe_pages(pages: DataFrame, url: str = "url", order: str = "fetched_at") -> DataFrame:
    """One page per canonical address, the one that was fetched first.

    Rows that say the same about ``order``, or have no such column, are told apart by their
    remaining columns, so the choice is the same in every run.
    """
    addressed = pages.withColumn("canonical_url", urls.canonical_url(F.col(url)))
    first = [F.col(order)] if order in pages.columns else []
    row = F.struct(*first, *[F.col(c).alias(f"_{i}") for i, c in enumerate(pages.columns)])
    kept = addressed.groupBy("canonical_url").agg(F.min(row).alias("_row"))
    return kept.select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(pages.columns)], "canonical_url")


def discover(links: DataFrame, crawls: DataFrame, names: bool = True) -> DataFrame:
    """Two hops from each crawl's seed: links of its year, then links of its county.

    ``crawls`` has crawl, seed, year and county. The year of the second hop is known from
    the first, so only the county is tested there. One row per crawl and county link.
    """
    out = links.select(F.col("source").alias("_source"), F.col("url").alias("_url"), "text", "position")
    year_links = (
        crawls.join(out, F.col("seed") == F.col("_source"))
        .filter(urls.looks_like_year(F.col("_url"), F.col("text"), F.col("year")))
        .select("crawl", "year", "county", F.col("_url").alias("year_url"), F.col("position").alias("year_position"))
    )
    county_links = year_links.join(out, F.col("year_url") == F.col("_source")).filter(
        urls.looks_like_county(F.col("_url"), F.col("text"), F.col("county"), names)
    )
    # A county page linked from several year pages keeps its first place.
    return county_links.groupBy("crawl", "year", "county", F.col("_url").alias("url")).agg(
        F.min_by("year_url", F.struct("year_position", "position")).alias("year_url"),
        F.min(F.struct("year_position", "position")).alias("_first"),
    ).select(
        "crawl", "year", "county", "url", "year_url",
        F.col("_first.year_position").alias("year_position"),
        F.col("_first.position").alias("position"),
    )


def discovery_failures(links: DataFrame, crawls: DataFrame, found: DataFrame) -> DataFrame:
    """Crawls that led nowhere, with all links of their seed page for the report.

    A seed's links are listed once, from the one page that has them, and then handed to every
    crawl that failed on it.
    """
    lost = crawls.join(found.select("crawl").distinct(), "crawl", "left_anti")
    seen = (
        links.join(lost.select(F.col("seed").alias("source")).distinct(), "source", "left_semi")
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("position", "url", "text"))).alias("links_seen"))
    )
    none = F.array().cast(seen.schema["links_seen"].dataType)
    return lost.join(seen, F.col("seed") == F.col("source"), "left").select(
        "crawl", "year", "county", F.coalesce("links_seen", none).alias("links_seen")
    )


def assert_discovered(failures: DataFrame) -> None:
    """Fail when a crawl led nowhere; the error names all such crawls by year and county."""
    lost = failures.select("year", "county").distinct().orderBy("year", "county").collect()
    if lost:
        raise ValueError("nothing discovered for " + ", ".join(f"{r['year']}/{r['county']}" for r in lost))


def descend(
    links: DataFrame,
    starts: DataFrame,
    max_pages: int | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Breadth-first from each crawl's start pages along links that stay in the directory
    of the page they were found on, or below it.

    ``starts`` has crawl, url and ``place`` (order of the start pages). Each level is one
    join of the frontier with the links and one anti-join with what was reached, written
    out before the next level so that the plan stays short and survives lost executors.
    It goes on until a level brings nothing new. ``max_pages`` caps each crawl in
    breadth-first order; ``None`` follows everything. Returns crawl, url, depth, place (the
    places of the links that led there, which order a depth) and ``truncated``: whether the
    cap left pages of that crawl out.
    """
    below = links.filter(urls.under_directory(F.col("url"), F.col("source")))
    if pages is not None:
        below = below.join(pages.select("url").distinct(), "url", "left_semi")
    below = cut_lineage(
        below.select(F.col("source").alias("_source"), F.col("url").alias("_url"), F.col("position").alias("_at"))
    )
    spark = links.sparkSession
    folder, cut = shared_path(spark, "reached"), shared_path(spark, "cut")
    schema = starts.select("crawl", "url", F.array(F.lit(0)).alias("place")).schema

    def keep(level: DataFrame, depth: int) -> DataFrame:
        """Add a level to the folder of what was reached, and read it back."""
        level.select("crawl", "url", "place").write.parquet(f"{folder}/depth={depth}")
        return spark.read.schema(schema).parquet(f"{folder}/depth={depth}")

    first = starts.groupBy("crawl", "url").agg(F.array(F.min("place").cast("int")).alias("place"))
    frontier = keep(first if max_pages is None else _capped(first, first.limit(0), max_pages, cut), 0)
    for depth in count(1):
        reached = spark.read.parquet(folder)
        candidates = frontier.join(below, F.col("url") == F.col("_source")).select(
            "crawl", F.col("_url").alias("url"), F.concat("place", F.array(F.col("_at").cast("int"))).alias("place")
        )
        fresh = candidates.groupBy("crawl", "url").agg(F.min("place").alias("place"))
        fresh = fresh.join(reached.select("crawl", "url"), ["crawl", "url"], "left_anti")
        frontier = keep(fresh if max_pages is None else _capped(fresh, reached, max_pages, cut), depth)
        if frontier.isEmpty():
            break
    found = spark.read.parquet(folder).select("crawl", "url", F.col("depth").cast("int").alias("depth"), "place")
    if max_pages is None:
        return found.withColumn("truncated", F.lit(False))
    lost = spark.read.schema(starts.select("crawl").schema).parquet(cut).distinct().withColumn("_cut", F.lit(True))
    return found.join(lost, "crawl", "left").withColumn("truncated", F.col("_cut").isNotNull()).drop("_cut")


def _capped(fresh: DataFrame, reached: DataFrame, max_pages: int, cut: str) -> DataFrame:
    """The pages of a level for which their crawl has room; crawls without it are noted in ``cut``."""
    in_order = Window.partitionBy("crawl").orderBy("place", "url")
    room = reached.groupBy("crawl").agg(F.count(F.lit(1)).alias("_used"))
    numbered = cut_lineage(
        fresh.withColumn("_n", F.row_number().over(in_order)).join(room, "crawl", "left")
    )
    fits = F.col("_n") + F.coalesce("_used", F.lit(0)) <= max_pages
    numbered.filter(~fits).select("crawl").distinct().write.mode("append").parquet(cut)
    return numbered.filter(fits)


def page_record(
    reached: DataFrame, crawls: DataFrame, harvested_at: Column | None = None, per_part: int = 10_000
) -> DataFrame:
    """Per year and county: its county links and every page that belongs to it, in order.

    A record comes in parts, numbered from 0, of at most ``per_part`` pages each, so that no
    crawl has to fit into one row.
    """
    entry = F.struct("depth", "place", "url")
    joined = crawls.select("crawl", "year", F.upper("county").alias("county")).join(reached, "crawl")
    order = [F.col("depth"), F.col("place"), F.col("url")]
    numbered = rank_within(joined, ["year", "county"], order, rank="_n", size="_size")
    part = F.call_function("div", F.col("_n"), F.lit(per_part)).cast("int")
    records = numbered.groupBy("year", "county", part.alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("_all"),
    )
    start = F.filter("_all", lambda e: e["depth"] == 0)
    return records.select(
        "year",
        "county",
        "part",
        F.transform(start, lambda e: e["url"]).alias("county_links"),
        F.transform("_all", lambda e: e["url"]).alias("pages"),
        (F.current_timestamp() if harvested_at is None else harvested_at).alias("harvested_at"),
    )


def scope_pages(pages: DataFrame, records: DataFrame, year: int, county: str) -> DataFrame:
    """Stored pages of one year and county; all pages when nothing is recorded for it."""
    wanted = records.filter((F.col("year") == year) & (F.col("county") == county.upper()))
    if wanted.isEmpty():
        return pages
    listed = wanted.select(F.explode("pages").alias("url")).distinct()
    return pages.join(listed, "url", "left_semi")


def stage_names(
    picks: DataFrame, staged: DataFrame | None = None, order: Sequence[str] = ("pick_rank",)
) -> DataFrame:
    """File names for pages to stage, with ``existing`` set where one was staged before.

    ``picks`` has county, year and url; ``staged`` has url and file. The first page of a
    name keeps it plain unless a staged file has it already; later ones add a short hash, which
    is longer (16, then all 40 digits) where two new pages or a staged file would share the name.
    A page that occurs in several rows has one name.
    """
    if staged is None:
        known = picks.withColumn("_file", F.lit(None).cast("string"))
        taken = None
    else:
        before = staged.groupBy("url").agg(F.max("file").alias("_file"))
        known = picks.join(before, "url", "left")
        taken = staged.select(F.regexp_replace("file", r"\.html$", "").alias("_stem")).distinct()
    named = known.withColumn("_stem", urls.staged_name(F.col("county"), F.col("year"), F.col("url")))
    fresh = F.col("_file").isNull()
    first = named.filter(fresh).groupBy("_stem").agg(
        F.min(F.struct(*order, "url")).alias("_first")
    )
    named = named.join(first, "_stem", "left")
    plain = F.col("url") == F.col("_first.url")
    if taken is not None:
        named = named.join(taken.withColumn("_taken", F.lit(True)), "_stem", "left")
        plain = plain & F.col("_taken").isNull()
    named = named.withColumn("_plain", plain)

    def name(digits: int) -> Column:
        hashed = F.concat("_stem", F.lit("-"), urls.short_hash(F.col("url"), digits), F.lit(".html"))
        own = F.when(F.col("_plain"), F.concat("_stem", F.lit(".html"))).otherwise(hashed)
        return F.when(F.col("_file").isNull(), own).otherwise(F.col("_file"))

    named = named.withColumn("_name", name(6))
    for digits in (16, 40):
        new = named.filter(fresh).groupBy("_name").agg(F.min("url").alias("_low"), F.max("url").alias("_high"))
        clash = new.filter(F.col("_low") != F.col("_high")).select("_name")
        if staged is not None:
            clash = clash.union(new.select("_name").join(staged.select(F.col("file").alias("_name")), "_name", "left_semi"))
        clash = clash.distinct().withColumn("_clash", F.lit(True))
        longer = fresh & ~F.col("_plain") & F.col("_clash").isNotNull()
        named = named.join(clash, "_name", "left").withColumn("_name", F.when(longer, name(digits)).otherwise(F.col("_name")))
        named = named.drop("_clash")
    return named.select(*picks.columns, F.col("_name").alias("file"), (~fresh).alias("existing"))


def stage(
    pages: DataFrame, count: int, staged: DataFrame | None = None, everything: bool = False
) -> DataFrame:
    """Staging list per year and county: representative pages, or all of them, named."""
    if everything:
        order = F.struct((-F.col("bytes")).alias("b"), F.col("url"))
        return stage_names(pages.withColumn("pick_rank", order), staged).drop("pick_rank")
    picks = pick_representative(pages, ["year", "county"], count)
    return stage_names(picks, staged)


def harvest_summary(results: DataFrame) -> DataFrame:
    """Pages, newly staged files, failures and crawls cut at their page cap per year.

    ``results`` has a row per crawl: year, pages, new_files, error and, where there was a cap,
    truncated.
    """
    stopped = F.count_if("truncated") if "truncated" in results.columns else F.lit(0).cast("bigint")
    summary = results.groupBy("year").agg(
        stopped.alias("stopped"),
        F.sum(F.coalesce("pages", F.lit(0))).alias("pages"),
        F.sum(F.coalesce("new_files", F.lit(0))).alias("new_files"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count(F.lit(1)).alias("crawls"),
    )
    return summary


def assert_harvest(summary: DataFrame) -> None:
    """Fail when every crawl of every year failed."""
    row = summary.agg(F.sum("crawls").alias("n"), F.sum("failed").alias("failed")).first()
    if row is not None and row["n"] and row["n"] == row["failed"]:
        raise ValueError("every year failed: nothing was discovered")
