"""Breadth-first crawl order over a page table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.operators.documents import is_html, page_links, url_prefix
from scorelake.session import materialize, new_table_path


def _site(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def lay_out(links: DataFrame) -> str:
    """Write url and links of a table into a bucketed table of the session, by url, and return its name.

    There are as many buckets as shuffle partitions, so what is joined to it on url is shuffled and the table isn't. Its files lie
    in the shared folder; dropping the table leaves them there.
    """
    spark = links.sparkSession
    name = f"links_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = links.select("url", "links").repartition(buckets, "url")  # a file a bucket
    ordered.write.bucketBy(buckets, "url").sortBy("url").option("path", new_table_path(spark, "links")).saveAsTable(name)
    return name


def probe(found: DataFrame, reached: DataFrame, table: DataFrame) -> DataFrame:
    """Candidates (seed, prefix, url, _rank; any number a url) that are not among ``reached`` (seed, url) and have a page, with its links.

    One shuffle by url brings candidates and visited pages together and to the table, which stays where it is.
    """
    visited = reached.select("seed", F.lit(None).cast("string").alias("prefix"), "url", F.lit(-1).cast("long").alias("_rank"))
    by_url = found.unionByName(visited).repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url")
    ranked = by_url.groupBy("seed", "url").agg(F.max("prefix").alias("prefix"), F.min("_rank").alias("_rank"))
    return ranked.filter(F.col("_rank") >= 0).join(table, "url")


def crawl(pages: DataFrame, seeds: DataFrame, max_pages: int = 20) -> DataFrame:
    """Pages each seed reaches, in crawl order: ``seed``, ``url``, ``level`` and ``position``.

    Only links below the seed's directory are followed, a url is visited once, links to pages the table lacks lead
    nowhere and do not count, and a crawl ends at ``max_pages``. All seeds advance together, one level per round; a
    level that adds nothing ends the loop.

    The page table is read once: pages below the directory of some seed are kept with their links, one row per url, in a table that
    is bucketed by url. A round shuffles its candidates, at most ``max_pages`` pages' links a seed, and the visited pages to that
    layout, and nothing of the table. The rank filter limits the candidates of a seed on each task ahead of the shuffle by seed. Each level is
    checkpointed in the shared folder, once and by itself; the result is the union of the levels.
    """
    spark = pages.sparkSession
    starts = seeds.select(F.col("url").alias("seed")).distinct().withColumn("prefix", url_prefix(F.col("seed")))
    areas = starts.select(_site(F.col("seed")).alias("site"), "prefix").distinct()
    located = pages.withColumn("site", _site(F.col("url")))
    # The slash lets in a seed without a path, which its own directory would not contain.
    inside = F.startswith(F.concat(located["url"], F.lit("/")), areas["prefix"])
    near = located.join(areas, (located["site"] == areas["site"]) & inside, "left_semi")
    links = F.when(is_html(F.col("html")), page_links(F.col("html"), F.col("url")))
    known = near.select("url", F.coalesce(links, F.array().cast("array<string>")).alias("links")).groupBy("url").agg(F.min("links").alias("links"))
    name = lay_out(known)
    try:
        table = spark.table(name)
        begun = starts.join(table, starts["seed"] == table["url"])
        level = materialize(begun.select("seed", "prefix", "url", F.lit(0).alias("level"), F.lit(0).alias("position"), "links"))
        reached = level
        for depth in range(1, max_pages):
            found = (
                level.select("seed", "prefix", F.col("position").alias("_from"), F.posexplode("links").alias("_ord", "url"))
                .filter(F.startswith("url", F.col("prefix")))
                .select("seed", "prefix", "url", (F.col("_from").cast("long") * F.lit(2**32) + F.col("_ord")).alias("_rank"))
            )
            used = reached.groupBy("seed").agg(F.count("*").cast("int").alias("_used"))
            place = F.row_number().over(W.partitionBy("seed").orderBy("_rank"))
            ranked = probe(found, reached, table).withColumn("_n", place).filter(F.col("_n") <= max_pages)
            level = (
                ranked.join(used, "seed")
                .withColumn("position", F.col("_used") + F.col("_n") - 1)
                .filter(F.col("position") < max_pages)
                .select("seed", "prefix", "url", F.lit(depth).alias("level"), "position", "links")
            )
            level = materialize(level)
            if level.isEmpty():
                break
            reached = reached.unionByName(level)
    finally:
        spark.sql(f"drop table if exists {name}")
    return reached.drop("links", "prefix")
