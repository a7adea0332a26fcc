"""Index runs: manifests, relocation, outputs by file, run summaries, annotations by pattern and parent, payload metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import platforms as P


def platform_of(files: DataFrame, folder: str, name: str, platforms: tuple[str, ...]) -> DataFrame:
    """(folder, platform): a folder's platform by its manifest's name, else by the name of its records; null if neither is there."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(platforms))):
        rank = F.when(F.col(name) == f"{p}-manifest.json", i).when(F.col(name).isin(f"{p}-posts.jsonl", f"{p}-videos.jsonl"), i + len(platforms)).otherwise(rank)
    best = files.groupBy(folder).agg(F.min(rank).alias("_r"))
    return best.select(folder, F.get(F.array(*[F.lit(p) for p in platforms]), F.col("_r") % len(platforms)).alias("platform"))


def capture_time(first_event: Column, written: Column, updated: Column, now: Column) -> Column:
    return F.coalesce(first_event, written, updated, now)


def relocated(docs: DataFrame, root: Column, name: str = "source_file") -> DataFrame:
    """docs with source_file_path under a new root, where they have a file."""
    return docs.withColumn("source_file_path", F.when(F.coalesce(F.col(name), F.lit("")) != "", P.source_path(root, F.col(name))))


def run_manifest(docs: DataFrame, kind: str, located: Column, invalid: Column) -> DataFrame:
    """One row: documents, by_type, located, unlocated, invalid; counted by type first."""
    by = docs.groupBy(F.col(kind).alias("t")).agg(F.count("*").alias("n"), F.count_if(located).alias("l"), F.count_if(invalid).alias("i"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(total("n").alias("documents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type"), total("l").alias("located"), (total("n") - total("l")).alias("unlocated"), total("i").alias("invalid"))


def collection_run(jobs: DataFrame) -> DataFrame:
    """One row for a run over jobs (job, warcs, failed, documents): jobs without files are skipped, one failure fails the run and stops nothing."""
    status = F.when(F.col("warcs") == 0, "skipped").when(F.col("failed"), "failed").otherwise("done")
    j = jobs.withColumn("status", status).withColumn("documents", F.when(F.col("status") == "done", F.col("documents")).otherwise(0))
    n = lambda k: F.count_if(F.col("status") == k).alias(k)
    return j.agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("done").alias("status"), n("done"), n("skipped"), n("failed"), F.sum("documents").cast("long").alias("documents"))


def run_summary(status: Column, alive: Column, written: Column, now: Column, detail: Column, idle: int = 60, most: int = 600) -> Column:
    """struct(status, error, detail): a run that is still marked as running without a process has failed; of a long detail the end."""
    died = (status == "running") & ~alive & (now - written > idle)
    return F.struct(F.when(died, "failed").otherwise(status).alias("status"), F.when(died, "stopped without finishing").alias("error"), F.nullif(F.right(detail, F.lit(most)), F.lit("")).alias("detail"))


def timing_tree(times: DataFrame, most: int = 20) -> DataFrame:
    """(parent, id, total, n, place): time and count of each id under its parent, the longest first, at most so many for a parent."""
    by = times.groupBy("parent", "id").agg(F.sum("nanos").alias("total"), F.count("*").alias("n"))
    return by.withColumn("place", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("total"), "id"))).where(F.col("place") <= most)


def annotated_by_pattern(docs: DataFrame, name: str, rules: list[tuple[str, str]]) -> DataFrame:
    """docs with subjects: those of rules (pattern, subject) whose pattern the name has; rules come from a configuration, so they are one expression."""
    hits = F.array_compact(F.array(*[F.when(F.col(name).rlike(p), F.lit(s)) for p, s in rules]))
    return docs.withColumn("subjects", F.array_distinct(hits))


def in_date_range(at: Column, start: Column, end: Column) -> Column:
    """Strictly after start and strictly before end; a missing end is open."""
    return F.coalesce(at > start, F.lit(True)) & F.coalesce(at < end, F.lit(True))


def taxonomy_paths(terms: DataFrame, depth: int, materialise) -> DataFrame:
    """(id, path): names of terms (id, parent, name) from the top down, as a/b/c; one join for each level, until no term moves up."""
    top = terms.where("parent IS NULL").select("id", F.col("name").alias("path"))
    done = level = materialise(top)
    for _ in range(depth):
        level = materialise(terms.join(level.select(F.col("id").alias("parent"), F.col("path").alias("_up")), "parent").select("id", F.concat("_up", F.lit("/"), "name").alias("path")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done


def metric(found: DataFrame, key: str, name: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, value): the first whole number among fields, or of a count, in a payload's objects whose path has the name. found: nodes with at, their order."""
    value = F.coalesce(*[F.get_json_object("node", f"$.{f}").try_cast("long") for f in (*fields, "count", "total_count")])
    hits = found.where(F.contains(F.lower("path"), F.lit(name))).withColumn("value", value).where("value IS NOT NULL")
    return hits.groupBy(key).agg(F.min_by("value", "at").alias("value"))


def media_urls(found: DataFrame, key: str, fields: tuple[str, ...], markers: tuple[str, ...], most: int = 50) -> DataFrame:
    """(key, urls): distinct addresses of media in a payload's objects, in order, up to most."""
    items = F.array(*[F.struct(F.get_json_object("node", f"$.{f}").alias("url"), F.lower(F.concat("path", F.lit("." + f))).alias("path"), F.lit(i).alias("i")) for i, f in enumerate(fields)])
    rows = found.select(key, "at", F.explode(items).alias("m")).select(key, "at", "m.*")
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("path", F.lit(m))
    rows = rows.where(F.startswith("url", F.lit("http")) & marked).repartition(key)  # dealt by key once, for both steps
    firsts = rows.groupBy(key, "url").agg(F.min(F.struct("at", "i")).alias("o"))
    return firsts.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o", "url"))), 1, most), lambda x: x["url"]).alias("urls"))


def nearest_ancestor(found: DataFrame, key: str, child: Column) -> DataFrame:
    """(key, path, parent): for objects of a payload that are children, the id of the closest object above them that has one.

    found: nodes with ids. The walk takes the id along on its way down, so that no
    object has to be joined with those above it.
    """
    return found.where(child).select(key, "path", F.col("above").alias("parent"))


def page_infos(found: DataFrame, key: str) -> DataFrame:
    """(key, path, has_next, cursor, on_page): what a payload's lists of comments say about further pages."""
    get = lambda p: F.get_json_object("node", p)
    rows = found.where((F.element_at(F.split("path", r"\."), -1) == "comments") & get("$.page_info").isNotNull() & get("$.edges").isNotNull())
    return rows.select(key, "path", F.coalesce(get("$.page_info.has_next_page").try_cast("boolean"), F.lit(False)).alias("has_next"), F.nullif(get("$.page_info.end_cursor"), F.lit("")).alias("cursor"), F.size(F.from_json(get("$.edges"), "array<string>")).alias("on_page"))


def link_chunks(links: DataFrame, key: str, order: str, cost: str, head: int, budget: int) -> DataFrame:
    """links with chunk: greedy packing in order, each chunk's costs and head within the budget; a link that alone is larger has its own chunk.

    Greedy packing is sequential within a key (the links of one page). The fold
    over a page's costs keeps the places only where chunks begin; chunks are then
    cut out of the list.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begin"))

    def add(acc: Column, x: Column) -> Column:
        new = (acc["at"] == 0) | (acc["used"] + x["cost"] > budget - head)
        return F.struct(F.when(new, x["cost"]).otherwise(acc["used"] + x["cost"]).alias("used"), (acc["at"] + 1).alias("at"), F.when(new, F.concat(acc["begin"], F.array(acc["at"] + 1))).otherwise(acc["begin"]).alias("begin"))

    lists = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("cost")))).alias("l"))
    cut = lists.select(key, "l", F.aggregate("l", start, add)["begin"].alias("b"))
    pairs = F.arrays_zip("b", F.concat(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), F.array(F.size("l") + 1)).alias("e"))
    chunks = cut.select(key, "l", F.posexplode(pairs).alias("chunk", "z"))
    return chunks.select(key, F.explode(F.slice("l", F.col("z.b"), F.col("z.e") - F.col("z.b"))).alias("x"), "chunk").select(key, F.col("x.o").alias(order), "chunk")


def selection_report(log: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(pages, links): the last record of each page; links that were skipped and weren't fetched as pages after all. log: (kind, url, decision, order, ...)."""
    last = lambda df: df.groupBy("url").agg(F.max_by(F.struct(*[c for c in log.columns if c != "url"]), order).alias("r")).select("url", "r.*")
    pages = last(log.where("kind = 'page'"))
    links = last(log.where("kind = 'link' AND decision = 'skip'"))
    return pages, links.join(pages.select("url"), "url", "left_anti")


def video_files(files: DataFrame) -> DataFrame:
    """(video, file): the first media file of each video, by the order of the list. files: (video, file, role, at)."""
    usable = files.where((F.col("role") == "video") & F.startswith("file", F.lit("media/")) & F.lower("file").rlike(r"\.(mp4|webm|m4a|mp3|opus)$"))
    return usable.groupBy("video").agg(F.min_by("file", "at").alias("file"))


def without_viewer_posts(found: DataFrame, viewer: Column, kind: str = "kind") -> DataFrame:
    """Records without the posts of a photo viewer's responses, which only point at an album's neighbours; photos count in viewers only, comments everywhere."""
    return found.where(~(viewer & (F.col(kind) == "post")) & (viewer | (F.col(kind) != "photo")))


def simulated_pages(seeds: DataFrame, most: int = 12) -> DataFrame:
    """(url, seed, body): made-up pages of each seed (url, max_pages), each with a body of its own; for fixtures of any size."""
    n = F.least(F.col("max_pages"), F.lit(most)).cast("int")
    pages = seeds.where(n > 0).select(F.col("url").alias("seed"), F.explode(F.sequence(F.lit(1), n)).alias("n"))
    return pages.select(F.concat("seed", F.lit("#page"), F.col("n").cast("string")).alias("url"), "seed", F.concat(F.lit("<html><body>page "), F.col("n").cast("string"), F.lit(" of "), "seed", F.lit("</body></html>")).alias("body"))
