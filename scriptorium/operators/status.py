"""Sources, tasks and history: inventories, latest outcomes, totals and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a task that has ended.
TERMINAL = ("succeeded", "partial", "failed", "cancelled", "interrupted")
PREVIEW_CHARS = 16000


def display_type(raw: Column) -> Column:
    """How a document's stored type is shown."""
    return F.when(raw == "long_pdf", "indexed").when(raw.isin("indexed", "short", "raw"), raw).when(raw.isNull() | (raw == ""), "raw").otherwise("short")


def inventory(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, name, type, state)``: registered documents with their source's state, and sources on the way that are not registered.

    ``registry(source_id, name, type)``, ``sources(source_id, origin, state)``.
    A source that is complete but no longer registered was removed and is left out.
    """
    both = registry.withColumn("_in", F.lit(True)).join(sources, "source_id", "full_outer")
    listed = both.where(F.col("_in") | ~F.coalesce(F.col("state") == "complete", F.lit(False)))
    return listed.select("source_id", F.coalesce("name", "origin").alias("name"), F.when(F.col("_in"), display_type(F.col("type"))).otherwise("raw").alias("type"), F.coalesce("state", F.lit("complete")).alias("state"))


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each key, by one grouping."""
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("_r")).select(key, f"_r.{order}", *[f"_r.{c}" for c in columns])


def source_status(sources: DataFrame, outcomes: DataFrame, usage: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(source_id, state, runs, charged, unknown, open_jobs)``: each source with its newest outcome, its usage and its open jobs.

    ``outcomes(source_id, seq, state)``, ``usage(source_id, charged, unknown)``, ``jobs(source_id, state)``.
    """
    last = latest(outcomes, "source_id", "seq", "state").drop("seq")
    spent = usage.groupBy("source_id").agg(F.count("*").alias("runs"), F.round(F.sum("charged"), 4).alias("charged"), F.sum("unknown").alias("unknown"))
    open_ = jobs.where(~F.col("state").isin(*TERMINAL)).groupBy("source_id").agg(F.count("*").alias("open_jobs"))
    out = sources.select("source_id").distinct().join(last, "source_id", "left").join(spent, "source_id", "left").join(open_, "source_id", "left")
    return out.fillna({"runs": 0, "charged": 0.0, "unknown": 0, "open_jobs": 0})


def usage_rollup(runs: DataFrame, key: str, group: str) -> DataFrame:
    """``(key, group, requests, tokens, complete)``: sums by ``group`` and over all (null), complete if every run's accounting is."""
    return runs.rollup(key, group).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.bool_and("complete").alias("complete"), F.grouping_id().alias("_g")).where("_g < 3").select(key, F.when(F.col("_g") == 0, F.col(group).cast("string")).alias(group), "requests", "tokens", "complete")


def folder_counts(files: DataFrame, folder: str = "folder", changed: str = "changed") -> DataFrame:
    """``(folder, files, newest)`` of a listing, newest as an ISO time in UTC."""
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.date_format(F.max(changed), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("newest"))


def status_counts(results: DataFrame, key: str, status: str = "status") -> DataFrame:
    """``(key, total, succeeded, skipped, failed, unfinished)`` of unit results; unfinished is all that is none of the three."""
    n = lambda s: F.count_if(F.coalesce(F.col(status) == s, F.lit(False)))
    counted = results.groupBy(key).agg(F.count("*").alias("total"), n("succeeded").alias("succeeded"), n("skipped").alias("skipped"), n("failed").alias("failed"))
    return counted.withColumn("unfinished", F.col("total") - F.col("succeeded") - F.col("skipped") - F.col("failed"))


def reloaded_state(state: Column) -> Column:
    """A saved state that has not ended reads as interrupted."""
    return F.when(state.isin(*TERMINAL), state).otherwise("interrupted")


def active_task(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """``(source_id, task, state)``: for each source the newest open task with a unit of it still to do; running ones come first.

    ``tasks(task, seq, state, done)`` with the number of units done, ``units(task, ord, source_id)`` in order from 0.
    """
    open_ = tasks.where(~F.col("state").isin(*TERMINAL))
    left = units.join(open_, "task").where("ord >= done")
    rank = Window.partitionBy("source_id").orderBy(F.desc(F.col("state") == "running"), F.desc("seq"))
    return left.select("source_id", "task", "seq", "state").distinct().withColumn("_k", F.row_number().over(rank)).where("_k = 1").select("source_id", "task", "state")


def issues(gaps: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(source_id, block, start, end, reason)``: review rows ``gaps(source_id, block, reason)`` with the pending ranges of their block.

    ``coverage(source_id, block, start, end, status)``; a gap of a block without pending ranges stays, with nulls.
    """
    pending = coverage.where("status = 'pending'").select("source_id", "block", "start", "end")
    return gaps.select("source_id", "block", "reason").join(pending, ["source_id", "block"], "left").select("source_id", "block", "start", "end", "reason")


def review_gaps(quality: DataFrame, notice: str, suffix: str) -> DataFrame:
    """Quality rows ``(…, status, reason)`` that need a review, carry ``notice`` or end with ``suffix``."""
    return quality.where((F.col("status") == "needs_review") | F.contains("reason", F.lit(notice)) | F.endswith("reason", F.lit(suffix)))


def readable(blocks: DataFrame, transcribed: DataFrame, marks: str) -> DataFrame:
    """``(doc_id, readable)``: whether any block has text left without image references and ``marks``; an image only if one of its assets was transcribed.

    ``blocks(doc_id, ord, kind, text, assets)``, ``transcribed(doc_id, asset)``.
    """
    left = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"!\[[^\]]*\]\([^)]*\)", ""), marks, ""))
    images = blocks.where("kind = 'image'").select("doc_id", "ord", F.explode("assets").alias("asset")).join(transcribed.distinct(), ["doc_id", "asset"], "left_semi").select("doc_id", "ord", F.lit(True).alias("_t")).distinct()
    seen = blocks.join(images, ["doc_id", "ord"], "left")
    return seen.groupBy("doc_id").agg(F.bool_or((left != "") & ((F.col("kind") != "image") | F.coalesce("_t", F.lit(False)))).alias("readable"))


def complete_parses(quality: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(parse_id, complete)``: whether every quality row ``(parse_id, item, status)`` is verified or in ``confirmed(parse_id, item)``."""
    sure = confirmed.select("parse_id", "item", F.lit(True).alias("_c")).distinct()
    return quality.join(sure, ["parse_id", "item"], "left").groupBy("parse_id").agg(F.bool_and((F.col("status") == "verified") | F.coalesce("_c", F.lit(False))).alias("complete"))


def selection(registry: DataFrame, identifier: str | None, everything: bool = False) -> DataFrame:
    """One row ``(state, n, hashes)`` of choosing documents: invalid (both or neither way asked), empty, not_found, multiple or ready."""
    if (identifier is None) != everything:
        return registry.sparkSession.createDataFrame([("invalid", 0, [])], "state string, n long, hashes array<string>")
    if everything:
        found, none = registry, "empty"
    else:
        from scriptorium.operators.store import lookup

        found, none = lookup(registry, identifier), "not_found"
    n = F.count("*")
    state = F.when(n == 0, none).when((n > 1) & F.lit(not everything), "multiple").otherwise("ready")
    return found.agg(state.alias("state"), n.alias("n"), F.array_sort(F.collect_list("hash")).alias("hashes"))


def stored_artifacts(records: DataFrame, keys: dict[str, str], stage: str, offset: int, limit: int) -> DataFrame:
    """A page of the records of one stage and identity, in order of ``id``, with their total and a preview."""
    from scriptorium.operators.search import page

    wanted = records.where(F.col("stage") == stage)
    for k, v in keys.items():
        wanted = wanted.where(F.col(k) == v)
    shown = wanted.select("id", F.left("content", F.lit(PREVIEW_CHARS)).alias("preview"), (F.length("content") > PREVIEW_CHARS).alias("cut"))
    return page(shown, ["id"], offset, limit)


def record_stage(record: Column) -> Column:
    """The stage of a saved record in JSON, by the keys it has."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    has = lambda *ks: F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in ks]))) == len(ks)
    return F.when(has("facts"), "facts").when(has("groups") | has("topics"), "plan").when(has("title", "content"), "generation").when(has("verdict") | has("reviews"), "review").otherwise("other")


def cleanup(objects: DataFrame, previewed: DataFrame, seen: str) -> DataFrame:
    """``objects(id, …)`` without those of ``previewed(id)``; raises if the objects' digest is no longer ``seen``."""
    now = state_digest(objects)
    stale = F.raise_error(F.lit("objects changed since the preview"))
    guard = objects.agg(now.alias("_now")).select(F.when(F.col("_now") == seen, F.lit(True)).otherwise(stale.cast("boolean")).alias("_same"))
    return objects.join(F.broadcast(guard)).where("_same").drop("_same").join(previewed.select("id").distinct(), "id", "left_anti")


def state_digest(objects: DataFrame) -> Column:
    """An aggregate that any change of the ids changes: their number and two sums of hashes, which add up without a sort."""
    part = lambda seed: F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("/", F.count("*").cast("string"), part(1), part(2)), 256)


def next_iteration(saved: DataFrame, name: str) -> DataFrame:
    """``(name, next)``: the number after the greatest of ``saved(name, folder)`` with folders ``iteration-<n>``; 1 for none."""
    n = F.regexp_extract("folder", r"^iteration-(\d+)$", 1).try_cast("int")
    return saved.where(F.col("name") == name).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next")).select(F.lit(name).alias("name"), "next")


def iterations(saved: DataFrame) -> DataFrame:
    """``(name, n, folder)``: saved iterations by number; other folders are left out."""
    n = F.regexp_extract("folder", r"^iteration-(\d+)$", 1).try_cast("int")
    return saved.select("name", n.alias("n"), "folder").where("n is not null")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change, lines)`` of two file tables ``(path, text)``: added, removed or changed, and by how many lines the text grew."""
    lines = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.split(c, "\n")))
    both = before.select("path", F.col("text").alias("old")).join(after.select("path", F.col("text").alias("new")), "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select("path", change.alias("change"), (lines("new") - lines("old")).alias("lines"))


def skills(packages: DataFrame, limit: int = 1024) -> DataFrame:
    """``(name, description, path)`` of ``packages(root, folder, name, description, path)``: the first root's package of a name; ones without name or description are left out."""
    name = F.trim(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("folder")))
    text = F.trim(F.coalesce("description", F.lit("")))
    named = packages.select("root", "folder", name.alias("name"), F.left(text, F.lit(limit)).alias("description"), "path").where("name <> '' and description <> ''")
    first = named.groupBy("name").agg(F.min_by(F.struct("description", "path"), F.struct("root", "folder")).alias("_f"))
    return first.select("name", "_f.description", "_f.path")


def first_labels(rows: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """``(key, label)``: distinct keys numbered by first appearance. Sorted over ranges, so no task holds them all.

    ``order`` must be unique.
    """
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    from scriptorium.operators.sequences import numbered

    return numbered(first, "_first").select(key, F.concat(F.lit(prefix), F.col("place").cast("string")).alias("label"))


def scope_groups(evidence: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """``(…scope, label, occurrences)``: evidence grouped by its scope in order of first appearance, with the ordered places of each group."""
    grouped = evidence.groupBy(*scope).agg(F.min(order).alias("_first"), F.array_sort(F.collect_list(order)).alias("occurrences"))
    from scriptorium.operators.sequences import numbered

    return numbered(grouped, "_first").select(*scope, F.concat(F.lit("s"), F.col("place").cast("string")).alias("label"), "occurrences")


def encoded(rows: DataFrame, key: str, order: str, prefix: str = "r") -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``key`` replaced by a label in order of first use, and the table ``(key, label)`` that leads back."""
    names = first_labels(rows, key, order, prefix)
    return rows.join(names, key).drop(key).withColumnRenamed("label", key), names


def published_images(files: DataFrame, assets: DataFrame) -> DataFrame:
    """``(asset, path)``: images of ``files(path, content)`` whose name and content hash are one of ``assets(asset)``; the least path of each."""
    stem = F.regexp_extract("path", r"([^/]+)\.(?i:png|jpe?g|gif|webp|bmp|tiff?)$", 1)
    found = files.select("path", stem.alias("asset"), F.sha2("content", 256).alias("_h")).where("asset <> '' and asset = _h")
    return found.join(assets.select("asset").distinct(), "asset", "left_semi").groupBy("asset").agg(F.min("path").alias("path"))


def inspect_parse(blocks: DataFrame, quality: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the identities of blocks ``(ord, block_id, kind, chars)`` in order, with the reviews of each ``(block_id, reason)`` and the total."""
    from scriptorium.operators.search import page

    reviews = quality.groupBy("block_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    cut = page(blocks.select("ord", "block_id", "kind", "chars"), ["ord"], offset, limit)
    return cut.join(reviews, "block_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def cloud_jobs(jobs: DataFrame, versions: DataFrame, source_id: str) -> DataFrame:
    """Jobs ``(job, version_id, pages, done)`` of a source's versions; unknown counters are 0, negative ones or ones past the pages break the row."""
    own = versions.where(F.col("source_id") == source_id).select("version_id")
    counted = jobs.join(own, "version_id").withColumn("pages", F.coalesce("pages", F.lit(0))).withColumn("done", F.coalesce("done", F.lit(0)))
    return counted.withColumn("valid", (F.col("pages") >= 0) & F.col("done").between(0, F.col("pages")))


def receipt_verified(state: Column, expected: Column, got: Column, digest: Column, own: Column) -> Column:
    """Whether a finished job's receipt names all its pages and its own content."""
    return F.coalesce((state == "succeeded") & (expected == got) & (expected > 0) & (digest == own), F.lit(False))


def local_omissions(quality: DataFrame) -> DataFrame:
    """``(ord, reason)`` of the rows to review, in their order, repeats kept."""
    return quality.where("status = 'needs_review'").select("ord", "reason")


def measurement_faults(records: DataFrame) -> DataFrame:
    """``(run, id, fault)`` of measured records ``(run, kind, id, stage, status, started, elapsed, tokens)``: blank names, repeated ids of a kind, durations that are negative or not finite, unsettled spans, negative tokens."""
    repeated = F.count("*").over(Window.partitionBy("run", "kind", "id")) > 1
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))
    fault = (
        F.when(blank("id") | blank("stage"), "identity").when(F.col("_n"), "repeated").when(odd("started") | odd("elapsed"), "duration")
        .when((F.col("kind") == "span") & ~F.coalesce(F.col("status").isin("completed", "interrupted"), F.lit(False)), "unsettled")
        .when(F.col("tokens") < 0, "tokens")
    )
    return records.withColumn("_n", repeated).select("run", "id", fault.alias("fault")).where("fault is not null")


def folder_files(files: DataFrame, folder: str) -> DataFrame:
    """``(name)`` of the Markdown files that lie in a folder itself, by name."""
    own = F.regexp_extract("path", r"^(.*)/([^/]+\.md)$", 2)
    return files.where((F.regexp_extract("path", r"^(.*)/[^/]+$", 1) == folder) & (own != "")).select(own.alias("name")).distinct()


def navigation_page(published: DataFrame, nodes: DataFrame, source_id: str, offset: int, limit: int) -> DataFrame:
    """A page of the nodes ``(tree_id, node, …)`` of the tree that ``published(source_id, seq, tree_id)`` shows last."""
    from scriptorium.operators.search import page

    shown = latest(published.where(F.col("source_id") == source_id), "source_id", "seq", "tree_id").select("tree_id")
    return page(nodes.join(shown, "tree_id"), ["node"], offset, limit)
