"""Resolving links between notes by the shortest path that tells a document from the others.

Every document is indexed by all suffixes of its path's segments, without the extension and
folded; a link looks its own segments up. This extends the model, in which nothing
resolves links, so callers ask for it; without it every internal link stays unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import casefold


def path_segments(path: Column) -> Column:
    """Folded segments of a path, back to front, without the last one's .md; ``.`` and empty ones left out, ``..`` taken back."""
    parts = F.filter(F.split(F.replace(casefold(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.transform(F.reverse(walked), lambda p, i: F.when(i == 0, F.regexp_replace(p, r"[.](md|markdown)$", "")).otherwise(p))


def suffix_index(documents: DataFrame) -> DataFrame:
    """``vault_id, suffix, document_id, whole``: every suffix of each document's path, as its segments back to front."""
    at = documents.select("vault_id", "document_id", path_segments(F.col("path")).alias("s")).where("size(s) > 0")
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.struct(F.array_join(F.slice("s", F.lit(1), n), "/").alias("suffix"), (n == F.size("s")).alias("whole"))))
    return at.select("vault_id", "document_id", each.alias("x")).select("vault_id", "x.suffix", "document_id", "x.whole")


def shortest_names(documents: DataFrame) -> DataFrame:
    """``vault_id, document_id, name``: the shortest suffix of each path that no other document of its vault has; null where there is none."""
    index = suffix_index(documents)
    alone = index.groupBy("vault_id", "suffix").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id")).where("n = 1")
    name = alone.groupBy("vault_id", "document_id").agg(F.min_by("suffix", F.struct(F.size(F.split("suffix", "/")), F.col("suffix"))).alias("s"))
    return documents.select("vault_id", "document_id").join(name, ["vault_id", "document_id"], "left").select("vault_id", "document_id", F.array_join(F.reverse(F.split("s", "/")), "/").alias("name"))


def resolve_links(links: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """``link_id, status, target_document_id, n_targets, anchor_found`` of links (link_id, document_id, kind, target, heading).

    A wiki link names a suffix of a path; a Markdown link is relative to its document's folder,
    or to the vault where it starts with a slash. One document is resolved; a path that one
    document has as a whole goes before longer ones that end so; several are ambiguous and have no target, none is unresolved;
    a target with a scheme is external. A null target is the document itself. A heading is
    looked up, folded, among the target's sections (document_id, heading); ``anchor_found`` is null without one.
    """
    at = links.join(documents.select("document_id", "vault_id", "path"), "document_id")
    folder = F.regexp_replace("path", "[^/]*$", "")
    plain = F.url_decode(F.replace("target", F.lit("+"), F.lit("%2B")))
    full = F.when(F.col("kind") == "markdown", F.when(F.startswith(F.col("target"), F.lit("/")), plain).otherwise(F.concat(folder, plain))).otherwise(F.col("target"))
    external = F.coalesce(F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False))
    asked = at.select("link_id", "vault_id", "document_id", "kind", "target", "heading", external.alias("external"), F.when(~external, F.array_join(path_segments(full), "/")).alias("suffix"))
    hits = asked.where("suffix IS NOT NULL AND suffix <> ''").select("link_id", "vault_id", "suffix", "kind").join(suffix_index(documents).withColumnRenamed("document_id", "hit"), ["vault_id", "suffix"])
    hits = hits.where("kind <> 'markdown' OR whole").groupBy("link_id").agg(F.count("*").alias("n"), F.count_if("whole").alias("n_whole"), F.min("hit").alias("any"), F.min(F.when(F.col("whole"), F.col("hit"))).alias("exact"))
    rows = asked.join(hits, "link_id", "left")
    target = F.when(F.col("target").isNull(), F.col("document_id")).when(F.col("n_whole") == 1, F.col("exact")).when(F.col("n") == 1, F.col("any"))
    status = F.when(F.col("external"), "external").when(F.col("found").isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    rows = rows.withColumn("found", target).select("link_id", status.alias("status"), F.col("found").alias("target_document_id"), F.coalesce("n", F.lit(0)).alias("n_targets"), casefold(F.trim("heading")).alias("anchor"))
    known = sections.select(F.col("document_id").alias("target_document_id"), casefold(F.trim("heading")).alias("anchor")).distinct().withColumn("there", F.lit(True))
    rows = rows.join(known, ["target_document_id", "anchor"], "left")
    return rows.select("link_id", "status", "target_document_id", "n_targets", F.when(F.col("anchor").isNotNull(), F.coalesce("there", F.lit(False))).alias("anchor_found"))


def links_to(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """``document_id, target_document_id, link_id, kind`` of resolved links: the LINKS_TO edges of a graph snapshot."""
    return links.select("link_id", "document_id", "kind").join(resolved.where("status = 'resolved'").select("link_id", "target_document_id"), "link_id").select("document_id", "target_document_id", "link_id", "kind")
