"""The chunk manifest: audit policies, layers and boosts, union of sources, counts and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions import text as T

from .order import first_match, keep_first

#: Policies whose chunks are in the default index.
DEFAULT_POLICIES = ("embed", "embed_preferred", "embed_preferred_and_image", "embed_with_parent", "embed_with_parent_and_image", "embed_with_image_evidence")


def corpus_layer(policy: Column) -> Column:
    return first_match([(policy == "metadata_only", "meta"), (policy == "embed_as_template", "template"), (F.startswith(policy, F.lit("exclude")), "excluded"), (F.contains(policy, F.lit("image")), "evidence")], "fact")


def rank_boost(policy: Column) -> Column:
    return first_match([(F.startswith(policy, F.lit("embed_preferred")), 1.12), (F.startswith(policy, F.lit("embed_with_parent")), 1.04)], 1.0)


def with_policy(chunks: DataFrame, policy: Column) -> DataFrame:
    """``chunks`` with embedding_policy and what follows from it: corpus_layer, rank_boost, default_index."""
    named = chunks.withColumn("embedding_policy", policy)
    p = F.col("embedding_policy")
    return named.withColumns({"corpus_layer": corpus_layer(p), "rank_boost": rank_boost(p), "default_index": p.isin(*DEFAULT_POLICIES)})


def audited(segments: DataFrame, audits: DataFrame, key: str, default: str = "exclude_until_fixed") -> DataFrame:
    """Segments with the policy of their audit; segments without one get ``default``."""
    joined = segments.join(audits.select(key, F.col("embedding_policy").alias("__policy")), key, "left")
    return with_policy(joined, F.coalesce(F.col("__policy"), F.lit(default))).drop("__policy")


def semantic_audit(segments: DataFrame, network: str, questionnaire: str, duties: str, cabinets: str, device_words: Sequence[str]) -> DataFrame:
    """``segments`` with semantic_status and embedding_policy by ordered rules; the first that holds decides.

    ``segments(category, role, values, text, has_aggregate, has_image, has_subject, has_centre)``. The category of
    network devices has no rule but its own. Rows with images get a policy that keeps the image.
    """
    values = F.size(F.filter("values", lambda v: ~T.blank(v)))
    device = F.lower("text").rlike("|".join(device_words))
    of = F.col("category")
    rules = [
        ((of == network) & (values <= 2) & ~device, "low_value_incomplete_source", "exclude"),
        (of == network, "ok", "embed"),
        (F.col("role") == "schema", "schema_only", "metadata_only"),
        (of == questionnaire, "template_not_fact", "embed_as_template"),
        (F.col("role").isin("procedure", "table_procedure"), "ok_aggregate", "embed_preferred"),
        (F.col("has_aggregate") & F.col("role").isin("instruction_step", "command_row", "data_row"), "ok_row_with_aggregate", "embed_with_parent"),
        (F.col("role") == "context", "context_marker", "metadata_only"),
        (F.col("has_image"), "ok_needs_image_evidence", "embed_with_image_evidence"),
        (F.startswith(of, F.lit(duties)) & ~F.col("has_subject") & (F.col("role") != "metadata"), "needs_subject_context", "exclude_until_fixed"),
        (F.startswith(of, F.lit(duties)), "ok_subject_scoped", "embed"),
        ((of == cabinets) & ~F.col("has_centre"), "needs_merged_cell_inheritance", "exclude_until_fixed"),
    ]
    status = first_match([(c, s) for c, s, _ in rules], "ok")
    policy = first_match([(c, p) for c, _, p in rules], "embed")
    overlaid = first_match([(~F.col("has_image") | (status == "ok_needs_image_evidence"), policy), (policy == "embed", "embed_with_image_evidence"), (policy.isin("embed_with_parent", "embed_preferred"), F.concat(policy, F.lit("_and_image")))], policy)
    return segments.withColumns({"semantic_status": status, "embedding_policy": overlaid})


def union_first(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """All parts by column name, blank texts dropped; of rows with the same key that of the earliest part stays."""
    out = None
    for k, part in enumerate(parts):
        part = part.where(~T.blank(F.col("text"))).withColumn("__part", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    order = ["__part", *[c for c in out.columns if c not in (key, "__part")]]
    return keep_first(out, [key], order).drop("__part")


def facet_counts(df: DataFrame, *facets: str) -> DataFrame:
    """``facet, value, n`` for each facet, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in facets])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def keyword_budget(chunks: DataFrame, groups: Sequence[tuple[str, str]], limit: int, id_column: str) -> DataFrame:
    """A sample of ``limit`` rows: from each keyword group up to its share of the limit (3 at least), then others by id.

    A row belongs to the first group whose pattern its text matches.
    """
    share = max(3, limit // max(1, len(groups)))
    named = chunks.withColumn("__group", first_match([(F.lower("text").rlike(p), i) for i, (_, p) in enumerate(groups)], len(groups)))
    # the best rows of each group alone can be in the sample; each group's window is cut before anything is joined
    w = Window.partitionBy("__group").orderBy(id_column)
    ranked = named.select("__group", id_column).withColumn("__turn", F.row_number().over(w)).where(F.col("__turn") <= limit)
    first = (F.col("__turn") <= share) & (F.col("__group") < len(groups))
    return ranked.withColumn("stage", F.when(first, 0).otherwise(1)).orderBy("stage", F.when(first, F.col("__group")).otherwise(0), id_column).limit(limit).select(id_column, F.col("__group").alias("keyword_group"), "stage")


def preservation(sources: DataFrame, segments: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """For each key: how many source values there are, and how many appear in none of its segments' texts."""
    joined = sources.join(segments.select(key, F.col(text).alias("__text")), key, "left")
    kept = joined.groupBy(key, value).agg(F.max(F.coalesce(F.contains(F.col("__text"), F.col(value)), F.lit(False))).alias("kept"))
    return kept.groupBy(key).agg(F.count("*").alias("n_values"), F.count_if(~F.col("kept")).alias("n_lost"))
