"""Queries of the data problems for training data: p1, p5, p6, p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import mixing, nearest, normalize, pii, splits, tokens
from loomspan.session import kept, table

_EVIDENCE = ("mention", "relation", "identity_link", "context")
#: Seconds within which a scan row may be paired with a record.
TOLERANCE = 0.9


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("ref_table"), "id", F.col("evidence.quote").alias("quote"), F.col("evidence.verbatim").alias("verbatim")) for t in _EVIDENCE]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.look_alikes(_evidence(spark, sf_dir), "quote", "verbatim").select("id").distinct()


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of both texts of every record."""
    formed = normalize.with_normal_form(_evidence(spark, sf_dir), ["quote", "verbatim"])
    return formed.select("ref_table", "id", "quote_form", "verbatim_form").distinct()


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tied_groups(table(spark, sf_dir, "source_record"), "story_id", ["narrator_id", "recording_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tied_pairs(kept(_ties(spark, sf_dir)))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every story with the least story that it is tied to and the number of stories tied together."""
    return splits.tied_sizes(kept(_ties(spark, sf_dir))).select(F.col("record").alias("story_id"), F.col("label").alias("least_story"), F.col("n").alias("n_tied"))


def p5_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every source record."""
    return splits.assign_splits(table(spark, sf_dir, "source_record"), _ties(spark, sf_dir), table(spark, sf_dir, "split_target"), "id", "story_id", "decoder_timing_eligible")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached and distribution of the label per split."""
    return splits.split_report(p5_assigned(spark, sf_dir), table(spark, sf_dir, "source_record"), table(spark, sf_dir, "split_target"), "id", "decoder_timing_eligible")


def p5_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records assigned, groups of tied stories, and groups that are torn apart (none may be)."""
    ties = kept(_ties(spark, sf_dir))
    records = table(spark, sf_dir, "source_record")
    assigned = splits.assign_splits(records, ties, table(spark, sf_dir, "split_target"), "id", "story_id", "decoder_timing_eligible")
    per = assigned.join(ties.select(F.col("record").alias("story_id"), "label"), "story_id").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("split").alias("k"))
    return per.agg(F.sum("n").alias("records"), F.count("*").alias("tied"), F.count_if(F.col("k") > 1).alias("torn"))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "source_record").where("raw_feature_bin >= 0").select(F.col("id").alias("source_id"), F.col("story_id").alias("entity"), F.col("available_at_seconds").alias("at"))
    scans = table(spark, sf_dir, "alignment").select(F.col("story_id").alias("entity"), F.explode(F.arrays_zip(F.col("tr_centers_story_seconds").alias("at"), F.col("response_raw_indices").alias("target"))).alias("z"))
    return nearest.nearest_in_time(records, scans.select("entity", "z.at", "z.target"), TOLERANCE)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("source_id", F.col("target").cast("int").alias("raw_row"))


def p6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_found, with the distance in seconds."""
    return _nearest(spark, sf_dir).select("source_id", F.col("target").cast("int").alias("raw_row"), F.round("gap", 6).alias("gap"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids with the code points at which each token begins and ends."""
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=True)


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents and those that decoding gives back exactly (null counts as empty)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("whole"), "text")
    back = tokens.decode(tokens.encode(documents), text="back")
    return back.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("whole") == F.col("back")).alias("exact"))


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = kept(tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixing.mixed(counted, table(spark, sf_dir, "mix_target"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shuffled(_mix(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.share_report(_mix(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with documents and a target, whether each reaches its share of their targets to within its longest document or a hundredth, and keeps its cap."""
    counted = kept(tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    targets = table(spark, sf_dir, "mix_target")
    longest = counted.where("tokens > 0").groupBy("source").agg(F.max("tokens").alias("_most"))
    report = kept(mixing.share_report(kept(mixing.mixed(counted, targets)), targets).where("target_share > 0 AND max_repeats > 0").join(longest, "source"))
    whole = report.agg(F.sum("target_share").alias("_t"), F.sum("tokens").alias("_n"))
    near = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("target_share") / F.col("_t")) <= F.greatest(F.lit(0.01), F.col("_most") / F.col("_n"))
    return report.crossJoin(whole).select("source", near.alias("reached"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"))


def _name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.name_terms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_name"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanned = pii.with_spans(table(spark, sf_dir, "documents"), _name_terms(spark, sf_dir), ["doc_id"])
    return pii.found_rows(spanned, "doc_id").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders in the stead of personal information."""
    return pii.with_spans(table(spark, sf_dir, "documents"), _name_terms(spark, sf_dir), ["doc_id"], clean="redacted").select("doc_id", "redacted")


def p10_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p10_redacted, with the terms generalised that disclose a person whose name was taken out."""
    return pii.sanitised(table(spark, sf_dir, "documents"), _name_terms(spark, sf_dir), "doc_id")


def p10_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that disclose names, numbers and streets, with the bits by which their place does."""
    return _name_terms(spark, sf_dir).select("term", "role", F.round("bits", 6).alias("bits"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_forms, p5_found, p5_groups, p5_assigned, p5_together, p5_report, p6_found, p6_gaps, p8_ids, p8_spans, p8_round_trip, p9_mix, p9_shares, p9_close, p10_found, p10_redacted, p10_sanitised, p10_terms)
}


_TIES = r"""WITH RECURSIVE n AS (SELECT DISTINCT id, story_id, lower(regexp_replace(narrator_id, '^\s+|\s+$', '', 'g')) AS a, lower(regexp_replace(recording_id, '^\s+|\s+$', '', 'g')) AS b FROM source_record WHERE story_id IS NOT NULL),
x AS (SELECT DISTINCT story_id, 'n:' || a AS e FROM n WHERE a NOT IN ('', 'unknown', 'n/a', 'none', '-') UNION SELECT DISTINCT story_id, 'r:' || b FROM n WHERE b NOT IN ('', 'unknown', 'n/a', 'none', '-')),
l AS (SELECT DISTINCT p.story_id AS a, q.story_id AS b FROM x p JOIN x q USING (e)), c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)"""
_SCANS = """WITH r AS (SELECT DISTINCT id AS source_id, story_id, available_at_seconds AS t FROM source_record WHERE raw_feature_bin >= 0 AND available_at_seconds IS NOT NULL), s AS (SELECT DISTINCT story_id, tr_centers_story_seconds[i] AS c, response_raw_indices[i] AS raw FROM (SELECT *, unnest(range(1, len(response_raw_indices) + 1)) AS i FROM alignment) WHERE tr_centers_story_seconds[i] IS NOT NULL AND NOT isnan(tr_centers_story_seconds[i])),
p AS (SELECT source_id, raw, abs(c - t) AS gap, row_number() OVER (PARTITION BY source_id ORDER BY abs(c - t), raw) AS k FROM r JOIN s ON s.story_id = r.story_id AND c BETWEEN t - 0.9 AND t + 0.9)"""
ORACLE = {
    "p5_found": _TIES + " SELECT DISTINCT a AS story_a, b AS story_b FROM c WHERE a < b",
    "p5_groups": _TIES + ", w AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM c UNION ALL SELECT DISTINCT story_id, story_id FROM source_record WHERE story_id IS NOT NULL)) SELECT a AS story_id, min(b) AS least_story, count(*) AS n_tied FROM w GROUP BY a",
    "p5_together": _TIES + ", r AS (SELECT id, min(story_id) AS story_id FROM source_record GROUP BY id HAVING min(story_id) IS NOT NULL), w AS (SELECT a, b FROM c UNION SELECT DISTINCT story_id, story_id FROM r), g AS (SELECT a AS story_id, min(b) AS label FROM w GROUP BY a) SELECT count(*) AS records, count(DISTINCT label) AS tied, 0 AS torn FROM r JOIN g USING (story_id)",
    "p8_round_trip": "SELECT source, count(*) AS documents, count(*) AS exact FROM documents GROUP BY source",
    "p9_close": "SELECT DISTINCT source, true AS reached, true AS capped FROM mix_target JOIN documents USING (source) WHERE target_share > 0 AND max_repeats > 0 AND length(text) > 0",
    "p6_found": _SCANS + " SELECT source_id, raw AS raw_row FROM p WHERE k = 1 AND gap <= 0.9",
    "p6_gaps": _SCANS + " SELECT source_id, raw AS raw_row, round(gap, 6) AS gap FROM p WHERE k = 1 AND gap <= 0.9",
}
