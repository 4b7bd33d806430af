"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of copies: ``round(total * share)`` where the
share is ``targets[source]`` (normalised), or, without targets, proportional to
the square root of the source's characters (which lifts small sources).  Within
a source a document's expected copies are proportional to its size measure,
the integer square root of its characters.  The whole part of the expectation
is allocated as certain copies.  The fractional parts are inclusion
probabilities p of a fixed-size sample: rank q = (u / (1 - u)) / (p / (1 - p))
with u a hash of (seed, doc_id); the least ranks are taken, exactly as many as
the source still lacks.

No source is sorted as a whole: ranks fall into ``CELLS`` cells, cells are
counted with map-side combining, and only the one cell of a source in which
the limit falls is ranked by a window.  So a hot source is no hot task.  The
per-source figures are one row a source; they are broadcast by Spark's own
choice only.

Cases: a null source is a source of its own (never a target's); a null or
empty text has size measure 1; equal ranks (rows that repeat a doc_id) are
taken in the order of doc_id and then any, so the number of copies is exact.
A null ``doc_id`` draws by its text.  Sources that ``targets`` doesn't name get
nothing; targets that no document has count as unfilled weight and are left
out of the normalisation.  Other columns of any name are ignored by ``copies``
and kept by ``mix``.  Of an empty table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 16
SEED = 11
UNIT = 1 << 52


def _uniform(key: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), key)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(UNIT))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Adds _s (source), _k (id), _w (size measure), _u (uniform number)."""
    chars = F.greatest(F.coalesce(F.length(F.col("_t")), F.lit(0)), F.lit(1)).cast("double")
    key = F.coalesce(F.col("_k").cast("string"), F.md5(F.coalesce("_t", F.lit(""))))
    return docs.withColumn("_w", F.floor(F.sqrt(chars)).cast("bigint")).withColumn("_u", _uniform(key, seed)).withColumn("_c", chars.cast("bigint"))


def quotas(rows: DataFrame, targets: dict[str, float] | None, total: float) -> DataFrame:
    """(_s, _sum, _quota): size of each source and copies it is to have. One row a source; the driver receives two sums."""
    per = rows.groupBy("_s").agg(F.sum("_w").alias("_sum"), F.sum("_c").alias("_chars"), F.count("*").alias("_n"))
    if targets is None:
        share = F.round(F.sqrt(F.col("_chars").cast("double")) * 1024).cast("bigint")
    else:
        share = F.lit(0).cast("bigint")
        for name, weight in targets.items():
            share = F.when(F.col("_s") == name, F.lit(round(weight * (1 << 20))).cast("bigint")).otherwise(share)
    per = common.materialise(per.withColumn("_share", share))
    whole, every = per.agg(F.sum("_share"), F.sum("_n")).first()
    quota = F.floor(F.lit(float(total) * float(every or 0)) * F.col("_share").cast("double") / F.lit(float(max(whole or 0, 1))) + 0.5).cast("bigint")
    return per.withColumn("_quota", quota).select("_s", "_sum", "_quota")


def _allocated(rows: DataFrame, targets: dict[str, float] | None, total: float) -> DataFrame:
    """Rows of ``sized`` with their certain copies (_sure) and, for the rest of the expectation, cell and limit."""
    per = quotas(rows, targets, total)
    expected = F.col("_quota").cast("double") * F.col("_w").cast("double") / F.col("_sum").cast("double")
    both = rows.join(per, rows["_s"].eqNullSafe(per["_s"])).drop(per["_s"]).withColumn("_e", expected)
    both = both.withColumn("_sure", F.floor("_e").cast("bigint")).withColumn("_p", F.col("_e") - F.floor("_e"))
    rank = F.col("_u") * (1 - F.col("_p")) / ((1 - F.col("_u")) * F.col("_p"))
    both = both.withColumn("_q", F.when(F.col("_p") > 0, rank)).withColumn("_cell", F.when(F.col("_p") > 0, F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS).cast("int")))
    light = both.select("_s", "_cell", "_sure", "_quota")
    cells = light.groupBy("_s", "_cell").agg(F.count("*").alias("_n"), F.sum("_sure").alias("_sure"), F.max("_quota").alias("_quota"))
    of = Window.partitionBy("_s")
    cells = cells.withColumn("_left", F.col("_quota") - F.sum("_sure").over(of)).where("_cell is not null")
    cells = cells.withColumn("_before", F.sum("_n").over(of.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    limit = cells.where("coalesce(_before, 0) < _left").groupBy("_s").agg(F.max("_cell").alias("_limit"), F.max_by(F.col("_left") - F.coalesce("_before", F.lit(0)), "_cell").alias("_take"))
    limit = common.materialise(limit.withColumnRenamed("_s", "_ls"))
    return both.join(limit, F.col("_s").eqNullSafe(F.col("_ls")), "left").drop("_ls", "_n")


def copies(docs: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_copies) of every document that gets a copy; ``total`` is the number of copies as a share of the rows.

    Texts are read once; what is needed of them is written to the shared folder, some 30 bytes a row.
    """
    common.need(docs, "doc_id", "text", "source")
    plain, names = common.numbered(docs)
    rows = plain.select(*(F.col(f"c{names.index(n)}").alias(a) for n, a in (("source", "_s"), ("doc_id", "_k"), ("text", "_t"))))
    out = _chosen(_allocated(common.materialise(sized(rows, seed).drop("_t")), targets, total))
    return out.select(F.col("_k").alias("doc_id"), F.col("_s").alias("source"), F.col("_copies").alias("n_copies"))


def _chosen(both: DataFrame) -> DataFrame:
    edge = F.col("_cell") == F.col("_limit")
    clear = both.where(~F.coalesce(edge, F.lit(False))).withColumn("_extra", F.coalesce(F.col("_cell") < F.col("_limit"), F.lit(False)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_q", "_k"))
    tied = both.where(edge).withColumn("_extra", (place <= F.col("_take")).cast("bigint"))
    return clear.unionByName(tied).withColumn("_copies", F.col("_sure") + F.col("_extra")).where("_copies > 0")


def mix(docs: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixture itself: all columns of ``docs``, a row for each copy."""
    common.need(docs, "doc_id", "text", "source")
    plain, names = common.numbered(docs)
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source")}
    rows = plain.withColumns({"_s": at["source"], "_k": at["doc_id"], "_t": at["text"]})
    out = _chosen(_allocated(sized(rows, seed).drop("_t"), targets, total))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mixture as large as the corpus, sources weighted by the root of their size."""
    return copies(common.table(spark, sf_dir, "documents"))


OP6_SQL = f"""WITH sized AS (SELECT source, doc_id, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS c,
    CAST(floor(sqrt(greatest(coalesce(length(text), 0), 1)::DOUBLE)) AS BIGINT) AS w,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(UNIT)}::DOUBLE AS u FROM documents),
per AS (SELECT source, sum(w)::BIGINT AS total, count(*) AS n, round(sqrt(sum(c)::DOUBLE) * 1024)::BIGINT AS share FROM sized GROUP BY source),
quota AS (SELECT source, total, floor(1.0::DOUBLE * (SELECT sum(n) FROM per)::DOUBLE * share::DOUBLE / (SELECT sum(share) FROM per)::DOUBLE + 0.5)::BIGINT AS quota FROM per),
expected AS (SELECT s.*, quota, quota::DOUBLE * w::DOUBLE / total::DOUBLE AS e FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
split AS (SELECT *, floor(e)::BIGINT AS sure, e - floor(e) AS p FROM expected),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, p > 0 ORDER BY CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END, doc_id) AS place,
    quota - sum(sure) OVER (PARTITION BY source) AS lacking FROM split)
SELECT doc_id, source, sure + CASE WHEN p > 0 AND place <= lacking THEN 1 ELSE 0 END AS n_copies FROM ranked
WHERE sure + CASE WHEN p > 0 AND place <= lacking THEN 1 ELSE 0 END > 0"""
