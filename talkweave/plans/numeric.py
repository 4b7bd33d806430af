"""Queries over arrays and the parts of the numerics that SQL can check, and the signal chain on small synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import arrays as ar
from talkweave.operators import enhance
from talkweave.sources import audio

from .fixtures import table

Q = {}
S = {}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")


VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def _frames(end: str | None, length: int, shift: int):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _vectors(spark, sf_dir).select("vec_id", F.posexplode(ar.segments(F.col("x"), length, shift, end)).alias("frame", "values"))

    return run


Q["segment_frames"] = _frames("pad", 10, 6)
S["segment_frames"] = f"""WITH {VECTORS}, p AS (SELECT vec_id, list_concat(x, list_value(0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0)) AS x, len(x) AS n FROM v)
SELECT vec_id, CAST(i AS INT) AS frame, x[i * 6 + 1 : i * 6 + 10] AS values FROM p, range(0, 2000) r(i) WHERE i <= (n - 10 + 5) // 6"""
Q["segment_frames_cut"] = _frames("cut", 10, 6)
S["segment_frames_cut"] = f"WITH {VECTORS} SELECT vec_id, CAST(i AS INT) AS frame, x[i * 6 + 1 : i * 6 + 10] AS values FROM v, range(0, 2000) r(i) WHERE i <= (len(x) - 10) // 6"
Q["segment_frames_wrap"] = _frames("wrap", 10, 6)
S["segment_frames_wrap"] = f"""WITH {VECTORS}, p AS (SELECT vec_id, list_concat(x, x[1:6]) AS x, len(x) AS n FROM v)
SELECT vec_id, CAST(i AS INT) AS frame, x[i * 6 + 1 : i * 6 + 10] AS values FROM p, range(0, 2000) r(i) WHERE i <= (n - 10 + 5) // 6"""
Q["segment_frames_reversed"] = _frames("cut", 10, -6)
S["segment_frames_reversed"] = f"WITH {VECTORS} SELECT vec_id, CAST((len(x) - 10) // 6 - i AS INT) AS frame, x[i * 6 + 1 : i * 6 + 10] AS values FROM v, range(0, 2000) r(i) WHERE i <= (len(x) - 10) // 6"


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding, rolling, cutting and one-hot labels."""
    x, cut = F.col("x"), ar.Cutter(3, -2)
    return _vectors(spark, sf_dir).select(
        "vec_id", ar.pad_axis(x, 1, 2).alias("padded"), ar.pad_to(x, 70).alias("filled"), ar.roll_zeropad(x, 2).alias("rolled"), ar.roll_zeropad(x, -900).alias("gone"),
        cut.cut(x).alias("cut"), cut.expand(x).alias("expanded"), cut.overwrite(x).alias("blanked"), ar.one_hot(F.col("label"), 10).alias("hot"),
    )


Q["array_shapes"] = padded
Z = "0.0::DOUBLE"


def _zeros(n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {Z})"


S["array_shapes"] = f"""WITH {VECTORS} SELECT vec_id, list_concat([{Z}], x, [{Z}, {Z}]) AS padded, list_concat(x, {_zeros('70 - len(x)')}) AS filled, list_concat([{Z}, {Z}], x[1:len(x) - 2]) AS rolled,
  {_zeros('len(x)')} AS gone, x[4:len(x) - 2] AS cut, list_concat([{Z}, {Z}, {Z}], x, [{Z}, {Z}]) AS expanded, list_concat([{Z}, {Z}, {Z}], x[4:len(x) - 2], [{Z}, {Z}]) AS blanked,
  list_transform(range(0, 10), lambda i: i = label) AS hot FROM v"""
Q["roll_zeropad"] = lambda spark, d: _vectors(spark, d).select("vec_id", ar.roll_zeropad(F.col("x"), 2).alias("y"))
S["roll_zeropad"] = f"WITH {VECTORS} SELECT vec_id, list_concat([{Z}, {Z}], x[1:len(x) - 2]) AS y FROM v"
Q["one_hot"] = lambda spark, d: _vectors(spark, d).select("vec_id", F.posexplode(ar.one_hot(F.col("label"), 10)).alias("class_idx", "on"))
S["one_hot"] = f'WITH {VECTORS} SELECT vec_id, CAST(i AS INT) AS class_idx, i = label AS "on" FROM v, range(0, 10) r(i)'


def complex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real and imaginary halves put together and taken apart."""
    half = F.call_function("div", F.size("x"), F.lit(2)).cast("int")
    both = ar.merge_complex(ar.split_complex(F.slice("x", F.lit(1), half), F.slice("x", half + 1, half)))
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(both).alias("at", "z")).select("vec_id", "at", "z.re", "z.im")


Q["complex_features"] = complex_split
S["complex_features"] = f"WITH {VECTORS} SELECT vec_id, CAST(i - 1 AS INT) AS at, x[i] AS re, x[i + len(x) // 2] AS im FROM v, range(1, 5000) r(i) WHERE i <= len(x) // 2"


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of each turn, edges repeated."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return ar.context_stack(t, ["conv_id"], "turn", "turn", 2, 1).select("conv_id", "turn", "stacked", ar.unstack_centre(F.col("stacked"), 2).alias("centre"))


Q["context_stack"] = context
Q["context_channels"] = lambda spark, d: ar.context_channels(_vectors(spark, d).select("label", "vec_id", F.slice("x", 1, 4).alias("x")), ["label"], "vec_id", "x", 1, 1, 2).select("label", "vec_id", F.flatten(F.flatten("stacked")).alias("stacked"))
S["context_channels"] = f"""WITH {VECTORS}, n AS (SELECT label, vec_id, x[1:4] AS x, coalesce(lag(x[1:4]) OVER w, x[1:4]) AS a, coalesce(lead(x[1:4]) OVER w, x[1:4]) AS b FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, [a[1], x[1], b[1], a[2], x[2], b[2], a[3], x[3], b[3], a[4], x[4], b[4]] AS stacked FROM n"""
S["context_stack"] = """SELECT conv_id, turn, [coalesce(lag(turn, 2) OVER w, first(turn) OVER e), coalesce(lag(turn) OVER w, first(turn) OVER e), turn, coalesce(lead(turn) OVER w, last(turn) OVER e)] AS stacked, turn AS centre
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "v"))


Q["axis_reduce_median"] = lambda spark, d: ar.reduce_axis(_long(spark, d), ["label", "i"], "v", "median")
S["axis_reduce_median"] = f"WITH {VECTORS} SELECT label, CAST(i - 1 AS INT) AS i, median(x[i]) AS v FROM v, range(1, 5000) r(i) WHERE i <= len(x) GROUP BY ALL"


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index split in two, reduced over one and flattened with the label."""
    two = ar.unflatten_axis(_long(spark, sf_dir), "i", 8, "a", "b")
    least = ar.reduce_axis(two, ["label", "b"], "v", "min")
    return ar.flatten_axes(least, "label", "b", 8, "ab")


Q["axis_morph"] = axes
S["axis_morph"] = f"WITH {VECTORS} SELECT label * 8 + CAST((i - 1) % 8 AS INT) AS ab, min(x[i]) AS v FROM v, range(1, 5000) r(i) WHERE i <= len(x) GROUP BY ALL"


def text_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named axes by text: an axis split and reduced, and the rest flattened in another order."""
    rows = _long(spark, sf_dir).select("label", F.pmod("vec_id", F.lit(5)).alias("A"), F.col("i").alias("B*C"), F.col("vec_id").alias("D"), F.floor(F.col("v") * 1000).alias("v"))
    return ar.morph(rows, "A B*C D -> C*A 1", "v", "sum", B=8, C=8, A=5).withColumnRenamed("C*A", "ca")


Q["axis_morph_text"] = text_morph
S["axis_morph_text"] = f"""WITH {VECTORS} SELECT label, ((i - 1) % 8) * 5 + vec_id % 5 AS ca, CAST(0 AS BIGINT) AS one1, CAST(sum(floor(x[i] * 1000)) AS BIGINT) AS v FROM v, range(1, 5000) r(i) WHERE i <= len(x) GROUP BY ALL"""


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask-weighted second moments of integer vectors by label (whole numbers, so that no order of sums matters)."""
    x = F.transform("embedding", lambda v: F.floor(v * 100).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("label", x.alias("x"), (F.col("vec_id") % 4).cast("double").alias("w"))
    return enhance.masked_covariance(rows, ["label"], "x", "w")


Q["masked_covariance"] = covariance
S["masked_covariance"] = """WITH r AS (SELECT label, vec_id, (vec_id % 4)::DOUBLE AS w, CAST(i - 1 AS INT) AS i, floor(embedding[i]::DOUBLE * 100) AS x FROM embeddings, range(1, 5000) t(i) WHERE i <= len(embedding))
SELECT a.label, a.i, b.i AS j, sum(a.w * a.x * b.x) / sum(a.w) AS cov FROM r a JOIN r b ON a.vec_id = b.vec_id GROUP BY ALL"""


def distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and distortion masks: the label's item and the sum of the others."""
    m = _long(spark, sf_dir).select("vec_id", F.col("i").alias("class_idx"), F.col("label").alias("target_idx"), F.floor(F.col("v") * 1000).cast("double").alias("mask"))
    return enhance.target_distortion(m, ["vec_id"])


Q["mask_target_distortion"] = distortion
S["mask_target_distortion"] = f"""WITH {VECTORS}, m AS (SELECT vec_id, i - 1 = label AS own, floor(x[i] * 1000) AS m FROM v, range(1, 5000) r(i) WHERE i <= len(x))
SELECT vec_id, coalesce(sum(m) FILTER (own), 0.0::DOUBLE) AS target, coalesce(sum(m) FILTER (NOT own), 0.0::DOUBLE) AS distortion FROM m GROUP BY vec_id"""


def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of varied length: those under 20 go, the others are cut to their label's shortest."""
    rows = _vectors(spark, sf_dir).select("vec_id", "label", F.slice("x", F.lit(1), (F.lit(18) + F.pmod("vec_id", F.lit(40))).cast("int")).alias("x"))
    return audio.truncated(rows, "label", "x", 20, may_drop=1000)


Q["truncate_to_shortest"] = shortest
S["truncate_to_shortest"] = f"""WITH {VECTORS}, c AS (SELECT vec_id, label, x[1:18 + vec_id % 40] AS x FROM v), k AS (SELECT *, min(len(x)) OVER (PARTITION BY label) AS n FROM c WHERE len(x) >= 20)
SELECT vec_id, label, x[1:n] AS x FROM k"""


def _beamformed(kind: str, postfilter: str | None = None):  # noqa: ANN202
    """Four vectors as the channels of an utterance of two frequencies, beamformed by the library; real parts by frame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir).select(F.call_function("div", F.col("vec_id"), F.lit(4)).cast("string").alias("utt"), "vec_id", "x")
        listed = lambda v: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", v.alias("v")))), lambda r: r["v"]))
        pairs = lambda k: F.flatten(F.transform("x", lambda v: F.array(F.floor(v * 1000).cast("double") * k, F.lit(0.0))))
        per = rows.groupBy("utt").agg(F.count("*").cast("int").alias("d"), F.min(F.size("x")).alias("t"), listed(pairs(1)).alias("s0"), listed(pairs(-3)).alias("s1"))
        spectrum = per.select("utt", "d", "t", F.posexplode(F.array("s0", "s1")).alias("f", "spectrum"))
        on = F.transform(F.sequence(F.lit(1), F.col("t")), lambda i: F.pmod(i, F.lit(3)).cast("double"))
        got = enhance.beamform(spectrum, spectrum.select("utt", "f", on.alias("target"), on.alias("noise")), kind, postfilter)
        return got.select("utt", "f", F.posexplode(F.filter("spectrum", lambda v, i: i % 2 == 0)).alias("i", "y"))

    return run


def _beamformed_sql(value: str) -> str:
    return f"""WITH {VECTORS}, e AS (SELECT vec_id, CAST(vec_id // 4 AS VARCHAR) AS utt, CAST(i - 1 AS INT) AS i, floor(x[i] * 1000) AS v FROM v, range(1, 5000) r(i) WHERE i <= len(x))
SELECT utt, CAST(f AS INT) AS f, i, {value} AS y FROM e, (VALUES (0, 1.0::DOUBLE), (1, -3.0::DOUBLE)) k(f, k)"""


Q["beamform_sum"] = _beamformed("sum")
S["beamform_sum"] = _beamformed_sql("sum(v * k)") + " GROUP BY ALL"
Q["beamform_channel"] = _beamformed("ch1")
S["beamform_channel"] = _beamformed_sql("v * k") + " QUALIFY row_number() OVER (PARTITION BY utt, f, i ORDER BY vec_id) = 2"
Q["beamform_postfilter"] = _beamformed("sum", "mask_mul")
S["beamform_postfilter"] = _beamformed_sql("sum(v * k * ((i + 1) % 3))") + " GROUP BY ALL"


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cropped at an offset that their id's hash gives, with an alignment of an item a frame of 4 by 2."""
    from talkweave.operators import catalog as cat

    rows = _vectors(spark, sf_dir).withColumn("frames", F.sequence(F.lit(0), F.call_function("div", F.size("x") - 2, F.lit(2)).cast("int")))
    return cat.limit_length(rows, "x", 40, "vec_id", alignment="frames", length=4, shift=2).select("vec_id", "num_samples", "x", F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


Q["limit_length"] = cropped
S["limit_length"] = f"""WITH {VECTORS}, o AS (SELECT vec_id, x, len(x) AS n, CAST(CAST('0x' || substr(md5('0:' || vec_id), 1, 8) AS BIGINT) % greatest(1, (len(x) - 40) // 2) AS INT) AS o FROM v)
SELECT vec_id, CAST(least(n, 40) AS BIGINT) AS num_samples, CASE WHEN n > 40 THEN x[o + 1:o + 40] ELSE x END AS x,
  array_to_string(CASE WHEN n > 40 THEN list_slice(range(0, (n - 2) // 2 + 1), greatest(0, (o - 2) // 2) + 1, greatest(0, (o - 2) // 2) + 19) ELSE range(0, (n - 2) // 2 + 1) END, ',') AS frames FROM o"""


def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as wav files of two channels, their headers read, and every sample of both read back, with samples 4 to 12 by a ranged read."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), "x")
    rows = rows.select("vec_id", "channel", F.transform("x", lambda v: (F.round(v * 64) + F.col("channel")) / 128).alias("samples"))
    files = audio.encode(rows.where("vec_id is not null"), "vec_id", kind="float64")
    # each file is made once and both ranges are read of it, so nothing is joined
    named = files.select("vec_id", F.lit("x").alias("path"), "content", "n_clipped", audio.shape(F.col("content")).alias("h"))
    both = audio.load(named, keep=("vec_id", "n_clipped", "h"), more={"some": (4, 12)})
    return both.select("vec_id", "channel", "h.channels", F.col("h.samples").alias("n"), "h.rate", "n_clipped", "samples", "some")


Q["wav_round_trip"] = wav_round_trip
S["wav_round_trip"] = f"""WITH {VECTORS}, y AS (SELECT vec_id, channel, list_transform(x, lambda z: (round(z * 64) + channel) / 128.0::DOUBLE) AS y FROM v, (VALUES (0), (1)) c(channel)),
k AS (SELECT vec_id, CAST(sum(len(list_filter(y, lambda z: z < -1 OR z >= 1))) AS BIGINT) AS k FROM y GROUP BY vec_id)
SELECT vec_id, channel, 2 AS channels, CAST(len(y) AS BIGINT) AS n, 16000 AS rate, k AS n_clipped, y AS samples, y[5:12] AS some FROM y JOIN k USING (vec_id)"""


def enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal chain over utterances made of the vectors: 4 channels and 2 speakers with a noise class each; length, and whether all is finite."""
    config = enhance.Config(stft_size=64, stft_shift=16, wpe_taps=2, em_iterations=4, drop_context=True)
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("n"), "x")
    per = rows.select(F.concat(F.lit("u"), F.call_function("div", F.col("n"), F.lit(20)).cast("string")).alias("utt"), F.pmod("n", F.lit(4)).alias("channel"), F.call_function("div", F.pmod("n", F.lit(20)), F.lit(4)).alias("k"), "x")
    samples = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]))
    channels = per.groupBy("utt", "channel").agg(samples.alias("samples"))
    utts = channels.select("utt").distinct()
    classes = utts.select("utt", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("class_idx"))
    spans = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("s"), F.lit(160).alias("e")), F.struct(F.lit(1).alias("c"), F.lit(120).alias("s"), F.lit(320).alias("e")), F.struct(F.lit(2).alias("c"), F.lit(0).alias("s"), F.lit(320).alias("e")))
    activity = utts.select("utt", F.explode(spans).alias("v")).select("utt", F.col("v.c").alias("class_idx"), F.col("v.s").cast("bigint").alias("start"), F.col("v.e").cast("bigint").alias("end"))
    targets = utts.select("utt", F.lit(0).alias("class_idx"), F.lit(20).alias("context_start"), F.lit(200).alias("num_samples"))
    out = enhance.enhance(channels, activity, classes, targets, config)
    return out.select("utt", F.size("samples").alias("n"), F.forall("samples", lambda v: ~F.isnan(v) & (F.abs(v) < 1e6)).alias("finite"))


Q["enhance_utterances"] = enhanced
S["enhance_utterances"] = "SELECT DISTINCT 'u' || vec_id // 20 AS utt, 200 AS n, true AS finite FROM embeddings"

QUERIES, ORACLES = Q, S
