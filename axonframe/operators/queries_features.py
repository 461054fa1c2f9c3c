"""Queries over features, labels and readouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import features as X
from .registry import query, table

DIM = 64
VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), "label")


@query(f"""WITH {VEC}, f AS (SELECT CAST(i - 1 AS INTEGER) AS feature, e[i] AS v FROM v, range(1, {DIM + 1}) t(i))
SELECT feature, round(avg(v), 6) AS mean, round(CASE WHEN stddev_pop(v) <= 1e-6 THEN 1.0 ELSE stddev_pop(v) END, 6) AS std FROM f GROUP BY feature""")
def feature_normalizer(spark, sf_dir):
    return X.normaliser(rows(spark, sf_dir)).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {VEC}, f AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature, e[i] AS v FROM v, range(1, {DIM + 1}) t(i)),
n AS (SELECT feature, avg(v) AS m, CASE WHEN stddev_pop(v) <= 1e-6 THEN 1.0 ELSE stddev_pop(v) END AS s FROM f GROUP BY feature)
SELECT vec_id, round(1.0 + sum((v - m) / s * (feature + 1)), 4) AS projected FROM f JOIN n USING (feature) GROUP BY vec_id""")
def standardise_augment(spark, sf_dir):
    """Each row standardised and augmented with 1, shown by its product with 1, 2, 3, ..."""
    each = rows(spark, sf_dir).select("vec_id", F.posexplode("x").alias("feature", "v"))
    scaled = each.join(X.normaliser(rows(spark, sf_dir)), "feature").groupBy("vec_id").agg(F.sum((F.col("v") - F.col("mean")) / F.col("std") * (F.col("feature") + 1)).alias("p"))
    return scaled.select("vec_id", F.round(F.lit(1.0) + F.col("p"), 4).alias("projected"))


@query(f"""WITH {VEC}, s AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS z FROM v)
SELECT vec_id, round(list_max(z) / list_sum(z), 6) AS top, round(z[1] / list_sum(z), 6) AS first FROM s""")
def softmax_rows(spark, sf_dir):
    p = rows(spark, sf_dir).select("vec_id", X.softmax(F.col("x")).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.get("p", F.lit(0)), 6).alias("first"))


@query(f"""WITH {VEC}, m AS (SELECT vec_id, [e[i] FOR i IN range(1, {DIM + 1}) IF (i - 1 + vec_id) % 5 = 0] AS kept FROM v), s AS (SELECT vec_id, list_transform(kept, lambda x: exp((x - list_max(kept)) / 0.5::DOUBLE)) AS z FROM m)
SELECT vec_id, round(list_max(z) / list_sum(z), 6) AS top FROM s""")
def masked_softmax_rows(spark, sf_dir):
    mask = F.transform(F.col("x"), lambda v, i: (i + F.col("vec_id")) % 5 == 0)
    return rows(spark, sf_dir).select("vec_id", F.round(F.array_max(X.masked_softmax(F.col("x"), mask, 0.5)), 6).alias("top"))


@query(f"WITH {VEC} SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS winner FROM v")
def argmax_class(spark, sf_dir):
    return rows(spark, sf_dir).select("vec_id", X.argmax(F.col("x")).cast("long").alias("winner"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark, sf_dir):
    return X.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT quality, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labels GROUP BY quality")
def per_class_accuracy(spark, sf_dir):
    return X.class_accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 48271 + 5 * 7919) % 2147483647, vec_id) AS n FROM embeddings) SELECT vec_id, label FROM r WHERE n <= 12")
def balanced_subset(spark, sf_dir):
    return X.balanced_subset(rows(spark, sf_dir), "label", "vec_id", 12, 5).select("vec_id", "label")


@query(f"""WITH {VEC}, c AS (SELECT vec_id, (i - 1) // 8 // 2 * 4 + (i - 1) % 8 // 2 AS block, e[i] AS v FROM v, range(1, {DIM + 1}) t(i))
SELECT vec_id, CAST(block AS INTEGER) AS block, round(avg(v), 6) AS mean FROM c GROUP BY vec_id, block""")
def block_mean(spark, sf_dir):
    b = rows(spark, sf_dir).select("vec_id", F.posexplode(X.block_mean(F.col("x"), 8, 2)).alias("block", "mean"))
    return b.select("vec_id", "block", F.round("mean", 6).alias("mean"))


@query(f"""WITH {VEC} SELECT vec_id, 'second' AS kind, CAST(n - 1 AS INTEGER) AS place, e[(n - 1) // 4 * 2 * 8 + (n - 1) % 4 * 2 + 1] AS v FROM v, range(1, 17) t(n)
UNION ALL SELECT vec_id, 'nearest', CAST(n AS INTEGER), e[n // 5 * 8 // 5 * 8 + n % 5 * 8 // 5 + 1] FROM v, range(25) t(n)""")
def smaller_images(spark, sf_dir):
    """Each row of 64 features as an 8 x 8 image: every second pixel, and to 5 x 5 by the nearest one."""
    r = rows(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    second = r.select("vec_id", F.lit("second").alias("kind"), F.posexplode(X.every_second(F.col("x"), 8)).alias("place", "v"))
    return second.unionByName(r.select("vec_id", F.lit("nearest").alias("kind"), F.posexplode(X.nearest(F.col("x"), 8, 8, 5, 5)).alias("place", "v")))


@query(f"WITH {VEC}, l AS (SELECT label, ln(list_sum(list_transform(e[1:10], lambda x: exp(x)))) - e[label + 1] AS loss FROM v) SELECT label, round(avg(loss), 6) AS loss FROM l GROUP BY label")
def cross_entropy_loss(spark, sf_dir):
    """Mean loss of each class, the first ten features being the scores."""
    loss = X.cross_entropy(F.slice("x", 1, 10), F.col("label"))
    return rows(spark, sf_dir).groupBy("label").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("SELECT i AS input, (i // 7 + 4) * 15 + i % 7 + 4 AS neuron FROM range(45) t(i)")
def input_layout(spark, sf_dir):
    """Forty-five inputs in the middle of 15 x 15 neurons."""
    return spark.range(45).select(F.col("id").alias("input"), X.centred_layout(F.col("id"), 45, 15).alias("neuron"))


@query(f"""WITH {VEC}, a AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i, e[i] AS x FROM v, range(1, {DIM + 1}) t(i))
SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x) + CASE WHEN a.i = b.i THEN 0.5 ELSE 0.0 END, 5) AS value FROM a JOIN a b USING (vec_id) GROUP BY a.i, b.i
UNION ALL SELECT i, -1, round(sum(x * label), 5) FROM a GROUP BY i""")
def ridge_gram(spark, sf_dir):
    return X.gram(rows(spark, sf_dir), "x", F.col("label"), 0.5).select("i", "j", F.round("value", 5).alias("value"))


@query()
def ridge_readout(spark, sf_dir):
    """Training accuracy of a ridge readout of the labels."""
    data = rows(spark, sf_dir)
    w = X.ridge(data, "x", "label", 10)
    scores = F.array(*[F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w[:-1, k]]), lambda a, b: a.cast("double") * b), F.lit(float(w[-1, k])), lambda s, v: s + v) for k in range(w.shape[1])])
    return data.select("label", X.argmax(scores).alias("predicted")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("correct"))


@query()
def online_softmax_fit(spark, sf_dir):
    return X.fit_online(rows(spark, sf_dir).withColumn("replicate", F.col("vec_id") % 4), "vec_id", "x", "label", "softmax", 10, "replicate")


@query()
def online_rls_fit(spark, sf_dir):
    return X.fit_online(rows(spark, sf_dir).withColumn("replicate", F.col("vec_id") % 4), "vec_id", "x", "label", "rls", 10, "replicate")


@query(f"""WITH {VEC}, s AS (SELECT label AS sequence, vec_id AS step, list_transform(e, lambda x: abs(x)) AS a FROM v),
r AS (SELECT sequence, list({{'e': a, 'decision': CAST(-1 AS BIGINT), 'steps': 0}} ORDER BY step) AS l FROM s GROUP BY sequence),
f AS (SELECT sequence, list_reduce(list_prepend({{'e': list_transform(range({DIM}), lambda i: 0.0::DOUBLE), 'decision': CAST(-1 AS BIGINT), 'steps': 0}}, l), lambda x, y: CASE WHEN x.decision >= 0 THEN x ELSE
 {{'e': list_transform(range(1, {DIM + 1}), lambda i: x.e[i] * 0.95::DOUBLE + y.e[i]), 'decision': CASE WHEN list_max(list_transform(range(1, {DIM + 1}), lambda i: x.e[i] * 0.95::DOUBLE + y.e[i])) >= 3.0
  THEN list_position(list_transform(range(1, {DIM + 1}), lambda i: x.e[i] * 0.95::DOUBLE + y.e[i]), list_max(list_transform(range(1, {DIM + 1}), lambda i: x.e[i] * 0.95::DOUBLE + y.e[i]))) - 1 ELSE -1 END, 'steps': x.steps + 1}} END) AS o FROM r)
SELECT sequence, CAST(o.decision AS BIGINT) AS decision, o.steps AS steps FROM f""")
def evidence_rollout(spark, sf_dir):
    s = rows(spark, sf_dir).select(F.col("label").alias("sequence"), F.col("vec_id").alias("step"), F.transform("x", lambda v: F.abs(v.cast("double"))).alias("scores"))
    return X.evidence(s, "sequence", "step", "scores", 3.0, 0.95)


@query("""SELECT file, CASE WHEN file LIKE '%.spire.gz' THEN 'SPIREGZIP' WHEN file LIKE '%.spire.xz' THEN 'SPIREXZ' WHEN file LIKE '%.spire.bz2' THEN 'SPIREBZ2' WHEN file LIKE '%.spire' THEN 'SPIRE' ELSE 'NML_STANDARD' END AS format
FROM (SELECT p_name || CASE p_partkey % 5 WHEN 0 THEN '.spire' WHEN 1 THEN '.spire.gz' WHEN 2 THEN '.spire.xz' WHEN 3 THEN '.spire.bz2' ELSE '.dat' END AS file FROM part)""")
def codec_from_filename(spark, sf_dir):
    from ..sources.frames import format_of

    ending = F.element_at(F.array(*map(F.lit, (".spire", ".spire.gz", ".spire.xz", ".spire.bz2", ".dat"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat("p_name", ending).alias("file")).withColumn("format", format_of(F.col("file")))
