"""Queries over tables: scans, cohorts, class statistics, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.operators import cohort as K
from noteforge.operators import joins as J
from noteforge.operators import splits
from noteforge.plans.catalog import query
from noteforge.plans.inputs import documents
from noteforge.sources.readers import table


@query(
    "scan_notes",
    "SELECT 'note_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.txt' AS fname, text AS bow, n_chars FROM documents",
)
def scan_notes(spark, sf):
    name = F.concat(F.lit("note_"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".txt"))
    return table(spark, sf, "documents").select(name.alias("fname"), F.col("text").alias("bow"), "n_chars")


@query("scan_labels", "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label FROM labels")
def scan_labels(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("label")
    )


@query("notes_labels", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def notes_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return J.notes_with_labels(docs, table(spark, sf, "labels"), "doc_id")


@query(
    "match_counts",
    "SELECT count(d.doc_id) FILTER (l.doc_id IS NOT NULL) AS matched, count(d.doc_id) FILTER (l.doc_id IS NULL) AS notes_only, "
    "count(l.doc_id) FILTER (d.doc_id IS NULL) AS labels_only "
    "FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
def match_counts(spark, sf):
    return J.match_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("label_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def label_counts(spark, sf):
    return K.value_counts(table(spark, sf, "documents"), "lang")


def _meta(spark, sf):
    """Cohort metadata: language stands for the specialty, source for the author, quality for the sp flag."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("spDesc"), F.col("source").alias("author"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("sp")), "doc_id")


META_SQL = (
    "meta AS (SELECT d.doc_id, d.lang AS spDesc, d.source AS author, l.quality AS sp FROM documents d JOIN labels l USING (doc_id))"
)
TOP_SQL = (
    f"WITH {META_SQL}, kept AS (SELECT spDesc FROM meta WHERE spDesc IS NOT NULL GROUP BY spDesc ORDER BY count(*) DESC, spDesc LIMIT 2), "
    "cohort AS (SELECT doc_id, spDesc AS label FROM meta WHERE sp = 1 AND spDesc IN (SELECT spDesc FROM kept)) "
)


@query("cohort_topn", TOP_SQL + "SELECT doc_id, label FROM cohort")
def cohort_topn(spark, sf):
    meta = _meta(spark, sf)
    kept = K.top_categories(meta, "spDesc", 2)
    chosen = K.restrict_to(meta.where(F.col("sp") == 1), kept, "spDesc")
    return chosen.select("doc_id", F.col("spDesc").alias("label"))


@query(
    "cohort_minn",
    f"WITH {META_SQL}, kept AS (SELECT author FROM meta WHERE author IS NOT NULL GROUP BY author HAVING count(*) > 20) "
    "SELECT doc_id, author AS label FROM meta WHERE sp = 1 AND author IN (SELECT author FROM kept)",
)
def cohort_minn(spark, sf):
    meta = _meta(spark, sf)
    kept = K.frequent_categories(meta, "author", 20)
    chosen = K.restrict_to(meta.where(F.col("sp") == 1), kept, "author")
    return chosen.select("doc_id", F.col("author").alias("label"))


@query("cohort_stats", TOP_SQL + "SELECT count(DISTINCT label) AS categories, count(*) AS documents FROM cohort")
def cohort_stats(spark, sf):
    return K.cohort_stats(cohort_topn(spark, sf), "label", "doc_id")


@query(
    "class_weights",
    "WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) "
    "SELECT lang, n, round(sum(n) OVER () / n, 6) AS weight, round(sum(n) OVER () / n / count(*) OVER (), 6) AS balanced FROM c",
)
def class_weights(spark, sf):
    docs = table(spark, sf, "documents")
    plain = K.class_weights(docs, "lang")
    balanced = K.class_weights(docs, "lang", balanced=True)
    return plain.join(balanced.select("lang", F.col("weight").alias("balanced")), "lang").select(
        "lang", "n", F.round("weight", 6).alias("weight"), F.round("balanced", 6).alias("balanced")
    )


@query("label_index", "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label_idx FROM documents WHERE lang IS NOT NULL")
def label_index(spark, sf):
    return K.label_index(table(spark, sf, "documents").select("doc_id", "lang"), "lang")


@query(
    "label_onehot",
    "SELECT d.doc_id, c.lang AS class, CAST(d.lang = c.lang AS BIGINT) AS hit FROM documents d, "
    "(SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) c",
)
def label_onehot(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return K.label_onehot(docs, "lang", K.class_names(docs, "lang")).drop("lang")


# --- splits --------------------------------------------------------------------


@query(
    "kfold",
    "SELECT doc_id, lang, rep, (row_number() OVER (PARTITION BY rep, lang ORDER BY md5(doc_id || '|' || rep), doc_id) - 1) % 5 AS fold "
    "FROM documents, (SELECT unnest([1, 2]::BIGINT[]) AS rep)",
)
def kfold(spark, sf):
    return splits.stratified_folds(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 5, 2)


@query(
    "kfold_nulls",
    "SELECT doc_id, g, rep, (row_number() OVER (PARTITION BY rep, g ORDER BY md5(doc_id || '|' || rep), doc_id) - 1) % 5 AS fold "
    "FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS g FROM documents), (SELECT unnest([1, 2]::BIGINT[]) AS rep)",
)
def kfold_nulls(spark, sf):
    """Rows without a label are a stratum of their own."""
    return splits.stratified_folds(_partly_labelled(spark, sf), "doc_id", "g", 5, 2)


def _partly_labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("g"))


@query(
    "split_strat_nulls",
    "SELECT doc_id, g, CAST(row_number() OVER (PARTITION BY g ORDER BY md5(doc_id || '|42'), doc_id) <= "
    "round(0.7 * count(*) OVER (PARTITION BY g)) AS BIGINT) AS in_train "
    "FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS g FROM documents)",
)
def split_strat_nulls(spark, sf):
    docs = _partly_labelled(spark, sf)
    return splits.stratified_split(docs, "doc_id", "g").withColumn("in_train", F.col("in_train").cast("bigint"))


@query(
    "split_strat",
    "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= "
    "round(0.7 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS in_train FROM documents",
)
def split_strat(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return splits.stratified_split(docs, "doc_id", "lang").withColumn("in_train", F.col("in_train").cast("bigint"))


@query(
    "split_exact",
    "SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) <= round(0.7 * count(*) OVER ()) AS BIGINT) AS in_train "
    "FROM documents",
)
def split_exact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    train = splits.exact_split(docs, "doc_id").where("in_train").select("doc_id")
    test = splits.complement(docs, train, "doc_id")
    return train.withColumn("in_train", F.lit(1).cast("bigint")).unionByName(
        test.withColumn("in_train", F.lit(0).cast("bigint"))
    )


@query(
    "split_hash",
    "SELECT doc_id, CAST(('0x' || substr(md5(doc_id || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.7 AS BIGINT) AS in_train FROM documents",
)
def split_hash(spark, sf):
    docs = documents(spark, sf).select("doc_id")
    return splits.hash_split(docs, "doc_id").withColumn("in_train", F.col("in_train").cast("bigint"))
