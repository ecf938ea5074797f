"""Selection of documents: budgets, quotas, samples, diversity, and features for topics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import ship
from corvane.tables import fresh, materialize, ranged


def shuffle_key(seed: int, *ids: str) -> Column:
    """A fixed order for a seed: the digest of seed and id. Any cut of it is a prefix of a longer cut."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)).cast("binary"), 256)


def running_total(df: DataFrame, order: Sequence[str], cost: str, out: str = "running") -> DataFrame:
    """Running sums over all rows in an order, in two levels: within written ranges of the order, and over their totals."""
    rows, part, base = ranged(df, order, cost, "running")
    inner = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.col(base) + F.sum(cost).over(inner)).drop(part, base)


def budget_prefix(df: DataFrame, order: Sequence[str], cost: str, budget: int) -> DataFrame:
    """Rows in order until the first that would pass the budget; costs are not negative."""
    return running_total(df, order, cost).where(F.col("running") <= budget)


def scaled_quotas(df: DataFrame, group: str, arm: str, cost: str, budget: float) -> DataFrame:
    """For each group the least sum over arms (an absent arm has none), scaled so that quotas sum to the budget."""
    sums = df.groupBy(group, arm).agg(F.sum(cost).alias("s"))
    least = sums.groupBy(group).agg(F.min("s").alias("least"))
    return least.withColumn("quota", F.col("least") * budget / F.sum("least").over(Window.partitionBy(F.lit(0))))


def quota_fill(df: DataFrame, group: str, order: Sequence[str], cost: str, quota: Column | str) -> DataFrame:
    """In order within each group, take a row if it still fits and skip it if not.

    The fold is sequential by nature; rows of a group stream through one task in order, only the room left is kept.
    """
    ship(df.sparkSession)
    q = F.col(quota) if isinstance(quota, str) else quota
    rows = df.withColumn("__room", q.cast("double")).repartition(group).sortWithinPartitions(group, *order)
    at, cost_at = df.columns.index(group), df.columns.index(cost)

    def run(frames):
        last, room = object(), 0.0
        for pdf in frames:
            keep = np.zeros(len(pdf), dtype=bool)
            groups, costs, rooms = pdf.iloc[:, at].tolist(), pdf.iloc[:, cost_at].tolist(), pdf["__room"].tolist()
            for k, (g, c) in enumerate(zip(groups, costs)):
                if g != last:
                    last, room = g, rooms[k]
                if c <= room:
                    room -= c
                    keep[k] = True
            yield pdf.loc[keep].drop(columns="__room")

    return rows.mapInPandas(run, df.schema)


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each group (a window group limit drops the rest before the shuffle)."""
    (rank,) = fresh(df.columns, "rank")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, first: int | None = None) -> DataFrame:
    """Exactly n rows of each stratum without replacement, of its ``first`` rows by key if given."""
    pool = first_n(df, [stratum], [key], first) if first else df
    (mark,) = fresh(df.columns, "mark")
    mixed = pool.withColumn(mark, shuffle_key(seed, key))
    return first_n(mixed, [stratum], [mark], n).drop(mark)


def keep_longest(df: DataFrame, key: str, text: str, position: str) -> DataFrame:
    """One row a key: the longest text, the earliest of several."""
    return first_n(df, [key], [F.desc(F.length(text)), position], 1)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_n(df, key, order, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def greedy_diverse(df: DataFrame, group: str, position: str, vector: str, n: int = 5, threshold: float = 0.85) -> DataFrame:
    """Of the first n rows of a group, those whose cosine to every row kept before stays below the threshold."""
    ship(df.sparkSession)
    few = first_n(df, [group], [position], n)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        kept: list[int] = []
        unit = [np.asarray(v, dtype=float) / (np.linalg.norm(v) or 1.0) for v in pdf[vector]]
        for k, v in enumerate(unit):
            if all(float(v @ unit[j]) < threshold for j in kept):
                kept.append(k)
        return pdf.iloc[kept]

    return few.groupBy(group).applyInPandas(pick, df.schema)


def with_outliers(selected: DataFrame, df: DataFrame, topic: str, outlier: int = -1) -> DataFrame:
    """Rows outside any topic are kept whole beside the selected ones."""
    return selected.where(F.col(topic) != outlier).unionByName(df.where(F.col(topic) == outlier))


def terms(text: Column, stop: Sequence[str] = (), n: int = 2) -> Column:
    """Words of two letters or more and their pairs, lower-cased and without accents."""
    plain = F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    if n < 2:
        return words
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


#: Different terms that a task counts before it hands them on.
TERMS_HELD = 400_000


def _term_lists(batches):
    """(batch, terms of each row) of lines of words, as ``_weighted`` writes them."""
    for batch in batches:
        yield batch, (
            [x for line in text.split("\n") if line for ws in (line.split(" "),) for x in (*ws, *(f"{p} {q}" for p, q in zip(ws, ws[1:])))]
            for text in batch["w"].to_pylist())


def _weighted(df: DataFrame, key: str, text: str, min_df: int, max_df: float, max_features: int, stop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The kept terms (term, ix from 0), written, and every key (as ``k``) with the numbers and weights of its kept terms, in order of numbers.

    Spark finds the words. Pairs of words are made and counted where a text stands, so only counts of terms are shuffled, never
    pairs of key and term; the texts of a key that occurs more than once are gathered first.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    n = df.count()
    rows = df.select(F.col(key).alias("k"), F.array(text).alias("t"))
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        rows = df.groupBy(F.col(key).alias("k")).agg(F.collect_list(text).alias("t"))
    rows = rows.select("k", F.array_join(F.transform("t", lambda t: F.array_join(terms(t, stop, 1), " ")), "\n").alias("w"))

    def count(batches):
        tf, in_texts = Counter(), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(tf), pa.string()), pa.array([in_texts[t] for t in tf], pa.int64()), pa.array(list(tf.values()), pa.int64())], names=["term", "df", "tf"])
        for _, lists in _term_lists(batches):
            for found in lists:
                tf.update(found)
                in_texts.update(set(found))
                if len(tf) > TERMS_HELD:
                    yield out()
                    tf.clear()
                    in_texts.clear()
        yield out()

    counts = rows.select("w").mapInArrow(count, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("all"))
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).orderBy(F.desc("all"), "term").limit(max_features)
    kept = materialize(kept.select("term", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("ix"), "df"), "terms")  # at most ``max_features`` rows
    listed = kept.orderBy("ix").collect()
    known = df.sparkSession.sparkContext.broadcast(({r.term: r.ix for r in listed}, np.array([np.log((1.0 + n) / (1.0 + r.df)) + 1 for r in listed])))

    def scale(batches):
        numbers, idf = known.value
        for batch, lists in _term_lists(batches):
            pairs = [sorted((numbers[t], c) for t, c in Counter(found).items() if t in numbers) for found in lists]
            sizes = np.array([len(p) for p in pairs], dtype=np.int64)
            flat = np.array([x for p in pairs for x in p], dtype=np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(pairs)), sizes)
            w = (1 + np.log(flat[:, 1])) * idf[flat[:, 0]]
            w = w / np.sqrt(np.bincount(of, w * w, len(pairs)))[of]
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.ListArray.from_arrays(ends, pa.array(flat[:, 0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))], names=["k", "ix", "w"])

    shape = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("ix", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return kept, rows.mapInArrow(scale, shape)


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 5, max_df: float = 0.35, max_features: int = 60_000, stop: Sequence[str] = ()) -> DataFrame:
    """(key, term, weight): (1 + ln tf) times the smoothed idf, scaled to length one by row."""
    kept, rows = _weighted(df, key, text, min_df, max_df, max_features, stop)
    pairs = rows.select("k", F.explode(F.arrays_zip("ix", "w")).alias("x")).select("k", F.col("x.ix").alias("ix"), F.col("x.w").alias("w"))
    return pairs.join(F.broadcast(kept.select("ix", "term")), "ix").select(F.col("k").alias(key), "term", F.col("w").alias("weight"))


def kmeans_topics(df: DataFrame, vector: str, k: int, seed: int = 42, inits: int = 1) -> DataFrame:
    """Topics of length-one vectors by the best of ``inits`` k-means runs; topic numbers have no meaning across runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    ready = Normalizer(inputCol="__v", outputCol="__u").transform(df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))))
    models = [KMeans(k=k, seed=seed + i, featuresCol="__u", predictionCol="topic", maxIter=20).fit(ready) for i in range(inits)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(ready).drop("__v", "__u")


def lsa(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Vectors projected on their leading components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="__v", outputCol="__c").fit(ready).transform(ready).withColumn("components", vector_to_array("__c")).drop("__v", "__c")


def _vectors(df: DataFrame, key: str, text: str, features: int, min_df: int = 5, max_df: float = 0.35) -> DataFrame:
    """Every key (as ``k``) with its sparse vector ``features``, written: fits pass over it several times."""
    from pyspark.ml.linalg import VectorUDT

    kept, rows = _weighted(df, key, text, min_df, max_df, features)
    size = max(kept.count(), 1)

    @F.udf(VectorUDT())
    def sparse(ix, values):
        from pyspark.ml.linalg import Vectors

        return Vectors.sparse(size, ix, values)

    return materialize(materialize(rows, "tfidf").select("k", sparse("ix", "w").alias("features")), "vectors")


def tfidf_vectors(df: DataFrame, key: str, text: str, features: int = 60_000, min_df: int = 5, max_df: float = 0.35) -> DataFrame:
    """Every row with a sparse vector ``features`` of its weighted terms; a row without a kept term has an empty one."""
    made = _vectors(df, key, text, features, min_df, max_df)
    return df.join(made, F.col(key).eqNullSafe(made["k"])).select(*df.columns, "features")


def topics(df: DataFrame, key: str, column: str, method: str = "lsa", k: int = 800, components: int = 200, seed: int = 42, given: str = "topic", inits: int = 3, features: int = 2000) -> DataFrame:
    """The rows with a ``topic`` by one of three methods: ``lsa`` (texts), ``kmeans`` (vectors), ``given`` (a column named by a model outside).

    ``lsa`` weights the ``features`` commonest terms, projects them on their leading components, scales rows to length one and keeps the
    best of ``inits`` k-means runs. Density models have no form in Spark; their topics come in by ``given``.
    """
    if method == "given":
        return df.withColumn("topic", F.col(given))
    if method == "kmeans":
        return kmeans_topics(df, column, k, seed, inits)
    if method != "lsa":
        raise ValueError(f"unknown method: {method}")
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    ready = _vectors(df, key, column, features)
    projected = PCA(k=components, inputCol="features", outputCol="__c").fit(ready).transform(ready)
    projected = materialize(projected.select("k", vector_to_array("__c").alias("components")), "components")
    found = kmeans_topics(projected, "components", k, seed, inits).select("k", "topic")
    return df.join(found, F.col(key).eqNullSafe(found["k"])).select(*df.columns, "topic")


def seeded_pick(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """The first row of a seeded order."""
    return df.orderBy(shuffle_key(seed, *keys)).limit(1)
