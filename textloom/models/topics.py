"""Topic model over weighted terms (M1-M4)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stores import scratch


def pairs(weighed: DataFrame, scheme: str = "tf") -> DataFrame:
    """(doc_id, indices, values): the term ids of a document in order, and their weights that are not 0."""
    listed = F.array_sort(F.collect_list(F.when(F.col(scheme) != 0, F.struct(F.col("term_id").cast("int").alias("i"), F.col(scheme).cast("double").alias("w")))))
    rows = weighed.groupBy("doc_id").agg(listed.alias("p"))
    return rows.select("doc_id", F.transform("p", lambda x: x["i"]).alias("indices"), F.transform("p", lambda x: x["w"]).alias("values"))


def vectors(sparse: DataFrame, size: int) -> DataFrame:
    """(doc_id, features): sparse vectors over `size` features, of (doc_id, indices, values).

    A vector is stored as the struct that it is read from, so that files hold what is not 0 and no row passes Python."""
    spark, path = sparse.sparkSession, scratch(sparse.sparkSession, "vectors")
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    sparse.select("doc_id", parts.alias("features")).write.parquet(path)
    return spark.read.schema(T.StructType([sparse.schema["doc_id"], T.StructField("features", VectorUDT())])).parquet(path)


#: Mini-batches of a pass at most.  Each looks through all documents for its own, so that with batches of one size the
#: work of a pass would grow as the square of the table.
BATCHES = 20


def _dealt(features: DataFrame) -> DataFrame:
    """To all cores, where fewer tasks read them: a document takes `topics` numbers for each of its terms, many times over."""
    cores = features.sparkSession.sparkContext.defaultParallelism
    return features if features.rdd.getNumPartitions() >= cores else features.repartition(cores)


def fit(features: DataFrame, topics: int = 1000, passes: int = 50, batch: int = 4096, decay: float = 0.5, seed: int = 1234) -> LDAModel:
    """M1: online variational Bayes; iterations are mini-batches, so passes are divided by the share of a batch.

    Batches hold `batch` documents, and more where a pass would be cut into over `BATCHES` of them; a pass draws as many
    documents as there are either way."""
    features = _dealt(features).persist(StorageLevel.MEMORY_AND_DISK)  # read by each mini-batch
    share = min(1.0, max(batch / max(1, features.count()), 1 / BATCHES))
    model = LDA(k=topics, maxIter=max(1, round(passes / share)), optimizer="online", learningDecay=decay, subsamplingRate=share, seed=seed).fit(features)
    features.unpersist()
    return model


def transform(model: LDAModel, features: DataFrame) -> DataFrame:
    """M2: (doc_id, topics)."""
    return model.transform(_dealt(features)).select("doc_id", vector_to_array("topicDistribution").alias("topics"))


def name(scheme: str, topics: int, passes: int, decay: float) -> str:
    """M4: the parameters make the name."""
    return f"lda_{scheme}_topics_{topics}_passes_{passes}_decay_{decay}"


def save(model: LDAModel, path: str) -> None:
    """M3."""
    model.write().overwrite().save(path)


def load(path: str) -> LDAModel:
    return LocalLDAModel.load(path)
