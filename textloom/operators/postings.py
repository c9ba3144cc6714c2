"""Postings, term selection and weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from . import packs

SCHEMES = ("tf", "sublinear_tf", "tf_idf", "sublinear_tf_idf", "bm25")
K1, B = 1.5, 0.75
#: Terms that may be broadcast to filter tokens before they are counted.
BROADCAST_TERMS = 100_000
#: Characters of text whose terms a task makes, and whose postings a task sorts, about: both fit its memory.
CHARS_MADE, CHARS_SORTED = 16_000_000, 8_000_000


def grown(rows: DataFrame) -> DataFrame:
    """Rows made by an explode: to be joined by shuffles, for Spark takes them to be as few as what they were made of
    and would send them to every task."""
    return rows.hint("merge")


def term_arrays(docs: DataFrame, tokens: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, terms): all terms of a document in one row, so that they are counted where they are made.

    Only rows that share a doc_id are brought together; whether there are any is asked of the ids alone."""
    made = X.terms(X.simple_tokens(F.col("text")) if tokens is None else tokens)
    rows = dealt(docs).select("doc_id", *carry, made.alias("terms"))
    return rows if unique_ids(docs) else rows.groupBy("doc_id", *carry).agg(F.flatten(F.collect_list("terms")).alias("terms"))


def dealt(docs: DataFrame) -> DataFrame:
    """Documents in tasks of about CHARS_MADE characters; tables that are cut as fine as that stay as they lie."""
    tasks = _tasks(docs, CHARS_MADE)
    return docs if docs.rdd.getNumPartitions() >= tasks else docs.repartition(tasks, "doc_id")


def _tasks(docs: DataFrame, chars: int) -> int:
    told = docs.agg(F.sum("len" if "len" in docs.columns else F.length("text").cast("long"))).first()[0]
    return max(1, -(-(told or 0) // chars))


def unique_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)


def postings(docs: DataFrame, tokens: Column | None = None, only: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, tf), counted inside the row of each document, with no shuffle.  `only`: terms (term) to
    keep.  `carry`: columns of the document that its postings keep, so that they need not be joined later."""
    if tokens is None:
        columns = ["doc_id", *carry]
        each = lowered(docs, *columns).mapInArrow(packs.postings(columns, K.STOPWORDS), f"term string, {_kinds(docs, columns)}, tf long")
    else:
        each = term_arrays(docs, tokens, carry).select("doc_id", *carry, F.inline(X.counted(F.col("terms"))).alias("term", "tf"))
    if only is not None:
        few = len(only.take(BROADCAST_TERMS + 1)) <= BROADCAST_TERMS
        each = each.join(F.broadcast(only) if few else only, "term", "left_semi")
    return each.select("term", "doc_id", *carry, "tf")


def _kinds(rows: DataFrame, columns: list[str], kind: str = "{}") -> str:
    return ", ".join(f"`{c}` {kind.format(rows.schema[c].dataType.simpleString())}" for c in columns)


def lowered(docs: DataFrame, *columns: str) -> DataFrame:
    """(columns, texts): the texts of each document in lower case.  Tasks hold a slice of their texts at a time, so that the
    table stays as it lies; only rows that share a doc_id are brought together."""
    rows = docs.select(*columns, F.array(F.lower("text")).alias("texts"))
    if "doc_id" not in columns or unique_ids(docs):
        return rows
    return rows.groupBy(*columns).agg(F.flatten(F.collect_list("texts")).alias("texts"))


def _sorted_tasks(docs: DataFrame) -> int:
    return max(_tasks(docs, CHARS_SORTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def class_counts(docs: DataFrame, more_than: int = 0) -> DataFrame:
    """(term, class, a): documents of each class with a term, of rows (doc_id, text, class), each document once, and of
    terms in more than `more_than` documents.  Terms are counted in the task that makes them, and packed for the shuffle."""
    tasks = _sorted_tasks(docs)
    sent = lowered(docs, "class").mapInArrow(packs.packed_classes(K.STOPWORDS, packs.BUCKETS * tasks), _PACK + "class array<int>, n array<int>, names array<string>")
    return sent.repartition(tasks, "bucket").mapInArrow(packs.summed_classes(more_than), "term string, class string, a long")


def document_frequencies(rows: DataFrame, n_docs: int | None = None, more_than: int = 5) -> DataFrame:
    """(term, df) with df > 5 and df < number of documents.

    The counts are named, as plans that also use them elsewhere can then share the shuffle of the postings."""
    found = rows.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df")).where(F.col("df") > more_than)
    return found if n_docs is None else found.where(F.col("df") < n_docs)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, len), in characters."""
    return docs.select("doc_id", F.length("text").cast("long").alias("len"))


def average_length(docs: DataFrame) -> DataFrame:
    """Floor of the mean; with the number of documents."""
    return lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.expr("sum(len) div count(*)").alias("avg_len"))


def chi_squared(rows: DataFrame, doc_classes: DataFrame, n_docs: int, more_than: int = 5) -> DataFrame:
    """(term, df, chi), over classes (doc_id, class), by observed pairs of term and class only.

    A class without the term adds T C^2 / ((N - T)(N - C)); the sum of this over all classes is a constant, which the
    observed pairs correct.  Classes of all documents are undefined and left out."""
    totals = doc_classes.groupBy("class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < n_docs)
    constant = totals.agg(F.sum(F.pow("c", F.lit(2)) / (n_docs - F.col("c"))).alias("k"))
    frequent = document_frequencies(rows, n_docs, more_than)
    seen = grown(grown(rows.where("tf > 0")).join(frequent, "term")).join(doc_classes, "doc_id").groupBy("term", "df", "class").agg(F.count(F.lit(1)).alias("a"))
    seen = seen.join(totals, "class")
    t, c, a, n = F.col("df"), F.col("c"), F.col("a"), F.lit(float(n_docs))
    own = F.pow(a * n - t * c, F.lit(2)) / (t * (n - t) * (n - c)) - t / (n - t) * F.pow(c, F.lit(2)) / (n - c)
    corrected = seen.groupBy("term", "df").agg(F.sum(own).alias("own")).join(F.broadcast(constant))
    return corrected.select("term", "df", (t / (n - t) * F.col("k") + F.col("own")).alias("chi"))


def chi_squared_once(docs: DataFrame, n_docs: int, more_than: int = 5) -> DataFrame:
    """As `chi_squared`, for rows (doc_id, text, class) with each document once and so in one class.

    df is then the sum of a over the classes, and with N a - T C multiplied out the sums over classes need no T: terms
    are counted by class and added up, and no posting is shuffled or joined."""
    seen, totals, constant = _by_class(docs, n_docs, more_than)
    a, c = F.col("a"), F.col("c")
    sums = seen.groupBy("term").agg(F.sum("a").alias("df"), F.sum(a * a / (n_docs - c)).alias("squares"), F.sum(a * c / (n_docs - c)).alias("products"))
    t, n = F.col("df"), F.lit(float(n_docs))
    chi = t / (n - t) * F.col("k") + n * n / (t * (n - t)) * F.col("squares") - 2 * n / (n - t) * F.col("products")
    frequent = sums.where((t > more_than) & (t < n_docs) & F.col("squares").isNotNull())
    return frequent.join(F.broadcast(constant)).select("term", "df", chi.alias("chi"))  # one row


def chi_squared_dense_once(docs: DataFrame, n_docs: int, more_than: int = 5) -> DataFrame:
    """As `chi_squared_dense`, for rows (doc_id, text, class) with each document once; every class is looked up in the
    counts of a term, which meet in one row with those of all classes."""
    seen, totals, _ = _by_class(docs, n_docs, more_than)
    every = totals.agg(F.collect_list(F.struct("class", "c")).alias("every"))  # a row for each class
    held = seen.groupBy("term").agg(F.sum("a").alias("df"), F.collect_list(F.when(F.col("c").isNotNull(), F.struct("class", "a"))).alias("seen"))
    held = held.where((F.col("df") > more_than) & (F.col("df") < n_docs)).join(F.broadcast(every)).where(F.size("every") > 0)
    t, n = F.col("df"), F.lit(float(n_docs))

    def value(x: Column, a: Column) -> Column:
        c = x["c"]
        b, c_not, d = t - a, c - a, n - t - c + a
        return c / n * n * F.pow(a * d - b * c_not, F.lit(2)) / (t * (n - t) * c * (n - c))

    counts = F.map_from_entries("seen")
    added = F.aggregate("every", F.lit(0.0), lambda s, x: s + X.let(F.coalesce(F.try_element_at("counts", x["class"]), F.lit(0).cast("long")), lambda a: value(x, a)))
    return held.withColumn("counts", counts).select("term", "df", added.alias("chi"))


def _by_class(docs: DataFrame, n_docs: int, more_than: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, class, a, c), with no c where the class is undefined; (class, c); and the constant k."""
    totals = docs.groupBy("class").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") < n_docs) & F.col("class").isNotNull())
    constant = totals.agg(F.sum(F.pow("c", F.lit(2)) / (n_docs - F.col("c"))).alias("k"))
    return class_counts(docs, more_than).join(totals, "class", "left"), totals, constant


def chi_squared_dense(rows: DataFrame, doc_classes: DataFrame, n_docs: int, more_than: int = 5) -> DataFrame:
    """W6 as it is defined, over every pair of term and class; for comparison."""
    totals = doc_classes.groupBy("class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < n_docs)
    frequent = document_frequencies(rows, n_docs, more_than)
    seen = grown(grown(rows).join(frequent, "term", "left_semi")).join(doc_classes, "doc_id").groupBy("term", "class").agg(F.count(F.lit(1)).alias("a"))
    every = frequent.crossJoin(totals).join(seen, ["term", "class"], "left").fillna(0, ["a"])
    t, c, a, n = F.col("df"), F.col("c"), F.col("a"), F.lit(float(n_docs))
    b, c_not, d = t - a, c - a, n - t - c + a
    value = c / n * n * F.pow(a * d - b * c_not, F.lit(2)) / (t * (n - t) * c * (n - c))
    return every.groupBy("term", "df").agg(F.sum(value).alias("chi"))


def top_terms(chi: DataFrame, k: int = 10_000) -> DataFrame:
    """The k best terms with an id in their order; ties by term.  k bounds the result."""
    best = chi.orderBy(F.desc(F.round("chi", 6)), "term").limit(k)
    return best.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc(F.round("chi", 6)), "term")) - 1)


def sized(docs: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """`docs` with len and split; without `splits` all are for training, with them documents of none have a null."""
    own = docs.withColumn("len", F.length("text").cast("long"))
    return own.withColumn("split", F.lit("training")) if splits is None else own.join(splits.select("doc_id", "split"), "doc_id", "left")


def weights(rows: DataFrame, docs: DataFrame, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """(doc_id, term, split, tf, and the four other schemes) of postings; `docs` are sized (len, split).

    df counts inside the split, N counts training documents; the idf floors its ratio; where N < df the idf is 0.
    Postings that carry len and split are not joined with their documents again.  Without the schemes that ask for df
    no posting is shuffled."""
    return _weighed(rows, docs, schemes, exact=False)


def weights_of(docs: DataFrame, schemes: tuple[str, ...] = SCHEMES) -> DataFrame:
    """As `weights`, of all postings of `docs` (doc_id, text, len, split), which are packed where they are made."""
    if not _counts_df(schemes):
        return weights(postings(docs, carry=("len", "split")), docs, schemes)
    columns, tasks = _columns(schemes), _sorted_tasks(docs)
    own = [c for c in columns if c != "tf"]
    kinds, fixed = f"{_kinds(docs, own)}, tf long", _fixed(docs, own) | {"tf": "i8"}
    made = lowered(docs.where("split is not null"), *own).mapInArrow(packs.packed_postings(own, K.STOPWORDS, packs.BUCKETS * tasks, fixed), _pressed(docs, own, fixed))
    return _scored(_met(made, columns, kinds, tasks, fixed), docs, schemes, exact=False)


def exact_weights(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """As `weights`, but the idf divides exactly."""
    return _weighed(rows, docs, SCHEMES, exact=True)


_PACK = "bucket int, terms binary, sizes array<int>, k array<int>, "


#: Numbers that packs press together, as numpy names them.
_NUMBERS = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


def _fixed(rows: DataFrame, columns: list[str]) -> dict[str, str]:
    kinds = {c: "int" if c == "split" else rows.schema[c].dataType.simpleString() for c in columns}  # its place in `names`
    return {c: _NUMBERS[k] for c, k in kinds.items() if k in _NUMBERS}


def _pressed(rows: DataFrame, columns: list[str], fixed: dict[str, str]) -> str:
    rest = [_kinds(rows, [c], "array<{}>") for c in columns if c not in fixed]
    return ", ".join(["bucket int, pack binary", *rest, "names array<string>"])


def _counts_df(schemes: tuple[str, ...]) -> bool:
    return not set(schemes) <= {"tf", "sublinear_tf"}


def _columns(schemes: tuple[str, ...]) -> list[str]:
    """What postings hold beside their term to be weighed."""
    return ["doc_id", "split", *(["len"] if "bm25" in schemes else []), "tf"]


def _met(sent: DataFrame, columns: list[str], kinds: str, tasks: int, fixed: dict[str, str]) -> DataFrame:
    """One shuffle, of packs: the postings of a term meet in one task, which counts them."""
    return sent.repartition(tasks, "bucket").mapInArrow(packs.frequencies(columns, fixed), f"term string, {kinds}, df long")


def _weighed(rows: DataFrame, docs: DataFrame, schemes: tuple[str, ...], exact: bool) -> DataFrame:
    carried = {"len", "split"} <= set(rows.columns)
    per_split = (rows if carried else grown(rows).join(docs.select("doc_id", "len", "split"), "doc_id")).where("split is not null")
    if _counts_df(schemes):
        columns, tasks = _columns(schemes), _sorted_tasks(docs)
        fixed = _fixed(per_split, columns)
        sent = per_split.select("term", *columns).mapInArrow(packs.packed_rows(columns, packs.BUCKETS * tasks, fixed), _pressed(per_split, columns, fixed))
        per_split = _met(sent, columns, _kinds(per_split, columns), tasks, fixed)
    return _scored(per_split, docs, schemes, exact)


def _scored(rows: DataFrame, docs: DataFrame, schemes: tuple[str, ...], exact: bool) -> DataFrame:
    """The schemes of postings (doc_id, term, split, tf, and df and len where they are asked for)."""
    tf, n, d = F.col("tf"), F.col("n"), F.col("df")
    sublinear = F.log10(1 + tf)
    made = {"tf": tf.cast("double"), "sublinear_tf": sublinear}
    if _counts_df(schemes):
        training = F.count(F.when(F.col("split") == "training", 1))
        totals = docs.agg(training.alias("n"), F.expr("sum(len) div count(*)").alias("avg_len"))
        rows = rows.join(F.broadcast(totals))  # one row
        ratio = (n + 1) / (d + 1) if exact else F.floor((n + 1) / (d + 1))
        idf = F.when(ratio > 0, F.log10(F.when(ratio > 0, ratio))).otherwise(0.0)
        length = F.col("len") if "bm25" in schemes else F.lit(0)
        okapi = F.log10(F.greatest(F.lit(1.0), (n - d + 0.5) / (d + 0.5)))
        bm25 = okapi * ((K1 + 1) * tf / (K1 * (1 - B + B * length / F.col("avg_len")) + tf))
        made |= {"tf_idf": tf * idf, "sublinear_tf_idf": sublinear * idf, "bm25": bm25}
    return rows.select("doc_id", "term", "split", *[made[s].alias(s) for s in SCHEMES if s in schemes])


def stacked(weighed: DataFrame) -> DataFrame:
    """(doc_id, term, split, scheme, weight)."""
    return weighed.unpivot(["doc_id", "term", "split"], list(SCHEMES), "scheme", "weight")


def doc_index(weighed: DataFrame, scheme: str = "tf") -> DataFrame:
    """(doc_id, terms map<term_id, weight>), of weights that carry a term_id."""
    pairs = F.array_sort(F.collect_list(F.struct("term_id", F.col(scheme).alias("weight"))))
    return weighed.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("terms"))


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 ranking of documents for each query (item_id, text): (item_id, doc_id, score, rank) of the k best, ties by
    doc_id.  Only postings of words that are asked for are made.  Scores are sums of decimals, the same in any order."""
    asked = queries.select("item_id", F.explode(F.array_distinct(X.simple_tokens(F.col("text")))).alias("term"))
    own = sized(docs)
    weighed = weights(postings(own, only=asked.select("term").distinct(), carry=("len", "split")), own).select("doc_id", "term", F.col("bm25").cast("decimal(24,12)").alias("bm25"))
    scored = grown(weighed).join(asked, "term").groupBy("item_id", "doc_id").agg(F.sum("bm25").cast("decimal(20,6)").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.col("score").cast("double"))
