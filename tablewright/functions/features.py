"""Feature encoders over DataFrames, and the way from vectors back to rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import feature as mlf
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.operators.columns import model_columns
from tablewright.operators.ordering import numbered, running_total
from tablewright.storage import cut_lineage

# Up to this many categories an indexer may keep them on the driver.
DRIVER_CATEGORIES = 10_000


def vector_rows(
    df: DataFrame, keys: Sequence[str], vector: str, digits: int = 6, name: str = "value"
) -> DataFrame:
    """One row per vector slot: keys, position, rounded value."""
    exploded = df.select(*keys, F.posexplode(vector_to_array(vector)).alias("pos", name))
    return exploded.withColumn(name, F.round(name, digits) + F.lit(0.0))


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Numeric and vector columns joined into one vector."""
    return mlf.VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def array_vector(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    """An array column as a vector column."""
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))


# --- tokens -----------------------------------------------------------------


def tokenize(df: DataFrame, text: str, output: str = "words") -> DataFrame:
    """Lower-case, split on white space."""
    return mlf.Tokenizer(inputCol=text, outputCol=output).transform(df)


def regex_tokenize(
    df: DataFrame, text: str, output: str = "words", pattern: str = r"\W"
) -> DataFrame:
    """Lower-case, split on a pattern."""
    return mlf.RegexTokenizer(inputCol=text, outputCol=output, pattern=pattern).transform(df)


def remove_stop_words(
    df: DataFrame, tokens: str, output: str = "filtered", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """Leave out stop words; the English list by default."""
    words = list(stop_words or mlf.StopWordsRemover.loadDefaultStopWords("english"))
    remover = mlf.StopWordsRemover(
        inputCol=tokens, outputCol=output, stopWords=words, locale="en_US"
    )
    return remover.transform(df)


def ngrams(df: DataFrame, tokens: str, n: int = 2, output: str = "ngrams") -> DataFrame:
    return mlf.NGram(n=n, inputCol=tokens, outputCol=output).transform(df)


def hashed_tfidf(
    df: DataFrame,
    tokens: str,
    buckets: int = 1 << 10,
    least_documents: int = 0,
    output: str = "tfidf",
) -> DataFrame:
    """Hashed term frequencies weighted by inverse document frequency."""
    counted = mlf.HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=buckets).transform(df)
    idf = mlf.IDF(inputCol="_tf", outputCol=output, minDocFreq=least_documents).fit(counted)
    return idf.transform(counted).drop("_tf")


def word2vec_model(
    df: DataFrame,
    tokens: str,
    size: int = 100,
    least_count: int = 5,
    partitions: int | None = None,
    seed: int = 1,
    output: str = "vector",
) -> mlf.Word2VecModel:
    """Word embedding; its `transform` gives the mean vector of a row's words."""
    learner = mlf.Word2Vec(
        vectorSize=size,
        minCount=least_count,
        numPartitions=partitions or df.sparkSession.sparkContext.defaultParallelism,
        seed=seed,
        inputCol=tokens,
        outputCol=output,
    )
    return learner.fit(df)


def vocabulary_of(counts: DataFrame, size: int | None = None, least_documents: float = 1.0, documents: int | None = None) -> DataFrame:
    """(term, code, n, documents) of (row, term, n): codes from 0 by falling n, ties by term.

    The terms are counted and numbered by Spark and stay a table.  A
    `least_documents` below 1 is a share of `documents`.
    """
    if least_documents < 1 and documents is None:
        raise ValueError("a share of the documents needs their number")
    least = least_documents if least_documents >= 1 else least_documents * documents
    terms = counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents")).where(F.col("documents") >= least)
    coded = numbered(terms, [F.col("n").desc(), F.col("term").asc()], name="code", start=0)
    kept = coded if size is None else coded.where(F.col("code") < size)
    return kept.select("term", F.col("code").cast("long").alias("code"), "n", "documents")


def row_terms(df: DataFrame, row: str, tokens: str) -> DataFrame:
    """(row, term, n): how often each term stands in each row; null tokens are none."""
    terms = df.select(F.col(row).alias("row"), F.explode(tokens).alias("term")).where("term is not null")
    return terms.groupBy("row", "term").agg(F.count("*").alias("n"))


def learnt_counts(df: DataFrame, row: str, tokens: str, size: int | None = None, least_documents: float = 1.0) -> DataFrame:
    """(row, code, term, n) over a learnt vocabulary of any size, which goes to no one task and not to the driver."""
    # In order of terms they are packed tighter, in the table and when they are sent to the codes.
    counts = cut_lineage(row_terms(df, row, tokens).sortWithinPartitions("term"), "row-terms")
    documents = df.count() if least_documents < 1 else None
    codes = vocabulary_of(counts, size, least_documents, documents)
    return counts.join(codes.select("term", "code"), "term").select("row", "code", "term", "n")


def count_vectors(
    df: DataFrame,
    tokens: str,
    size: int | None = None,
    least_documents: float = 1.0,
    vocabulary: Sequence[str] | None = None,
    output: str = "counts",
) -> DataFrame:
    """Term count vectors over a learnt or a given vocabulary; without a size, every term is learnt."""
    if vocabulary is not None:
        model = mlf.CountVectorizerModel.from_vocabulary(
            list(vocabulary), inputCol=tokens, outputCol=output
        )
        return model.transform(df)
    marked = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "marked-rows")
    found = cut_lineage(learnt_counts(marked, "_row", tokens, size, least_documents), "learnt-counts")
    width = found.select("code").distinct().count()

    @F.udf(VectorUDT())
    def vector(pairs):
        return Vectors.sparse(width, [(int(p["code"]), float(p["n"])) for p in pairs or []])

    # A row's distinct terms, no more than the row holds.
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("_pairs"))
    joined = marked.join(lists, marked["_row"] == lists["row"], "left")
    return joined.withColumn(output, vector("_pairs")).drop("_row", "row", "_pairs")


# --- numbers and vectors ----------------------------------------------------


def binarize(df: DataFrame, column: str, threshold: float = 0.5, output: str = "flag") -> DataFrame:
    return mlf.Binarizer(threshold=threshold, inputCol=column, outputCol=output).transform(df)


def polynomial(
    df: DataFrame, vector: str, degree: int = 3, output: str = "expanded"
) -> DataFrame:
    return mlf.PolynomialExpansion(degree=degree, inputCol=vector, outputCol=output).transform(df)


def dct(df: DataFrame, vector: str, inverse: bool = False, output: str = "dct") -> DataFrame:
    return mlf.DCT(inverse=inverse, inputCol=vector, outputCol=output).transform(df)


def index_slots(
    df: DataFrame, vector: str, max_categories: int = 20, output: str = "indexed"
) -> DataFrame:
    """Slots with few distinct values become category codes."""
    indexer = mlf.VectorIndexer(
        inputCol=vector, outputCol=output, maxCategories=max_categories, handleInvalid="keep"
    )
    return indexer.fit(df).transform(df)


def normalize(df: DataFrame, vector: str, p: float = 1.0, output: str = "normed") -> DataFrame:
    return mlf.Normalizer(p=p, inputCol=vector, outputCol=output).transform(df)


def scale_standard(df: DataFrame, vector: str, output: str = "scaled") -> DataFrame:
    """Divide each slot by its sample deviation, without centring."""
    scaler = mlf.StandardScaler(withStd=True, withMean=False, inputCol=vector, outputCol=output)
    return scaler.fit(df).transform(df)


def scale_minmax(df: DataFrame, vector: str, output: str = "scaled") -> DataFrame:
    """Each slot to [0, 1]; a constant slot becomes 0.5."""
    return mlf.MinMaxScaler(inputCol=vector, outputCol=output).fit(df).transform(df)


def scale_maxabs(df: DataFrame, vector: str, output: str = "scaled") -> DataFrame:
    """Each slot to [-1, 1] by its largest absolute value."""
    return mlf.MaxAbsScaler(inputCol=vector, outputCol=output).fit(df).transform(df)


def bucketize(
    df: DataFrame, column: str, splits: Sequence[float], output: str = "bucket"
) -> DataFrame:
    return mlf.Bucketizer(splits=list(splits), inputCol=column, outputCol=output).transform(df)


def elementwise_product(
    df: DataFrame, vector: str, weights: Sequence[float], output: str = "product"
) -> DataFrame:
    from pyspark.ml.linalg import Vectors

    product = mlf.ElementwiseProduct(
        scalingVec=Vectors.dense(list(weights)), inputCol=vector, outputCol=output
    )
    return product.transform(df)


def exact_quantiles(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner borders of equal-depth buckets: the value at rank ceil(i / buckets * n).

    Distinct values are counted first and ranked by a distributed running
    total; only the borders come to the driver.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, [column], "_n", "_upto")
    total = ranked.agg(F.max("_upto")).scalar()
    ranks = [F.ceil(F.lit(i / buckets) * total) for i in range(1, buckets)]
    borders = ranked.agg(
        *[
            F.min(F.when(F.col("_upto") >= rank, F.col(column))).alias(f"b{i}")
            for i, rank in enumerate(ranks)
        ]
    ).first()
    return sorted({float(b) for b in borders if b is not None})


def quantile_buckets(
    df: DataFrame, column: str, buckets: int = 3, output: str = "bucket"
) -> DataFrame:
    """Bucket number by exact quantiles; equal values share a bucket."""
    splits = [-math.inf, *exact_quantiles(df, column, buckets), math.inf]
    return bucketize(df, column, splits, output)


def slice_vector(
    df: DataFrame,
    vector: str,
    indices: Sequence[int] = (),
    names: Sequence[str] = (),
    output: str = "sliced",
) -> DataFrame:
    """Vector slots by index or by slot name."""
    slicer = mlf.VectorSlicer(
        inputCol=vector, outputCol=output, indices=list(indices), names=list(names)
    )
    return slicer.transform(df)


def apply_formula(df: DataFrame, formula: str) -> DataFrame:
    """Label and features of a formula such as ``clicked ~ country + hour``."""
    return mlf.RFormula(formula=formula, featuresCol="features", labelCol="label").fit(df).transform(df)


def select_by_chi_square(
    df: DataFrame, vector: str, label: str, k: int = 2, output: str = "selected"
) -> mlf.UnivariateFeatureSelectorModel:
    """The k categorical slots most dependent on a categorical label."""
    selector = mlf.UnivariateFeatureSelector(
        featuresCol=vector, labelCol=label, outputCol=output, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k)
    return selector.fit(df)


def run_statement(df: DataFrame, statement: str) -> DataFrame:
    """A SQL statement over ``__THIS__`` as a transform stage."""
    return mlf.SQLTransformer(statement=statement).transform(df)


# --- categories -------------------------------------------------------------


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 by falling frequency, ties by value.

    The distinct values are counted and numbered by Spark, so a column with
    as many categories as rows is no burden on the driver.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    codes = numbered(counts, [F.col("_n").desc(), F.col(column).asc()], name="code", start=0)
    return codes.select(F.col(column).alias("value"), F.col("code").cast("double").alias("code"))


def index_column(
    df: DataFrame, column: str, output: str, codes: DataFrame | None = None
) -> DataFrame:
    """Append the category code of a column; null stays null."""
    table = codes if codes is not None else category_codes(df, column)
    renamed = table.select(F.col("value").alias("_value"), F.col("code").alias(output))
    return df.join(renamed, df[column] == renamed["_value"], "left").drop("_value")


def unindex_column(df: DataFrame, column: str, codes: DataFrame, output: str) -> DataFrame:
    """Append the category a code stands for."""
    renamed = codes.select(F.col("code").alias("_code"), F.col("value").alias(output))
    return df.join(renamed, df[column] == renamed["_code"], "left").drop("_code")


def one_hot(df: DataFrame, index: str, output: str = "onehot", drop_last: bool = True) -> DataFrame:
    encoder = mlf.OneHotEncoder(inputCols=[index], outputCols=[output], dropLast=drop_last)
    return encoder.fit(df).transform(df)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def index_strings(
    df: DataFrame, columns: Sequence[str] | None = None, keep_null: bool = False
) -> DataFrame:
    """Replace string columns by their category codes, in place.

    Columns with few categories share one multi-column indexer; one with many
    is indexed by a join.  With `keep_null`, null gets the code after the last.
    """
    names = list(columns) if columns is not None else string_columns(df)
    if not names:
        return df
    spread = df.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    small = [n for n in names if spread[n] <= DRIVER_CATEGORIES]
    original = df.columns
    if small:
        coded = [f"_code_{n}" for n in small]
        indexer = mlf.StringIndexer(
            inputCols=small, outputCols=coded, handleInvalid="keep", stringOrderType="frequencyDesc"
        ).fit(df)
        labels = dict(zip(small, indexer.labelsArray))
        df = indexer.transform(df)
        replaced = {}
        for name, code in zip(small, coded):
            known = F.col(code) < len(labels[name])
            replaced[name] = F.col(code) if keep_null else F.when(known, F.col(code))
        df = df.withColumns(replaced).drop(*coded)
    for name in names:
        if name in small:
            continue
        codes = category_codes(df, name)
        df = index_column(df, name, f"_code_{name}", codes).drop(name)
        code = F.col(f"_code_{name}")
        if keep_null:
            code = F.coalesce(code, codes.agg(F.count("*").cast("double")).scalar())
        df = df.withColumn(name, code).drop(f"_code_{name}")
    return df.select(*original)


def number_or_zero(df: DataFrame, name: str) -> Column:
    """A numeric column as double, null as 0; any other type counts as 0."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def label_features(
    df: DataFrame,
    targets: Sequence[str],
    features: Sequence[str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Label and feature vector of a table.

    The label is the first target the table has; the features are the listed
    columns it has, without the targets, in the order given.  String columns
    are indexed; null counts as 0.
    """
    chosen = model_columns(df.columns, targets, features)
    if not chosen["targets"] or not chosen["features"]:
        raise ValueError("the table has none of the targets or none of the features")
    used = [chosen["targets"][0], *chosen["features"]]
    strings = [c for c in string_columns(df) if c in used and c not in keep]
    coded = index_strings(df.select(*dict.fromkeys([*keep, *used])), strings)
    values = F.array(*[number_or_zero(coded, c) for c in chosen["features"]])
    return coded.select(
        *keep,
        number_or_zero(coded, chosen["targets"][0]).alias("label"),
        array_to_vector(values).alias("features"),
    )
