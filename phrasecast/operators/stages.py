"""Feature blocks as stages of an ML pipeline: each fits its tables and adds one vector column.

    Pipeline(stages=[TextBlock(inputCols=["text"], outputCol="t"), CategoryBlock(inputCols=["speaker"], outputCol="c"),
                     VectorAssembler(inputCols=["t", "c"], outputCol="features"), LogisticRegression()])

The fitted state is what the functions of ``features`` fit, kept as tables and saved as Parquet beside the parameters, so a
pipeline that holds these stages is saved and loaded like any other. Rows need a unique id column (``rowId``).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasecast.operators import features as fx
from phrasecast.operators.indicators import fill_gaps, fit_fills
from phrasecast.session import materialize


class _BlockParams(HasInputCols, HasOutputCol):
    rowId = Param(Params._dummy(), "rowId", "column that names a row", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(rowId="segment_id", outputCol="features")

    def _rows(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.getOrDefault(self.rowId)).alias("row_id"), *self.getInputCols())


class _ModelWriter(MLWriter):
    def __init__(self, instance: "BlockModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"size": self.instance.size, "tables": sorted(self.instance.tables)})
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path.rstrip('/')}/tables/{name}")


class _ModelReader(MLReader):
    def __init__(self, cls: type["BlockModel"]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "BlockModel":
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        tables = {name: spark.read.parquet(f"{path.rstrip('/')}/tables/{name}") for name in metadata["tables"]}
        model = self.cls(tables, metadata["size"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class BlockModel(Model, _BlockParams, MLWritable, MLReadable):
    """A fitted block: its tables (always with ``index``) and the length of its vectors."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, size: int = 0):
        super().__init__()
        self.tables, self.size = tables or {}, size
        self._defaults()

    def _cells(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.withColumn("row_id", F.col(self.getOrDefault(self.rowId)))
        for taken in {"features", "row_id"} & set(dataset.columns):
            raise ValueError(f"the column {taken!r} is needed by the block; rename it")
        out = fx.feature_vectors(rows, self._cells(self._rows(dataset)), self.tables["index"], self.size)
        return out.drop("row_id").withColumnRenamed("features", self.getOutputCol())

    def names(self) -> list[str]:
        """Feature names by place in the vector."""
        return [row["feature"] for row in self.tables["index"].orderBy("index").collect()]

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _Block(Estimator, _BlockParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the tables of a block on the rows of a table."""

    _model: type[BlockModel]

    def _tables(self, rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """The fitted tables and the names of the features."""
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> BlockModel:
        tables, names = self._tables(self._rows(dataset))
        index = materialize(fx.feature_index(names), "index")
        size = index.count()
        if size == 0:
            raise ValueError(f"{type(self).__name__} found no features")
        return self._copyValues(self._model({**tables, "index": index}, size))


class _TextParams(_BlockParams):
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)
    minDf = Param(Params._dummy(), "minDf", "least number (int) or share (float) of rows")
    maxDf = Param(Params._dummy(), "maxDf", "greatest number (int) or share (float) of rows")
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most terms, 0 for no cap", TypeConverters.toInt)
    sublinear = Param(Params._dummy(), "sublinear", "1 + log of term counts", TypeConverters.toBoolean)
    lowercase = Param(Params._dummy(), "lowercase", "fold case", TypeConverters.toBoolean)

    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(low=1, high=2, minDf=2, maxDf=0.9, maxFeatures=0, sublinear=True, lowercase=True)

    def _counts(self, rows: DataFrame) -> DataFrame:
        grams = (self.getOrDefault(self.low), self.getOrDefault(self.high))
        (text,) = self.getInputCols()
        return fx.term_counts(rows, "row_id", text, grams, self.getOrDefault(self.lowercase))


class TextBlockModel(BlockModel, _TextParams):
    def _cells(self, rows: DataFrame) -> DataFrame:
        cap = self.getOrDefault(self.maxFeatures) or None
        return fx.tfidf(self._counts(rows), self.tables["vocabulary"], cap, self.getOrDefault(self.sublinear))


class TextBlock(_Block, _TextParams):
    """TF-IDF of one text column."""

    _model = TextBlockModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", rowId="segment_id", low=1, high=2, minDf=2, maxDf=0.9, maxFeatures=0, sublinear=True, lowercase=True):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _tables(self, rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        counts = materialize(self._counts(rows), "counts")
        n_docs = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        cap = self.getOrDefault(self.maxFeatures) or None
        vocabulary = fx.fit_tfidf(counts, n_docs, self.getOrDefault(self.minDf), self.getOrDefault(self.maxDf), cap)
        vocabulary = materialize(vocabulary, "vocabulary")
        return {"vocabulary": vocabulary}, fx.text_names(vocabulary)


class _CategoryParams(_BlockParams):
    drop = Param(Params._dummy(), "drop", "none, first or if_binary", TypeConverters.toString)
    unknown = Param(Params._dummy(), "unknown", "ignore or error", TypeConverters.toString)

    def _defaults(self) -> None:
        super()._defaults()
        self._setDefault(drop="none", unknown="ignore")


class CategoryBlockModel(BlockModel, _CategoryParams):
    def _cells(self, rows: DataFrame) -> DataFrame:
        return fx.one_hot(rows, "row_id", self.getInputCols(), self.tables["levels"], self.getOrDefault(self.unknown))


class CategoryBlock(_Block, _CategoryParams):
    """One column per known level of the input columns."""

    _model = CategoryBlockModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", rowId="segment_id", drop="none", unknown="ignore"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _tables(self, rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        drop = self.getOrDefault(self.drop)
        levels = materialize(fx.fit_one_hot(rows, "row_id", self.getInputCols(), None if drop == "none" else drop), "levels")
        return {"levels": levels}, fx.category_names(levels)


class NumberBlockModel(BlockModel):
    def _cells(self, rows: DataFrame) -> DataFrame:
        return fx.numeric_features(fill_gaps(rows, self.tables["fills"], self.getInputCols()), "row_id", self.getInputCols())


class NumberBlock(_Block):
    """Numeric columns, gaps filled with the median of the fitted rows."""

    _model = NumberBlockModel

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", rowId="segment_id"):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _tables(self, rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        fills = materialize(fit_fills(rows, self.getInputCols()), "fills")
        return {"fills": fills}, rows.sparkSession.createDataFrame([(c,) for c in self.getInputCols()], "feature string")
