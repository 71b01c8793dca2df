"""Pipelines that start from raw leads and are saved with their encoders.

Levels, sizes and class statistics are learnt from the training rows and saved
with the model, so a later batch gets the codes of the training rows whatever
levels it holds. A level that training lacked, like a null, has its own code in
the ``label`` style (-1) and is coded as the first level in the ``onehot`` style.
Each stage adds columns; the last one leaves the input's columns and ``prob``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.functions.features import DERIVED_INPUTS, derive_features, fill_null, recode
from dialwise.operators.encode import EDUCATION_LEVELS, level_table
from dialwise.plans.bayes import GaussianBayesModel, fit_gaussian_bayes
from dialwise.plans.models import BUILDERS
from dialwise.scale import ensure_checkpoint_dir, materialise
from dialwise.sources.leads import CATEGORICAL, FEATURES

UNKNOWN = -1.0


def param(name: str, doc: str, convert=None) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class DerivedFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds derived features as doubles; one whose source columns are missing is refused."""

    which = param("which", "names of derived features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, which=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        which = self.getOrDefault("which")
        lacking = [w for w in which if not set(DERIVED_INPUTS[w]) <= set(df.columns)]
        if lacking:
            raise ValueError(f"no source columns for {lacking}")
        return derive_features(df, which)


class OrderedLevels(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fixed order of levels as 0, 1, ...; every other value, and null, is -1."""

    inputCol = param("inputCol", "text column", TypeConverters.toString)
    outputCol = param("outputCol", "code column", TypeConverters.toString)
    levels = param("levels", "levels from lowest to highest", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, levels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        codes = {level: float(i) for i, level in enumerate(self.getOrDefault("levels"))}
        coded = recode(F.col(self.getOrDefault("inputCol")), codes)
        return df.withColumn(self.getOrDefault("outputCol"), fill_null(coded.cast("double"), UNKNOWN))


class _LevelParams(Params):
    inputCols = param("inputCols", "text columns", TypeConverters.toListString)
    outputCols = param("outputCols", "code columns", TypeConverters.toListString)
    reverse = param("reverse", "count from the last level, unknown ones with the first", TypeConverters.toBoolean)


class LevelCodes(Estimator, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the alphabetical place of each level of each column."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, reverse=False):
        super().__init__()
        self._setDefault(reverse=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LevelCodesModel:
        cols = self.getOrDefault("inputCols")
        levels = materialise(level_table(df, cols))
        # one row per column
        sizes = dict(levels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect())
        model = LevelCodesModel(sizes=[sizes.get(c, 0) for c in cols])
        model.levels = levels
        return self._copyValues(model)


class LevelCodesModel(Model, _LevelParams, MLReadable, MLWritable):
    """Codes by a join with the table of levels, which is saved as Parquet.

    The plan is the same for any number of levels: the scan's known size lets
    Catalyst broadcast a small table and shuffle a large one.
    """

    sizes = param("sizes", "number of levels per column", TypeConverters.toListInt)
    levels: DataFrame

    @keyword_only
    def __init__(self, *, sizes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        reverse = self.getOrDefault("reverse")
        for c, out, size in zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols"),
                                self.getOrDefault("sizes")):
            last = max(size - 1, 0)
            code = F.lit(last) - F.col("code") if reverse else F.col("code")
            mine = self.levels.where(F.col("column") == c).select(
                F.col("level").alias("__level"), code.cast("double").alias("__code"))
            unknown = float(last) if reverse else UNKNOWN
            df = (df.join(mine, F.col(c).cast("string") == F.col("__level"), "left")
                    .withColumn(out, F.coalesce("__code", F.lit(unknown))).drop("__level", "__code"))
        return df

    def write(self) -> MLWriter:
        return _LevelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelReader()


class _LevelWriter(MLWriter):
    def __init__(self, model: LevelCodesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.levels.write.parquet(f"{path}/levels")


class _LevelReader(MLReader):
    def load(self, path: str) -> LevelCodesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = LevelCodesModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.levels = self.sparkSession.read.schema("column string, level string, code int").parquet(f"{path}/levels")
        return model


class _BayesParams(Params):
    inputCols = param("inputCols", "feature columns", TypeConverters.toListString)
    outputCol = param("outputCol", "probability of class 1", TypeConverters.toString)


class GaussianBayes(Estimator, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian naive Bayes over plain columns; nulls in them are refused."""

    labelCol = param("labelCol", "0/1 label", TypeConverters.toString)
    smoothing = param("smoothing", "share of a feature's variance added to the class's", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="prob", labelCol="y", smoothing=1e-9):
        super().__init__()
        self._setDefault(outputCol="prob", labelCol="y", smoothing=1e-9)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BayesModel:
        features, label = self.getOrDefault("inputCols"), self.getOrDefault("labelCol")
        made = fit_gaussian_bayes(df, features, label, self.getOrDefault("smoothing"), standardised=True)
        return self._copyValues(BayesModel(
            priors=[made.priors[c] for c in (0, 1)], means=made.means[0] + made.means[1],
            variances=made.variances[0] + made.variances[1]))


class BayesModel(Model, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Class priors, then means and variances of class 0 followed by those of class 1."""

    priors = param("priors", "class shares", TypeConverters.toListFloat)
    means = param("means", "class means", TypeConverters.toListFloat)
    variances = param("variances", "smoothed class variances", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, priors=None, means=None, variances=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        features = self.getOrDefault("inputCols")
        halves = lambda name: {0: self.getOrDefault(name)[:len(features)], 1: self.getOrDefault(name)[len(features):]}
        model = GaussianBayesModel(features, dict(enumerate(self.getOrDefault("priors"))),
                                   halves("means"), halves("variances"))
        return model.transform(df, self.getOrDefault("outputCol"))


class Chance(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The probability of class 1 as a plain column; intermediate columns go."""

    outputCol = param("outputCol", "probability of class 1", TypeConverters.toString)
    drops = param("drops", "intermediate columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, outputCol="prob", drops=None):
        super().__init__()
        self._setDefault(outputCol="prob", drops=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOrDefault("outputCol")
        if "probability" in df.columns:
            df = df.withColumn(out, vector_to_array("probability")[1])
        elif "prediction" in df.columns:
            df = df.withColumn(out, F.col("prediction"))
        return df.drop(*self.getOrDefault("drops"), "rawPrediction", "probability", "prediction")


def encoder_stages(columns: Sequence[str], derived: Sequence[str] = (), style: str = "onehot") -> tuple[list, list[str], list[str]]:
    """Stages from raw leads to numbers, the columns to learn from and the intermediate ones.

    ``label`` codes every category alphabetically; ``onehot`` orders education
    and gives the others one sparse vector each, without the first level.
    """
    present = [c for c in FEATURES if c in columns]
    numeric = [c for c in present if c not in CATEGORICAL]
    cats = [c for c in present if c in CATEGORICAL]
    stages: list = [DerivedFeatures(which=list(derived))] if derived else []
    coded, made = [f"{c}__code" for c in cats], list(derived)
    if style == "label":
        if cats:
            stages.append(LevelCodes(inputCols=cats, outputCols=coded))
        return stages, [*numeric, *coded, *derived], [*coded, *made]
    if style != "onehot":
        raise ValueError(f"unknown style {style}")
    features = list(numeric)
    if "education" in cats:
        cats = [c for c in cats if c != "education"]
        order = sorted(EDUCATION_LEVELS, key=EDUCATION_LEVELS.get)
        stages.append(OrderedLevels(inputCol="education", outputCol="education__code", levels=order))
        features.append("education__code")
        made.append("education__code")
    if cats:
        coded, vectors = [f"{c}__code" for c in cats], [f"{c}__onehot" for c in cats]
        stages += [LevelCodes(inputCols=cats, outputCols=coded, reverse=True),
                   OneHotEncoder(inputCols=coded, outputCols=vectors, dropLast=True)]
        features += vectors
        made += [*coded, *vectors]
    return stages, [*features, *derived], made


def fit_pipeline(train: DataFrame, learner: str, params: dict | None = None, style: str = "onehot",
                 derived: Sequence[str] = (), label: str = "y") -> PipelineModel:
    """Encoders and learner fitted on raw leads; ``transform`` adds ``prob``.

    Needs a row of each class and no null in numeric columns. Further columns
    of a scored table pass through; stages of this module name theirs with
    two underscores.
    """
    params = dict(params or {})
    ensure_checkpoint_dir(train.sparkSession)
    stages, features, made = encoder_stages(train.columns, derived, style)
    # every encoder and the learner read the rows, so they are stored once
    train = materialise(train.select(label, *[c for c in FEATURES if c in train.columns]))
    if learner == "naive_bayes":
        if style != "label":
            raise ValueError("naive Bayes takes the label style")
        stages += [GaussianBayes(inputCols=features, labelCol=label, smoothing=params.get("var_smoothing", 1e-9)),
                   Chance(drops=made)]
    else:
        rows = train.count() if learner == "logistic_regression" else 0
        model = BUILDERS[learner](params, rows).setLabelCol(label).setFeaturesCol("__features")
        stages += [VectorAssembler(inputCols=features, outputCol="__features"), model,
                   Chance(drops=[*made, "__features"])]
    return Pipeline(stages=stages).fit(train)
