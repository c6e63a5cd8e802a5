"""Features, classifiers and density of cell records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, log10_total


def log_feature(x: Column, bias_before: float = 0.0, bias: float = 0.0, scale: float = 1.0) -> Column:
    """(log10(x + bias_before) + bias) * scale, infinite logarithms as the largest doubles, the rest of NaN as 0."""
    l = log10_total(x + bias_before)  # noqa: E741
    return F.when(F.abs(l) < 1e300, (l + bias) * scale).otherwise(l)


def feature_columns(df: DataFrame, mean_intensity: bool = False) -> DataFrame:
    i = F.col("intensity") / F.col("size") if mean_intensity else F.col("intensity")
    return df.withColumns({"f0": log_feature(i), "f1": log_feature(F.col("structureness")), "f2": log_feature(F.col("blobness"))})


def above(feature: Column, threshold: float) -> Column:
    return feature > threshold


def linear(x: Column, y: Column, a: float, b: float, c: float, whole: bool = True) -> Column:
    """a x + b y + c > 0; with `whole` the coefficients lose their fractions first."""
    a, b, c = (float(int(k)) for k in (a, b, c)) if whole else (a, b, c)
    return a * x + b * y + c > 0


def background_normalized(df: DataFrame, image: DataFrame, at: dict[str, Column], sizes: dict[str, int], value: str, feature: str) -> DataFrame:
    """Subtract the log of the image's value at each cell's voxel, coordinates clipped to the image."""
    keyed = df.withColumns({f"__{a}": clip(F.floor(c), 0, sizes[a] - 1).cast("long") for a, c in at.items()})
    img = image.select(*[F.col(a).alias(f"__{a}") for a in at], F.col(value).alias("__v"))
    out = keyed.join(img, [f"__{a}" for a in at])
    return out.withColumn(feature, F.col(feature) - log10_total(F.col("__v").cast("double"))).drop(*[f"__{a}" for a in at], "__v")


def gather(df: DataFrame, image: DataFrame, at: dict[str, Column], value: str, out: str) -> DataFrame:
    """Value of the image at each row's voxel; null outside."""
    keyed = df.withColumns({f"__{a}": F.floor(c).cast("long") for a, c in at.items()})
    img = image.select(*[F.col(a).alias(f"__{a}") for a in at], F.col(value).alias(out))
    return keyed.join(img, [f"__{a}" for a in at], "left").drop(*[f"__{a}" for a in at])


def bin_of(v: Column, n: int) -> Column:
    """Bin of n equal bins over [0, n - 1]; the last one is closed; null outside.

    The quotient is corrected against the edges, which rounding can miss by one."""
    step = (n - 1) / n
    g = F.floor(v * n / (n - 1))
    g = F.when(v < g * step, g - 1).when(v >= (g + 1) * step, g + 1).otherwise(g)
    return F.when(v == n - 1, F.lit(n - 1)).when((v >= 0) & (v < n - 1), g).cast("int")


def density(df: DataFrame, axes: tuple[str, str, str]) -> DataFrame:
    """Cells in each bin of a 3-D histogram; as many unit-like bins as the largest coordinate has whole units."""
    most = df.agg(*[F.floor(F.max(a)).cast("int").alias(a) for a in axes]).first()
    if most is None or any(most[a] is None or most[a] < 2 for a in axes):
        return df.select(*[F.lit(None).cast("int").alias(f"b{i}") for i in range(3)], F.lit(0).cast("long").alias("n")).limit(0)
    b = df.select(*[bin_of(F.col(a), most[a]).alias(f"b{i}") for i, a in enumerate(axes)]).dropna()
    return b.groupBy("b0", "b1", "b2").agg(F.count("*").alias("n"))


def boundary_tree(features: list[str], label: str, depth: int = 2, bins: int = 32):  # noqa: ANN201  (a Pipeline of pyspark.ml)
    """A shallow decision tree on the principal components of centred features, not yet fitted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    # components are of centred columns, which PCA itself doesn't centre
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="__row"), StandardScaler(inputCol="__row", outputCol="__centred", withMean=True, withStd=False),
        PCA(k=len(features), inputCol="__centred", outputCol="components"), DecisionTreeClassifier(maxDepth=depth, maxBins=bins, featuresCol="components", labelCol=label, seed=1),
    ])
