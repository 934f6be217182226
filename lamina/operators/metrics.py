"""Differences between an image and its render, gradients and edges, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.pixels import PIXEL

RGB = ("r", "g", "b")


def aligned(pixels: DataFrame, renders: DataFrame) -> DataFrame:
    """Pixels with those of the render at the same place (r2, g2, b2)."""
    return pixels.join(renders.select(*PIXEL, *[F.col(c).alias(f"{c}2") for c in RGB]), PIXEL)


def differences(pairs: DataFrame) -> DataFrame:
    """image_id, mae, rmse, psnr. Sums stay whole numbers until the last division."""
    off = [F.col(c) - F.col(f"{c}2") for c in RGB]
    sums = pairs.groupBy("image_id").agg(F.sum(sum(F.abs(d) for d in off)).alias("a"), F.sum(sum(d * d for d in off)).alias("s"), (F.count("*") * 3).alias("n"))
    rmse = F.sqrt(F.col("s") / F.col("n"))
    return sums.select("image_id", (F.col("a") / F.col("n")).alias("mae"), rmse.alias("rmse"), F.when(F.col("s") == 0, 99.0).otherwise(F.log10(F.lit(255.0) / F.greatest(rmse, F.lit(1e-9))) * 20).alias("psnr"))


def amplified(pairs: DataFrame, times: int = 4) -> DataFrame:
    """Absolute differences of each pixel, made visible."""
    return pairs.select(*PIXEL, *[F.least(F.lit(255), F.abs(F.col(c) - F.col(f"{c}2")) * times).alias(c) for c in RGB])


def grey(pixels: DataFrame) -> DataFrame:
    """v: integer grey, with weights 299, 587 and 114 in thousandths, rounded."""
    return pixels.select(*PIXEL, F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114 + 500) / 1000).cast("int").alias("v"))


def gradients(greys: DataFrame) -> DataFrame:
    """magnitude: the larger of the steps from the pixel to the left and from the one above; 0 at the first ones."""
    step = lambda by, order: F.coalesce(F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("image_id", by).orderBy(order))), F.lit(0))
    return greys.select(*PIXEL, F.greatest(step("y", "x"), step("x", "y")).alias("magnitude"))


def edges(gradient: DataFrame, quantile: float = 0.91, least: float = 12.0) -> DataFrame:
    """Pixels whose gradient reaches the image's quantile, and the least one."""
    bound = gradient.groupBy("image_id").agg(F.greatest(F.lit(least), F.percentile("magnitude", quantile)).alias("bound"))
    return gradient.join(bound, "image_id").where(F.col("magnitude") >= F.col("bound")).select(*PIXEL)


def edge_f1(mine: DataFrame, theirs: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, tp, fp, fn, edge_f1. images: image_id of all images; one without edges on either side has 1."""
    both = mine.withColumn("a", F.lit(1)).join(theirs.withColumn("b", F.lit(1)), PIXEL, "full").groupBy("image_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("b").isNull()).alias("fn"))
    n = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn")}
    return images.join(both, "image_id", "left").select("image_id", *[v.alias(k) for k, v in n.items()], f1_score(**n).alias("edge_f1"))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(tp * 2 / F.greatest(F.lit(1), tp * 2 + fp + fn))


def compared(rendered: DataFrame, n: int, quantile: float = 0.91, least: float = 12.0) -> DataFrame:
    """image_id, place, mae, edge_f1 of each of n renders, as differences() and edge_f1() give them. rendered: of layers.laid_out().

    The renders of a pixel stay in its row, so windows over rows, columns and images need no shuffle if pixels are dealt by image.
    """
    value = lambda c: F.floor((c("r") * 299 + c("g") * 587 + c("b") * 114 + 500) / 1000).cast("int")
    render = [lambda c, k=k: F.col(f"render{k}")[c] for k in range(n)]
    greys = rendered.select(*PIXEL, value(F.col).alias("v"), *[value(c).alias(f"v{k}") for k, c in enumerate(render)], *[sum(F.abs(F.col(x) - c(x)) for x in RGB).alias(f"off{k}") for k, c in enumerate(render)])
    row, column, whole = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y"), Window.partitionBy("image_id")
    names = ["v", *[f"v{k}" for k in range(n)]]
    step = lambda c, w: F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)), F.lit(0))
    steps = greys.withColumns({f"row_{c}": step(c, row) for c in names}).withColumns({f"step_{c}": F.greatest(f"row_{c}", step(c, column)) for c in names})
    bounds = steps.withColumns({f"bound_{c}": F.greatest(F.lit(least), F.percentile(f"step_{c}", quantile).over(whole)) for c in names})
    edge = {c: F.col(f"step_{c}") >= F.col(f"bound_{c}") for c in names}
    mine = edge["v"]
    counts = lambda k: {"off": F.sum(f"off{k}"), "tp": F.count_if(mine & edge[f"v{k}"]), "fp": F.count_if(~mine & edge[f"v{k}"]), "fn": F.count_if(mine & ~edge[f"v{k}"])}
    sums = bounds.groupBy("image_id").agg(F.count("*").alias("n"), *[F.struct(F.lit(k).alias("place"), *[v.alias(name) for name, v in counts(k).items()]).alias(f"of{k}") for k in range(n)])
    each = sums.select("image_id", "n", F.explode(F.array(*[f"of{k}" for k in range(n)])).alias("of")).select("image_id", "n", "of.*")
    return each.select("image_id", "place", (F.col("off") / (F.col("n") * 3)).alias("mae"), f1_score(*map(F.col, ("tp", "fp", "fn"))).alias("edge_f1"))


def quality_score(mae: Column, f1: Column) -> Column:
    """From 0 to 100; missing metrics count as the worst (999 and 0)."""
    mae, f1 = F.coalesce(mae, F.lit(999.0)), F.coalesce(f1, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - mae * 1.8 + (f1 - 0.8) * 25))


def grade(score: Column) -> Column:
    # The least score of each grade.
    return F.when(score >= 92, "A").when(score >= 86, "B+").when(score >= 78, "B").when(score >= 68, "C").otherwise("D")
