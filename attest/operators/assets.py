"""Assets a page refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column

# Fixed value: what counts as a page's script or style.
SCRIPT_OR_STYLE = r"[^\"]+\.(?:js|css)"


def extract_assets(df: DataFrame, html: str, base: ColumnLike, shape: str = SCRIPT_OR_STYLE) -> DataFrame:
    """One row per ``src``/``href`` of the given shape: ``asset``, ``resolved``, ``same_origin``.

    An address is resolved against the page's own: absolute, with the page's scheme, rooted, relative to the page's
    folder (dot segments removed), or only another query or fragment. Origins are compared by scheme, host and port,
    with a scheme's own port left out.
    """
    pattern = rf'(?:src|href)="({shape})"'
    page = as_column(base)
    document = F.regexp_extract(page, r"\A[^#]*", 0)
    path = F.regexp_extract(document, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    rows = df.withColumns({
        "__origin": origin_of(page), "__scheme": F.lower(F.regexp_extract(page, r"\A([^:/?#]*):", 1)), "__document": document,
        "__path": F.when(path == "", "/").otherwise(path),
    })
    rows = rows.withColumn("asset", F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).drop(html)
    asset = F.col("asset")
    place = F.regexp_extract(asset, r"\A[^?#]*", 0)
    rest = F.regexp_extract(asset, r"\A[^?#]*(.*)\z", 1)
    folder = F.when(asset.startswith("/"), F.lit("")).otherwise(F.regexp_extract("__path", r"\A.*/", 0))
    absolute = asset.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")
    resolved = (
        F.when(absolute, asset)
        .when(asset.startswith("//"), F.concat("__scheme", F.lit(":"), asset))
        .when(asset.startswith("#"), F.concat("__document", asset))
        .when(asset.startswith("?"), F.concat("__origin", "__path", asset))
        .otherwise(F.concat("__origin", _without_dots(F.concat(folder, place)), rest))
    )
    return (
        rows.withColumn("resolved", resolved)
        .withColumn("same_origin", origin_of(F.col("resolved")) == F.col("__origin"))
        .drop("__origin", "__scheme", "__document", "__path")
    )


def origin_of(url: ColumnLike) -> Column:
    """Scheme, host and port in lower case, without credentials and the scheme's own port; empty without a host."""
    parts = F.regexp_extract(F.lower(as_column(url)), r"\A[a-z][a-z0-9+.-]*://[^/?#]*", 0)
    return F.regexp_replace(F.regexp_replace(parts, r"://[^@]*@", "://"), r"\A(https://.*):443\z|\A(http://.*):80\z", "$1$2")


def _without_dots(path: Column) -> Column:
    """A rooted path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    segments = F.slice(segments, 2, F.size(segments))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, part: F.when(part == ".", done).when(
        part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))))
    ends_in_folder = F.element_at(segments, -1).isin(".", "..")
    closed = F.concat(kept, F.when(ends_in_folder, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def asset_gate(assets: DataFrame, page: str, least: int = 2) -> DataFrame:
    """Per page: enough assets, all of them its own."""
    return assets.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_assets"), F.bool_and("same_origin").alias("all_own")
    ).withColumn("ok", (F.col("n_assets") >= least) & F.col("all_own"))
