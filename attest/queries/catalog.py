"""Search and catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators.assets import asset_gate, extract_assets
from attest.operators.catalog import build_index, fetch_receipt, list_children, search_catalog, search_index, search_pages, search_stored, write_index
from attest.queries.registry import Tables, query
from attest.session import fresh_folder


@query("search_catalog", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring')")
def parts(t: Tables) -> DataFrame:
    return search_catalog(t.part.select("p_partkey", "p_name", "p_brand"), "p_name", "RING")


@query("list_children", r"""
WITH p AS (SELECT regexp_extract(url, '^[a-z]+:/(/.*)$', 1) AS path FROM pages),
c AS (SELECT substr(path, 2) AS rest FROM p)
SELECT split_part(rest, '/', 1) AS name, bool_or(contains(rest, '/')) AS is_folder, count(*) AS n_entries FROM c WHERE split_part(rest, '/', 1) <> '' GROUP BY 1
""")
def sites(t: Tables) -> DataFrame:
    return list_children(t.pages.select(F.regexp_extract("url", r"\A[a-z]+:/(/.*)\z", 1).alias("path")), "path", "/")


@query("fetch_receipt", """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, octet_length(encode(text)) > 2000 AS over_limit FROM documents
""")
def receipts(t: Tables) -> DataFrame:
    return fetch_receipt(t.documents, "text", 2000).select("doc_id", "size", "sha256", "over_limit")


SCORES = r"""
SELECT doc_id, count(*) AS score FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents)
WHERE w IN ('the', 'été', 'ouer', 'ion') GROUP BY doc_id
"""
QUERY_TEXT = "The été, ouer-ION"


@query("search_pages", f"SELECT doc_id, score FROM ({SCORES}) ORDER BY score DESC, doc_id LIMIT 25")
def best_pages(t: Tables) -> DataFrame:
    return search_pages(t.documents, "doc_id", "text", QUERY_TEXT, limit=25)


@query("search_index", SCORES)
def indexed_pages(t: Tables) -> DataFrame:
    return search_index(build_index(t.documents, "doc_id", "text"), "doc_id", QUERY_TEXT)


@query("search_stored", f"SELECT doc_id, score FROM ({SCORES}) ORDER BY score DESC, doc_id LIMIT 25")
def stored_pages(t: Tables) -> DataFrame:
    folder = fresh_folder(t.spark, "index")
    write_index(t.documents, "doc_id", "text", folder)
    return search_stored(t.spark, folder, "doc_id", QUERY_TEXT, limit=25)


# Addresses of every kind: the pages' rooted ones, and by page relative, climbing, query and fragment ones and full ones with a port.
ASSETS_SQL = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[^#]*') AS document,
                  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
                  CASE page_id % 6 WHEN 1 THEN replace(html, 'href="/', 'href="') WHEN 2 THEN replace(html, 'href="/', 'href="../')
         WHEN 3 THEN replace(html, 'href="/', 'href="?') WHEN 4 THEN replace(html, 'href="/', 'href="#')
         WHEN 5 THEN replace(html, 'href="/', concat('href="', regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), CASE WHEN starts_with(url, 'https:') THEN ':443/' ELSE ':80/' END))
         ELSE html END AS html FROM pages),
f AS (SELECT *, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM p),
a AS (SELECT *, unnest(regexp_extract_all(html, '(?:src|href)="([^"]+)"', 1)) AS asset FROM f),
r AS (SELECT page_id, asset, origin, CASE
    WHEN regexp_matches(asset, '^[a-z]+:') THEN asset
    WHEN starts_with(asset, '//') THEN concat(split_part(origin, '/', 1), asset)
    WHEN starts_with(asset, '/') THEN concat(origin, asset)
    WHEN starts_with(asset, '?') THEN concat(origin, path, asset)
    WHEN starts_with(asset, '#') THEN concat(document, asset)
    WHEN starts_with(asset, '../') THEN concat(origin, regexp_extract(folder, '^(.*/)[^/]+/$|^/$', 1), CASE WHEN folder = '/' THEN '/' ELSE '' END, substr(asset, 4))
    ELSE concat(origin, folder, asset) END AS resolved FROM a),
s AS (SELECT *, regexp_replace(regexp_extract(resolved, '^([a-z]+://[^/?#]+)', 1), '^(https://.*):443$|^(http://.*):80$', '\1\2') = origin AS same_origin FROM r)
"""


def linked_pages(t: Tables) -> DataFrame:
    origin = F.regexp_extract("url", r"\A([a-z]+://[^/?#]+)", 1)
    full = F.concat(F.lit('href="'), origin, F.when(F.col("url").startswith("https:"), ":443/").otherwise(":80/"))
    forms = [F.lit('href="'), F.lit('href="../'), F.lit('href="?'), F.lit('href="#'), full]
    html = F.col("html")
    for i, form in enumerate(forms, 1):
        html = F.when(F.col("page_id") % 6 == i, F.replace("html", F.lit('href="/'), form)).otherwise(html)
    rows = t.pages.select("page_id", "url", html.alias("html"))
    return extract_assets(rows, "html", "url", r"[^\"]+")


@query("extract_assets", ASSETS_SQL + "SELECT page_id, asset, resolved, same_origin, count(*) AS n_rows FROM s GROUP BY ALL")
def page_assets(t: Tables) -> DataFrame:
    rows = linked_pages(t)
    return rows.groupBy("page_id", "asset", "resolved", "same_origin").agg(F.count(F.lit(1)).alias("n_rows"))


@query("asset_gate", ASSETS_SQL + """
SELECT page_id, count(*) AS n_assets, bool_and(same_origin) AS all_own, count(*) >= 6 AND bool_and(same_origin) AS ok FROM s GROUP BY page_id
""")
def gated_pages(t: Tables) -> DataFrame:
    return asset_gate(linked_pages(t), "page_id", least=6)
