"""Product search over an index of character runs.

The index has a posting (gram, field, product) for every run of one to three
characters of a product's lower-case name and brand, stored by a hash bucket of
the gram. A search reads the buckets of its term's longest runs only (three
characters, or the whole term if it is shorter), keeps the products that have
all of them in one field, and verifies those by the substring test, so the
result is that of `commerce_ops.product_search` for any term.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import ORACLES, lake, register
from ..session import scratch_path
from ..sources.io import write_table
from .commerce_ops import product_search

c = F.col
LONGEST, BUCKETS = 3, 256


def bucket_of(gram: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(gram.encode()) % buckets


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def postings(products: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(gram, field, product_id, gram_bucket) of the active products."""
    fields = products.filter("is_active").select("product_id", F.explode(F.array(
        *[F.struct(F.lit(f).alias("field"), F.lower(n).alias("text")) for f, n in (("name", "product_name"), ("brand", "brand"))])).alias("f"))
    every = F.flatten(F.array(*[grams(c("f.text"), n) for n in range(1, LONGEST + 1)]))
    out = fields.filter(c("f.text").isNotNull()).select("product_id", c("f.field").alias("field"), F.explode(every).alias("gram"))
    return out.select("gram", "field", "product_id", F.pmod(F.crc32("gram"), F.lit(buckets)).cast("int").alias("gram_bucket"))


def write_index(products: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Store the postings by bucket; returns their number."""
    return write_table(postings(products, buckets).hint("rebalance", "gram_bucket"), path, partition_by=["gram_bucket"])


def candidates(index: DataFrame, term: str, buckets: int = BUCKETS) -> DataFrame:
    """Ids of the products with all longest runs of ``term`` in one field."""
    term = term.lower()
    n = min(LONGEST, len(term))
    wanted = sorted({term[i:i + n] for i in range(len(term) - n + 1)})
    found = index.filter(c("gram_bucket").isin(sorted({bucket_of(g, buckets) for g in wanted})) & c("gram").isin(wanted))
    whole = found.groupBy("product_id", "field").agg(F.count(F.lit(1)).alias("n")).filter(c("n") == len(wanted))
    return whole.select("product_id").distinct()


def indexed_search(index: DataFrame, products: DataFrame, term: str, category: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """`product_search` by the index; the empty term finds every active product."""
    if not term:
        return product_search(products, term, category)
    return product_search(products.join(candidates(index, term, buckets), "product_id", "left_semi"), term, category)


# ------------------------------------------------------------ registration
def _indexed(term: str, category: str | None = None):
    def run(spark, d):
        products = lake(spark, d).silver("products")
        path = scratch_path(spark, f"product-index-{zlib.crc32(repr((d, term)).encode()):08x}")
        write_index(products, path, 32)
        return indexed_search(spark.read.parquet(path), products, term, category, 32)
    return run


register("product_search_indexed", ORACLES["product_search"])(_indexed("rod"))
register("product_search_indexed_one_letter", ORACLES["product_search_in_category"])(_indexed("A", "PROMO"))
