"""One primary field for each paper, and how it was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.operators.providers import last_part


def _held(text: Column, words: tuple[str, ...]) -> Column:
    """A bit for each word that the text holds."""
    return reduce(Column.bitwiseOR, [F.when(F.contains(text, F.lit(w)), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")) for n, w in enumerate(words)])


def primary_field(papers: DataFrame, terms: DataFrame, category_fields: dict[str, str], prefix: str, other: str, subfield: str, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """paper_id, field, evidence (direct, inferred or unclassified) of papers (paper_id, categories with the primary one first, primary_topic with display_name and subfield.id, title,
    abstract) and their terms (paper_id, term).

    The first that holds decides: a category of ``category_fields`` or with ``prefix`` (then ``other``); a primary topic of the subfield, by the field with most ``keywords`` in its name
    (``other`` if none); the field with most keywords in title, abstract or a term. Equal numbers go to the field that is named first; no keyword leaves ``unclassified``. Keywords are
    lower case, 63 a field at most, and count once. Only bits of found keywords are shuffled, never texts. Nulls count as empty; an empty table gives no rows.
    """
    cats = F.coalesce("categories", F.array().cast("array<string>"))
    first = F.get(F.filter(cats, lambda c: c.isin(list(category_fields)) | F.startswith(c, F.lit(prefix))), F.lit(0))
    by_category = F.when(first.isNotNull(), F.coalesce(*(F.when(first == k, v) for k, v in category_fields.items()), F.lit(other)))
    topic = F.col("primary_topic")
    basis = F.when(by_category.isNotNull(), "category").when(last_part(topic["subfield"]["id"]) == subfield, "topic").otherwise("text")
    whole = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "abstract")))
    own = papers.select("paper_id", by_category.alias("named"), basis.alias("basis"), F.when(basis == "topic", topic["display_name"]).when(basis == "text", whole).alias("text"))
    every = own.unionByName(terms.select("paper_id", F.col("term").alias("text")), allowMissingColumns=True).withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    bits = every.select("paper_id", "named", "basis", *(_held(F.col("text"), words).alias(f"m{n}") for n, words in enumerate(keywords.values())))
    mine = [F.bit_or(F.when(F.col("basis").isNotNull(), F.col(f"m{n}"))).alias(f"own{n}") for n in range(len(keywords))]
    found = bits.groupBy("paper_id").agg(F.max("named").alias("named"), F.max("basis").alias("basis"), *mine, *(F.bit_or(f"m{n}").alias(f"all{n}") for n in range(len(keywords)))).filter("basis is not null")
    count = lambda n: F.bit_count(F.when(F.col("basis") == "topic", F.col(f"own{n}")).otherwise(F.col(f"all{n}")))
    best = F.array_min(F.array(*(F.struct((-count(n)).alias("score"), F.lit(n).alias("place"), F.lit(f).alias("field")) for n, f in enumerate(keywords))))
    scored = found.select("paper_id", "named", "basis", best.alias("best"))
    by_words = F.when(F.col("best.score") < 0, F.col("best.field")).when(F.col("basis") == "topic", other).otherwise("unclassified")
    evidence = F.when(F.col("basis") != "text", "direct").when(F.col("best.score") < 0, "inferred").otherwise("unclassified")
    return scored.select("paper_id", F.coalesce("named", by_words).alias("field"), evidence.alias("evidence"))


def field_distribution(fields: DataFrame) -> DataFrame:
    """field, papers, direct, inferred, unclassified."""
    return fields.groupBy("field").agg(F.count("*").alias("papers"), *(F.count_if(F.col("evidence") == e).alias(e) for e in ("direct", "inferred", "unclassified")))
