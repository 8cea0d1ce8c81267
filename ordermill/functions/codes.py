"""Article codes: paper, grammage, width and supplier in one string, such as KB100L28MON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paper names and their codes; the first name found wins.
PAPERS = [("kraft blanchi", "KB"), ("kraft ecru", "KE"), ("kraft naturel", "KE"), ("kraft", "KE"), ("blanchi", "KB"), ("ecru", "KE")]
#: Suppliers and their codes.
SUPPLIERS = [("mondi", "MON"), ("nordic", "NOR"), ("billerud", "BIL"), ("smurfit", "SMU"), ("default", "STD")]
#: Standard grammages (g/m2) and widths (cm).
GRAMMAGES = [40, 50, 60, 70, 80, 90, 100, 120, 140]
WIDTHS = [15, 18, 20, 22, 25, 28, 30, 32, 35, 40, 45, 50]
#: Names of the paper codes, and what holds where nothing is given.
PAPER_NAMES = {"KB": "Kraft Blanchi", "KE": "Kraft Écru"}
DEFAULT_PAPER, DEFAULT_GRAMMAGE = "KE", 80
#: Patterns of a grammage and of a width in lower-case text, the first that matches wins.
GRAMMAGE_PATTERNS = [r"(\d+)\s*g(?:\/m2|ram|r)?", r"(\d+)\s*gr", r"grammage\s*[\:\=]?\s*(\d+)"]
WIDTH_PATTERNS = [r"laize?\s*[\:\=]?\s*(\d+)", r"l(\d+)", r"largeur\s*[\:\=]?\s*(\d+)"]


def first_found(text: Column, pairs: list[tuple[str, str]], default: str | None) -> Column:
    out = None
    for name, code in pairs:
        out = F.when(text.contains(name), code) if out is None else out.when(text.contains(name), code)
    return out.otherwise(F.lit(default))


def article_code(paper: Column, grammage: Column, width: Column, supplier: Column) -> Column:
    """The code for given parts; nulls (and a zero width or grammage) fall back or are left out."""
    low = F.lower(F.coalesce(paper, F.lit("")))
    grams = F.coalesce(F.nullif(grammage.cast("long"), F.lit(0)), F.lit(DEFAULT_GRAMMAGE)).cast("string")
    wide = F.coalesce(F.concat(F.lit("L"), F.nullif(width.cast("long"), F.lit(0)).cast("string")), F.lit(""))
    who = F.coalesce(first_found(F.lower(F.coalesce(supplier, F.lit(""))), SUPPLIERS, None), F.lit(""))
    return F.concat(first_found(low, PAPERS, DEFAULT_PAPER), grams, wide, who)


def first_number(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]).try_cast("long")


def suggested_code(description: Column) -> Column:
    """The code that a description in plain words asks for; null for none."""
    low = F.lower(description)
    supplier = F.coalesce(*[F.when(low.contains(name), name) for name, _ in SUPPLIERS])
    code = article_code(low, first_number(low, GRAMMAGE_PATTERNS), first_number(low, WIDTH_PATTERNS), supplier)
    return F.when(description.isNotNull() & (description != ""), code)


def parsed_code(code: Column) -> Column:
    """A struct of paper, grammage, width and supplier; each null where the code has none."""
    shape = r"^(KB|KE)?(\d+)?(?:L(\d+))?(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(code, shape, i), F.lit(""))
    paper, rest = part(1), part(4)
    names, supplier = None, None
    for short, name in PAPER_NAMES.items():
        names = F.when(paper == short, name) if names is None else names.when(paper == short, name)
    for name, short in SUPPLIERS:
        supplier = F.when(rest == short, name.capitalize()) if supplier is None else supplier.when(rest == short, name.capitalize())
    return F.struct(
        names.alias("paper"), part(2).try_cast("long").alias("grammage"), part(3).try_cast("long").alias("laize"), supplier.otherwise(rest).alias("supplier")
    )


def standard_codes(spark: SparkSession) -> DataFrame:
    """All standard codes: each paper name by each grammage by each width."""
    row = F.explode(F.array(*[F.struct(F.lit(name).alias("paper"), F.lit(code).alias("paper_code")) for name, code in PAPERS]))
    x = spark.range(1).select(row.alias("p")).select("p.*")
    x = x.withColumn("grammage", F.explode(F.array(*map(F.lit, GRAMMAGES)))).withColumn("laize", F.explode(F.array(*map(F.lit, WIDTHS))))
    code = F.concat("paper_code", F.col("grammage").cast("string"), F.lit("L"), F.col("laize").cast("string"))
    return x.select("paper", code.alias("code"), "grammage", "laize")
