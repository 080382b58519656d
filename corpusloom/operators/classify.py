"""Language family of a file, typology of a file's name and of a line, and the routing of lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.regexkit import S


#: Most aliases a table may hold: it is broadcast.
MOST_ALIASES = 100_000


def alias_table(spark: SparkSession, aliases: dict[str, list[str] | tuple[str, ...] | str] | str | None = None) -> DataFrame:
    """(family, family_rank, alias, bare) of an ordered alias mapping, given as such, as the path of a JSON file or by default the built-in one.

    It holds names of languages, so it is small; more than ``MOST_ALIASES`` are refused, as the table is broadcast.
    """
    if isinstance(aliases, str):
        aliases = json.loads("\n".join(r[0] for r in spark.read.text(aliases, wholetext=True).collect()))
    rows = []
    for rank, (family, names) in enumerate((aliases or rules.ALIASES).items()):
        for n in names.split() if isinstance(names, str) else names:
            rows.append((family, rank, n.lower(), "".join(c for c in n.lower() if c.isascii() and c.isalnum())))
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    return spark.createDataFrame(rows, "family string, family_rank int, alias string, bare string")


def file_families(files: DataFrame, aliases: DataFrame, name: str = "file") -> DataFrame:
    """(name, family, tier): family of each file, null if none fits or the file is a generated one.

    Tier 1: a telling token of the name is an alias; tier 2: the bare name holds a bare alias of three or
    more letters; tier 3: the raw name holds a raw alias. Earlier tiers win, then earlier families.
    """
    base = F.lower(F.regexp_replace(F.col(name), r"^.*/", ""))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    tokens = F.filter(F.split(stem, r"[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(list(rules.NAME_NOISE)))
    each = files.select(F.col(name)).distinct().select(name, base.alias("_raw"), F.regexp_replace(stem, "[^a-z0-9]", "").alias("_bare"), tokens.alias("_tokens"), base.isin([*rules.GENERATED, *rules.PASSED_OVER]).alias("_skip"))
    small = F.broadcast(aliases)
    t1 = each.select(name, F.explode("_tokens").alias("_t")).join(small, F.col("_t") == F.col("bare")).select(name, F.lit(1).alias("tier"), "family_rank", "family")
    t23 = each.join(small, (F.length("bare") >= 3) & F.col("_bare").contains(F.col("bare")) | (F.length("alias") >= 3) & F.col("_raw").contains(F.col("alias")))
    t23 = t23.select(name, F.when((F.length("bare") >= 3) & F.col("_bare").contains(F.col("bare")), 2).otherwise(3).alias("tier"), "family_rank", "family")
    best = t1.unionByName(t23).groupBy(name).agg(F.min(F.struct("tier", "family_rank", "family")).alias("_b"))
    out = each.select(name, "_skip").join(best, name, "left")
    return out.select(name, F.when(~F.col("_skip"), F.col("_b.family")).alias("family"), F.when(~F.col("_skip"), F.col("_b.tier")).alias("tier"))


def name_typology(name: Column) -> Column:
    """Typology by keywords in a file's name; fusional if none fits."""
    low = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    out = None
    for typology, words in rules.NAME_KEYWORDS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, typology) if out is None else out.when(hit, typology)
    return out.otherwise("fusional")


def line_typology(text: Column) -> Column:
    """Typology of a masked line: by script blocks and tell-tale words, in a fixed order."""
    words = F.split(F.lower(text), f"{S}+")
    block = lambda names: text.rlike("|".join(rf"__U_{n}|\[U\+{n}" for n in names))
    hit = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    return (
        F.when(block(rules.FUSIONAL_BLOCKS) | hit(rules.FUSIONAL_WORDS), "fusional")
        .when(block(rules.ANALYTIC_BLOCKS) | hit(rules.ANALYTIC_WORDS), "analytic")
        .otherwise("agglutination")
    )


def routed(lines: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Lines with their ``typology``: by line in mixed files (a single file, or "all" or "corpus" in its name), else by file.

    A typology without any line gets all lines.
    """
    n = lines.select(file).distinct().limit(2).count()
    mixed = F.lit(n == 1) | F.lower(F.col(file)).rlike("all|corpus")
    own = lines.withColumn("typology", F.when(mixed, line_typology(F.col(text))).otherwise(name_typology(F.col(file))))
    present = {r[0] for r in own.select("typology").distinct().collect()}
    for t in rules.TYPOLOGIES if present else ():
        if t not in present:
            own = own.unionByName(lines.withColumn("typology", F.lit(t)))
    return own


def family_files(files: DataFrame, aliases: DataFrame, name: str = "file") -> DataFrame:
    """(family, files): the classified files of each family, sorted."""
    return file_families(files, aliases, name).where("family IS NOT NULL").groupBy("family").agg(F.sort_array(F.collect_list(name)).alias("files"))
