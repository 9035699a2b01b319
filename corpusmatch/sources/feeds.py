"""Feed items from XML columns, and taxonomy releases from CSV folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "title string, link string, description string, pubDate string"
# The files of a release, and the type of concept in each.
CONCEPT_FILES = {"skills": "skill", "occupations": "occupation", "skillGroups": "skill_group", "ISCOGroups": "occupation_group"}
BROADER_FILES = ("broaderRelationsSkillPillar", "broaderRelationsOccPillar")
SKILL_FILE = "skillSkillRelations"


def rfc822(raw: Column) -> Column:
    """Timestamp of an RFC-822 date; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(raw, r"^\s*\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))


def feed_items(items: DataFrame, xml: str, id_pattern: str = r"/vacancies/(\d+)/") -> DataFrame:
    """(external_id, url, title, description_html, published_at) of items; without an id in their link they are dropped."""
    parsed = items.select(F.from_xml(F.col(xml), _ITEM).alias("i"))
    out = parsed.select(
        F.regexp_extract("i.link", id_pattern, 1).alias("external_id"), F.col("i.link").alias("url"), F.trim("i.title").alias("title"),
        F.col("i.description").alias("description_html"), rfc822(F.col("i.pubDate")).alias("published_at"),
    )
    return out.where("external_id <> ''")


def _csv(spark: SparkSession, folder: str, name: str, language: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}_{language}.csv", header=True, multiLine=True, escape='"')


def taxonomy_concepts(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    """(concept_id, type, label, forms, description): one row a URI; rows without URI or label drop.

    Of records that share a URI, in the order of the files and of their rows, the first gives type and label, forms are
    joined in order, each once, and the first description that is there counts.
    """
    rows = None
    for place, (name, kind) in enumerate(CONCEPT_FILES.items()):
        df = _csv(spark, folder, name, language)
        text = lambda c, df=df: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
        typed = F.when(text("skillType") == "knowledge", "knowledge").otherwise(kind) if kind == "skill" else F.lit(kind)
        packed = F.split(F.concat_ws("\n", "preferredLabel", text("altLabels"), text("hiddenLabels")), "\n")
        forms = F.array_distinct(F.filter(F.transform(packed, lambda x: F.trim(x)), lambda x: x != ""))
        # Cells with line ends keep a file in one task, so this number follows its rows.
        order = F.struct(F.lit(place).alias("file"), F.monotonically_increasing_id().alias("row"))
        one = df.select("*", order.alias("order")).where("trim(conceptUri) <> '' and trim(preferredLabel) <> ''").select(
            F.trim("conceptUri").alias("concept_id"), "order", typed.alias("type"), F.trim("preferredLabel").alias("label"), forms.alias("forms"), F.nullif(F.trim(text("description")), F.lit("")).alias("description")
        )
        rows = one if rows is None else rows.unionByName(one)
    all_forms = F.transform(F.array_sort(F.collect_list(F.struct("order", "forms"))), lambda x: x["forms"])
    return rows.groupBy("concept_id").agg(
        F.min_by("type", "order").alias("type"), F.min_by("label", "order").alias("label"), F.array_distinct(F.flatten(all_forms)).alias("forms"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("order"))).alias("description"),
    )


def taxonomy_relations(spark: SparkSession, folder: str, language: str = "en") -> DataFrame:
    """(source, target, type) of broader and skill edges; those that miss an end are dropped, repeats merged."""
    edges = None
    for name in BROADER_FILES:
        one = _csv(spark, folder, name, language).select(F.col("conceptUri").alias("source"), F.col("broaderUri").alias("target"), F.lit("broader").alias("type"))
        edges = one if edges is None else edges.unionByName(one)
    kind = F.when(F.col("relationType") == "essential", "essential_for").otherwise("optional_for")
    skill = _csv(spark, folder, SKILL_FILE, language).select(F.col("originalSkillUri").alias("source"), F.col("relatedSkillUri").alias("target"), kind.alias("type"))
    return edges.unionByName(skill).where("trim(source) <> '' and trim(target) <> ''").distinct()


def release_report(concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """(concepts, surface_forms, relations) without writing anything."""
    return concepts.agg(F.count("*").alias("concepts"), F.sum(F.size("forms")).alias("surface_forms")).join(relations.agg(F.count("*").alias("relations")))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of a release's files: equal for a release seen before."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def release_files(spark: SparkSession, folder: str) -> tuple[list[str], dict[str, list[str]]]:
    """(languages that a folder holds, the required files that each of them misses), from its file names; nothing is read or written."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").toPandas()["path"]
    names = {p.rsplit("/", 1)[-1] for p in paths}
    languages = sorted(n.removeprefix("skills_").removesuffix(".csv") for n in names if n.startswith("skills_"))
    required = (*CONCEPT_FILES, *BROADER_FILES, SKILL_FILE)
    return languages, {x: [f"{n}_{x}.csv" for n in required if f"{n}_{x}.csv" not in names] for x in languages}
