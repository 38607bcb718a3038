"""Bills from landed payloads: nested JSON, history XML, history indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import classify, ordered

PERSON = "struct<fullName:string,name:string,bioguideId:string,party:string,state:string,district:string>"
BILL_JSON = (
    "congress int, type string, number string, title string, url string, "
    "latestAction struct<actionDate:string,text:string>, "
    f"sponsors array<{PERSON}>, cosponsors array<{PERSON}>, "
    "actions array<struct<actionDate:string,text:string,actionCode:string>>, "
    "amendments array<struct<type:string,number:string,description:string,url:string,"
    "latestAction:struct<actionDate:string,text:string>>>, "
    "textVersions array<struct<type:string,name:string,date:string,"
    "formats:array<struct<type:string,url:string,text:string>>>>, _corrupt_record string"
)
# Text formats, best first.
FORMATS = ["Formatted XML", "Formatted Text", "PDF"]


def _landed(reader, file_format: str, schema: str, path: str, files_per_batch: int | None) -> DataFrame:
    reader = reader.format(file_format).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if file_format == "xml":
        # A record that is broken must not end its file.
        reader = reader.options(rowTag="bill", useLegacyXMLParser="true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def landed_json(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Bill payloads of landed files, one per line, with the name of their file.

    A line that is no payload is a row too: its text is in _corrupt_record.
    `split_corrupt` tells both apart.
    """
    return _landed(spark.readStream if stream else spark.read, "json", BILL_JSON, path, files_per_batch)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed bill payloads and the lines that are no payload."""
    return split_corrupt(landed_json(spark, path))


def parse_json(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """The same for payloads held in a text column."""
    parsed = raw.withColumn("p", F.from_json(column, BILL_JSON, {"mode": "PERMISSIVE"}))
    rows = parsed.select(*[c for c in raw.columns if c != column], "p.*")
    return split_corrupt(rows)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and those set aside with the reason."""
    kind = classify.federal_type(F.col("type"))
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON")
        .when(F.coalesce("number", F.lit("")) == "", "no bill number")
        .when(kind.isNull(), "bill type not followed")
    )
    marked = rows.withColumn("reason", reason).withColumn("bill_type", kind)
    good = marked.filter("reason IS NULL").drop("reason", "_corrupt_record")
    return good, marked.filter("reason IS NOT NULL")


KEY = ["congress", "bill_type", "number"]


def bill_rows(bills: DataFrame) -> DataFrame:
    return bills.select(
        F.lit("US").alias("jurisdiction"),
        F.col("congress").cast("string").alias("session_code"),
        "bill_type",
        F.col("number").alias("bill_number"),
        "title",
        F.col("latestAction.text").alias("latest_action"),
        F.coalesce(
            "url", classify.federal_url(F.col("congress"), F.col("bill_type"), F.col("number"))
        ).alias("source_url"),
    )


def sponsor_rows(bills: DataFrame) -> DataFrame:
    def people(column: str, role: str) -> DataFrame:
        return bills.select(*KEY, F.posexplode(column).alias("pos", "p")).select(
            *KEY,
            F.lit(role).alias("role"),
            F.coalesce(*[F.nullif(F.col(f"p.{c}"), F.lit("")) for c in ("fullName", "name", "bioguideId")], F.lit("Unknown")).alias("full_name"),
            F.col("p.bioguideId").alias("external_id"),
            F.col("p.party").alias("party"),
            F.col("p.state").alias("state"),
            F.col("p.district").alias("district"),
        )

    return people("sponsors", "sponsor").unionByName(people("cosponsors", "cosponsor"))


def action_rows(bills: DataFrame) -> DataFrame:
    rows = bills.select(*KEY, F.posexplode("actions").alias("pos", "a"))
    return rows.filter(F.coalesce("a.text", F.lit("")) != "").select(
        *KEY, "pos", F.col("a.actionDate").alias("action_date"), F.col("a.text").alias("text"),
        F.col("a.actionCode").alias("action_code"),
    )


def amendment_rows(bills: DataFrame) -> DataFrame:
    rows = bills.select(*KEY, F.explode("amendments").alias("a"))
    return rows.filter(F.coalesce("a.number", F.lit("")) != "").select(
        *KEY,
        F.lower(F.coalesce(F.nullif(F.col("a.type"), F.lit("")), F.lit("unknown"))).alias("amendment_type"),
        F.col("a.number").alias("amendment_number"),
        F.col("a.description").alias("description"),
        F.col("a.latestAction.text").alias("latest_action"),
        F.col("a.url").alias("source_url"),
    )


def preferred_format(formats: Column) -> Column:
    """The first format with an address, best kind first."""
    rank = lambda f: F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(x) for x in FORMATS]), f["type"]), F.lit(0)), F.lit(9)
    )
    usable = F.filter(formats, lambda f: F.coalesce(f["url"], F.lit("")) != "")
    ranked = F.transform(usable, lambda f, i: F.struct(rank(f).alias("rank"), i.alias("i"), f.alias("f")))
    return F.array_min(ranked)["f"]


def version_rows(bills: DataFrame) -> DataFrame:
    rows = bills.select(*KEY, F.explode("textVersions").alias("v"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumn("f", preferred_format(F.col("v.formats"))).select(
        *KEY,
        F.coalesce(blank("v.type"), blank("v.name"), F.lit("unknown")).alias("version_code"),
        F.col("v.name").alias("version_name"),
        F.col("v.date").alias("issued_on"),
        F.col("f.url").alias("source_url"),
        F.col("f.type").alias("format"),
        F.col("f.text").alias("text"),
    )


# Bill-history XML.
VERSION = "struct<versionDescription:string,WebHTMLURL:string,WebPDFURL:string>"
VERSIONS = f"struct<versions:struct<version:array<{VERSION}>>>"
BILL_XML = (
    "caption string, authors string, coauthors string, sponsors string, cosponsors string, "
    "actions struct<action:array<struct<actionNumber:string,date:string,description:string>>>, "
    "subjects struct<subject:array<string>>, "
    f"billtext struct<docTypes:struct<bill:{VERSIONS},analysis:{VERSIONS},fiscalNote:{VERSIONS}>>"
)
# Codes of named versions, and who counts as what.
VERSION_CODES = {
    "Introduced": "I", "Engrossed": "E", "Senate Committee Report": "S",
    "House Committee Report": "H", "Enrolled": "F",
}
ROLES = [("authors", "sponsor"), ("coauthors", "cosponsor"), ("sponsors", "sponsor"), ("cosponsors", "cosponsor")]


def landed_histories(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Bill histories of landed XML files with the name of their file; as `landed_json`."""
    return _landed(spark.readStream if stream else spark.read, "xml", BILL_XML + ", _corrupt_record string", path, files_per_batch)


def split_histories(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable histories, and those set aside with the reason."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), "not valid XML").when(F.coalesce("caption", F.lit("")) == "", "no caption")
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason", "_corrupt_record"), marked.filter("reason IS NOT NULL")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed histories and the records that are none."""
    return split_histories(landed_histories(spark, path))


def parse_history(raw: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """Histories held in a text column."""
    return raw.select(*keys, F.from_xml(column, BILL_XML).alias("p")).select(*keys, "p.*").filter(
        F.coalesce("caption", F.lit("")) != ""
    )


def history_sponsors(bills: DataFrame, keys: list[str]) -> DataFrame:
    """People per role, the first mention of a name in a role counts."""
    def named(tag: str, role: str) -> Column:
        names = F.transform(F.split(F.coalesce(tag, F.lit("")), r" \| "), T.strip)
        return F.transform(
            F.filter(names, lambda n: n != ""),
            lambda n: F.struct(T.folded(n).alias("folded"), F.lit(role).alias("role"), n.alias("full_name")),
        )

    people = F.concat(*[named(tag, role) for tag, role in ROLES])
    rows = T.rows(bills, keys, people, "p", "pos")
    first = rows.groupBy(*keys, "p.folded", "p.role").agg(F.min_by("p.full_name", "pos").alias("full_name"))
    return first.select(*keys, "role", "full_name")


def history_actions(bills: DataFrame, keys: list[str]) -> DataFrame:
    rows = bills.select(*keys, F.posexplode("actions.action").alias("pos", "a"))
    return rows.select(
        *keys, "pos",
        T.iso_or_same(F.col("a.date")).alias("action_date"),
        T.strip(F.coalesce("a.description", F.lit(""))).alias("text"),
        F.nullif(T.strip(F.coalesce("a.actionNumber", F.lit(""))), F.lit("")).alias("action_code"),
    ).filter("text <> ''")


def latest_action(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the newest action; the later row wins on equal dates."""
    at = F.struct(F.coalesce("action_date", F.lit("")), "pos")
    return actions.groupBy(*keys).agg(
        F.max_by("text", at).alias("latest_action"), F.max("action_date").alias("latest_date")
    )


def _url(value: Column) -> Column:
    return F.replace(
        T.strip(F.coalesce(value, F.lit(""))), F.lit("http://capitol.texas.gov/"), F.lit("https://capitol.texas.gov/")
    )


def history_versions(bills: DataFrame, keys: list[str]) -> DataFrame:
    rows = bills.select(*keys, F.explode("billtext.docTypes.bill.versions.version").alias("v"))
    name = T.strip(F.coalesce("v.versionDescription", F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in VERSION_CODES.items() for x in pair])
    letter = F.upper(F.regexp_extract("source_url", r"(?i)([ISEHF])\.(?:HTM|HTML)$", 1))
    return (
        rows.select(*keys, F.nullif(name, F.lit("")).alias("version_name"), _url(F.col("v.WebHTMLURL")).alias("source_url"))
        .filter("source_url <> ''")
        .withColumn(
            "version_code",
            F.coalesce(
                F.nullif(letter, F.lit("")), F.try_element_at(known, F.coalesce("version_name", F.lit(""))),
                "version_name", F.lit("unknown"),
            ),
        )
    )


def history_documents(bills: DataFrame, keys: list[str]) -> DataFrame:
    """Analyses and fiscal notes; the HTML address is preferred to the PDF."""

    def kind(path: str, document_type: str) -> DataFrame:
        rows = bills.select(*keys, F.explode(f"billtext.docTypes.{path}.versions.version").alias("v"))
        html, pdf = _url(F.col("v.WebHTMLURL")), _url(F.col("v.WebPDFURL"))
        return rows.select(
            *keys,
            F.lit(document_type).alias("document_type"),
            F.nullif(T.strip(F.coalesce("v.versionDescription", F.lit(""))), F.lit("")).alias("description"),
            F.when(html != "", html).otherwise(pdf).alias("source_url"),
            F.when(html != "", "html").otherwise("pdf").alias("format"),
        ).filter("source_url <> ''")

    return kind("analysis", "bill_analysis").unionByName(kind("fiscalNote", "fiscal_note"))


# File prefixes of history files.
INDEX_FILE = r"(?i)[A-Za-z0-9_./\\-]*(?:HB|HR|HC|HJ|SB|SR|SC|SJ)\d{5}\.xml"
INDEX_NAME = r"(?i)(HB|HR|HC|HJ|SB|SR|SC|SJ)(\d{5})\.XML$"
INDEX_MENTION = r"(?iU)\b(HB|HCR|HJR|HR|SB|SCR|SJR|SR)\s*0*(\d{1,5})\b"
PREFIXES = {"HB": "HB", "HR": "HR", "HC": "HCR", "HJ": "HJR", "SB": "SB", "SR": "SR", "SC": "SCR", "SJ": "SJR"}


def history_index(raw: DataFrame, keys: list[str], column: str = "raw", limit: int | None = None) -> DataFrame:
    """Bills listed by an index: file names first, then bare mentions, each bill once."""
    known = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    text = F.coalesce(F.col(column), F.lit(""))
    files = F.transform(
        F.regexp_extract_all(text, F.lit(INDEX_FILE), F.lit(0)),
        lambda path: F.struct(
            F.try_element_at(known, F.upper(F.regexp_extract(path, INDEX_NAME, 1))).alias("bill_type"),
            F.regexp_extract(path, INDEX_NAME, 2).try_cast("int").cast("string").alias("number"),
        ),
    )
    mentions = F.transform(
        F.regexp_extract_all(text, F.lit(INDEX_MENTION), F.lit(0)),
        lambda hit: F.struct(
            F.upper(F.regexp_extract(hit, INDEX_MENTION, 1)).alias("bill_type"),
            F.regexp_extract(hit, INDEX_MENTION, 2).try_cast("int").cast("string").alias("number"),
        ),
    )
    listed = F.array_distinct(
        F.filter(F.concat(files, mentions), lambda b: b["bill_type"].isNotNull() & b["number"].isNotNull())
    )
    rows = T.rows(raw, keys, listed, "b", "pos").select(*keys, "pos", "b.*")
    return ordered.first_rows(rows, keys, [F.col("pos")], limit) if limit else rows
