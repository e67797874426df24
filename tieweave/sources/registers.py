"""Readers of landed register files: each turns what a source serves into mentions and assertions.

Files are landed first (JSON lines, CSV, HTML) and read by Spark, so a load is a pure
function of the landing zone. Fetching itself is outside of the library. A reader gives a
``Landed``: mentions with the columns of ``schemas.MENTIONS`` that it fills, and
assertions between their ids. Ids are hashes of natural keys, so loading again is the same.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

_TEXTS = (
    "entity_type_hint raw_name company_number officer_link officer_role parliament_member_id donor_id regulated_entity_id country nationality description dob".split()
)
FUNDER_LEAST_GBP = 1500


@dataclass(frozen=True)
class Landed:
    mentions: DataFrame
    assertions: DataFrame

    def union(self, other: Landed) -> Landed:
        return Landed(self.mentions.unionByName(other.mentions), self.assertions.unionByName(other.assertions))


def mention_id(source: str, *key: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(source), *key))


def _mentions(df: DataFrame, source: str, key: Column, **columns: Column) -> DataFrame:
    """Mentions of ``df`` with nulls for what isn't given, one for each key: the first in order of its columns."""
    filled = [columns.get(c, F.lit(None)).cast("string").alias(c) for c in _TEXTS]
    identified = F.coalesce(columns.get("has_identification", F.lit(False)), F.lit(False)).alias("has_identification")
    return df.select(key.alias("mention_id"), F.lit(source).alias("source_code"), *filled, identified).where("raw_name is not null").groupBy("mention_id").agg(
        F.min(F.struct("source_code", *_TEXTS, "has_identification")).alias("m")
    ).select("mention_id", "m.*")


def _ties(df: DataFrame, source: str, kind: Column | str, a: Column, b: Column, begin: Column | None = None, end: Column | None = None, amount: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None)
    row = df.select(
        kind.alias("statement_type"), F.lit(source).alias("source_code"), a.alias("from_mention_id"), b.alias("to_mention_id"),
        (none if begin is None else begin).cast("date").alias("valid_from"), (none if end is None else end).cast("date").alias("valid_to"),
        (none if amount is None else amount).cast("decimal(18,2)").alias("amount_gbp"),
    )
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row.columns))
    return row.where("from_mention_id != to_mention_id").select(F.md5(key).alias("assertion_id"), *row.columns)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_DATE_OF_BIRTH = "date_of_birth:struct<month:int,year:int>"
COMPANIES = (
    "company_number string, company_name string, company_status string, "
    f"officers array<struct<name:string,officer_role:string,appointed_on:date,resigned_on:date,nationality:string,country_of_residence:string,link:string,identified:boolean,{_DATE_OF_BIRTH}>>, "
    f"pscs array<struct<kind:string,name:string,notified_on:date,ceased_on:date,nationality:string,country:string,registration_number:string,{_DATE_OF_BIRTH}>>"
)


def companies(df: DataFrame) -> Landed:
    """Company profiles with officers and persons of control. ``df`` has COMPANIES."""
    source = "companies_house"
    company = lambda: mention_id(source, F.lit("company"), "company_number")
    officers = df.select("company_number", F.explode("officers").alias("o"))
    officer = mention_id(source, F.lit("officer"), F.coalesce("o.link", F.concat_ws("|", "company_number", "o.name")))
    holders = df.select("company_number", F.explode("pscs").alias("p")).where("p.name is not null")
    corporate = F.contains(F.lower("p.kind"), F.lit("corporate"))
    holder = mention_id(source, F.lit("psc"), "company_number", "p.name")
    mentions = [
        _mentions(df, source, company(), entity_type_hint=F.lit("company"), raw_name=F.col("company_name"), company_number=F.col("company_number")),
        _mentions(officers, source, officer, entity_type_hint=F.lit("person"), raw_name=F.col("o.name"), officer_link=F.col("o.link"), officer_role=F.col("o.officer_role"),
                  has_identification=F.col("o.identified"), country=F.col("o.country_of_residence"), nationality=F.col("o.nationality"), dob=F.col("o.date_of_birth.year")),
        _mentions(holders, source, holder, entity_type_hint=F.when(corporate, "company").otherwise("person"), raw_name=F.col("p.name"), company_number=F.col("p.registration_number"),
                  country=F.col("p.country"), nationality=F.col("p.nationality"), dob=F.col("p.date_of_birth.year")),
    ]
    ties = [
        _ties(officers, source, "DIRECTOR_OF", officer, company(), F.col("o.appointed_on"), F.col("o.resigned_on")),
        _ties(holders, source, F.when(corporate, "OWNS").otherwise("PSC_OF"), holder, company(), F.col("p.notified_on"), F.col("p.ceased_on")),
    ]
    return Landed(_all(mentions), _all(ties))


def crawl(profiles: DataFrame, appointments: DataFrame, anchor: str, most: int = 8) -> DataFrame:
    """(company_number) reached from ``anchor`` through shared officers, nearest first, up to ``most``.

    appointments: (officer, company_number). Each step is a join of the frontier.
    """
    from ..checkpoints import checkpointed

    seen = checkpointed(profiles.where(F.col("company_number") == anchor).select("company_number", F.lit(0).alias("hop")))
    hop, n = 0, seen.count()
    while 0 < n < most:
        hop += 1
        front = seen.where(F.col("hop") == hop - 1).select("company_number")
        officers = appointments.join(front, "company_number", "left_semi").select("officer").distinct()
        near = appointments.join(officers, "officer", "left_semi").select("company_number").distinct()
        new = near.join(seen, "company_number", "left_anti").orderBy("company_number").limit(most - n)
        seen = checkpointed(seen.unionByName(new.select("company_number", F.lit(hop).alias("hop"))))
        if (now := seen.count()) == n:
            break
        n = now
    return seen


DONATIONS = (
    "ECRef string, RegulatedEntityName string, RegulatedEntityType string, Value string, AcceptedDate string, DonorName string, DonorStatus string, "
    "CompanyRegistrationNumber string, DonorId string, RegulatedEntityId string, ReportedDate string"
)


def donations_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The columns of DONATIONS of an export, whatever others it has and in whatever order; null where it lacks one.

    most: see ``largest_donations``.
    """
    read = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    # A byte order mark stands before the first name.
    read = read.toDF(*(c.lstrip("\ufeff").strip('"') for c in read.columns))
    wanted = [x.split()[0] for x in DONATIONS.split(", ")]
    rows = read.select(*(F.col(c) if c in read.columns else F.lit(None).cast("string").alias(c) for c in wanted))
    return rows if most is None else largest_donations(rows, most)


def largest_donations(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` donations of the largest value, as the source itself serves them."""
    return df.orderBy(F.desc_nulls_last(text.money(F.col("Value"))), "ECRef").limit(most)


def donations(df: DataFrame) -> Landed:
    """Donations with the columns of the public export; rows without donor or recipient are skipped."""
    source = "electoral_commission"
    rows = df.where("trim(coalesce(DonorName, '')) != '' and trim(coalesce(RegulatedEntityName, '')) != ''")
    donor = mention_id(source, F.lit("donor"), F.coalesce("DonorId", "DonorName"))
    recipient = mention_id(source, F.lit("recipient"), F.coalesce("RegulatedEntityId", "RegulatedEntityName"))
    mentions = [
        _mentions(rows, source, donor, entity_type_hint=text.donor_type(F.trim("DonorStatus")), raw_name=F.col("DonorName"), donor_id=F.col("DonorId"), company_number=F.col("CompanyRegistrationNumber")),
        _mentions(rows, source, recipient, entity_type_hint=text.recipient_type(F.trim("RegulatedEntityType")), raw_name=F.col("RegulatedEntityName"), regulated_entity_id=F.col("RegulatedEntityId")),
    ]
    begin = F.coalesce(text.register_date(F.col("AcceptedDate")), text.register_date(F.col("ReportedDate")))
    return Landed(_all(mentions), _ties(rows, source, "DONATED_TO", donor, recipient, begin, None, text.money(F.coalesce("Value", F.lit("")))))


MEMBERS = (
    "id string, name string, party string, party_from date, posts array<struct<name:string,start:date,end:date>>, "
    "committees array<struct<name:string,role:string,start:date,end:date>>"
)


def members(df: DataFrame) -> Landed:
    """Parliamentarians with party, posts and committees. ``df`` has MEMBERS."""
    source = "parliament"
    member = lambda c="id": mention_id(source, F.lit("member"), c)
    body = lambda kind, c: mention_id(source, F.lit(kind), F.lower(F.trim(c)))
    posts, seats = df.select("id", F.explode("posts").alias("x")), df.select("id", F.explode("committees").alias("x"))
    chair = F.when(F.contains(F.lower(F.coalesce("x.role", F.lit(""))), F.lit("chair")), "CHAIR_OF").otherwise("MEMBER_OF")
    mentions = [
        _mentions(df, source, member(), entity_type_hint=F.lit("person"), raw_name=F.col("name"), parliament_member_id=F.col("id")),
        _mentions(df, source, body("party", "party"), entity_type_hint=F.lit("party"), raw_name=F.col("party")),
        _mentions(posts, source, body("post", "x.name"), entity_type_hint=F.lit("government_body"), raw_name=F.col("x.name")),
        _mentions(seats, source, body("committee", "x.name"), entity_type_hint=F.lit("organisation"), raw_name=F.col("x.name")),
    ]
    ties = [
        _ties(df.where("party is not null"), source, "MEMBER_OF", member(), body("party", "party"), F.col("party_from")),
        _ties(posts, source, "MINISTERIAL_ROLE", member(), body("post", "x.name"), F.col("x.start"), F.col("x.end")),
        _ties(seats, source, chair, member(), body("committee", "x.name"), F.col("x.start"), F.col("x.end")),
    ]
    return Landed(_all(mentions), _all(ties))


INTERESTS = "member_id string, member string, summary string, registered date, fields array<struct<name:string,value:string>>"


def interests(df: DataFrame) -> Landed:
    """Members' declared interests: holdings, payers and gifts, told apart by their named fields. ``df`` has INTERESTS.

    Of a name that is there more than once the last value counts.
    """
    source = "parliament_interests"
    last = lambda k: F.element_at(F.filter("fields", lambda x: x["name"] == k), -1)["value"]
    f = lambda k: F.when(F.exists("fields", lambda x: x["name"] == k), last(k))
    holding, payer = (F.when(f(k) != "", F.trim(f(k))) for k in ("OrganisationName", "PayerName"))
    giver = F.coalesce(F.nullif(F.trim(F.regexp_extract("summary", "^(.*?)(\\s+[-–]\\s+£?|$)", 1)), F.lit("")), F.lit("Unknown donor"))
    gift = F.when(f("DonationSource").isNotNull(), giver)
    truthy = lambda k: F.lower(f(k)).isin("true", "yes", "1")
    role = F.when(truthy("IsPaidAsDirectorOfPayer"), "DIRECTOR_OF").otherwise("ADVISER_TO")
    kind = F.when(holding.isNotNull(), "OWNS").when(payer.isNotNull(), role).otherwise("DONATED_TO")
    hint = F.when(holding.isNotNull(), "company").when(payer.isNotNull(), F.when(truthy("PayerIsPrivateIndividual"), "person").otherwise(text.entity_type(payer, "organisation")))
    hint = hint.otherwise(text.entity_type(gift, "person"))
    about = F.concat_ws(" ", F.when(holding.isNotNull(), f("OrganisationDescription")), F.when(holding.isNull() & payer.isNotNull(), f("PayerNatureOfBusiness")))
    rows = df.select("member_id", "member", "registered", F.coalesce(holding, payer, gift).alias("other"), kind.alias("kind"), hint.alias("hint"), about.alias("about"), f("Value").alias("value"))
    rows = rows.where("other != ''")
    member, org = mention_id(source, F.lit("member"), "member_id"), mention_id(source, F.lit("org"), F.lower("other"))
    mentions = [
        _mentions(rows, source, member, entity_type_hint=F.lit("person"), raw_name=F.col("member"), parliament_member_id=F.col("member_id")),
        _mentions(rows, source, org, entity_type_hint=F.col("hint"), raw_name=F.col("other"), description=F.col("about")),
    ]
    gives = F.col("kind") == "DONATED_TO"
    value = F.when(F.col("kind") != "OWNS", text.declared_money(F.col("value")))
    ties = _ties(rows, source, F.col("kind"), F.when(gives, org).otherwise(member), F.when(gives, member).otherwise(org), F.col("registered"), None, value)
    return Landed(_all(mentions), ties)


LORDS = "member_id string, member string, category int, interest_id string, parent_id string, interest string, deleted boolean"


def standing_interests(df: DataFrame) -> DataFrame:
    """The rows of LORDS that stand, children with the category of their first ancestor.

    A row stands if neither it nor a row above it is deleted. Each round goes one
    generation down; there are few.
    """
    from ..checkpoints import checkpointed

    rows = df.where("not coalesce(deleted, false)")
    front = checkpointed(rows.where("parent_id is null"))
    found, children = [], rows.where("parent_id is not null").drop("category")
    while not front.isEmpty():
        found.append(front)
        above = front.select(F.col("member_id").alias("_member"), F.col("interest_id").alias("_above"), "category")
        front = checkpointed(children.join(above, (F.col("parent_id") == F.col("_above")) & (F.col("member_id") == F.col("_member"))).select(*df.columns))
    return _all(found) if found else df.limit(0)


def lords(df: DataFrame) -> Landed:
    """Lords' employment and shareholdings (categories 1 and 2), children below their parents. ``df`` has LORDS."""
    source = "lords_interests"
    rows = standing_interests(df).where("category in (1, 2)")
    role, org = text.employment(F.col("interest"))
    rows = rows.withColumn("org", F.when(F.col("category") == 1, org).otherwise(text.shareholding(F.col("interest")))).withColumn("role", role).where("org is not null")
    member, other = mention_id(source, F.lit("member"), "member_id"), mention_id(source, F.lit("org"), F.lower("org"))
    kind = F.when(F.col("category") == 2, "OWNS").otherwise(text.role_type(F.col("role")))
    hint = F.when(F.col("category") == 2, "company").otherwise(text.entity_type(F.col("org"), "organisation"))
    mentions = [
        _mentions(rows, source, member, entity_type_hint=F.lit("person"), raw_name=F.col("member"), parliament_member_id=F.col("member_id")),
        _mentions(rows, source, other, entity_type_hint=hint, raw_name=F.col("org")),
    ]
    return Landed(_all(mentions), _ties(rows, source, kind, member, other))


def contract_targets(entities: DataFrame, numbers: DataFrame) -> DataFrame:
    """Companies with a number, in order of name: what contracts are looked up for. numbers: (entity_id, company_number)."""
    own = entities.where("entity_type = 'company'").join(numbers.where("trim(coalesce(company_number, '')) != ''"), "entity_id")
    return own.select("entity_id", "name", "company_number", text.search_key(text.supplier_name(F.col("name"))).alias("search_key")).orderBy("name", "entity_id")


AWARDS = "notice_id string, title string, buyer string, supplier string, value string, awarded date, start date, end date"


def contracts(df: DataFrame, targets: DataFrame) -> Landed:
    """Awards to known companies, by strict supplier name; one tie a notice and company. targets: (name, company_number).

    Companies whose names are equal but for the legal form each get the tie, as the name can't tell them apart.
    """
    source = "contracts_finder"
    known = targets.groupBy(text.supplier_name(F.col("name")).alias("k"), "company_number").agg(F.min("name").alias("company"))
    matched = df.withColumn("k", text.supplier_name(F.col("supplier"))).where("k != '' and trim(coalesce(buyer, '')) != ''").join(known, "k")
    rows = matched.groupBy("notice_id", "company_number", "company").agg(
        F.min("buyer").alias("buyer"), F.max(text.contract_money(F.col("value"))).alias("amount"), F.min(F.coalesce("awarded", "start")).alias("begin"), F.max("end").alias("end"), F.count("*").alias("lots")
    )
    company, buyer = mention_id(source, F.lit("company"), "company_number"), mention_id(source, F.lit("buyer"), F.lower(F.trim("buyer")))
    mentions = [
        _mentions(rows, source, company, entity_type_hint=F.lit("company"), raw_name=F.col("company"), company_number=F.col("company_number")),
        _mentions(rows, source, buyer, entity_type_hint=F.lit("government_body"), raw_name=F.col("buyer")),
    ]
    return Landed(_all(mentions), _ties(rows, source, "CONTRACTED_WITH", company, buyer, F.col("begin"), F.col("end"), F.col("amount")))


def html_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, table, row, cells): cell texts of each table row."""
    tables = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit("(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table", "t"))
    rows = tables.select(id_col, "table", F.posexplode(F.regexp_extract_all("t", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), text.plain_text)
    return rows.select(id_col, "table", "row", cells.alias("cells"))


# Editions of the register of groups that are known to exist, and what its contents page says.
KNOWN_EDITIONS = ("260518", "260413", "260223", "260112")
CONTENTS_TITLE = "All-Party Parliamentary Groups"
# Headings of a group's page.
OFFICERS, BENEFITS, BENEFITS_HEADER = ["Officers"], ["Financial Benefits"], ["Source", "Value £s", "Received", "Registered"]


def group_editions(as_of: str) -> list[str]:
    """Editions to ask for, in order: every sixth week back from a date, then those that are known."""
    day = datetime.date.fromisoformat(as_of)
    recent = [(day - datetime.timedelta(weeks=weeks)).strftime("%y%m%d") for weeks in (0, 6, 12, 18, 24)]
    return [*recent, *(x for x in KNOWN_EDITIONS if x not in recent)]


def latest_edition(pages: DataFrame, editions: list[str]) -> DataFrame:
    """One row, the first of ``editions`` whose contents page came; none if none did. pages: (key, body), as ``rest.fetched`` gives them."""
    order = F.array_position(F.array(*map(F.lit, editions)), F.col("key"))
    there = pages.where(F.contains("body", F.lit(CONTENTS_TITLE))).select(F.col("key").alias("edition"), "body", order.alias("place")).where("place > 0")
    return there.orderBy("place").limit(1).drop("place")


def group_index(contents: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, slug, group) of the links on contents pages, without the introduction."""
    link = 'href="([a-z0-9-]+)\\.htm">([^<]+)</a>'
    found = contents.select(id_col, F.explode(F.arrays_zip(F.regexp_extract_all(html_col, F.lit(link), 1).alias("slug"), F.regexp_extract_all(html_col, F.lit(link), 2).alias("name"))).alias("x"))
    return found.select(id_col, "x.slug", F.trim(text.unescaped(F.col("x.name"))).alias("group")).where("slug != 'introduction'")


def groups_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Landed:
    """Cross-party group pages: title, officers and financial benefits.

    The first table has names and values. A table that begins with OFFICERS has a header and
    then officers. After a row BENEFITS, rows of four cells are benefits, up to the first
    row of another shape; rows that do not parse are skipped, not guessed.
    """
    source = "appg"
    rows = html_rows(pages, id_col, html_col).withColumn("n", F.size("cells"))
    is_row = lambda wanted: F.col("cells") == F.array(*map(F.lit, wanted))
    cell = lambda i: text.unescaped(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    named = rows.where(F.col("table") == 0).where("n = 2 and cells[0] = 'Title'")
    titles = named.groupBy(id_col).agg(F.max_by("cells", "row").alias("cells")).select(id_col, cell(1).alias("group")).where("group != ''")
    lists = rows.where(F.col("row") == 0).where(is_row(OFFICERS)).select(id_col, "table")
    officers = rows.where("row >= 2 and n = 3").join(lists, [id_col, "table"], "left_semi").select(id_col, cell(0).alias("role"), cell(1).alias("person")).join(titles, id_col).where("person != ''")
    before = Window.partitionBy(id_col, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.max(F.when(F.col("n") != 4, F.struct("row", is_row(BENEFITS).alias("begins")))).over(before)
    benefits = rows.withColumn("turn", turn).where((F.col("n") == 4) & F.col("turn.begins") & ~is_row(BENEFITS_HEADER))
    received = F.try_to_date(F.regexp_extract(cell(2), "^\\s*([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")
    benefits = benefits.select(id_col, cell(0).alias("funder"), text.declared_money(cell(1)).alias("value"), received.alias("received"))
    benefits = benefits.join(titles, id_col).where((F.col("value") >= FUNDER_LEAST_GBP) & (F.col("funder") != ""))
    group = mention_id(source, F.lit("group"), F.lower("group"))
    person, funder = mention_id(source, F.lit("person"), F.lower("person")), mention_id(source, F.lit("funder"), F.lower("funder"))
    mentions = [
        _mentions(titles, source, group, entity_type_hint=F.lit("appg"), raw_name=F.col("group")),
        _mentions(officers, source, person, entity_type_hint=F.lit("person"), raw_name=F.col("person")),
        _mentions(benefits, source, funder, entity_type_hint=text.entity_type(F.col("funder"), "organisation"), raw_name=F.col("funder")),
    ]
    chair = F.when(F.contains(F.lower("role"), F.lit("chair")), "CHAIR_OF").otherwise("MEMBER_OF")
    ties = [_ties(officers, source, chair, person, group), _ties(benefits, source, "FUNDS", funder, group, F.col("received"), None, F.col("value"))]
    return Landed(_all(mentions), _all(ties))


LEAKED = "node_id string, name string, jurisdiction string, jurisdiction_description string, sourceID string"


def leaked_csv(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, name, jurisdiction, leak) of unpacked node files, by column names in any order; nameless rows go."""
    read = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _leaked(read)


def _leaked(read: DataFrame) -> DataFrame:
    own = lambda c: F.nullif(F.trim(c), F.lit("")) if c in read.columns else F.lit(None).cast("string")
    where = F.coalesce(own("jurisdiction_description"), own("jurisdiction"))
    return read.select(own("node_id").alias("node_id"), own("name").alias("name"), where.alias("jurisdiction"), own("sourceID").alias("leak")).where("name is not null")


def leaked_zip(spark: SparkSession, path: str, member: str = "nodes-entities.csv", rows: int = 10_000) -> DataFrame:
    """The same from archives, each streamed out of its member by one task, ``rows`` rows at a time.

    Only an archive's compressed bytes are held whole; unpack large ones and use ``leaked_csv``.
    """
    names = [x.split()[0] for x in LEAKED.split(", ")]

    def run(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    held = []
                    for row in csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")):
                        held.append([row.get(c) for c in names])
                        if len(held) == rows:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names)

    return _leaked(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, LEAKED))


def offshore_matches(leaked: DataFrame, entities: DataFrame) -> DataFrame:
    """Leaked entities whose name base and legal form equal a company's; bases of one word are too weak.

    leaked: (node_id, name, jurisdiction, leak).
    """
    keys = lambda df, c: df.withColumn("base", text.company_base(F.col(c))).withColumn("form", text.suffix_class(F.col(c)))
    own = keys(entities.where("entity_type in ('company', 'organisation')").select("entity_id", F.col("name").alias("own_name")), "own_name")
    hits = keys(leaked.where("lower(coalesce(leak, '')) not like '%corporate registry%'"), "name").where("base like '% %'").join(own.select("entity_id", "base", "form"), ["base", "form"])
    return hits.select(F.md5(F.concat_ws("|", F.lit("OFFSHORE"), "entity_id", "node_id")).alias("lead_id"), "entity_id", "node_id", "name", "jurisdiction", "leak").dropDuplicates(["lead_id"])


def news_names(found: DataFrame, ranked: DataFrame, leads: DataFrame, entities: DataFrame, most: int = 150) -> DataFrame:
    """Names worth looking up in the news: members of findings, then high ranks, then leads' donors. leads: (donor_id), in any number of rows."""
    parts = [
        found.select(F.explode("member_ids").alias("entity_id"), F.lit(3).alias("priority")),
        ranked.where("rank <= 10").select("entity_id", F.lit(2).alias("priority")),
        leads.select(F.col("donor_id").alias("entity_id"), F.lit(1).alias("priority")),
    ]
    first = _all(parts).groupBy("entity_id").agg(F.min("priority").alias("priority")).join(entities.select("entity_id", "name"), "entity_id")
    told = first.where((F.size(F.split(F.trim("name"), "\\s+")) >= 2) & (F.length("name") >= 8))
    return told.orderBy("priority", "name", "entity_id").limit(most)


def articles_found(answers: DataFrame, most: int = 3) -> DataFrame:
    """(key, url, title, domain, seendate): the first articles of each answer of a news search.

    answers: (key, body), as ``rest.fetched`` gives them; those that failed or can't be read have none.
    """
    found = F.from_json("body", "articles array<struct<url:string,title:string,domain:string,seendate:string>>")
    return answers.select("key", F.explode(F.slice(F.coalesce(found["articles"], F.array()), 1, most)).alias("a")).select("key", "a.*")


def coverage(articles: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` articles for each entity, the newest first. articles: (entity_id, url, title, domain, seendate).

    Of an article that was found twice, the one seen last counts; those without address or title don't.
    """
    there = articles.where("trim(coalesce(url, '')) != '' and trim(coalesce(title, '')) != ''").withColumns({"url": F.trim("url"), "title": F.trim("title")})
    once = there.groupBy("entity_id", "url").agg(F.max(F.struct("seendate", "title", "domain")).alias("a")).select("entity_id", "url", "a.*")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("seendate"), "url"))
    rows = once.withColumn("place", place).where(F.col("place") <= most)
    return rows.select(F.md5(F.concat_ws("|", F.lit("COVERAGE"), "entity_id", "url")).alias("coverage_id"), "entity_id", "title", "domain", "url", "seendate", text.seen_date(F.col("seendate")).alias("seen"))


def declared_companies(mentions: DataFrame, assertions: DataFrame) -> DataFrame:
    """(name, n_declarers) of companies that members declare: the other ends of their ties are counted."""
    own = mentions.where("entity_type_hint = 'company' and source_code in ('parliament_interests', 'lords_interests')").select("mention_id", "raw_name")
    ends = F.explode(F.array(F.struct(F.col("from_mention_id").alias("m"), F.col("to_mention_id").alias("o")), F.struct(F.col("to_mention_id").alias("m"), F.col("from_mention_id").alias("o"))))
    ties = assertions.select(ends.alias("x")).select(F.col("x.m").alias("mention_id"), F.col("x.o").alias("other"))
    return own.join(ties, "mention_id", "left").groupBy(F.col("raw_name").alias("name")).agg(F.count_distinct("other").alias("n_declarers")).orderBy(F.desc("n_declarers"), "name")


def bridge(declared: DataFrame, register: DataFrame) -> DataFrame:
    """(name, company_number, reason): the one active company of equal base and fitting form, or why there is none.

    declared: (name). register: (company_number, company_name, company_status).
    """
    want = declared.withColumn("base", text.company_base(F.col("name"))).withColumn("form", text.suffix_class(F.col("name")))
    have = register.where("lower(company_status) = 'active'").select("company_number", text.company_base(F.col("company_name")).alias("base"), text.suffix_class(F.col("company_name")).alias("other_form"))
    hits = want.where("base != ''").join(have, "base").where(text.compatible(F.col("form"), F.col("other_form"))).groupBy("name").agg(F.count_distinct("company_number").alias("n"), F.min("company_number").alias("found"))
    joined = want.join(hits, "name", "left")
    reason = F.when(F.col("base") == "", "empty key").when(F.col("n").isNull(), "no match").when(F.col("n") > 1, F.concat(F.lit("ambiguous:"), F.col("n").cast("string")))
    return joined.select("name", F.when(F.col("n") == 1, F.col("found")).alias("company_number"), reason.alias("reason"))


def not_ingested(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates (company_number) without a document. documents: (external_ref), as ``number:part``."""
    have = documents.select(F.split_part("external_ref", F.lit(":"), F.lit(1)).alias("company_number")).distinct()
    return candidates.join(have, "company_number", "left_anti")


def donor_groups(mentions: DataFrame, assertions: DataFrame, least_gbp: int = 500_000, most: int = 40) -> DataFrame:
    """(name_key, name, total): personal donors by name key, the longest spelling, large totals first."""
    people = mentions.where("source_code = 'electoral_commission' and entity_type_hint = 'person'").select("mention_id", "raw_name", text.person_token_key(F.col("raw_name")).alias("name_key"))
    gifts = assertions.where("statement_type = 'DONATED_TO'").select(F.col("from_mention_id").alias("mention_id"), "amount_gbp")
    own = people.where("name_key != ''").join(gifts, "mention_id").groupBy("name_key").agg(
        F.sum("amount_gbp").alias("total"), F.max_by("raw_name", F.struct(F.length("raw_name"), "raw_name")).alias("name")
    )
    return own.where(F.col("total") >= least_gbp).orderBy(F.desc("total"), "name_key").limit(most)


def donor_appointments(donors: DataFrame, officers: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` active companies of each officer with a donor's name key. officers: (officer, name, company_number, active)."""
    keyed = officers.where("active").withColumn("name_key", text.person_token_key(F.col("name")))
    hits = keyed.join(donors.select("name_key"), "name_key", "left_semi").dropDuplicates(["officer", "company_number"])
    place = F.row_number().over(Window.partitionBy("officer").orderBy("company_number"))
    return hits.withColumn("place", place).where(F.col("place") <= most).select("name_key", "officer", "company_number")
