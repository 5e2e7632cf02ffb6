"""Landed payloads of three kinds of job boards as normalised postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions import text as X
from matchspark.functions.normalize import dedup_hash, extract_city
from matchspark.schema import JOB_COLUMNS

SEARCH_RECORD = "id string, title string, company struct<display_name:string>, location struct<display_name:string>, description string, redirect_url string, salary_min string, salary_max string, salary_is_predicted string, created string"
#: Fields of a posting by the kind that each must have where it is there.
BOARD_FIELDS = {"title": "STRING", "location": "OBJECT", "content": "STRING"}
SECTIONED_FIELDS = {"text": "STRING", "categories": "OBJECT", "description": "STRING", "lists": "ARRAY", "additional": "STRING", "workplaceType": "STRING"}
#: JSON that counts as an absent field.
NOTHING = ("null", '""', "false", "0", "[]", "{}")


def _posting(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    """All posting columns in order, absent ones null; rows without id or title go."""
    named = {"source": F.lit(source)} | columns
    out = df.select(*(named.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in JOB_COLUMNS.items()))
    return out.where((F.coalesce("source_job_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def normalize_search_api(raw: DataFrame, country: str, payload: str = "payload", source: str = "search_api") -> DataFrame:
    """One search result a row, as JSON text in column ``payload``."""
    r = raw.select(F.from_json(payload, SEARCH_RECORD).alias("r")).select("r.*")
    r = r.withColumn("_plain", X.strip_html_flat_all(F.col("title"), F.col("location.display_name"), F.col("description"), F.col("company.display_name")))
    # an explode of one element: what asks for a title later cannot be moved below the decoding and repeat it
    r = r.withColumn("_plain", F.explode(F.array("_plain")))
    flat = lambda i: F.get("_plain", F.lit(i))
    r = r.select("*", flat(0).alias("t"), flat(1).alias("l"), flat(2).alias("d"), flat(3).alias("c"), X.to_decimal(F.col("salary_min")).alias("lo"), X.to_decimal(F.col("salary_max")).alias("hi"))
    r = r.withColumn("x", X.min_experience(F.col("d")))
    currency, paid = X.currency_of(F.lit(country)), X.has_salary(F.col("lo"), F.col("hi"))
    return _posting(r, source, {
        "source_job_id": F.col("id"), "title": F.col("t"), "company": F.col("c"), "location": F.col("l"),
        "is_remote": X.is_remote(F.col("t"), F.col("l"), F.col("d")), "description": F.col("d"), "apply_url": F.col("redirect_url"),
        "salary_raw": X.salary_text(F.col("lo"), F.col("hi"), currency, F.coalesce(F.col("salary_is_predicted") == "1", F.lit(False))),
        "salary_min": F.col("lo"), "salary_max": F.col("hi"), "salary_currency": F.when(paid, currency), "salary_period": F.when(paid, "year"),
        "experience_raw": F.col("x.raw"), "experience_min_years": F.col("x.years"), "posted_date": X.iso_date(F.col("created")),
    })


def _with_experience(parse: bool) -> dict[str, Column]:
    found = X.min_experience(F.col("d"))
    return {"experience_raw": found["raw"], "experience_min_years": found["years"]} if parse else {}


def _field(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "variant")


def _absent(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null")).isin(*NOTHING)


def _another(v: Column, kind: str) -> Column:
    """Whether a field is there and not of the kind that it should have."""
    return ~F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lit(kind)) & ~_absent(v)


def _string(name: str) -> Column:
    return F.when(F.schema_of_variant(_field(name)) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))


def _text(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def _records(raw: DataFrame, elements: Column, company: str, payload: str, title: str, kinds: dict[str, str], odd: Column, fields: dict[str, Column]) -> DataFrame:
    """Every posting of every board by itself; see ``company_board_records``.

    A board is split into the JSON texts of its postings, and each of these is
    parsed apart, so that whatever one of them holds, its neighbours are read.
    """
    blank = F.trim(F.coalesce(payload, F.lit(""))) == ""
    lost = F.when(elements.isNotNull(), None).when(blank, "empty").when(F.get_json_object(payload, "$").isNull(), "unreadable").otherwise("no list of postings")
    boards = raw.select(F.col(company).alias("company"), lost.alias("_lost"), F.when(elements.isNull(), F.col(payload)).alias("_payload"), elements.alias("_elements"))
    each = boards.select("company", "_lost", "_payload", F.posexplode_outer("_elements").alias("position", "_element")).where("position is not null or _lost is not null")
    each = each.withColumn("v", F.explode(F.array(F.try_parse_json("_element"))))
    identity, kind = _field("id"), F.schema_of_variant("v")
    reason = F.col("_lost")
    tests = [("unreadable", F.col("_element").isNotNull() & kind.isNull()), ("not an object", ~F.startswith(F.coalesce(kind, F.lit("VOID")), F.lit("OBJECT"))), ("no id", _absent(identity) | ~F.coalesce(_text("id"), F.lit("x")).rlike(r"\S"))]
    tests += [("id of another kind", F.schema_of_variant(identity).rlike("^(OBJECT|ARRAY)"))] + [(f"{name} of another kind", _another(_field(name), kind)) for name, kind in kinds.items()]
    tests += [("no title", ~F.coalesce(_string(title), F.lit("")).rlike(r"\S")), ("date or list of another kind", odd)]
    why = F.when(reason.isNotNull(), reason)
    for name, test in tests:
        why = why.when(test, name)
    # an explode of one element: a filter on the reason cannot be moved below the parsing and repeat it
    one = F.struct(why.alias("reason"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("r"))
    out = each.select("company", "position", F.coalesce("_payload", "_element").alias("record"), F.explode(F.array(one)).alias("x"))
    return out.select("company", "position", F.when(F.col("x.reason").isNotNull(), F.col("record")).alias("record"), "x.reason", "x.r")


def company_board_records(raw: DataFrame, payload: str = "payload", company: str = "company") -> DataFrame:
    """Every posting of every board: company, position (from 0), reason, record and r.

    Postings that can be used have no reason, and their fields as text in r; all
    others have a reason and the JSON text that was landed in record. One odd
    posting takes nothing from its neighbours. A payload that cannot be read, or
    that holds no list, is one row without a position; an empty list is none. A
    bare string among the postings, or one that names a field twice, is unreadable.
    Absent fields, null, "", false, 0, [] and {} count as nothing. A title,
    content or date must be a text and a location an object.
    """
    elements = F.from_json(payload, "jobs array<string>")["jobs"]
    changed, first = _field("updated_at"), _field("first_published")
    date = F.when(_absent(changed), _another(first, "STRING")).otherwise(_another(changed, "STRING"))
    fields = {"id": _text("id"), "title": _string("title"), "location": _text("location.name"), "content": _string("content"), "updated_at": _string("updated_at"), "first_published": _string("first_published"), "absolute_url": _text("absolute_url")}
    return _records(raw, elements, company, payload, "title", BOARD_FIELDS, date, fields)


def sectioned_board_records(raw: DataFrame, payload: str = "payload", company: str = "company") -> DataFrame:
    """The same of boards that are a bare list. Parts of ``lists`` that are no objects are passed over; headings and contents must be texts."""
    elements = F.from_json(payload, "array<string>")
    parts = F.filter(F.coalesce(F.try_variant_get("v", "$.lists", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.startswith(F.coalesce(F.schema_of_variant(b), F.lit("VOID")), F.lit("OBJECT")))
    part = lambda b, name: F.try_variant_get(b, f"$.{name}", "variant")
    odd = F.exists(parts, lambda b: _another(part(b, "text"), "STRING") | _another(part(b, "content"), "STRING"))
    words = lambda b, name: F.when(F.schema_of_variant(part(b, name)) == "STRING", F.try_variant_get(b, f"$.{name}", "string"))
    lists = F.transform(parts, lambda b: F.struct(words(b, "text").alias("text"), words(b, "content").alias("content")))
    fields = {"id": _text("id"), "text": _string("text"), "location": _text("categories.location"), "description": _string("description"), "lists": lists, "additional": _string("additional"), "createdAt": _text("createdAt"), "workplaceType": _string("workplaceType"), "hostedUrl": _text("hostedUrl"), "applyUrl": _text("applyUrl")}
    return _records(raw, elements, company, payload, "text", SECTIONED_FIELDS, odd, fields)


def set_aside(records: DataFrame) -> DataFrame:
    """What of the boards is no posting, with the reason."""
    return records.where("reason is not null").select("company", "position", "record", "reason")


def company_postings(records: DataFrame, source: str = "company_board", parse_experience: bool = False) -> DataFrame:
    """The usable records of company boards as postings. Ids are held within the company's name."""
    r = records.where("reason is null").select(F.col("company").alias("c"), "r.*")
    r = r.select("c", "id", "updated_at", "first_published", "absolute_url", F.trim("title").alias("t"), F.col("location").alias("l"), X.html_to_text(F.col("content")).alias("d"))
    return _posting(r, source, {
        "source_job_id": F.concat_ws(":", "c", "id"), "title": F.col("t"), "company": F.col("c"), "location": F.col("l"),
        "is_remote": X.mentions_remote(F.col("t"), F.col("l"), F.substring("d", 1, 2000)), "description": F.nullif("d", F.lit("")), "apply_url": F.col("absolute_url"),
        "posted_date": X.iso_date(F.coalesce(F.nullif("updated_at", F.lit("")), "first_published")),
    } | _with_experience(parse_experience))


def normalize_company_board(raw: DataFrame, payload: str = "payload", company: str = "company", source: str = "company_board", parse_experience: bool = False) -> DataFrame:
    """One board's response a row: ``company`` and JSON text with an array of jobs. Odd postings are left out (``company_board_records`` tells which)."""
    return company_postings(company_board_records(raw, payload, company), source, parse_experience)


def sections_to_text(opening: Column, lists: Column, closing: Column) -> Column:
    """Opening, ``heading:`` blocks and closing of (already plain) texts."""
    def block(b: Column) -> Column:
        heading = F.trim(F.coalesce(b["text"], F.lit("")))
        return F.when(b["content"] == "", "").when(heading != "", F.concat(heading, F.lit(":\n"), b["content"])).otherwise(b["content"])

    return X.join_blocks(F.concat(F.array(opening), F.coalesce(F.transform(lists, block), F.array().cast("array<string>")), F.array(closing)))


def sectioned_postings(records: DataFrame, source: str = "sectioned_board", parse_experience: bool = False) -> DataFrame:
    """The usable records of sectioned boards as postings."""
    r = records.where("reason is null").select(F.col("company").alias("c"), "r.*")
    # the texts of the lists are decoded as one column with a mark between, since the decoder takes columns
    mark = X.MARK
    joined = F.array_join(F.transform("lists", lambda b: F.translate(F.coalesce(b["content"], F.lit("")), mark, "")), f"\n{mark}\n")
    r = r.withColumn("_joined", joined).withColumns({"_bodies": X.html_to_text(F.col("_joined")), "_open": X.html_to_text(F.col("description")), "_close": X.html_to_text(F.col("additional"))})
    bodies = F.split("_bodies", f"\n*{mark}\n*")
    pairs = F.transform(F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")), lambda b, i: F.struct(b["text"].alias("text"), F.trim(F.coalesce(F.get(bodies, i), F.lit(""))).alias("content")))
    r = r.withColumn("d", sections_to_text(F.col("_open"), pairs, F.col("_close")))
    place, kind = F.col("location"), F.lower(F.coalesce("workplaceType", F.lit("")))
    return _posting(r, source, {
        "source_job_id": F.concat_ws(":", "c", "id"), "title": F.trim("text"), "company": F.col("c"), "location": place,
        "is_remote": (kind == "remote") | X.mentions_remote(F.trim("text"), place, kind), "description": F.nullif("d", F.lit("")),
        "apply_url": F.coalesce(F.nullif("hostedUrl", F.lit("")), "applyUrl"), "posted_date": X.epoch_date(F.col("createdAt")),
    } | _with_experience(parse_experience))


def normalize_sectioned_board(raw: DataFrame, payload: str = "payload", company: str = "company", source: str = "sectioned_board", parse_experience: bool = False) -> DataFrame:
    """One board's response a row: ``company`` and a JSON array of postings with headed lists. Odd postings are left out."""
    return sectioned_postings(sectioned_board_records(raw, payload, company), source, parse_experience)


def remote_only(jobs: DataFrame, wanted: bool) -> DataFrame:
    return jobs.where("is_remote") if wanted else jobs


def split_unusable(rows: DataFrame, id_col: str = "source_job_id", title_col: str = "title") -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a title, and the others with the reason."""
    reason = F.when(F.coalesce(F.col(id_col).cast("string"), F.lit("")) == "", "no id").when(F.trim(F.coalesce(title_col, F.lit(""))) == "", "no title")
    tagged = rows.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def union_sources(batches: dict[str, DataFrame | Exception | None]) -> tuple[DataFrame | None, dict[str, str]]:
    """The postings of all sources that could be read, and the first error of each that could not."""
    good = [df for df in batches.values() if isinstance(df, DataFrame)]
    errors = {name: str(df) for name, df in batches.items() if isinstance(df, Exception)}
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good) if good else None), errors


def quarantine(raw: DataFrame, schema: str, source: str = "source", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Landed rows whose payload can be read, and a table (source, payload, reason) of those that cannot, so that one bad record stops no source."""
    state = F.when(F.trim(F.coalesce(payload, F.lit(""))) == "", "empty").when(F.from_json(payload, schema, {"mode": "PERMISSIVE"}).isNull(), "unreadable").when(F.get_json_object(payload, "$").isNull(), "unreadable")
    tagged = raw.withColumn("reason", state)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null").select(F.col(source).alias("source"), F.col(payload).alias("payload"), "reason")


def with_dedup_hash(jobs: DataFrame, unicode: bool = True) -> DataFrame:
    return jobs.withColumn("dedup_hash", dedup_hash(F.col("company"), F.col("title"), extract_city(F.col("location")), unicode))
