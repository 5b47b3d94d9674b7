"""Provider records in full: parsing, papers, venues, identifiers, locations, lookups.

Records are landed JSON lines (column ``value``).  What a record holds stays in arrays of
structs of its row, built by higher-order functions, so nothing here shuffles but the joins
between providers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, urls

_LOCATION = "struct<pdf_url:string,landing_page_url:string,version:string,license:string,source:struct<id:string,display_name:string,type:string>>"
OPENALEX = f"""id string, doi string, title string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>,
abstract_inverted_index map<string,array<int>>, primary_location {_LOCATION}, locations array<{_LOCATION}>, best_oa_location {_LOCATION}, _broken string"""
SEMANTIC_SCHOLAR = """paperId string, title string, year int, authors array<struct<name:string>>, abstract string, externalIds struct<DOI:string,ArXiv:string,ACL:string>, citationCount int,
openAccessPdf struct<url:string>, venue string, publicationVenue struct<id:string,name:string,type:string,url:string>, url string, _broken string"""

#: What tells that a source is no publication venue, and how versions and hosts are ordered.
NO_VENUE_TYPES = ["repository", "preprint"]
NO_VENUE_NAME = r"(?i)\b(?:arxiv|biorxiv|medrxiv)\b|\bpreprints?\b|\brepository\b"
UNPUBLISHED = "submittedVersion"
VERSIONS = ["publishedVersion", "acceptedVersion", "submittedVersion"]

_ID = "array<struct<scheme:string,value:string,revision:string,provider:string,metadata_path:string>>"
_LOC = f"array<struct<location_id:string,metadata_path:string,pdf_url:string,landing_url:string,version:string,host_type:string,license:string,identifiers:{_ID}>>"


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Landed lines (``value`` and other columns) with the record as struct ``r``; a line that isn't a JSON object has ``r._broken``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    found = F.from_json("value", schema, options)
    return lines.withColumn("r", F.when(F.ltrim("value").startswith("{"), found).otherwise(F.from_json(F.lit("{"), schema, options)))


def inverted_index(words: Column) -> Column:
    """Map of each word to its positions, from 0, ascending: sorted by word and position, cut where the word changes."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def cut(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda x, i: i), lambda i: F.coalesce(F.get(found, i - 1)["w"] != F.get(found, i)["w"], F.lit(True)))
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(found))
        spots = lambda i, j: F.transform(F.slice(found, i + 1, j - i), lambda x: x["p"])
        return urls.let(starts, lambda at: F.map_from_entries(F.transform(at, lambda i, k: F.struct(F.get(found, i)["w"], spots(i, end(at, k))))))

    return urls.let(placed, cut)


def inverted_abstract(index: Column) -> Column:
    """The words by position; of words that claim one position the last counts, gaps are left out; null without any."""
    entries = F.map_entries(index)
    words = F.transform(entries, lambda e, n: F.transform(e["value"], lambda p: F.struct(p.alias("p"), n.alias("n"), e["key"].alias("w"))))
    last = urls.let(F.array_sort(F.flatten(words)), lambda placed: F.filter(placed, lambda x, i: F.coalesce(F.get(placed, i + 1)["p"] != x["p"], F.lit(True))))
    return urls.let(last, lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda y: y["w"]), " ")))


def is_venue(name: Column, kind: Column, version: Column) -> Column:
    """Whether a source is a publication venue: named, no repository or preprint, not a submitted version's."""
    other = F.lower(F.coalesce(kind, F.lit(""))).isin(NO_VENUE_TYPES) | (F.coalesce(version, F.lit("")) == UNPUBLISHED) | name.rlike(NO_VENUE_NAME)
    return F.coalesce((F.btrim(name) != "") & ~other, F.lit(False))


def openalex_locations(r: Column) -> Column:
    """All locations of a record as array of struct(path, l): primary, listed, best open one."""
    item = lambda path, l: F.struct((path if isinstance(path, Column) else F.lit(path)).alias("path"), l.alias("l"))
    listed = F.coalesce(F.transform(r["locations"], lambda l, i: item(F.concat(F.lit("locations["), i.cast("string"), F.lit("]")), l)), F.array().cast(f"array<struct<path:string,l:{_LOCATION}>>"))
    return F.concat(F.array(item("primary_location", r["primary_location"])), listed, F.array(item("best_oa_location", r["best_oa_location"])))


def _first_of_each(items: Column, key) -> Column:
    """Items whose key no earlier item has."""
    return urls.let(items, lambda all_: urls.let(F.transform(all_, key), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def openalex_venues(r: Column) -> Column:
    """Array of struct(path, source_id, name, type, url) of a record's venues, each source and name once."""
    v = F.filter(openalex_locations(r), lambda x: is_venue(x["l"]["source"]["display_name"], x["l"]["source"]["type"], x["l"]["version"]))
    named = F.transform(v, lambda x: F.struct(F.concat(x["path"], F.lit(".source")).alias("path"), x["l"]["source"]["id"].alias("source_id"), F.btrim(x["l"]["source"]["display_name"]).alias("name"), x["l"]["source"]["type"].alias("type"), x["l"]["landing_page_url"].alias("url")))
    return _first_of_each(named, lambda x: F.concat_ws("\u0000", F.coalesce(x["source_id"], F.lit("\u0001")), F.lower(x["name"])))


def s2_venues(r: Column) -> Column:
    """The structured venue, or where it has no name the plain one, if it is a venue."""
    v, none = r["publicationVenue"], F.lit(None).cast("string")
    named = lambda path, i, n, t, u: F.struct(F.lit(path).alias("path"), i.alias("source_id"), F.btrim(n).alias("name"), t.alias("type"), u.alias("url"))
    structured = F.coalesce(v["name"], F.lit("")) != ""
    found = F.when(structured & is_venue(v["name"], v["type"], none), F.array(named("publicationVenue", v["id"], v["name"], v["type"], v["url"])))
    found = found.when(~structured & is_venue(r["venue"], none, none), F.array(named("venue", none, r["venue"], none, none)))
    return F.coalesce(found, F.array().cast("array<struct<path:string,source_id:string,name:string,type:string,url:string>>"))


def openalex_papers(records: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and a paper's columns of each usable record: id, title, year, an author and an abstract of 20 characters."""
    r = F.col("r")
    authors = F.filter(F.transform(r["authorships"], lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    rows = records.select(
        *keep,
        r["id"].alias("paper_id"),
        text.norm_doi(r["doi"]).alias("doi"),
        r["title"].alias("title"),
        authors.alias("authors"),
        r["publication_year"].alias("year"),
        inverted_abstract(r["abstract_inverted_index"]).alias("abstract"),
        F.coalesce(F.nullif(r["primary_location"]["landing_page_url"], F.lit("")), r["id"]).alias("url"),
        openalex_venues(r).alias("venues"),
        r["cited_by_count"].alias("citation_count"),
        r["best_oa_location"]["pdf_url"].alias("pdf_url"),
    )
    fine = (F.coalesce("paper_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("year", F.lit(0)) != 0) & (F.size("authors") > 0) & (F.length(F.btrim("abstract")) >= 20)
    return rows.filter(fine & F.col("year").between(1900, 2100)).withColumn("venue", F.get("venues", F.lit(0))["name"])


def s2_papers(records: DataFrame, *keep: str) -> DataFrame:
    """The same of Semantic Scholar's records: id, title, an author, a year from 1900 to 2100; a short abstract gives way to a placeholder."""
    r = F.col("r")
    authors = F.filter(F.transform(r["authors"], lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    rows = records.select(
        *keep,
        r["paperId"].alias("paper_id"),
        text.norm_doi(r["externalIds"]["DOI"]).alias("doi"),
        r["title"].alias("title"),
        authors.alias("authors"),
        r["year"].alias("year"),
        F.when(F.length(F.btrim(r["abstract"])) >= 20, r["abstract"]).otherwise(F.lit(text.PLACEHOLDER)).alias("abstract"),
        F.coalesce(F.nullif(r["url"], F.lit("")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), r["paperId"])).alias("url"),
        s2_venues(r).alias("venues"),
        F.coalesce(r["citationCount"], F.lit(0)).alias("citation_count"),
        F.nullif(r["openAccessPdf"]["url"], F.lit("")).alias("pdf_url"),
    )
    fine = (F.coalesce("paper_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.size("authors") > 0) & F.coalesce(F.col("year").between(1900, 2100), F.lit(False))
    return rows.filter(fine).withColumn("venue", F.get("venues", F.lit(0))["name"])


def response(records: DataFrame, papers: DataFrame) -> DataFrame:
    """received, normalised and skipped of one response."""
    both = records.agg(F.count("*").alias("received")).crossJoin(papers.agg(F.count("*").alias("normalised")))  # one row each
    return both.withColumn("skipped", F.col("received") - F.col("normalised"))


def _identifier(scheme: Column | str, value: Column, revision: Column, provider: str, path: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(scheme).alias("scheme"), value.alias("value"), revision.alias("revision"), F.lit(provider).alias("provider"), as_column(path).alias("metadata_path"))


def last_of_each(identifiers: Column) -> Column:
    """Identifiers by scheme, value and revision: the last of each, where the first stood."""
    key = lambda x: F.concat_ws("\u0000", x["scheme"], x["value"], F.coalesce(x["revision"], F.lit("\u0001")))
    last = lambda all_: F.transform(F.array_distinct(F.transform(all_, key)), lambda k: F.element_at(F.filter(all_, lambda x: key(x) == k), -1))
    return urls.let(identifiers, last)


def _located(provider: str, record_id: Column, items: Column) -> Column:
    """Locations with a usable URL, and the identifiers that their URLs name."""

    def one(x: Column) -> Column:
        l, path = x["l"], x["path"]
        good = lambda u: F.when(urls.is_http_url(u), u)
        found = []
        for field in ("pdf_url", "landing_page_url"):
            named = urls.identifier(good(l[field]))
            found.append(F.when(named.isNotNull(), _identifier(named["scheme"], named["value"], named["revision"], provider, F.concat(path, F.lit(f".{field}")))))
        name = F.concat_ws(":", F.lit(provider), F.coalesce(record_id, F.lit("None")), path)
        return F.struct(
            F.substring(F.sha2(name, 256), 1, 20).alias("location_id"),
            path.alias("metadata_path"),
            good(l["pdf_url"]).alias("pdf_url"),
            good(l["landing_page_url"]).alias("landing_url"),
            l["version"].alias("version"),
            l["source"]["type"].alias("host_type"),
            l["license"].alias("license"),
            F.array_compact(F.array(*found)).alias("identifiers"),
        )

    return F.filter(F.transform(items, one), lambda x: x["pdf_url"].isNotNull() | x["landing_url"].isNotNull())


def _bare_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(doi), "^https?://doi\\.org/", "")


def _sources(rows: DataFrame, provider: str, record_id: Column, doi: Column, doi_path: str, named: list[Column]) -> DataFrame:
    """``rows`` (with array ``locations``) with identifiers, whether they are related, and the revision asked for."""
    none = F.lit(None).cast("string")
    arxiv = urls.arxiv_id(doi)
    items = [
        F.when(doi.isNotNull(), _identifier("doi", doi, none, provider, doi_path)),
        F.when(record_id.isNotNull(), _identifier(provider, record_id, none, provider, "id" if provider == "openalex" else "paperId")),
        *named,
    ]
    tail = F.when(arxiv.isNotNull(), _identifier("arxiv", arxiv["base"], arxiv["revision"], provider, "doi"))
    every = F.concat(F.array_compact(F.array(*items)), F.flatten(F.transform("locations", lambda x: x["identifiers"])), F.array_compact(F.array(tail)))
    rows = rows.withColumn("identifiers", last_of_each(every))
    related = F.size(F.filter("identifiers", lambda x: x["scheme"].isin("doi", "arxiv", "acl"))) > 1
    revised = F.filter("identifiers", lambda x: (x["scheme"] == "arxiv") & x["revision"].isNotNull())
    return rows.withColumn("related", related).withColumn("target_revision", F.when(F.size(revised) == 1, F.get(revised, F.lit(0))["revision"]))


def openalex_sources(records: DataFrame) -> DataFrame:
    """Records with identifiers, locations, related and target_revision.

    Unlike venues, locations begin with the best open one.
    """
    r = F.col("r")
    every = openalex_locations(r)
    items = F.concat(F.slice(every, -1, 1), F.slice(every, F.lit(1), F.size(every) - 1))
    rows = records.withColumn("locations", _located("openalex", r["id"], items))
    return _sources(rows, "openalex", r["id"], _bare_doi(r["doi"]), "doi", [])


def s2_sources(records: DataFrame) -> DataFrame:
    r, none = F.col("r"), F.lit(None).cast("string")
    location = F.struct(r["openAccessPdf"]["url"].alias("pdf_url"), none.alias("landing_page_url"), none.alias("version"), none.alias("license"), F.struct(none.alias("id"), none.alias("display_name"), none.alias("type")).alias("source"))
    rows = records.withColumn("locations", _located("semantic_scholar", r["paperId"], F.array(F.struct(F.lit("openAccessPdf").alias("path"), location.alias("l")))))
    arxiv, acl = urls.arxiv_id(r["externalIds"]["ArXiv"]), urls.identifier(F.concat(F.lit("https://aclanthology.org/"), r["externalIds"]["ACL"], F.lit("/")))
    named = [
        F.when(arxiv.isNotNull(), _identifier("arxiv", arxiv["base"], arxiv["revision"], "semantic_scholar", "externalIds.ArXiv")),
        F.when(acl.isNotNull(), _identifier(acl["scheme"], acl["value"], acl["revision"], "semantic_scholar", "externalIds.ACL")),
    ]
    return _sources(rows, "semantic_scholar", r["paperId"], _bare_doi(r["externalIds"]["DOI"]), "externalIds.DOI", named)


def with_official(rows: DataFrame, key: str) -> DataFrame:
    """One row for each location of rows (key, locations, identifiers), and for the official PDFs of identifiers that have one: key, ord, source, loc."""
    none = F.lit(None).cast("string")

    def official(x: Column) -> Column:
        where = F.concat(x["scheme"], F.lit(":"), x["value"], F.coalesce(x["revision"], F.lit("")))
        return F.struct(where.alias("location_id"), x["metadata_path"].alias("metadata_path"), urls.official_pdf(x).alias("pdf_url"), none.alias("landing_url"), none.alias("version"), none.alias("host_type"), none.alias("license"), F.array(x).cast(_ID).alias("identifiers"))

    more = F.transform(F.filter("identifiers", lambda x: x["scheme"].isin("arxiv", "acl")), official)
    return rows.select(key, "target_revision", F.posexplode_outer(F.concat("locations", more.cast(_LOC))).alias("ord", "loc")).filter("loc is not null")  # outer: no filter that would evaluate the array again


def merge_locations(located: DataFrame, key: str) -> DataFrame:
    """Locations of :func:`with_official` by canonical URL: identifiers and metadata paths together, a version only if they agree.

    ``place`` is the order in which they are tried: the revision asked for, then published
    before accepted before submitted, then publishers, arXiv and others, then as they came.
    """
    url = F.coalesce("loc.pdf_url", "loc.landing_url")
    rows = located.withColumn("url", urls.canonical_url(url)).withColumn("__raw", url)
    first = lambda c: F.min_by(c, "ord")
    several = F.count_distinct("loc.version") > 1
    merged = rows.groupBy(key, "url").agg(
        F.min("ord").alias("first_ord"),
        first("target_revision").alias("target_revision"),
        first("loc.location_id").alias("location_id"),
        first("__raw").alias("raw_url"),
        first("loc.host_type").alias("host_type"),
        F.when(~several, F.min("loc.version")).alias("version"),
        several.alias("conflict"),
        F.array_sort(F.collect_list(F.struct(F.col("ord").alias("at"), F.col("loc.metadata_path").alias("p"), F.col("loc.identifiers").alias("i")))).alias("every"),
    )
    merged = merged.withColumn("provenance", F.transform("every", lambda x: x["p"])).withColumn("identifiers", last_of_each(F.flatten(F.transform("every", lambda x: x["i"])))).drop("every")
    exact = F.exists("identifiers", lambda x: (x["scheme"] == "arxiv") & F.coalesce(x["revision"] == F.col("target_revision"), F.lit(False)))
    version = F.when(F.array_position(F.array(*map(F.lit, VERSIONS)), F.coalesce("version", F.lit(""))) > 0, F.array_position(F.array(*map(F.lit, VERSIONS)), F.col("version"))).otherwise(9)
    where = urls.host(F.col("raw_url"))
    host = F.when((where == "aclanthology.org") | F.coalesce(F.col("host_type") == "publisher", F.lit(False)), 0).when(where == "arxiv.org", 1).otherwise(2)
    order = W.partitionBy(key).orderBy(F.when(exact, 0).otherwise(1), version, host, "first_ord")
    return merged.withColumn("place", F.row_number().over(order))


def planned_attempts(merged: DataFrame, key: str, budget: int = 3) -> DataFrame:
    """The locations that a recovery tries: with a usable PDF link, each URL once, the first ``budget``; ``attempt`` from 1."""
    fine = merged.filter(urls.is_http_url(F.col("raw_url")))
    return fine.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy("place"))).filter(F.col("attempt") <= budget)


def attach_lookup(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Papers (paper_id, doi, title, authors) that a looked-up record belongs to: equal DOI and title and a shared author, case and marks aside."""
    plain = text.norm_nfkc
    rows = records.select(
        F.regexp_replace(F.lower(F.col("r.doi")), "^https://doi\\.org/", "").alias("__doi"),
        F.col("r.id").alias("record_id"),
        plain(F.col("r.title")).alias("__title"),
        F.transform("r.authorships", lambda a: a["author"]["display_name"]).alias("__names"),
    )
    joined = papers.join(rows, F.col("doi") == F.col("__doi")).filter(plain(F.col("title")) == F.col("__title"))
    pairs = joined.select("paper_id", "record_id", F.explode("authors").alias("__a"), "__names").select("paper_id", "record_id", plain(F.col("__a")).alias("__a"), F.explode("__names").alias("__n"))
    same = pairs.withColumn("__n", plain(F.col("__n"))).filter("__a = __n and __a <> ''")
    return same.select("paper_id", "record_id").distinct()


def backfill_abstracts(papers: DataFrame, lookup: DataFrame) -> DataFrame:
    """``papers`` with abstracts of ``lookup`` (doi, abstract) where their own isn't usable and a DOI finds one that is."""
    fresh = lookup.filter(F.col("doi").isNotNull() & text.usable_abstract(F.col("abstract"))).groupBy(F.col("doi").alias("__doi")).agg(F.min("abstract").alias("__abstract"))
    own = text.usable_abstract(F.col("abstract"))
    joined = papers.join(fresh, F.col("doi") == F.col("__doi"), "left")
    return joined.withColumn("abstract", F.when(own, F.col("abstract")).otherwise(F.coalesce("__abstract", "abstract"))).select(*papers.columns)


def with_fallback(primary: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """All rows of ``primary``, and those of ``fallback`` for each query to which ``primary`` gave none; ``provider`` tells which."""
    answered = primary.select(by).distinct()
    rest = fallback.join(answered, by, "left_anti").withColumn("provider", F.lit("fallback"))
    return primary.withColumn("provider", F.lit("primary")).unionByName(rest.select(*primary.columns, "provider"))


def _sanitised(field: str):
    return lambda x: x.withField(field, urls.sanitize_url(x[field]))


def safe_paper(papers: DataFrame) -> DataFrame:
    """Papers with every URL sanitised: their own, their PDF's, those of their locations and venues where these columns are there."""
    out = papers.withColumn("url", urls.sanitize_url(F.col("url"))).withColumn("pdf_url", urls.sanitize_url(F.col("pdf_url")))
    for name, fields in (("locations", ("pdf_url", "landing_url")), ("venues", ("url",))):
        if name in papers.columns:
            for field in fields:
                out = out.withColumn(name, F.transform(name, _sanitised(field)))
    return out
