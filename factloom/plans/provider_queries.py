"""Provider records, venues, identifiers and locations over landed JSON lines, each with its SQL.

Every document lands one OpenAlex and one Semantic Scholar record, awkward ones among them;
DuckDB parses the same lines with its own JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import papers as P
from ..operators import providers as R
from ..sources import adapters as A
from .queries import query

_PLACE = '{"pdf_url":%s,"landing_page_url":%s,"version":%s,"license":"cc-by","source":{"id":%s,"display_name":%s,"type":%s}}'


def _place(pdf: str | None = None, page: str | None = None, version: str | None = None, sid: str | None = None, name: str | None = None, kind: str | None = None) -> str:
    return _PLACE % tuple("null" if x is None else f'"{x}"' for x in (pdf, page, version, sid, name, kind))


def _work(doi: str = '"https://doi.org/10.1/AB{i}"', title: str = '"Graph Methods {i}"', year: str = "2020", cites: str = "12", authors: str = '"Ann Lee","Bo Li"', index: str = '{"We":[0],"study":[1],"graphs":[2,5],"and":[3],"their":[4],"today":[6]}', primary: str = "null", listed: str = "", best: str = "null", wid: str = '"https://openalex.org/W{i}"') -> str:
    people = ",".join(f'{{"author":{{"display_name":{a}}}}}' for a in authors.split(",")) if authors else ""
    return f'{{"id":{wid},"doi":{doi},"title":{title},"publication_year":{year},"cited_by_count":{cites},"authorships":[{people}],"abstract_inverted_index":{index},"primary_location":{primary},"locations":[{listed}],"best_oa_location":{best}}}'


_CONF = _place(None, "https://conf.org/{i}", "publishedVersion", "S1", "Conf on Graphs", "conference")
_ARXIV = _place("https://arxiv.org/pdf/2001.00001v2.pdf", "https://arxiv.org/abs/2001.00001", "submittedVersion", "S2", "arXiv (Cornell University)", "repository")
OPENALEX_LINES = [
    _work(primary=_CONF, listed=",".join([_ARXIV, _place(None, "https://conf.org/again", None, "S1", "CONF ON GRAPHS", "conference")]), best=_place("https://aclanthology.org/2020.acl-main.{i}.pdf", None, "publishedVersion", "S3", "ACL", "conference")),
    _work(index='{"alpha":[0],"beta":[0,2],"gamma":[9],"this abstract is long":[4],"late":[9]}', cites="null", primary=_place(None, None, None, "S4", " Journal of Things ", None)),
    _work(authors=""),
    _work(index='{"too":[0],"short":[1]}', primary=_CONF),
    _work(year="null", primary=_CONF),
    _work(title='""', listed=_CONF),
    "{broken {i}",
    _work(doi="null", primary=_place("https://www.medrxiv.org/{i}.pdf", "https://www.medrxiv.org/{i}", None, None, "medRxiv preprints", None), listed=",".join([_place(None, "ftp://x.org/a", "submittedVersion", "S5", "Conf on Sets", "conference"), _place(None, None, None, "S6", "   ", "journal")])),
    _work(doi='"10.48550/arXiv.2001.00002v3"', listed=_place("https://arxiv.org/pdf/2001.00002v3", "https://arxiv.org/abs/2001.00002", None, "S2", "Archive", "Repository")),
    _work(listed=",".join([_place("https://user:pw@e.org/{i}.pdf", "https://openreview.net/forum?id=rev{i}", "acceptedVersion", "S7", "OpenReview", "journal"), _place("https://e.org/p.pdf#x", None, "publishedVersion", "S7", "Open review", "journal")]), best=_place("HTTPS://E.org:443/p.pdf", None, "acceptedVersion", "S8", "Preprint server", "conference")),
    "[{i}]",
    _work(authors='null,"Cy Öst"', wid="null"),
]


def _s2(pid: str = '"s{i}"', title: str = '"Graph methods {i}"', year: str = "2019", authors: str = '"Bo Li","Dee"', abstract: str = '"An abstract of some length for {i}."', ids: str = '{"DOI":"10.1/AB{i}"}', cites: str = "3", pdf: str = "null", venue: str = '""', structured: str = "null", url: str = "null") -> str:
    people = ",".join(f'{{"name":{a}}}' for a in authors.split(",")) if authors else ""
    return f'{{"paperId":{pid},"title":{title},"year":{year},"authors":[{people}],"abstract":{abstract},"externalIds":{ids},"citationCount":{cites},"openAccessPdf":{pdf},"venue":{venue},"publicationVenue":{structured},"url":{url}}}'


S2_LINES = [
    _s2(structured='{"id":"V1","name":"Conf on Graphs","type":"conference","url":"https://conf.org"}', venue='"Other"', pdf='{"url":"https://arxiv.org/pdf/2001.00001"}', ids='{"DOI":"10.1/AB{i}","ArXiv":"2001.00001v2","ACL":"2020.acl-main.{i}"}', url='"https://s2.org/{i}"'),
    _s2(venue='" Journal of Things "', abstract='"short"', cites="null"),
    _s2(structured='{"id":"V2","name":"bioRxiv","type":"journal","url":null}', venue='"Kept out"', ids="null"),
    _s2(structured='{"id":"V3","name":"","type":"journal","url":null}', venue='"Legacy Venue"', abstract="null"),
    _s2(venue='"ArXiv"', ids='{"DOI":"https://doi.org/10.1/cd{i}","ArXiv":"2013.00001"}'),
    _s2(year="1800"),
    _s2(authors=""),
    "nothing at all {i}",
    _s2(pid="null"),
    _s2(structured='{"id":"V4","name":"Some Repository Journal","type":"journal","url":null}', pdf='{"url":"ftp://e.org/x.pdf"}'),
    _s2(year="null"),
]


def _lines(spark, sf, lines: list[str]) -> DataFrame:
    held = F.array(*[F.lit(x) for x in lines])
    value = F.replace(F.element_at(held, (F.col("doc_id") % len(lines) + 1).cast("int")), F.lit("{i}"), F.col("doc_id").cast("string"))
    return A.read(spark, sf, "documents").select("doc_id", value.alias("value"))


def openalex(spark, sf) -> DataFrame:
    return R.parsed(_lines(spark, sf, OPENALEX_LINES), R.OPENALEX)


def semantic_scholar(spark, sf) -> DataFrame:
    return R.parsed(_lines(spark, sf, S2_LINES), R.SEMANTIC_SCHOLAR)


def _records(name: str, lines: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(k, x.replace("'", "''")) for k, x in enumerate(lines))
    return f"{name} AS (SELECT doc_id, CASE WHEN json_type(v) = 'OBJECT' THEN v END AS r FROM (SELECT doc_id, TRY_CAST(replace(t, '{{i}}', CAST(doc_id AS VARCHAR)) AS JSON) AS v FROM documents JOIN (VALUES {rows}) c(k, t) ON doc_id % {len(lines)} = c.k))"


_OA, _SS = _records("oa", OPENALEX_LINES), _records("ss", S2_LINES)
_PLACES = """places AS (
  SELECT doc_id, 0 AS ord, 'primary_location' AS path, r->'primary_location' AS l FROM oa UNION ALL
  SELECT doc_id, generate_subscripts(CAST(r->'locations' AS JSON[]), 1), 'locations[' || (generate_subscripts(CAST(r->'locations' AS JSON[]), 1) - 1) || ']', unnest(CAST(r->'locations' AS JSON[])) FROM oa UNION ALL
  SELECT doc_id, 999, 'best_oa_location', r->'best_oa_location' FROM oa)"""
_NO_VENUE = r"(?i)\b(arxiv|biorxiv|medrxiv)\b|\bpreprints?\b|\brepository\b"
_OA_VENUES = rf"""venues AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source_id, lower(name) ORDER BY ord) AS nth FROM (
    SELECT doc_id, ord, path || '.source' AS path, l->'source'->>'id' AS source_id, trim(l->'source'->>'display_name') AS name, l->>'landing_page_url' AS url FROM places
    WHERE trim(coalesce(l->'source'->>'display_name', '')) <> '' AND lower(coalesce(l->'source'->>'type', '')) NOT IN ('repository', 'preprint')
      AND coalesce(l->>'version', '') <> 'submittedVersion' AND NOT regexp_matches(l->'source'->>'display_name', '{_NO_VENUE}')))"""
_OA_ABSTRACT = """spots AS (SELECT doc_id, k.w, k.n, unnest(CAST(json_extract(r, '$.abstract_inverted_index."' || k.w || '"') AS INTEGER[])) AS p
  FROM (SELECT doc_id, r, unnest(json_keys(r, '$.abstract_inverted_index')) AS w, generate_subscripts(json_keys(r, '$.abstract_inverted_index'), 1) AS n FROM oa) k),
abstracts AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS abstract FROM (SELECT doc_id, p, arg_max(w, n) AS w FROM spots GROUP BY doc_id, p) GROUP BY doc_id)"""
_OA_PAPERS = """oa_papers AS (
  SELECT oa.doc_id, r->>'id' AS paper_id, nullif(regexp_replace(lower(trim(r->>'doi')), '^(https?://doi\\.org/|doi:)', ''), '') AS doi, r->>'title' AS title,
    list_filter(CAST(json_extract_string(r, '$.authorships[*].author.display_name') AS VARCHAR[]), lambda x: x <> '') AS authors, CAST(r->>'publication_year' AS INTEGER) AS year, abstract,
    coalesce(r->'primary_location'->>'landing_page_url', r->>'id') AS url, (SELECT name FROM venues v WHERE v.doc_id = oa.doc_id ORDER BY ord LIMIT 1) AS venue,
    CAST(r->>'cited_by_count' AS INTEGER) AS citation_count, r->'best_oa_location'->>'pdf_url' AS pdf_url
  FROM oa JOIN abstracts a ON oa.doc_id = a.doc_id
  WHERE r->>'id' <> '' AND r->>'title' <> '' AND r->>'publication_year' IS NOT NULL AND length(trim(abstract)) >= 20 AND len(authors) > 0)"""
_SS_VENUES = rf"""ss_venues AS (SELECT * FROM (
  SELECT doc_id, CASE WHEN coalesce(r->'publicationVenue'->>'name', '') <> '' THEN 'publicationVenue' ELSE 'venue' END AS path,
    CASE WHEN coalesce(r->'publicationVenue'->>'name', '') <> '' THEN r->'publicationVenue'->>'id' END AS source_id,
    trim(coalesce(nullif(r->'publicationVenue'->>'name', ''), r->>'venue')) AS name FROM ss) WHERE name <> '' AND NOT regexp_matches(name, '{_NO_VENUE}'))"""
_SS_PAPERS = """ss_papers AS (
  SELECT ss.doc_id, r->>'paperId' AS paper_id, nullif(regexp_replace(lower(trim(r->'externalIds'->>'DOI')), '^(https?://doi\\.org/|doi:)', ''), '') AS doi, r->>'title' AS title,
    list_filter(CAST(json_extract_string(r, '$.authors[*].name') AS VARCHAR[]), lambda x: x <> '') AS authors, CAST(r->>'year' AS INTEGER) AS year,
    CASE WHEN length(trim(r->>'abstract')) >= 20 THEN r->>'abstract' ELSE 'Abstract not available for this paper.' END AS abstract,
    coalesce(r->>'url', 'https://www.semanticscholar.org/paper/' || (r->>'paperId')) AS url, v.name AS venue, coalesce(CAST(r->>'citationCount' AS INTEGER), 0) AS citation_count, r->'openAccessPdf'->>'url' AS pdf_url
  FROM ss LEFT JOIN ss_venues v ON ss.doc_id = v.doc_id WHERE r->>'paperId' <> '' AND r->>'title' <> '' AND CAST(r->>'year' AS INTEGER) BETWEEN 1900 AND 2100 AND len(authors) > 0)"""
_OA_ALL, _SS_ALL = f"{_OA}, {_PLACES}, {_OA_VENUES}, {_OA_ABSTRACT}, {_OA_PAPERS}", f"{_SS}, {_SS_VENUES}, {_SS_PAPERS}"
_COLUMNS = "doc_id, paper_id, doi, title, array_to_string(authors, '|') AS authors, year, abstract, url, venue, citation_count, pdf_url"


def _shown(papers: DataFrame) -> DataFrame:
    return papers.select("doc_id", "paper_id", "doi", "title", F.array_join("authors", "|").alias("authors"), "year", "abstract", "url", "venue", "citation_count", "pdf_url")


@query(f"WITH {_OA_ALL} SELECT {_COLUMNS} FROM oa_papers")
def src_openalex_norm(spark, sf):
    return _shown(R.openalex_papers(openalex(spark, sf), "doc_id"))


@query(f"WITH {_SS_ALL} SELECT {_COLUMNS} FROM ss_papers")
def src_s2_norm(spark, sf):
    return _shown(R.s2_papers(semantic_scholar(spark, sf), "doc_id"))


@query(f"WITH {_OA_ALL} SELECT count(*) AS received, (SELECT count(*) FROM oa_papers) AS normalised, count(*) - (SELECT count(*) FROM oa_papers) AS skipped FROM oa")
def src_search(spark, sf):
    records = openalex(spark, sf)
    return R.response(records, R.openalex_papers(records))


@query(f"WITH {_SS_ALL} SELECT count(*) AS received, (SELECT count(*) FROM ss_papers) AS normalised, count(*) - (SELECT count(*) FROM ss_papers) AS skipped FROM ss")
def src_s2_search(spark, sf):
    records = semantic_scholar(spark, sf)
    return R.response(records, R.s2_papers(records))


@query(f"WITH {_OA}, {_OA_ABSTRACT} SELECT doc_id, abstract FROM abstracts")
def abstract_rebuild(spark, sf):
    """Inverted indexes to texts, with words that claim one position and gaps."""
    found = openalex(spark, sf).select("doc_id", R.inverted_abstract(F.col("r.abstract_inverted_index")).alias("abstract"))
    return found.filter("abstract is not null")


@query(f"WITH {_OA}, {_PLACES}, {_OA_VENUES} SELECT doc_id, path, source_id, name, url FROM venues WHERE nth = 1")
def venue_extract_openalex(spark, sf):
    return openalex(spark, sf).select("doc_id", F.explode(R.openalex_venues(F.col("r"))).alias("v")).select("doc_id", "v.path", "v.source_id", "v.name", "v.url")


@query(f"WITH {_SS}, {_SS_VENUES} SELECT doc_id, path, source_id, name FROM ss_venues")
def venue_extract_s2(spark, sf):
    return semantic_scholar(spark, sf).select("doc_id", F.explode(R.s2_venues(F.col("r"))).alias("v")).select("doc_id", "v.path", "v.source_id", "v.name")


@query(
    f"""WITH {_OA}, {_PLACES} SELECT doc_id, path, coalesce(trim(l->'source'->>'display_name') <> '' AND lower(coalesce(l->'source'->>'type', '')) NOT IN ('repository', 'preprint')
    AND coalesce(l->>'version', '') <> 'submittedVersion' AND NOT regexp_matches(l->'source'->>'display_name', '{_NO_VENUE}'), false) AS venue FROM places WHERE l IS NOT NULL AND json_type(l) = 'OBJECT'"""
)
def venue_reject_repo(spark, sf):
    rows = openalex(spark, sf).select("doc_id", F.explode(R.openalex_locations(F.col("r"))).alias("x")).filter("x.l is not null")
    return rows.select("doc_id", "x.path", R.is_venue(F.col("x.l.source.display_name"), F.col("x.l.source.type"), F.col("x.l.version")).alias("venue"))


_URL_ID = r"""CASE WHEN regexp_matches({u}, '^https?://(www\.)?arxiv\.org/(abs|pdf)/') THEN 'arxiv' WHEN regexp_matches({u}, '^https?://aclanthology\.org/[0-9]{{4}}\.[a-z0-9-]+\.[0-9]+(\.pdf)?/?$') THEN 'acl' WHEN regexp_matches({u}, '^https?://openreview\.net/forum\?id=') THEN 'openreview' END"""
_URL_VALUE = r"""coalesce(nullif(regexp_extract({u}, '/(?:abs|pdf)/([0-9]{{4}}\.[0-9]{{5}})(?:v[0-9]+)?(?:\.pdf)?$', 1), ''), nullif(regexp_extract({u}, 'aclanthology\.org/(.*?)(?:\.pdf)?/?$', 1), ''), regexp_extract({u}, 'id=(.*)$', 1))"""
_URL_REVISION = r"""nullif(regexp_extract({u}, '(v[0-9]+)(?:\.pdf)?$', 1), '')"""


def _named(u: str) -> str:
    return f"{_URL_ID.format(u=u)} AS scheme, {_URL_VALUE.format(u=u)} AS value, CASE WHEN {_URL_ID.format(u=u)} = 'arxiv' THEN {_URL_REVISION.format(u=u)} END AS revision"


_OA_IDS = f"""located AS (SELECT doc_id, CASE path WHEN 'best_oa_location' THEN -1 ELSE ord END AS ord, path, l, CASE WHEN regexp_matches(l->>'pdf_url', '(?i)^https?://[^/@]+(/|$)') THEN l->>'pdf_url' END AS pdf, CASE WHEN regexp_matches(l->>'landing_page_url', '(?i)^https?://[^/@]+(/|$)') THEN l->>'landing_page_url' END AS page FROM places),
raw_ids AS (
  SELECT doc_id, -9.0 AS ord, 'doi' AS scheme, regexp_replace(lower(r->>'doi'), '^https?://doi\\.org/', '') AS value, NULL AS revision, 'doi' AS path FROM oa WHERE r->>'doi' IS NOT NULL UNION ALL
  SELECT doc_id, -8.0, 'openalex', r->>'id', NULL, 'id' FROM oa WHERE r->>'id' IS NOT NULL UNION ALL
  SELECT doc_id, ord + 0.0, {_named('pdf')}, path || '.pdf_url' FROM located WHERE pdf IS NOT NULL UNION ALL
  SELECT doc_id, ord + 0.5, {_named('page')}, path || '.landing_page_url' FROM located WHERE page IS NOT NULL UNION ALL
  SELECT doc_id, 9999.0, 'arxiv', regexp_extract(lower(r->>'doi'), 'arxiv\\.([0-9.]+)', 1), nullif(regexp_extract(lower(r->>'doi'), '(v[0-9]+)$', 1), ''), 'doi' FROM oa WHERE regexp_matches(lower(r->>'doi'), '10\\.48550/arxiv\\.')),
ids AS (SELECT doc_id, scheme, value, revision, arg_max(path, ord) AS metadata_path, min(ord) AS first_at FROM raw_ids WHERE scheme IS NOT NULL GROUP BY doc_id, scheme, value, revision)"""


@query(f"WITH {_OA}, {_PLACES}, {_OA_IDS} SELECT doc_id, scheme, value, revision, metadata_path, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS place FROM ids")
def metadata_sources(spark, sf):
    rows = R.openalex_sources(openalex(spark, sf)).select("doc_id", F.posexplode_outer("identifiers").alias("at", "x")).filter("x is not null")
    return rows.select("doc_id", "x.scheme", "x.value", "x.revision", "x.metadata_path", (F.col("at") + 1).alias("place"))


@query(
    f"""WITH {_OA}, {_PLACES}, {_OA_IDS} SELECT located.doc_id, substr(sha256('openalex:' || coalesce(r->>'id', 'None') || ':' || path), 1, 20) AS location_id, path AS metadata_path, pdf AS pdf_url, page AS landing_url, l->>'version' AS version, l->'source'->>'type' AS host_type
    FROM located JOIN oa ON located.doc_id = oa.doc_id WHERE pdf IS NOT NULL OR page IS NOT NULL"""
)
def metadata_locations(spark, sf):
    rows = R.openalex_sources(openalex(spark, sf)).select("doc_id", F.explode_outer("locations").alias("x")).filter("x is not null")
    return rows.select("doc_id", "x.location_id", "x.metadata_path", "x.pdf_url", "x.landing_url", "x.version", "x.host_type")


@query(
    f"""WITH {_OA}, {_PLACES}, {_OA_IDS}, n AS (SELECT doc_id, count(*) FILTER (scheme IN ('doi', 'arxiv', 'acl')) AS n, count(*) FILTER (scheme = 'arxiv' AND revision IS NOT NULL) AS v, min(revision) FILTER (scheme = 'arxiv') AS revision FROM ids GROUP BY doc_id)
    SELECT oa.doc_id, coalesce(n, 0) > 1 AS related, CASE WHEN v = 1 THEN revision END AS target_revision FROM oa LEFT JOIN n ON oa.doc_id = n.doc_id"""
)
def version_relations(spark, sf):
    return R.openalex_sources(openalex(spark, sf)).select("doc_id", "related", "target_revision")


_SS_IDS = """ss_ids AS (
  SELECT doc_id, 0 AS ord, 'doi' AS scheme, regexp_replace(lower(r->'externalIds'->>'DOI'), '^https?://doi\\.org/', '') AS value, NULL AS revision, 'externalIds.DOI' AS path FROM ss WHERE (r->'externalIds'->>'DOI') IS NOT NULL UNION ALL
  SELECT doc_id, 1, 'semantic_scholar', r->>'paperId', NULL, 'paperId' FROM ss WHERE (r->>'paperId') IS NOT NULL UNION ALL
  SELECT doc_id, 2, 'arxiv', regexp_extract(r->'externalIds'->>'ArXiv', '^([0-9.]+)', 1), nullif(regexp_extract(r->'externalIds'->>'ArXiv', '(v[0-9]+)$', 1), ''), 'externalIds.ArXiv' FROM ss WHERE regexp_matches(r->'externalIds'->>'ArXiv', '^[0-9]{2}(0[1-9]|1[0-2])\\.') UNION ALL
  SELECT doc_id, 3, 'acl', r->'externalIds'->>'ACL', NULL, 'externalIds.ACL' FROM ss WHERE (r->'externalIds'->>'ACL') IS NOT NULL UNION ALL
  SELECT doc_id, 4, 'arxiv', regexp_extract(r->'openAccessPdf'->>'url', '/pdf/([0-9.]+[0-9])', 1), nullif(regexp_extract(r->'openAccessPdf'->>'url', '(v[0-9]+)$', 1), ''), 'openAccessPdf.pdf_url' FROM ss WHERE regexp_matches(r->'openAccessPdf'->>'url', '^https?://arxiv\\.org/pdf/'))"""


@query(
    f"""WITH {_OA}, {_PLACES}, {_OA_IDS}, {_SS}, {_SS_IDS}, both_ids AS (SELECT doc_id, scheme, value, revision, metadata_path, first_at AS spot FROM ids UNION ALL SELECT doc_id, scheme, value, revision, path, 100000 + ord FROM ss_ids),
    kept AS (SELECT doc_id, scheme, value, revision, arg_max(metadata_path, spot) AS metadata_path, min(spot) AS spot FROM both_ids GROUP BY doc_id, scheme, value, revision)
    SELECT doc_id, scheme, value, revision, metadata_path, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS place FROM kept"""
)
def dedup_identifiers(spark, sf):
    """The identifiers of both providers' records of a paper, the last of each where the first stood."""
    a = R.openalex_sources(openalex(spark, sf)).select("doc_id", F.col("identifiers").alias("a"))
    b = R.s2_sources(semantic_scholar(spark, sf)).select("doc_id", F.col("identifiers").alias("b"))
    both = a.join(b, "doc_id").select("doc_id", F.posexplode_outer(R.last_of_each(F.concat("a", "b"))).alias("at", "x")).filter("x is not null")
    return both.select("doc_id", "x.scheme", "x.value", "x.revision", "x.metadata_path", (F.col("at") + 1).alias("place"))


_CANONICAL = r"CASE WHEN regexp_matches(u, '^https?://(www\.)?arxiv\.org/pdf/') THEN regexp_replace(u, '\.pdf$', '') WHEN regexp_matches(u, '(?i)^https://e\.org(:443)?/p\.pdf') THEN 'https://e.org/p.pdf' ELSE u END"
_MERGED = rf"""target AS (SELECT doc_id, CASE WHEN count(*) FILTER (scheme = 'arxiv' AND revision IS NOT NULL) = 1 THEN min(revision) FILTER (scheme = 'arxiv') END AS revision FROM ids GROUP BY doc_id),
spots AS (
  SELECT doc_id, CAST(ord AS DOUBLE) AS ord, coalesce(pdf, page) AS u, l->>'version' AS version, l->'source'->>'type' AS host_type, path, CASE WHEN {_URL_ID.format(u='pdf')} = 'arxiv' THEN {_URL_REVISION.format(u='pdf')} END AS revision FROM located WHERE pdf IS NOT NULL OR page IS NOT NULL UNION ALL
  SELECT doc_id, 2000 + row_number() OVER (PARTITION BY doc_id ORDER BY first_at), CASE scheme WHEN 'arxiv' THEN 'https://arxiv.org/pdf/' || value || coalesce(revision, '') ELSE 'https://aclanthology.org/' || value || '.pdf' END, NULL, NULL, metadata_path, CASE scheme WHEN 'arxiv' THEN revision END FROM ids WHERE scheme IN ('arxiv', 'acl')),
merged AS (
  SELECT s.doc_id, {_CANONICAL} AS url, min(ord) AS ord, arg_min(u, ord) AS raw_url, arg_min(coalesce(host_type, ''), ord) AS host_type, CASE WHEN count(DISTINCT version) <= 1 THEN min(version) END AS version, count(DISTINCT version) > 1 AS conflict,
    string_agg(path, ' ' ORDER BY ord) AS provenance, bool_or(coalesce(s.revision = t.revision, false)) AS exact FROM spots s LEFT JOIN target t ON s.doc_id = t.doc_id GROUP BY s.doc_id, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT exact, CASE version WHEN 'publishedVersion' THEN 1 WHEN 'acceptedVersion' THEN 2 WHEN 'submittedVersion' THEN 3 ELSE 9 END,
    CASE WHEN regexp_matches(raw_url, '^https?://aclanthology\.org/') OR host_type = 'publisher' THEN 0 WHEN regexp_matches(raw_url, '^https?://arxiv\.org/') THEN 1 ELSE 2 END, ord) AS place FROM merged)"""


def _merged(spark, sf) -> DataFrame:
    return R.merge_locations(R.with_official(R.openalex_sources(openalex(spark, sf)), "doc_id"), "doc_id")


@query(f"WITH {_OA}, {_PLACES}, {_OA_IDS}, {_MERGED} SELECT doc_id, url, version, conflict, provenance FROM placed")
def merge_locations(spark, sf):
    return _merged(spark, sf).select("doc_id", "url", "version", "conflict", F.array_join("provenance", " ").alias("provenance"))


@query(f"WITH {_OA}, {_PLACES}, {_OA_IDS}, {_MERGED} SELECT doc_id, url, place FROM placed")
def loc_priority(spark, sf):
    return _merged(spark, sf).select("doc_id", "url", "place")


@query(f"WITH {_OA}, {_PLACES}, {_OA_IDS}, {_MERGED}, tried AS (SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS attempt FROM placed) SELECT * FROM tried WHERE attempt <= 3")
def recover_pdf(spark, sf):
    """The plan of a recovery: each URL once, in order, under the budget; fetching is the caller's."""
    return R.planned_attempts(_merged(spark, sf), "doc_id").select("doc_id", "url", "attempt")


@query(
    f"""WITH {_OA_ALL}, {_SS_ALL} SELECT p.paper_id, o.r->>'id' AS record_id FROM ss_papers p JOIN oa o ON p.doi = regexp_replace(lower(o.r->>'doi'), '^https://doi\\.org/', '')
    AND lower(regexp_replace(p.title, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(o.r->>'title', '[^A-Za-z0-9]', '', 'g'))
    AND len(list_intersect(list_transform(p.authors, lambda x: lower(replace(x, ' ', ''))), list_transform(CAST(json_extract_string(o.r, '$.authorships[*].author.display_name') AS VARCHAR[]), lambda x: lower(replace(x, ' ', ''))))) > 0"""
)
def join_attach_lookup(spark, sf):
    return R.attach_lookup(R.s2_papers(semantic_scholar(spark, sf)), openalex(spark, sf))


_BACKFILL = "lookup AS (SELECT doi, min(abstract) AS abstract FROM oa_papers WHERE doi IS NOT NULL AND length(trim(abstract)) >= 20 GROUP BY doi), filled AS (SELECT p.doc_id, p.paper_id, CASE WHEN p.abstract <> 'Abstract not available for this paper.' AND length(trim(p.abstract)) >= 20 THEN p.abstract ELSE coalesce(l.abstract, p.abstract) END AS abstract FROM ss_papers p LEFT JOIN lookup l ON p.doi = l.doi)"


def _backfilled(spark, sf) -> DataFrame:
    return R.backfill_abstracts(R.s2_papers(semantic_scholar(spark, sf), "doc_id"), R.openalex_papers(openalex(spark, sf)))


@query(f"WITH {_OA_ALL}, {_SS_ALL}, {_BACKFILL} SELECT paper_id, abstract FROM filled")
def abstract_backfill(spark, sf):
    return _backfilled(spark, sf).select("paper_id", "abstract")


@query(f"WITH {_OA_ALL}, {_SS_ALL}, {_BACKFILL} SELECT count(*) AS papers, count(*) FILTER (abstract <> 'Abstract not available for this paper.') AS usable, count(*) FILTER (f.abstract IN (SELECT abstract FROM lookup)) AS found FROM filled f")
def join_backfill(spark, sf):
    lookup = R.openalex_papers(openalex(spark, sf)).select("abstract").distinct().withColumn("__found", F.lit(True))
    rows = _backfilled(spark, sf).join(lookup, "abstract", "left")
    return rows.agg(F.count("*").alias("papers"), F.count_if(text.usable_abstract(F.col("abstract"))).alias("usable"), F.count_if(F.col("__found")).alias("found"))


def _query_id(column: str = "doc_id") -> Column:
    return F.concat(F.lit("q"), F.floor(F.col(column) / 3).cast("string"))


@query(
    f"""WITH {_OA_ALL}, {_SS_ALL}, a AS (SELECT 'q' || doc_id // 3 AS query_id, paper_id FROM ss_papers), b AS (SELECT 'q' || doc_id // 3 AS query_id, paper_id FROM oa_papers)
    SELECT query_id, paper_id, 'primary' AS provider FROM a UNION ALL SELECT query_id, paper_id, 'fallback' FROM b WHERE query_id NOT IN (SELECT query_id FROM a)"""
)
def provider_fallback(spark, sf):
    """Queries of three records each; one to which the primary provider gave no usable record takes the other's."""
    first = R.s2_papers(semantic_scholar(spark, sf), "doc_id").select(_query_id().alias("query_id"), "paper_id")
    second = R.openalex_papers(openalex(spark, sf), "doc_id").select(_query_id().alias("query_id"), "paper_id")
    return R.with_fallback(first, second, "query_id")


@query(
    f"""WITH {_OA_ALL}, {_SS_ALL}, every AS (SELECT paper_id, doi, title, year, doc_id * 2 AS ord FROM ss_papers UNION ALL SELECT paper_id, doi, title, year, doc_id * 2 + 1 FROM oa_papers),
    k AS (SELECT paper_id, ord, CASE WHEN doi <> '' THEN 'doi:' || doi ELSE 'title:' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || ':' || year END AS key FROM every)
    SELECT paper_id, key, row_number() OVER (PARTITION BY key ORDER BY ord) > 1 AS seen FROM k"""
)
def dedup_download(spark, sf):
    a = R.s2_papers(semantic_scholar(spark, sf), "doc_id").withColumn("ord", F.col("doc_id") * 2)
    b = R.openalex_papers(openalex(spark, sf), "doc_id").withColumn("ord", F.col("doc_id") * 2 + 1)
    every = a.select("paper_id", "doi", "title", "year", "ord").unionByName(b.select("paper_id", "doi", "title", "year", "ord"))
    return P.mark_seen(every.withColumn("key", text.dedup_key(F.col("doi"), F.col("title"), F.col("year"))), "key", "ord").select("paper_id", "key", "seen")


@query(f"WITH {_OA_ALL} SELECT doc_id, CASE WHEN venue IS NULL THEN 'unconfirmed' ELSE 'provider_reported' END AS verification FROM oa_papers")
def venue_verif(spark, sf):
    return R.openalex_papers(openalex(spark, sf), "doc_id").select("doc_id", text.venue_verification(F.col("venues")).alias("verification"))


@query(
    rf"""WITH {_OA_ALL} SELECT doc_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/]*', 0)), '', '') || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS url,
    CASE WHEN pdf_url IS NOT NULL THEN lower(regexp_extract(pdf_url, '^[A-Za-z]+://[^/]*', 0)) || regexp_extract(pdf_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS pdf_url, len(list_filter(CAST(json_extract_string(r, '$.locations[*].pdf_url') AS VARCHAR[]), lambda x: contains(x, '@'))) AS hidden
    FROM oa_papers JOIN oa USING (doc_id)"""
)
def safe_paper(spark, sf):
    """Papers as they may be stored: every URL sanitised, those of locations and venues too."""
    rows = openalex(spark, sf)
    with_places = R.openalex_sources(rows).select(F.col("doc_id").alias("__d"), "locations", "r")
    papers = R.openalex_papers(rows, "doc_id").join(with_places, F.col("doc_id") == F.col("__d"))
    safe = R.safe_paper(papers)
    hidden = F.size(F.filter("r.locations", lambda x: F.coalesce(F.contains(x["pdf_url"], F.lit("@")), F.lit(False))))
    return safe.select("doc_id", "url", "pdf_url", hidden.cast("long").alias("hidden"))
