"""URL and identifier functions as Spark columns.

A URL is ``scheme://[user@]host[:port]path[?query][#fragment]``; scheme and host don't mind
case.  A port that isn't a number up to 65535 makes a URL unusable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that are kept, identifier and host patterns.
KEPT_KEYS = ["id", "article", "paper", "doi", "download"]
ARXIV = r"(?i)^((?:\d{4}\.\d{4,5}|[a-z][a-z.-]*(?:\.[A-Z]{2})?/\d{7}))(v[1-9]\d*)?$"
ACL = r"^(?:\d{4}\.[a-z0-9-]+\.\d+|[A-Z]\d{2}-\d{4})$"
ARXIV_HOSTS = ["arxiv.org", "www.arxiv.org"]
LABELS = ["pdf", "download pdf", "full text pdf"]
READ_BYTES = 1024 * 1024

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def let(value: Column, function) -> Column:
    """``function`` of ``value``, which stands in the expression once however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def parts(url: Column) -> Column:
    """struct(scheme, user, host, port, path, query) of a URL; all are empty if it isn't one, null for null.

    The user is what stands before ``@`` without a password; the port is text.
    """
    groups = F.struct(*[F.regexp_extract(url, _PARTS, k).alias(f"g{k}") for k in (1, 2, 3, 4)])
    placed = let(groups, lambda g: F.struct(g["g1"].alias("g1"), g["g2"].alias("g2"), g["g3"].alias("g3"), g["g4"].alias("g4"), F.regexp_replace(g["g2"], "^.*@", "").alias("place")))
    return let(
        placed,
        lambda g: F.struct(
            F.lower(g["g1"]).alias("scheme"),
            F.regexp_extract(g["g2"], r"^([^@:]*)(?::[^@]*)?@", 1).alias("user"),
            F.lower(F.regexp_replace(g["place"], ":[^:]*$", "")).alias("host"),
            F.regexp_extract(g["place"], ":([^:]*)$", 1).alias("port"),
            g["g3"].alias("path"),
            g["g4"].alias("query"),
            g["g2"].alias("authority"),
        ),
    )


def host(url: Column) -> Column:
    return parts(url)["host"]


def _number(p: Column) -> Column:
    return F.coalesce(p["port"].try_cast("int"), F.lit(-1))


def _usable(p: Column) -> Column:
    """Whether the URL can be taken apart at all."""
    return (p["scheme"] != "") & ((p["port"] == "") | (p["port"].rlike("^[0-9]+$") & _number(p).between(0, 65535)))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parameters(p: Column) -> Column:
    """The query as an array of struct(k, v), decoded, in order; a name without ``=`` has an empty value."""
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    return F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(value(x)).alias("v")))


def _query(items: Column) -> Column:
    """``?k=v&...``, encoded; empty without items."""
    text = F.array_join(F.transform(items, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    return F.when(F.size(items) > 0, F.concat(F.lit("?"), text)).otherwise("")


def _with_port(p: Column, drop_default: bool) -> Column:
    number = _number(p)
    shown = number > 0
    if drop_default:
        shown = shown & ~(((p["scheme"] == "https") & (number == 443)) | ((p["scheme"] == "http") & (number == 80)))
    return F.concat(p["host"], F.when(shown, F.concat(F.lit(":"), number.cast("string"))).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, user or fragment, sorted query, one form of arXiv PDF links; a URL that can't be taken apart as it is."""

    def of(p: Column) -> Column:
        arxiv = p["host"].isin(ARXIV_HOSTS) & p["path"].startswith("/pdf/") & (p["port"] == "")
        where = F.when(arxiv, F.lit("arxiv.org")).otherwise(_with_port(p, True))
        rest = F.when(arxiv, F.regexp_replace(p["path"], "\\.pdf$", "")).otherwise(p["path"])
        return F.when(_usable(p), F.concat(p["scheme"], F.lit("://"), where, rest, _query(F.array_sort(_parameters(p))))).otherwise(url)

    return let(parts(url), of)


def sanitize_url(url: Column) -> Column:
    """No user information or fragment, and only allow-listed query keys that have a value; null if it can't be taken apart."""

    def of(p: Column) -> Column:
        kept = F.filter(_parameters(p), lambda x: F.lower(x["k"]).isin(KEPT_KEYS) & (x["v"] != ""))
        return F.when(_usable(p), F.concat(p["scheme"], F.lit("://"), _with_port(p, False), p["path"], _query(kept)))

    return let(parts(url), of)


def is_http_url(url: Column) -> Column:
    return F.coalesce(let(parts(url), lambda p: _usable(p) & p["scheme"].isin("http", "https") & (p["host"] != "") & (p["user"] == "")), F.lit(False))


def pdf_host(url: Column) -> Column:
    return F.nullif(host(url), F.lit(""))


def arxiv_id(value: Column) -> Column:
    """struct(base, revision) of an arXiv id with a month from 1 to 12, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(value), "^arXiv:", ""), "(?i)^10\\.48550/arxiv\\.", "")
    found = let(bare, lambda x: F.struct(F.regexp_extract(x, ARXIV, 1).alias("base"), F.nullif(F.regexp_extract(x, ARXIV, 2), F.lit("")).alias("revision")))
    return let(found, lambda x: F.when((x["base"] != "") & F.substring(F.element_at(F.split(x["base"], "/"), -1), 3, 2).try_cast("int").between(1, 12), x))


def identifier(url: Column) -> Column:
    """struct(scheme, value, revision) for official arXiv, ACL and OpenReview URLs, else null."""
    none = F.lit(None).cast("string")
    named = lambda s, v, r=none: F.struct(F.lit(s).alias("scheme"), v.alias("value"), r.alias("revision"))

    def of(p: Column) -> Column:
        arxiv = let(arxiv_id(F.regexp_extract(p["path"], r"^/(?:abs|pdf)/(.+?)(?:\.pdf)?/?$", 1)), lambda x: F.when(x.isNotNull(), named("arxiv", x["base"], x["revision"])))
        acl = let(F.regexp_replace(F.btrim(p["path"], F.lit("/")), "\\.pdf$", ""), lambda x: F.when(x.rlike(ACL), named("acl", x)))
        ids = F.filter(_parameters(p), lambda x: (x["k"] == "id") & (x["v"] != ""))
        review = let(ids, lambda x: F.when((F.size(x) == 1) & F.get(x, F.lit(0))["v"].rlike("^[A-Za-z0-9_-]{1,128}$"), named("openreview", F.get(x, F.lit(0))["v"])))
        found = F.when(p["host"].isin(ARXIV_HOSTS), arxiv).when(p["host"] == "aclanthology.org", acl).when((p["host"] == "openreview.net") & p["path"].isin("/forum", "/pdf"), review)
        return F.when(p["scheme"].isin("http", "https") & (p["user"] == ""), found)

    return let(parts(url), of)


def id_from_url(url: Column) -> Column:
    """``scheme:value`` of :func:`identifier`."""
    return let(identifier(url), lambda x: F.concat(x["scheme"], F.lit(":"), x["value"]))


def official_pdf(found: Column) -> Column:
    """The official PDF's URL of an arXiv or ACL struct(scheme, value, revision)."""
    arxiv = lambda x: F.concat(F.lit("https://arxiv.org/pdf/"), x["value"], F.coalesce(x["revision"], F.lit("")))
    acl = lambda x: F.concat(F.lit("https://aclanthology.org/"), x["value"], F.lit(".pdf"))
    return let(found, lambda x: F.when(x["scheme"] == "arxiv", arxiv(x)).when(x["scheme"] == "acl", acl(x)))


def derived_pdf(identifier: Column) -> Column:
    """The official PDF's URL for an ``arxiv:`` or ``acl:`` identifier."""
    kind, value = F.substring_index(identifier, ":", 1), F.regexp_replace(identifier, "^[a-z]+:", "")
    return official_pdf(F.struct(kind.alias("scheme"), value.alias("value"), F.lit(None).cast("string").alias("revision")))


def anchors(html: Column) -> Column:
    """Targets of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def _joined(link: Column, base: Column, p: Column) -> Column:
    """``link`` as seen from the page ``base``: absolute, from the scheme, from the root, or beside the page; ``.`` and ``..`` are left as they are."""
    root = F.concat(p["scheme"], F.lit("://"), p["authority"])
    beside = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(p["path"], "^(.*/)", 1), F.lit("")), F.lit("/")))
    found = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(p["scheme"], F.lit(":"), link))
    found = found.when(link.startswith("/"), F.concat(root, link)).when(link == "", base).when(link.startswith("?"), F.concat(root, p["path"], link))
    return found.otherwise(F.concat(beside, link))


def pdf_links(html: Column, base: Column) -> Column:
    """Distinct links of a page to PDFs, joined with its URL, in order of appearance.

    A ``citation_pdf_url`` meta tag, anchors whose path ends in ``.pdf``, that say so, or that
    are AAAI downloads, and on ACL pages the page's own PDF at the end.  The first MiB is read.
    """
    tags = F.regexp_extract_all(F.substring(html, 1, READ_BYTES), F.lit(r"(?is)<meta\s[^>]*>|<a\s[^>]*>[^<]*"), F.lit(0))
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)

    def of(p: Column) -> Column:
        aaai = (p["host"] == "aaai.org") | p["host"].endswith(".aaai.org")

        def target(tag: Column) -> Column:
            label = F.lower(F.btrim(F.regexp_replace(F.regexp_extract(tag, r"(?s)>(.*)$", 1), r"\s+", " ")))

            def anchor(href: Column) -> Column:
                wanted = F.lower(F.regexp_replace(href, "[?#].*$", "")).endswith(".pdf") | label.isin(LABELS) | (aaai & F.contains(href, F.lit("/article/download/")))
                return F.when((href != "") & wanted, href)

            meta = F.when(F.lower(value(tag, "name")) == "citation_pdf_url", value(tag, "content"))
            return F.when(F.lower(F.substring(tag, 1, 5)) == "<meta", meta).otherwise(let(value(tag, "href"), anchor))

        own = F.concat(F.regexp_replace(p["path"], "/+$", ""), F.lit(".pdf"))
        acl = F.when((p["host"] == "aclanthology.org") & ~p["path"].endswith(".pdf"), F.array(own)).otherwise(F.array().cast("array<string>"))
        return F.transform(F.concat(F.array_compact(F.transform(tags, target)), acl), lambda x: _joined(x, base, p))

    return F.array_distinct(F.filter(let(parts(base), of), lambda x: is_http_url(x)))
