"""Section classes of headings and chunk texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = r"(?i)^[0-9]*\.?\s*"
#: Name, priority and pattern, in the order in which they are tried.
SECTIONS = [
    ("abstract", 1, r"abstract\b"),
    ("limitations", 2, r"limitations?\b"),
    ("future work", 3, r"future\s+work\b"),
    ("results", 4, r"results?\b"),
    ("experiments", 5, r"experiments?\b"),
    ("evaluation", 6, r"evaluation(?:s)?\b"),
    ("method", 7, r"method(?:ology|ologies|ogies|s)?\b"),
    ("approach", 8, r"approach\b"),
    ("introduction", 9, r"introduction\b"),
    ("conclusion", 10, r"conclusion(?:s)?\b"),
    ("related work", 11, r"related\s+work\b"),
    ("background", 11, r"background\b"),
    ("discussion", 11, r"discussion\b"),
    ("acknowledgments", 14, r"acknowledge?ments?\b"),
    ("references", 14, r"(?:references?|references?\s+list|references?\s+cited|literature\s+cited|works\s+cited|bibliography)\b"),
    ("appendix", 13, r"(?:appendix|supplementary\s+material)\b"),
]
OTHER_PRIORITY, APPENDIX_PRIORITY, REFERENCES_PRIORITY = 12, 13, 14
NOISE = ["references", "bibliography", "acknowledgments"]
#: Section families.
FAMILIES = {
    "approach": "method",
    "our approach": "method",
    "proposed method": "method",
    "proposed approach": "method",
    "proposed framework": "method",
    "experimental setup": "experiments",
    "experimental results": "results",
    "empirical evaluation": "evaluation",
}
#: Evidence categories, in the order in which they are tried.
CATEGORIES = [
    ("context", r"(?i)^(?:abstract|introduction|background|related\s+work|literature\s+review|motivation|problem\s+statement)(?:\b|$)"),
    ("method", r"(?i)^(?:methods?|methodologies|approach|our\s+approach|proposed\s+(?:method|approach)|framework|architecture|system|model|design)(?:\b|$)"),
    ("evaluation_setup", r"(?i)^(?:experimental\s+setup|evaluation\s+(?:setup|design|protocol)|datasets?|data|benchmarks?|baselines?|metrics?|implementation\s+details)(?:\b|$)"),
    ("limitations_future", r"(?i)^(?:limitations?|threats?\s+to\s+validity|future\s+(?:work|directions?))(?:\b|$)"),
    ("results", r"(?i)^(?:(?:additional|supplementary)\s+)?(?:results?|findings?|experiments?|evaluation|ablations?|error\s+analysis|discussion|conclusions?)(?:\b|$)"),
]
#: Categories of the classes above, cues, prefixes.
SHARED = {
    "abstract": "context",
    "introduction": "context",
    "background": "context",
    "related work": "context",
    "method": "method",
    "approach": "method",
    "experiments": "results",
    "results": "results",
    "evaluation": "results",
    "discussion": "results",
    "conclusion": "results",
    "limitations": "limitations_future",
    "future work": "limitations_future",
}
SETUP_CUE = r"(?i)\b(?:datasets?|baselines?|metrics?|protocol|hyperparameters?|implementation details|training setup)\b"
HEADING_PREFIX = r"(?i)^(?:\d+(?:\.\d+)*\.?\s*|[A-Z](?:\.\d+)*(?:[.)])?\s+)"
APPENDIX_HEADING = r"(?i)^(?:appendix|supplementary\s+material)\b"


#: Classes that only a heading has; the lines of a text are not searched for them.
HEADING_ONLY = ("references", "appendix")


def heading_class(heading: Column, in_text: bool = False) -> Column:
    """struct(name, priority) of one heading, or of one line of a text."""
    out = None
    for name, priority, pattern in SECTIONS:
        if in_text and name in HEADING_ONLY:
            continue
        value = F.struct(F.lit(name).alias("name"), F.lit(priority).alias("priority"))
        out = F.when(heading.rlike(_N + pattern), value) if out is None else out.when(heading.rlike(_N + pattern), value)
    return out.otherwise(F.struct(F.lit("other").alias("name"), F.lit(OTHER_PRIORITY).alias("priority")))


def path(section: Column) -> Column:
    """The headings of a path ``A > B``, without blank ones."""
    return F.filter(F.transform(F.split(section, " > "), lambda x: F.btrim(x)), lambda x: x != "")


def last_heading(section: Column) -> Column:
    """The deepest heading of a path, without bold marks."""
    return F.btrim(F.replace(F.element_at(F.split(section, " > "), -1), F.lit("**"), F.lit("")))


def short_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: F.length(x) < 80)


def text_class(text: Column) -> Column:
    """The class of the first short line that has one."""
    classes = F.filter(F.transform(short_lines(text), lambda x: heading_class(x, True)), lambda c: c["name"] != "other")
    return F.coalesce(F.get(classes, F.lit(0)), heading_class(F.lit("")))


def chunk_class(section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", heading_class(F.coalesce(last_heading(section), F.lit("")))).otherwise(text_class(text))


def is_noise(section: Column, text: Column) -> Column:
    """References or acknowledgments: by the heading if there is one, else by a references line."""
    by_text = F.exists(short_lines(text), lambda x: x.rlike(_N + r"(?:references|bibliography)\b"))
    return F.when(F.coalesce(section, F.lit("")) != "", heading_class(F.coalesce(last_heading(section), F.lit("")))["name"].isin(NOISE)).otherwise(by_text)


def is_appendix_boundary(section: Column, text: Column) -> Column:
    pattern = _N + r"(?:appendix|supplementary\s+material)\b"
    return F.when(F.coalesce(section, F.lit("")) != "", F.coalesce(last_heading(section), F.lit("")).rlike(pattern)).otherwise(F.exists(short_lines(text), lambda x: x.rlike(pattern)))


def canonical_section(heading: Column) -> Column:
    """The family of a heading: an alias's, else the heading's class; other text as it is; noise and appendix are ``other``."""
    bare = F.lower(F.btrim(F.regexp_replace(heading, r"^[0-9]*\.?\s*", "")))
    families = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    found = heading_class(heading)["name"]
    named = F.coalesce(F.try_element_at(families, bare), F.when(found != "other", F.coalesce(F.try_element_at(families, found), found)), bare)
    return F.when(named.isin("references", "appendix", "acknowledgments") | (F.coalesce(bare, F.lit("")) == ""), "other").otherwise(named)


def _heading_category(heading: Column, text: Column) -> Column:
    setup = text.rlike(SETUP_CUE)
    broad = F.lower(heading).rlike("^(?:experiments|evaluation)")
    out = F.when(heading.rlike(APPENDIX_HEADING), F.lit(None).cast("string"))
    for name, pattern in CATEGORIES:
        value = F.when(broad & setup, F.lit("evaluation_setup")).otherwise(F.lit(name)) if name == "results" else F.lit(name)
        out = out.when(heading.rlike(pattern), value)
    shared = heading_class(heading)["name"]
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHARED.items() for x in pair]), shared)
    return out.otherwise(F.when(shared.isin("experiments", "evaluation") & setup, F.lit("evaluation_setup")).otherwise(mapped))


def category(section: Column, text: Column, title: Column | None = None) -> Column:
    """context, method, evaluation_setup, results, limitations_future or other: the deepest heading that has one."""
    headings = F.transform(path(F.coalesce(section, F.lit(""))), lambda h: F.btrim(F.regexp_replace(h, HEADING_PREFIX, "")))
    if title is not None:
        key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
        first, whole = key(F.coalesce(F.get(headings, F.lit(0)), F.lit(""))), key(title)
        same = (first != "") & (whole != "") & (F.startswith(whole, first) | F.startswith(first, whole))
        headings = F.when(F.coalesce(same, F.lit(False)), F.slice(headings, F.lit(2), F.greatest(F.size(headings), F.lit(1)))).otherwise(headings)
    headings = F.when(F.size(headings) == 0, F.array(text_class(text)["name"])).otherwise(headings)
    found = F.filter(F.transform(F.reverse(headings), lambda h: _heading_category(h, text)), lambda c: c.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("other"))


def merge_numbered(aspect: Column) -> Column:
    """``2.1.3 X`` as ``2``; others as they are."""
    return F.when(aspect.rlike(r"^\d+\.\d+"), F.regexp_extract(aspect, r"^(\d+)\.", 1)).otherwise(aspect)


def has_heading(section: Column, name: str) -> Column:
    return F.exists(path(F.coalesce(section, F.lit(""))), lambda h: F.lower(F.regexp_replace(h, HEADING_PREFIX, "")) == name)


def is_abstract(section: Column) -> Column:
    """Whether any heading of the path is an abstract's."""
    return F.exists(bare_headings(section), lambda h: h.rlike(r"(?i)^abstract(?:\b|$)"))


def is_appendix(section: Column) -> Column:
    """Whether any heading of the path opens an appendix."""
    return F.exists(bare_headings(section), lambda h: h.rlike(APPENDIX_HEADING))


def bare_headings(section: Column) -> Column:
    """The path's headings without bold marks and numbers."""
    return F.transform(F.split(F.coalesce(section, F.lit("")), " > "), lambda h: F.btrim(F.regexp_replace(F.btrim(F.replace(h, F.lit("**"), F.lit(""))), HEADING_PREFIX, "")))


def appendix_kept(section: Column, text: Column, title: Column | None = None) -> Column:
    """Whether a chunk stays: appendix chunks do only if they have an evidence category."""
    return ~is_appendix(section) | (category(section, text, title) != "other")


#: How journals begin a title.
TITLE_PREFIXES = ["article ", "research article ", "journal article ", "full length article ", "original article ", "review article "]


def _is_metadata(heading: Column) -> Column:
    """An author or copyright line that passes for a heading."""
    marks = F.regexp_count(heading, F.lit(r"<sup>\d+(?:,\d+)*</sup>"))
    return (marks >= 2) | ((marks >= 1) & heading.rlike("[\u00b7,]")) | heading.rlike("(?i)\u00a9\\s+the\\s+author")


def top_section(section: Column, title: Column | None = None) -> Column:
    """The first heading of a path that is neither a metadata line nor the paper's title; null if there is none.

    The first heading counts as the title if the title begins with it, or if others follow;
    one with a number never does.
    """
    parts = F.filter(F.transform(F.split(section, " > "), lambda p: F.btrim(F.replace(p, F.lit("**"), F.lit("")))), lambda p: p != "")
    parts = F.when(_is_metadata(F.get(parts, F.lit(0))), F.slice(parts, 2, 1000)).otherwise(parts)
    first = F.get(parts, F.lit(0))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    plain = first
    for prefix in reversed(TITLE_PREFIXES):
        plain = F.when(F.lower(first).startswith(prefix), F.substring(first, F.lit(len(prefix) + 1), F.length(first))).otherwise(plain)
    titled = F.size(parts) > 1
    if title is not None:
        titled = titled | F.coalesce((key(plain) != "") & F.startswith(key(title), key(plain)), F.lit(False))
    return F.when(F.coalesce(section, F.lit("")) != "", F.get(F.when(titled & ~first.rlike("^[0-9]"), F.slice(parts, 2, 1000)).otherwise(parts), F.lit(0)))
