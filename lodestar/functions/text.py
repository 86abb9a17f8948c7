"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.rules import QUERY_STOPWORDS, REPORT_CUES, TITLE_STOPWORDS

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"“(])"
ANSWER_SENTENCE_END = r"(?<=[.!?])\s+|(?<=;)\s+(?=[A-Z])"
UNKNOWN = "UNKNOWN"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(""))


# --- normalisation and tokens -------------------------------------------------


def normalize_ws(c: Column | str) -> Column:
    """Drops soft hyphens, unifies dashes, expands two ligatures, collapses white space."""
    plain = F.translate(text_or_empty(c), "‐‑‒–—­", "-----")
    plain = F.replace(F.replace(plain, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def collapse_ws(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-cased word tokens: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD), F.lit(0))


def token_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(WORD))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def sentences(c: Column | str) -> Column:
    """Pieces between a sentence end and a capital, digit, quote or bracket."""
    return plain_sentences(normalize_ws(c))


def plain_sentences(plain: Column) -> Column:
    """The same of a text that is normalised already."""
    pieces = F.transform(F.split(plain, SENTENCE_END), lambda s: F.trim(s))  # trim itself takes the index as what to trim
    return F.filter(pieces, lambda s: s != "")


def answer_sentences(c: Column | str) -> Column:
    """The looser splitter for answers: after . ! ? always, after ; before a capital."""
    return F.transform(F.split(collapse_ws(c), ANSWER_SENTENCE_END), lambda s: F.trim(s))


def slug(c: Column | str, mark: str = "_", default: str | None = None) -> Column:
    """Lower case with runs of other characters than a-z and 0-9 as one mark."""
    runs = F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", mark)
    bare = F.regexp_replace(runs, f"^{mark}+|{mark}+$", "")
    return bare if default is None else F.when(bare == "", F.lit(default)).otherwise(bare)


def slug_words(c: Column | str, n: int) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit("[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*"), F.lit(0))
    return F.lower(F.array_join(F.slice(found, 1, n), " "))


# --- composed texts -----------------------------------------------------------


def join_known(parts: list[Column], mark: str) -> Column:
    """Joins parts, leaving out null, empty and UNKNOWN ones."""
    known = F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: (p != "") & (p != UNKNOWN))
    return F.array_join(known, mark)


def index_text(title: str = "title", section: str = "section", subsection: str = "subsection", tags: str = "tags", text: str = "text") -> Column:
    return join_known([F.col(title), F.col(section), F.col(subsection), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.col(text)], " ")


def embed_text(prefix: str = "", title: str = "title", section: str = "section", subsection: str = "subsection", text: str = "text") -> Column:
    """The text that embedders get; `prefix` may hold {title}."""
    head = F.replace(F.lit(prefix), F.lit("{title}"), F.coalesce(F.col(title), F.lit("none"))) if prefix else F.lit("")
    return F.concat(head, join_known([F.col(title), F.col(section), F.col(subsection), F.col(text)], "\n"))


def rerank_text(title: str = "title", section: str = "section", subsection: str = "subsection", text: str = "text") -> Column:
    return join_known([F.col(title), F.col(section), F.col(subsection), F.col(text)], "\n")


def page_range(start: Column | str, end: Column | str) -> Column:
    a, b = as_column(start).cast("string"), as_column(end).cast("string")
    return F.when(a == b, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("-"), b))


def citation(evidence_id: Column, document: Column, section: Column, pages: Column, chunk_id: Column) -> Column:
    named = F.when(F.coalesce(section, F.lit("")).isin("", UNKNOWN), F.lit("section unknown")).otherwise(section)
    return F.concat(F.lit("["), evidence_id, F.lit("] "), document, F.lit("; "), named, F.lit("; "), pages, F.lit("; chunk "), chunk_id)


# --- comparison of texts ------------------------------------------------------


def eval_normalize(c: Column | str, nbsp: bool = True) -> Column:
    """Lower case, dashes unified, white space collapsed; the evaluators' own variant."""
    dashes = F.translate(F.lower(text_or_empty(c)), "–—", "--")
    return F.trim(F.regexp_replace(F.translate(dashes, " ", " ") if nbsp else dashes, r"(?U)\s+", " "))


def group_hit(text: Column, groups: Column, empty: bool = True, nbsp: bool = True) -> Column:
    """All groups have some alias inside the text; `empty` is the answer for no groups."""
    hay = eval_normalize(text, nbsp)
    every = F.forall(groups, lambda g: F.exists(g, lambda a: F.contains(hay, eval_normalize(a, nbsp))))
    return F.when(F.size(F.coalesce(groups, F.array().cast("array<array<string>>"))) == 0, F.lit(empty)).otherwise(every)


def option_in_text(option: Column, text: Column) -> Column:
    wanted = eval_normalize(option)
    return (wanted != "") & F.contains(eval_normalize(text), wanted)


def jaccard(left: Column, right: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / either)


def overlap_min(left: Column, right: Column) -> Column:
    """Shared members over the smaller set; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / least)


def share_of(wanted: Column, have: Column) -> Column:
    """Share of the wanted set's members that `have` holds; 0 if nothing is wanted."""
    return F.size(F.array_intersect(wanted, have)) / F.greatest(F.size(wanted), F.lit(1))


def keyword_terms(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-zA-Z]{3,}"), F.lit(0)))


def terms_ratio(wanted: Column, have: Column) -> Column:
    """Share of the wanted terms; 0 if either has none."""
    return F.when((F.size(wanted) == 0) | (F.size(have) == 0), F.lit(0.0)).otherwise(share_of(wanted, have))


def keyword_ratio(query: Column, text: Column) -> Column:
    return terms_ratio(keyword_terms(query), keyword_terms(text))


def strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def query_terms(c: Column | str, stopwords: tuple[str, ...] = QUERY_STOPWORDS) -> Column:
    """Content tokens in order: no stop words, bare digits or tokens under three characters."""
    return F.filter(tokens(c), lambda t: ~t.isin(*stopwords) & ~t.rlike(r"^\p{Nd}+$") & (F.char_length(t) >= 3))


def title_terms(c: Column | str, stopwords: tuple[str, ...] = TITLE_STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-zA-Z][a-zA-Z0-9]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), strings(stopwords))


def _cue_of(kind: str):
    return lambda number: F.concat(F.lit(f"{kind}:"), F.when(number == "", F.lit("0")).otherwise(number))


def report_cues(c: Column | str, families: dict[str, str] = REPORT_CUES) -> Column:
    """Identifiers such as tg:100, leading zeros dropped."""
    plain = normalize_ws(F.translate(text_or_empty(c), "_-", "  "))
    parts = []
    for kind, pattern in families.items():
        numbers = F.regexp_extract_all(F.lower(plain), F.lit(pattern), F.lit(1))
        bare = F.transform(numbers, lambda n: F.ltrim(n, F.lit("0")))
        parts.append(F.transform(bare, _cue_of(kind)))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def query_focus(c: Column | str) -> Column:
    """The concept of "What is X according to ..." or "Define X"; null if neither."""
    q = normalize_ws(c)
    what = F.regexp_extract(q, r"(?i)^what is\s+(.+?)(?:\s+according to.*)?\??$", 1)
    define = F.regexp_extract(q, r"(?i)^define\s+(.+?)\??$", 1)
    found = F.when(what != "", what).when(define != "", define)
    return F.lower(F.trim(found))


def requested_page(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), r"(?i)\bpage\s+(\d{1,4})\b", 1).try_cast("int")


def extract_numbers(c: Column | str) -> Column:
    """Distinct numbers, ranges and percentages, evidence marks such as [E1] left out."""
    bare = F.regexp_replace(text_or_empty(c), r"\[E\d+\]", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?%?\b"), F.lit(0)))


def claim_text(c: Column | str, marker: str = "Supporting evidence excerpts:") -> Column:
    return F.substring_index(text_or_empty(c), "\n\n" + marker, 1)


def enumeration_bonus(query: Column, sentence: Column, listing: str) -> Column:
    """For listing questions: markers .06, separators .05, acronyms .03 each up to .09."""
    low = F.lower(sentence)
    marks = F.contains(low, F.lit("including")) | F.contains(low, F.lit("such as")) | F.contains(low, F.lit("consist")) | F.contains(low, F.lit("are:")) | F.contains(low, F.lit("are "))
    separators = (F.regexp_count(sentence, F.lit(",")) >= 2) | F.contains(sentence, F.lit(";"))
    acronyms = F.least(F.lit(0.09), F.regexp_count(sentence, F.lit(r"\b[A-Z][A-Z0-9-]{1,}\b")) * 0.03)
    bonus = F.when(marks, 0.06).otherwise(0.0) + F.when(separators, 0.05).otherwise(0.0) + acronyms
    return F.when(query.rlike(listing), bonus).otherwise(0.0)


# --- vectors, casts and JSON --------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """A vector of norm 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def safe_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(as_column(c).try_cast("int"), F.lit(default))


def safe_float(c: Column | str) -> Column:
    return as_column(c).try_cast("double")


def safe_bbox(c: Column | str) -> Column:
    """Four numbers, or null."""
    box = F.transform(as_column(c), lambda x: x.try_cast("double"))
    return F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()), box)


def json_object(c: Column | str) -> Column:
    """The text as JSON, else its outermost braces, else null."""
    whole = text_or_empty(c)
    return F.coalesce(F.try_parse_json(whole), F.try_parse_json(F.regexp_extract(whole, r"(?s)\{.*\}", 0)))


def front_matter_field(c: Column | str, key: str) -> Column:
    """A `key: value` line between --- lines at the head of a text."""
    head = F.regexp_extract(text_or_empty(c), r"(?s)\A---\n(.*?)\n---", 1)
    return F.trim(F.regexp_extract(head, rf"(?m)^{key}\s*:\s*(.*)$", 1))


def table_preview(rows: Column, limit: int = 1800) -> Column:
    """Cells joined by " | ", rows by " || ", empty ones left out; cut at the limit."""
    cells = F.transform(rows, lambda r: F.array_join(F.filter(F.transform(r["cells"], lambda c: normalize_ws(c)), lambda c: c != ""), " | "))
    whole = F.array_join(F.filter(cells, lambda r: r != ""), " || ")
    return F.when(F.char_length(whole) > limit, F.concat(F.rtrim(F.substring(whole, 1, limit)), F.lit("..."))).otherwise(whole)


def phrase(c: Column | str) -> Column:
    """White space collapsed, final period dropped, first letter lowered."""
    bare = F.rtrim(collapse_ws(c), F.lit("."))
    return F.concat(F.lower(F.left(bare, F.lit(1))), F.substring(bare, 2, 1 << 30))
