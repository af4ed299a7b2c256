"""Column functions for records, names, snippets, JSON and identifiers."""

from __future__ import annotations

import bisect
import html
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters and types of the extraction record format.
TUPLE, RECORD, COMPLETE, SEP = "<|>", "##", "<|COMPLETE|>", "<SEP>"
# Words that carry no meaning in a snippet.
SNIPPET_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "their", "to", "what", "when", "where", "which", "with"]
# Capitalised words that are no entity.
ENTITY_STOPWORDS = ["The", "A", "An", "This", "That", "These", "Those", "Chapter", "Table", "Figure", "Section", "Appendix", "Introduction"]
# Fixed pattern: title-case runs of at most three words, or runs of acronyms. ASCII word limits, so both engines agree.
ENTITY_PATTERN = r"(?<![A-Za-z0-9_])(?:[A-Z][a-z]+(?:[ \t\n\r\f]+[A-Z][a-z]+){0,2}|[A-Z]{2,}(?:[ \t\n\r\f]+[A-Z]{2,}){0,2})(?![A-Za-z0-9_])"

BLANKS = r"[ \t\n\r\f]"


def trim_ws(c: Column) -> Column:
    """Without outer blanks; a pattern would look at every blank of a text."""
    return F.btrim(c, F.lit(" \t\n\r\f"))


def tokens(c: Column) -> Column:
    """White-space words; blank and null texts have none."""
    t = trim_ws(c)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, f"{BLANKS}+"))


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c)).cast("bigint")


_WORD = re.compile(rb"[^ \t\n\r\f]+")


def words_of(t: bytes) -> list[bytes]:
    """`tokens` of one UTF-8 text."""
    return _WORD.findall(t) if b"\v" in t else t.split()


def n_words(t: bytes) -> int:
    return len(words_of(t))


def prefixed_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.md5(c))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def split_markers(c: Column, markers: list[str]) -> Column:
    pattern = "|".join(rf"\Q{m}\E" for m in markers)
    return F.filter(F.transform(F.split(c, pattern), trim_ws), lambda x: x != "")


def is_float(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def unescape_html(c: Column) -> Column:
    """Character references decoded; in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


def clean_name(c: Column, unescape: bool = True) -> Column:
    """Outer white space and control characters removed; entities decoded where there are any."""
    t = trim_ws(c)
    if unescape:
        t = unescape_html(t)
    return F.regexp_replace(t, r"[\x00-\x1f\x7f-\x9f]", "")


def snippet_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: (F.length(t) > 1) & ~t.isin(*SNIPPET_STOPWORDS)))


def entity_names(c: Column) -> Column:
    """Distinct capitalised names in order of first mention."""
    found = F.coalesce(F.regexp_extract_all(c, F.lit(ENTITY_PATTERN), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(*ENTITY_STOPWORDS))


def sep_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SEP), trim_ws), lambda x: x != "")


def first_of_sep(c: Column) -> Column:
    return F.substring_index(c, SEP, 1)


def chunk_ids_only(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.startswith("chunk-"))


def ordered_unique(arr: Column) -> Column:
    return F.filter(F.array_distinct(arr), lambda x: x.isNotNull() & (trim_ws(x) != ""))


def custom_id(*parts: Column) -> Column:
    """Parts joined by '|'; '|' and spaces inside a part become '_'."""
    return F.concat_ws("|", *[F.translate(p.cast("string"), "| ", "__") for p in parts])


def csv_cell(c: Column, numeric: bool = False) -> Column:
    return c.cast("string") if numeric else F.concat(F.lit('"'), trim_ws(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'))


def csv_row(*cells: Column) -> Column:
    return F.concat_ws(",\t", *cells)


# Fixed formats: the texts of entities and edges that are embedded.


def entity_text(name: Column, kind: Column, description: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(name, F.lit("")), F.concat(F.lit("type: "), F.coalesce(kind, F.lit("UNKNOWN"))), F.concat(F.lit("description: "), F.coalesce(description, F.lit(""))))


def edge_text(src: Column, src_desc: Column, tgt: Column, tgt_desc: Column, desc: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("source: "), src), blank(src_desc), F.concat(F.lit("relation: "), blank(desc)), F.concat(F.lit("target: "), tgt), blank(tgt_desc))


def decode_tokens(arr: Column) -> Column:
    """White-space words back to text; the inverse of `tokens` up to white space."""
    return F.array_join(arr, " ")


def truncate_tokens(c: Column, most: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, most), " ")


def first_sentences(c: Column, n: int) -> Column:
    parts = F.filter(F.transform(F.split(c, r"\."), trim_ws), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, 1, n), ". "), F.lit("."))).otherwise("")


def em_normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def prefix_snippet(c: Column, chars: int) -> Column:
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, chars)), F.lit(" ...")))


def label_of_namespace(c: Column) -> Column:
    """A string as a graph label: letters, digits and '_', not beginning with a digit."""
    t = F.regexp_replace(trim_ws(c), r"[^A-Za-z0-9_]+", "_")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def retrieval_seconds(c: Column) -> Column:
    s = F.regexp_extract(c, r"\[Retrieval Time: ([0-9.]+) seconds\]", 1)
    return F.when(s != "", s.try_cast("double"))


def report_markdown(title: Column, summary: Column, findings: Column) -> Column:
    """findings: array of struct<summary, explanation>; for plain strings see plain_findings."""
    body = F.transform(findings, lambda f: F.concat(F.lit("## "), F.coalesce(f["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(f["explanation"], F.lit(""))))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), summary, F.lit("\n\n"), F.array_join(body, "\n\n"))


def plain_findings(findings: Column) -> Column:
    """Findings that are plain strings as struct<summary, explanation>, for report_markdown."""
    return F.transform(findings, lambda f: F.struct(f.alias("summary"), F.lit("").alias("explanation")))


def judge_object(c: Column) -> Column:
    """A judge's verdict as JSON text: the whole text if it is JSON, else what lies between its first and last brace, else null."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(normal_json(c).isNotNull(), c).when(normal_json(inner).isNotNull(), inner)


def normal_json(c: Column) -> Column:
    """A text's JSON with each key once, the last one's value, and NaN as null (a VARIANT takes neither); null where it is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t, parse_constant=lambda _: None), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in s], dtype=object)

    return run(c)


# What is said of a community report that can't be used.
NO_REPORT, NO_TITLE, NO_SUMMARY = "unable to parse community report JSON", "community report missing title", "community report missing summary"
NO_JSON_FINDINGS, NO_FINDINGS = "community report findings is not a JSON list", "community report findings is not a list"


def report_error(c: Column) -> Column:
    """Why a community report's JSON can't be used (null if it can); findings may be a list or a string that holds one."""
    v = F.try_parse_json(normal_json(c))
    field = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda x: F.schema_of_variant(x)
    found = F.try_variant_get(v, "$.findings", "variant")
    inner = F.try_parse_json(normal_json(field("findings")))
    return (
        F.when(v.isNull() | ~kind(v).startswith("OBJECT") | (kind(v) == "OBJECT<>"), NO_REPORT)
        .when(F.coalesce(field("title"), F.lit("")) == "", NO_TITLE)
        .when(F.coalesce(field("summary"), F.lit("")) == "", NO_SUMMARY)
        .when((kind(found) == "STRING") & inner.isNull(), NO_JSON_FINDINGS)
        .when(~F.coalesce(F.when(kind(found) == "STRING", kind(inner)).otherwise(kind(found)).startswith("ARRAY"), F.lit(False)), NO_FINDINGS)
    )


def report_findings(c: Column) -> Column:
    """The findings of a usable report as array<struct<summary, explanation>>."""
    one = "array<struct<summary: string, explanation: string>>"
    return F.when(report_error(c).isNull(), F.coalesce(F.from_json(F.get_json_object(c, "$.findings"), one), F.array().cast(one)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; both sides in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


# ------------------------------------------------ sequential text functions, in Arrow batches

_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def word_bag(text: str) -> set[str]:
    """What snippet_tokens gives, for one text."""
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1} - set(SNIPPET_STOPWORDS)


def best_window(content: str, query: str, chars: int) -> str:
    """The run of whole sentences of at most `chars` characters that shares most with the query. Of all runs that can't be longer to
    the left: greatest number of shared words, then greatest share of shared words, then shortest, then earliest. Sentences over the
    limit are cut into overlapping halves. Word counts of a run are kept while its ends move."""
    wanted = word_bag(query)
    if len(content) <= chars and wanted:
        return content
    step = max(1, chars // 2)
    units = [x for s in _SENTENCES.split(content) if (t := s.strip()) for x in ([t] if len(t) <= chars else [t[i : i + chars] for i in range(0, len(t), step)])]
    if not wanted or not units:
        return content[:chars].rstrip()
    bags = [word_bag(u) for u in units]
    ends = list(itertools.accumulate(len(u) + 1 for u in units))  # each unit with a separator
    held: Counter[str] = Counter()
    ranks, lo = [], 0
    for hi, bag in enumerate(bags):
        held.update(bag)
        first = min(hi, bisect.bisect_left(ends, ends[hi] - chars, lo) + 1) if ends[hi] - (ends[lo - 1] if lo else 0) > chars else lo
        while lo < first:
            held.subtract(bags[lo])
            lo += 1
        have = {w for w, n in held.items() if n > 0}
        shared = len(have & wanted)
        ranks.append((shared, shared / max(1, len(have)), -(ends[hi] - (ends[lo - 1] if lo else 0)), -hi, lo))
    *_, last, first = max(ranks)
    return " ".join(units[first : 1 - last]).strip()[:chars].rstrip()


def query_snippet(content: Column, query: Column, chars: int) -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else a if len(a) <= chars else best_window(a, b or "", chars) + " ..." for a, b in zip(c, q, strict=True)], dtype=object)

    return run(content, query)


def text_unit_content(content: Column, query: Column | None = None, chars: int | None = None, by_query: bool = False) -> Column:
    """A text unit as it stands in a context: whole, or cut to `chars` characters, at the start or where it shares most with the query."""
    if not chars or chars <= 0:
        return content
    if not by_query or query is None:
        return prefix_snippet(content, chars)
    return F.when(F.coalesce(F.trim(query), F.lit("")) == "", prefix_snippet(content, chars)).otherwise(query_snippet(content, query, chars))


def first_object(text: str | None) -> str | None:
    """The first complete {...} of a text, as JSON text, or null where it doesn't parse."""
    if not text:
        return None
    start, depth = -1, 0
    for i, ch in enumerate(text):
        if ch == "{":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    return json.dumps(json.loads(text[start : i + 1].replace("\n", "")))
                except ValueError:
                    return None
    return None


_PAIR = re.compile(r'"?(\w+)"?\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(\{)|([^,{}\[\]\s]+))')


def _closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`, or the text's end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def _scalar(bare: str):
    low = bare.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    for kind in (int, float):
        try:
            return kind(bare)
        except ValueError:
            continue
    return bare


def _pairs(text: str) -> dict:
    out, at = {}, 0
    while m := _PAIR.search(text, at):
        key, quoted, opened, bare = m.groups()
        at = m.end()
        if opened:
            end = _closing(text, at - 1)
            out[key], at = _pairs(text[at:end]), end
        else:
            out[key] = quoted if quoted is not None else _scalar(bare)
    return out


def lenient_pairs(text: str | None) -> str | None:
    """key: value pairs of a text that is no JSON, as a JSON object of strings, numbers, booleans, null and inner objects."""
    out = _pairs(text or "")
    return json.dumps(out) if out else None


def repaired_json(c: Column) -> Column:
    """The first complete object, else the pairs that can be made out, else null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([first_object(t) or lenient_pairs(t) for t in s], dtype=object)

    return run(c)
