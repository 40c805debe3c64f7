"""Text functions (TX) as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they must equal the published behaviour -------------------
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "is", "was", "are", "were", "be", "been", "have",
    "has", "do", "does", "did", "will", "would", "could", "should", "this",
    "that", "it", "not", "so", "if", "as", "up", "out", "just", "also",
)
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "doesn't", "don't", "won't", "cannot", "can't")
SECRETS = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"aws_secret_access_key\s*=\s*['\"]?[A-Za-z0-9/+=]{40}",
    r"ghp_[A-Za-z0-9]{36}",
    r"gho_[A-Za-z0-9]{36}",
    r"xoxb-[A-Za-z0-9-]{50,}",
    r"xoxp-[A-Za-z0-9-]{50,}",
)
WRAPPERS = ("<command-message>", "<command-name>", "<system-reminder>", "<local-command-stdout>", "<user-prompt-submit-hook>")
LIFECYCLE_LINE = r"(?m)^---+ (?:SESSION (?:START|END)|COMPACTION EVENT) at \d"
CAMEL_CASE = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
SNAKE_CALL = r"\b([a-z][a-z0-9_]{2,}\(\))"
PY_FILE = r"\b([a-z][a-z0-9_/\-]+\.py)\b"
KEY_LINES = (r"(?m)^→\s+(.{10,300})", r"(?im)^DECISION:\s*(.{10,300})", r"(?im)^NOTE:\s*(.{10,300})", r"(?im)^IMPORTANT:\s*(.{10,300})", r"(?im)^WARNING:\s*(.{10,300})", r"(?m)^\*\*(.{10,150})\*\*")
CATEGORIES = {
    "debugging": ("debug", "debugging", "error", "traceback", "bug", "fix", "exception", "AttributeError", "TypeError", "ValueError", "KeyError", "stacktrace"),
    "refactor": ("refactor", "refactoring", "cleanup", "clean", "restructure", "rename", "extract", "reorganize"),
    "planning": ("plan", "planning", "roadmap", "milestone", "sprint", "architecture", "design", "strategy", "proposal", "spec"),
    "research": ("research", "investigate", "explore", "compare", "evaluate", "analysis", "study", "review", "options"),
    "feature": ("feature", "implement", "add", "build", "create", "new", "develop", "integration", "endpoint", "api"),
}
VENDORS = (
    ("claude", "anthropic"), ("opus", "anthropic"), ("sonnet", "anthropic"), ("haiku", "anthropic"), ("gpt", "openai"), ("o1", "openai"),
    ("o3", "openai"), ("codex", "openai"), ("deepseek", "deepseek"), ("gemini", "google"), ("cursor", "cursor"),
)
MODEL_NAMES = (
    ("claude-opus", "opus"), ("opus", "opus"), ("claude-sonnet", "sonnet"), ("sonnet", "sonnet"), ("claude-haiku", "haiku"), ("haiku", "haiku"),
    ("gpt-4o-mini", "gpt-4o-mini"), ("gpt-4o", "gpt-4o"), ("codex-5.5", "codex-5.5"),
)
# -----------------------------------------------------------------------------


#: A word, in lower-cased text.
WORD = r"\b[a-z][a-z0-9_]+\b"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def tokenize(text: Column) -> Column:
    """Lower-case words of two characters or more that start with a letter, without stopwords; repeats stay."""
    return F.filter(matches(F.lower(text), WORD), lambda w: ~w.isin(*STOPWORDS))


def token_count(text: Column) -> Column:
    return F.size(tokenize(text))


def session_tokens(text: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(F.transform(matches(text, r"[a-zA-Z][a-zA-Z0-9_]{2,}"), F.lower))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cost_estimate(tokens: Column, usd_per_1k: Column) -> Column:
    return tokens / 1000 * usd_per_1k


def affordable_tokens(ceiling: Column, usd_per_1k: Column) -> Column:
    return F.floor(F.try_divide(ceiling, usd_per_1k) * 1000).cast("long")


def fixed_chunks(text: Column, tokens: int = 1000, overlap: int = 200, chars: int = 4) -> Column:
    """Windows of tokens * chars characters, each starting overlap earlier; trimmed, blank ones dropped; stops at the end."""
    size, step = tokens * chars, (tokens - overlap) * chars
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.btrim(F.substring(text, i * step + 1, F.lit(size)), F.lit(" \t\n\r\f\x0b")))
    return F.when(F.length(text) > 0, F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def sentence_chunks(text: Column, most: int) -> Column:
    """Sentences (cut after . ! ? and white space) packed greedily up to `most` characters; a longer sentence is cut hard."""
    sentences = F.filter(F.split(F.btrim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    pieces = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, p: Column) -> Column:
        fits = F.length(a["open"]) + 1 + F.length(p) <= most
        return (
            F.when(a["open"] == "", F.struct(a["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(" "), p).alias("open")))
            .otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), p.alias("open")))
        )

    return F.aggregate(pieces, start, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def trim_to_sentence(text: Column, most: int) -> Column:
    """Cut after the last sentence end (. ! ? or newline) that lies in the last two fifths, else before the last space, with an ellipsis."""
    cut = F.substring(text, 1, most)
    sentence = F.length(F.regexp_extract(cut, r"(?s)^(.*[.!?\n])", 1))
    space = F.length(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    short = F.when(sentence >= int(most * 0.6) + 1, F.substring(cut, F.lit(1), sentence)).when(space > 0, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("…")))


def slug(text: Column) -> Column:
    return F.btrim(F.substring(F.regexp_replace(F.lower(F.btrim(text, F.lit(" \t\n\r\f\x0b"))), r"[^a-z0-9-]", "-"), 1, 40), F.lit("-"))


def project_of_stem(stem: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(stem, r"^\d{4}-\d{2}-\d{2}-", ""), r"(^|-)session$", "")
    return F.when(name == "", "unknown").otherwise(name)


def session_project(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^Project:\s+(\S+)\s*$", 1)
    return F.when(found != "", found)


def boilerplate(text: Column) -> Column:
    """0.2 for a text of at most 12 lines that aren't blank and that has a lifecycle marker, else 1."""
    lines = F.size(F.filter(F.split(text, r"\R"), lambda x: F.btrim(x) != ""))
    return F.when(F.coalesce(text.rlike(LIFECYCLE_LINE) & (lines <= 12), F.lit(False)), 0.2).otherwise(1.0)


def richness(text: Column) -> Column:
    """Distinct words per word over 0.2, between 0.5 and 1; 1 for up to 20 words."""
    found = F.transform(matches(text, r"[a-zA-Z]{2,}"), F.lower)
    n = F.size(found)
    ratio = F.size(F.array_distinct(found)) / n / F.lit(0.2)
    return F.when((n <= 20) | text.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), ratio)))


def normalised_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.btrim(text, F.lit(" \t\n\r\f\x0b"))), r"\s+", " "), 256)


def redact(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(SECRETS), "[REDACTED]")


def secret_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("|".join(SECRETS)))


def is_wrapper(text: Column) -> Column:
    head = F.ltrim(text)
    out = F.lit(False)
    for w in WRAPPERS:
        out = out | head.startswith(w)
    return out


def category(text: Column) -> Column:
    """The category of most keyword hits in lower-cased plus original words; the first of equals; `other` without any."""
    low, own = F.array_distinct(matches(F.lower(text), r"(?U)\b\w+\b")), F.array_distinct(matches(text, r"(?U)\b\w+\b"))
    hits = [F.size(F.array_intersect(low, _strings(k))) + F.size(F.array_intersect(own, _strings(k))) for k in CATEGORIES.values()]
    best = F.greatest(*hits)
    out = F.when(best <= 0, "other")
    for name, n in zip(CATEGORIES, hits):
        out = out.when(n == best, name)
    return out


def key_lines(text: Column, most: int = 50) -> Column:
    """Decision-like lines: each pattern's matches of ten characters or more, in order, once each, 50 at most."""
    found = F.flatten(F.array(*[matches(text, p, 1) for p in KEY_LINES]))
    kept = F.filter(F.transform(found, lambda x: F.btrim(x)), lambda x: F.length(x) >= 10)
    return F.when(F.length(F.btrim(text)) < 20, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(kept), 1, most))


def entities(text: Column) -> Column:
    """(name, kind) of CamelCase classes, snake calls and .py files; a name keeps its first kind."""
    kinds = (("class", CAMEL_CASE), ("function", SNAKE_CALL), ("file", PY_FILE))

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(matches(text, pattern, 1)), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*[named(k, p) for k, p in kinds]))
    names = F.transform(found, lambda x: x["name"])
    return F.filter(found, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def has_negation(text: Column) -> Column:
    return text.rlike(r"(?iU)\b(" + "|".join(NEGATIONS) + r")\b")


def without_negations(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\b(" + "|".join(NEGATIONS) + r")\b", ""))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def overlap_max(a: Column, b: Column) -> Column:
    """Common members over the larger set's size; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def short_id(*parts: Column) -> Column:
    """The first 12 hex digits of the sha256 of the parts joined without a separator."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12)


def cache_priority(accesses: Column, age_days: Column, size_bytes: Column) -> Column:
    return accesses * F.exp(-age_days / 7.0) / F.greatest(F.log2(F.greatest(size_bytes, F.lit(1))) / 10, F.lit(0.1))


def first_rule(value: Column, rules: tuple[tuple[str, str], ...], default: Column) -> Column:
    """The name of the first rule whose text occurs in the lower-cased value."""
    low = F.lower(value)
    out = None
    for part, name in rules:
        out = (F if out is None else out).when(low.contains(part), name)
    return out.otherwise(default)


def vendor(model: Column) -> Column:
    return first_rule(model, VENDORS, F.lit("unknown"))


def model_name(model: Column) -> Column:
    return first_rule(model, MODEL_NAMES, F.lower(model))


def projects_named(query: Column, slugs: Column) -> Column:
    """The slugs of four characters or more that the query names."""
    found = F.transform(F.array(F.lower(query)), lambda low: F.filter(slugs, lambda s: (F.length(s) >= 4) & F.contains(low, F.lower(s))))  # bound, so lowered once and not for each slug
    return found[0]
