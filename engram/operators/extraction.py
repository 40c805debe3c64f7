"""Decision and failed-approach extraction (TX15, TX16): one regular expression a row, ordered and deduplicated in each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import KEY_LINES as ANNOTATED

# --- fixed values: patterns that results must equal, in their order; TOPICS is one alternation of five, and empty second groups stand for a missing reason ---
PROSE = (
    r"(?i)(?:I'?m |we'?re |going )?going with\s+(.{10,200}?)(?:[.;,\n]|$)",
    r"(?i)settled on\s+(.{10,200}?)(?:[.;,\n]|$)",
    r"(?i)decided(?:\s+to)?\s*:?\s+(.{10,200}?)(?:[.;,\n]|$)",
    r"(?i)(?:we |I )?chose\s+(.{10,200}?)(?:[.;,\n]|$)",
    r"(?i)(?:the )?decision(?:\s+is|:)\s+(.{10,200}?)(?:[.;,\n]|$)",
    r"(?im)^(?:Use|Using)\s+(.{10,200}?)(?:[.;]|$)",
    r"(?im)^Policy:\s*(.{10,200}?)(?:[.;]|$)",
    r"(?im)^Standard(?:\s+rule)?:\s*(.{10,200}?)(?:[.;]|$)",
    r"(?im)^(?:All|Every)\s+(.{10,200}?must.{5,100}?)(?:[.;]|$)",
    r"(?i)migrat(?:e|ed|ing)\s+(?:from\s+\S+\s+)?to\s+(.{10,150}?)(?:[.;,\n]|$)",
    r"(?i)switch(?:ed|ing)\s+(?:from\s+\S+\s+)?to\s+(.{10,150}?)(?:[.;,\n]|$)",
    r"(?im)^Replacing\s+(.{10,200}?)(?:[.;]|$)",
    r"(?i)(.{10,100}?)\s+over\s+\S.{5,80}?\s+(?:because|since|as)\s+.{5,100}?(?:[.;]|$)",
)
TOPICS = r"(?i)^(the following|where\s+to\s+|how\s+to\s+|on\s+the\s+|the\s+(?:\w+[\s-]){0,3}(?:toolchain|stack|approach|design|system|solution|architecture)\b)"
NEGATIVE = (
    r"(?im)^(?:DO NOT|NEVER|DON'T)\s+(.{10,200})()$",
    r"(?im)^(?:avoid|don'?t use|never use)\s+(.{10,200})()$",
    r"(?i)(.{10,150})\s+did(?:n'?t| not)\s+work\s+because\s+(.{5,200})",
    r"(?i)(.{10,100})\s+failed\s+(?:with|because|due to)\s+(.{5,200})",
    r"(?i)(.{5,80})\s+doesn'?t\s+support\s+(.{5,100})",
    r"(?i)(.{5,80})\s+is(?:n'?t)?\s+incompatible\s+with\s+(.{5,100})",
    r"(?i)(.{10,100})\s+causes?\s+(.{5,100}(?:error|bug|issue|crash|failure))",
    r"(?i)(?:error|exception|traceback):\s*(.{10,200})()",
    r"(?im)^(?:Implemented|Used|Deployed|Introduced|Added|Set up|Enabled|Had|Stored)\s+(.{10,200}?)()(?:[.,;]|\s+so\s+|\s+(?:to\s+\w+\s+){0,3}(?:Worked|Seemed|Appeared|Initially|But\s+it|Problem|Issue|The\s+issue)|$)",
    r"(?im)^(?:Evaluated|Investigated|Considered|Explored)\s+(.{10,200}?)()(?:[.,;]|\s+so\s+|$)",
    r"(?im)^(?:Attempted|Proposed)\s+(?:to\s+)?(.{10,200}?)()(?:[.,;]|$)",
    r"(?i)[Tt]ried\s+(.{10,150}?)()(?:\s*[.,;—]|$)",
    r"(?i)\bused\s+(.{10,200}?)()(?:[.,;]|$)",
    r"(?i)(?:reverted?|rolled back|abandoned|pulled back|switched away from)\s+(?:\S+\s+){0,3}(.{10,150}?)()(?:[.,;]|$)",
    r"(?i)(.{10,100}?)\s+(?:hit|hits|hitting)\s+(?:the\s+)?(.{5,80}?(?:limit|quota|cap|ceiling))(?:[.,;]|$)",
    r"(?i)(.{10,120}?)\s+(?:doesn'?t|wasn'?t|stopped)\s+work(?:ing)?(?:\s+because\s+(.{5,150}))?(?:[.,;]|$)",
    r"(?i)(.{10,120}?)\s+(?:caused?|led to|resulted in)\s+(.{5,100}?(?:problem|issue|failure|error|timeout|crash|conflict))(?:[.,;]|$)",
    r"(?i)[Tt]he problem(?:\s+(?:is|with\s+\S+)\s*)?:\s*(.{10,200}?)()(?:[.,;]|$)",
    r"(?i)(.{10,100}?)\s+breaks?\s+(?:when|if|because)\s+(.{5,150}?)(?:[.,;]|$)",
    r"(?i)(?:codebase|system|application|service|team)\s+uses?\s+(.{10,200}?)()(?:[.,;]|$)",
)
#: What every match of a pattern that starts with any characters must hold. Where a text has none of it the pattern isn't tried from each of its places.
NEEDED = {
    PROSE[12]: r"(?i)\sover\s",
    NEGATIVE[2]: r"(?i)\sdid(?:n'?t| not)\s+work\s+because\s",
    NEGATIVE[3]: r"(?i)\sfailed\s+(?:with|because|due to)\s",
    NEGATIVE[4]: r"(?i)\sdoesn'?t\s+support\s",
    NEGATIVE[5]: r"(?i)\sis(?:n'?t)?\s+incompatible\s+with\s",
    NEGATIVE[6]: r"(?i)\scauses?\s",
    NEGATIVE[14]: r"(?i)\s(?:hit|hits|hitting)\s",
    NEGATIVE[15]: r"(?i)\s(?:doesn'?t|wasn'?t|stopped)\s+work",
    NEGATIVE[16]: r"(?i)\s(?:caused?|led to|resulted in)\s",
    NEGATIVE[18]: r"(?i)\sbreaks?\s+(?:when|if|because)\s",
}
DECISION_CONFIDENCE, NEGATIVE_CONFIDENCE = 0.60, 0.70
# ---------------------------------------------------------------------------


def _all(content: Column, pattern: str, group: int) -> Column:
    """All matches' group."""
    found = F.regexp_extract_all(content, F.lit(pattern), group)
    return F.when(content.rlike(NEEDED[pattern]), found).otherwise(F.array().cast("array<string>")) if pattern in NEEDED else found


def _found(content: Column, patterns: tuple[str, ...], prose: bool) -> Column:
    """(text, prose) of all matches' first groups, pattern by pattern."""
    one = [F.transform(_all(content, p, 1), lambda x: F.struct(F.btrim(x).alias("text"), F.lit(prose).alias("prose"))) for p in patterns]
    return F.flatten(F.array(*one))


def decisions(docs: DataFrame, key: str, content: str, least: int = 25, most: int = 50) -> DataFrame:
    """(key, i, text, confidence): annotated and prose decisions; prose needs `least` characters and not to be a mere topic; a text contained in another
    one of its document goes (of equals but for case the first stays); longest first, `most` at the most."""
    both = F.concat(_found(F.col(content), ANNOTATED, False), _found(F.col(content), PROSE, True))
    good = F.filter(both, lambda x: (x["text"] != "") & (~x["prose"] | ((F.length(x["text"]) >= least) & ~x["text"].rlike(TOPICS))))
    texts = F.array_distinct(F.transform(good, lambda x: x["text"]))
    ordered = F.array_sort(F.transform(texts, lambda t, p: F.struct((-F.length(t)).alias("l"), p.alias("p"), F.lower(t).alias("low"), t.alias("text"))))
    none = F.array().cast("array<struct<l:int,p:int,low:string,text:string>>")
    # longest first: a text stays unless a kept one holds it; no more than `most` are ever kept
    kept = F.aggregate(ordered, none, lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda o: F.contains(o["low"], x["low"])), a).otherwise(F.array_append(a, x)))
    each = docs.select(key, F.posexplode_outer(kept).alias("at", "x")).where("at IS NOT NULL").select(key, "at", "x.text")  # not posexplode: its inferred filter would search twice
    place = F.col("at") + 1
    return each.select(key, "text", place.alias("i"), F.lit(DECISION_CONFIDENCE).alias("confidence"))


def negatives(docs: DataFrame, key: str, content: str, most: int = 30) -> DataFrame:
    """(key, i, what, why, confidence) of failed approaches, the first of each `what`, `most` at the most."""

    def of(p: str) -> Column:
        what, why = (_all(F.col(content), p, g) for g in (1, 2))
        return F.arrays_zip(what.alias("what"), why.alias("why"))

    pairs = F.flatten(F.array(*[F.transform(of(p), lambda x: F.struct(F.btrim(x["what"]).alias("what"), F.btrim(x["why"]).alias("why"))) for p in NEGATIVE]))
    rows = docs.select(key, F.posexplode_outer(F.filter(pairs, lambda x: x["what"] != "")).alias("_p", "x")).where("_p IS NOT NULL").select(key, "_p", "x.what", "x.why")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, F.lower("what")).orderBy("_p"))).where("_r = 1")
    return first.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).where(F.col("i") <= most).select(key, "i", "what", "why").withColumn("confidence", F.lit(NEGATIVE_CONFIDENCE))
