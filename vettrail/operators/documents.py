"""Documents as text spans: hidden layers, edits after production, provenance, one verdict each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import instructions, unicode
from ..functions.text import as_re2, let, re2_text, trimmed
from ..model import FINDING, by_severity_and_code, finding, none
from .texts import headline, verdict

# Thresholds, producers, what money, dates and names look like.
TINY, BACKGROUND, INVISIBLE_MODE = 1.01, 0.06, 3
LINE_REACH, SIZE_SLACK, SIZE_STEP, OVERLAP, MOST_OVERLAYS, HIDDEN_WORDS = 2.5, 0.6, 1.0, 0.6, 6, 8
HR_PRODUCERS = (
    r"docusign|adobe\s*sign|hellosign|dropbox\s*sign|workday|greenhouse|lever|icims|successfactors|bamboohr|rippling|gusto|justworks|deel|remote\.com|"
    r"ashby|smartrecruiters|jobvite|taleo|oracle|sap\b"
)
GENERIC_PRODUCERS = (
    r"microsoft|word|libreoffice|openoffice|pages|google|canva|photoshop|illustrator|indesign|ilovepdf|smallpdf|pdfescape|sejda|foxit|"
    r"wkhtmltopdf|reportlab|tcpdf|fpdf|itext|skia|quartz|cairo"
)
MONEY = r"(?i)[$€£]\s?[\d,]+(\.\d{2})?|\b\d{2,3},\d{3}\b|\bper\s+(annum|year|hour)\b"
DATE = r"(?i)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2})\b"
NAME = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"


def reasons(text: Column, size: Column, color: Column, alpha: Column, mode: Column, box: Column, page: Column) -> Column:
    """Why a person can't see the span; empty when one can."""
    part = lambda shift: (F.shiftright(color, shift).bitwiseAND(F.lit(255))) / F.lit(255.0)
    distance = F.sqrt(sum(((part(s) - 1.0) * (part(s) - 1.0) for s in (16, 8, 0)), F.lit(0.0)))
    flat = ((box["x1"] - box["x0"]) <= 0.01) | ((box["y1"] - box["y0"]) <= 0.01)
    outside = (box["x1"] < page["x0"] - 1) | (box["x0"] > page["x1"] + 1) | (box["y1"] < page["y0"] - 1) | (box["y0"] > page["y1"] + 1)
    return F.filter(F.array(
        F.when(alpha == 0, F.lit("transparent")), F.when(mode == INVISIBLE_MODE, F.lit("invisible mode")), F.when((size > 0) & (size <= TINY), F.lit("tiny font")),
        F.when(distance <= BACKGROUND * 3**0.5, F.lit("background colour")), F.when(flat, F.lit("no area")).when(outside, F.lit("off the page")),
    ), lambda x: x.isNotNull())


def classify(spans: DataFrame) -> DataFrame:
    """Spans with text, each with its reasons and whether it is hidden."""
    c = F.col
    spans = spans.filter(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+", "") != "")
    why = reasons(c("text"), F.coalesce("size", F.lit(0.0)), F.coalesce("color_rgb", F.lit(0)), F.coalesce("alpha", F.lit(255)), F.coalesce("render_mode", F.lit(0)), c("bbox"), c("page_rect"))
    return spans.withColumn("reasons", F.coalesce(why, F.array().cast("array<string>"))).withColumn("hidden", F.size("reasons") > 0)


def layers(spans: DataFrame) -> DataFrame:
    """(document_id, visible_text, hidden_text, n_spans, hidden_spans, pages), texts in span order."""
    joined = lambda flag: F.array_join(F.transform(F.filter(F.col("all"), lambda x: x["hidden"] == flag), lambda x: x["text"]), " ")
    held = classify(spans).groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("span_idx", "text", "hidden"))).alias("all"), F.count("*").alias("n_spans"), F.sum(F.col("hidden").cast("int")).alias("hidden_spans"), F.max("page").alias("pages")
    )
    return held.select("document_id", joined(False).alias("visible_text"), joined(True).alias("hidden_text"), "n_spans", "hidden_spans", "pages")


def hidden_layer(spans: DataFrame) -> DataFrame:
    """(document_id, finding): a document has text that people can't see, with a histogram of the reasons."""
    hidden = classify(spans).filter("hidden")
    why = hidden.select("document_id", F.explode("reasons").alias("reason")).groupBy("document_id", "reason").agg(F.count("*").alias("n"))
    why = why.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))), lambda x: F.concat(x["reason"], F.lit(" "), (-x["k"]).cast("string"))), "; ").alias("why"))
    words = layers(spans).select("document_id", "hidden_text", F.size(F.regexp_extract_all(F.col("hidden_text"), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))).alias("n"))
    both = words.filter("n > 0").join(why, "document_id")
    return both.select("document_id", finding(
        "HIDDEN_TEXT_LAYER", "The document has a hidden text layer", F.when(F.col("n") >= HIDDEN_WORDS, 3).otherwise(2), F.concat(F.col("n").cast("string"), F.lit(" words that people can't see: "), F.col("why")),
        layer="hidden", evidence=F.substring("hidden_text", 1, 240), confidence=0.98, remediation="Read the hidden text before relying on the file.", meta={"words": F.col("n")},
    ).alias("f"))


def body_style(spans: DataFrame) -> DataFrame:
    """(document_id, body_font, body_size): the style that most visible characters are set in; of equals the one seen first."""
    seen = classify(spans).filter("not hidden").withColumn("size1", F.bround("size", 1))
    styles = seen.groupBy("document_id", "font", "size1").agg(F.sum(F.length(trimmed(F.col("text")))).alias("n"), F.min("span_idx").alias("i"))
    first = styles.withColumn("r", F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("n"), "i"))).filter("r = 1")
    return first.select("document_id", F.col("font").alias("body_font"), F.col("size1").alias("body_size"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy lines of a partition sorted by document and span: a span joins the first line of its page whose first span is within reach.

    What is held is the current document's line starts, page by page.
    """
    document, started, count = None, {}, 0
    for batch in batches:
        out = []
        for own, page, mid in zip(batch["document_id"].to_pylist(), batch["page"].to_pylist(), batch["mid"].to_pylist()):
            if own != document:
                document, started, count = own, {}, 0
            y = float(round(mid))
            at = next((line for first, line in started.setdefault(page, []) if abs(first - y) <= LINE_REACH), None)
            if at is None:
                at, count = count, count + 1
                started[page].append((y, at))
            out.append(at)
        yield batch.append_column("line", pa.array(out, pa.int32()))


def lines(spans: DataFrame) -> DataFrame:
    """Visible spans with their line. Order decides who starts a line, which no window expresses; a partition is read as a stream."""
    seen = classify(spans).filter("not hidden").select("document_id", "span_idx", "page", "text", "font", "size", ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("mid"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema)
    return seen.repartition("document_id").sortWithinPartitions("document_id", "span_idx").mapInArrow(_lines, kinds + ", line int")


def family(font: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(font, "-", 1), ",", 1))


def what_field(text: Column) -> Column:
    """money, date or name, in that order; null if none. Bounds of words are those of ASCII, so Tre Ció holds a name, as in SQL."""
    return let(re2_text(text), lambda t: F.when(t.rlike(as_re2(MONEY)), "money").when(t.rlike(as_re2(DATE)), "date").when(t.rlike(as_re2(NAME)), "name"))


def font_findings(spans: DataFrame) -> DataFrame:
    """(document_id, i, f): spans off the body style on lines that are otherwise in it."""
    c = F.col
    seen = lines(spans).join(body_style(spans), "document_id")
    seen = seen.withColumn("size1", F.bround("size", 1)).withColumn("on", (c("font") == c("body_font")) & (c("size1") == c("body_size")))
    whole = W.partitionBy("document_id", "line")
    seen = seen.withColumns({"members": F.count("*").over(whole), "fits": F.sum(c("on").cast("int")).over(whole), "t": trimmed(c("text"))})
    same, delta, field = family(c("font")) == family(c("body_font")), F.abs(c("size1") - c("body_size")), what_field(c("t"))
    odd = seen.filter((c("members") >= 2) & (c("fits") >= 1) & ~c("on") & (F.length("t") >= 2) & ~(same & (delta < SIZE_SLACK)))
    odd = odd.withColumns({"same": same, "delta": delta, "field": field})
    has, level = c("field").isNotNull(), None
    level = F.when(has & ~c("same"), 3).when(has, 2).when(~c("same") & (c("delta") >= SIZE_STEP), 2).otherwise(1)
    confidence = F.when(has & ~c("same"), 0.8).when(has, 0.65).when(~c("same") & (c("delta") >= SIZE_STEP), 0.55).otherwise(0.4)
    return odd.select("document_id", c("span_idx").alias("i"), finding(
        "DOC_FONT_INCONSISTENCY", F.concat(F.lit("Text off the document's body style"), F.coalesce(F.concat(F.lit(": a "), c("field")), F.lit(""))), level,
        F.concat(c("font"), F.lit(" "), c("size1").cast("string"), F.lit(" in a line of "), c("body_font"), F.lit(" "), c("body_size").cast("string"), F.lit("; templates filled in by hand look the same.")),
        evidence=F.substring("t", 1, 70), location=F.concat(F.lit("page "), c("page").cast("string")), confidence=confidence, remediation="Ask the issuer for the original.", meta={"field": c("field"), "span": c("span_idx")},
    ).alias("f"))


def overlays(spans: DataFrame) -> DataFrame:
    """(document_id, i, f): the first MOST_OVERLAYS pairs of different texts drawn over each other, hidden spans included."""
    some = classify(spans).select("document_id", "page", "span_idx", F.trim("text").alias("t"), "bbox")
    order = some.groupBy("document_id", "page").agg(F.min("span_idx").alias("seen"))
    a, b, c = some.alias("a"), some.alias("b"), F.col
    ox = F.least(c("a.bbox.x1"), c("b.bbox.x1")) - F.greatest(c("a.bbox.x0"), c("b.bbox.x0"))
    oy = F.least(c("a.bbox.y1"), c("b.bbox.y1")) - F.greatest(c("a.bbox.y0"), c("b.bbox.y0"))
    area = lambda p: F.greatest(F.lit(1e-6), (c(f"{p}.bbox.x1") - c(f"{p}.bbox.x0")) * (c(f"{p}.bbox.y1") - c(f"{p}.bbox.y0")))
    share = ox * oy / F.least(area("a"), area("b"))
    met = (c("a.document_id") == c("b.document_id")) & (c("a.page") == c("b.page")) & (c("a.span_idx") < c("b.span_idx")) & (ox > 1) & (oy > 1) & (share >= OVERLAP) & (c("a.t") != c("b.t"))
    pairs = a.join(b, met).select(c("a.document_id").alias("document_id"), c("a.page").alias("page"), c("a.span_idx").alias("ia"), c("b.span_idx").alias("ib"), c("a.t").alias("ta"), c("b.t").alias("tb"), share.alias("share"))
    pairs = pairs.join(order, ["document_id", "page"])
    pairs = pairs.withColumn("i", F.row_number().over(W.partitionBy("document_id").orderBy("seen", "ia", "ib"))).filter(c("i") <= MOST_OVERLAYS)
    return pairs.select("document_id", "i", finding(
        "DOC_TEXT_OVERLAY", "Two texts stand in one place", "high", F.concat(F.lit("Only one of them can be read; they cover "), F.round(c("share") * 100).cast("int").cast("string"), F.lit(" % of each other.")),
        evidence=F.concat(F.substring("ta", 1, 50), F.lit(" | "), F.substring("tb", 1, 50)), location=F.concat(F.lit("page "), c("page").cast("string")), confidence=0.85,
        remediation="Both can be recovered from the file.", meta={"a": F.substring("ta", 1, 80), "b": F.substring("tb", 1, 80)},
    ).alias("f"))


def provenance(metadata: Column) -> Column:
    """What the producing software says; null for software that says nothing either way."""
    producer = F.concat(F.coalesce(F.try_element_at(metadata, F.lit("producer")), F.lit("")), F.lit(" "), F.coalesce(F.try_element_at(metadata, F.lit("creator")), F.lit("")))
    make = lambda code, title, rank, why, advice, conf: finding(code, title, rank, why, layer="metadata", evidence=F.substring(F.trim(producer), 1, 120), confidence=conf, remediation=advice)
    return (
        F.when(F.trim(producer) == "", make("DOC_NO_PROVENANCE", "No producing software is recorded", "low", "Most programs leave their name.", "Weigh it with the rest.", 0.5))
        .when(producer.rlike("(?i)" + HR_PRODUCERS), make("DOC_HR_PROVENANCE", "Made by a platform for contracts or hiring", "info", "It fits a real offer.", "Confirm the sender all the same.", 0.6))
        .when(producer.rlike("(?i)" + GENERIC_PRODUCERS), make("DOC_GENERIC_PROVENANCE", "Made by general software", "low", "Small employers do this too.", "Ask for a countersigning link.", 0.5))
    )


def metadata_text(metadata: Column) -> Column:
    """Lines `key: value` of the entries that hold something."""
    return F.array_join(F.transform(F.filter(F.map_entries(metadata), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def scan_documents(spans: DataFrame, metadata: DataFrame) -> DataFrame:
    """(document_id, document_verdict, document_headline, document_findings) of every document with spans or metadata."""
    text = layers(spans)
    base = metadata.select("document_id", "metadata").join(text, "document_id", "full")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = base.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))).withColumn("metadata_text", metadata_text(F.col("metadata")))
    base = base.withColumns({"visible_text": blank("visible_text"), "hidden_text": blank("hidden_text")})
    combined = F.array_join(F.filter(F.array("visible_text", "hidden_text", "metadata_text"), lambda t: t != ""), "\n")
    base = base.withColumn("combined", combined)
    source = F.col("metadata")
    own = base.select("document_id", F.concat(
        unicode.run_all(F.col("combined")), instructions.scan(F.col("hidden_text"), F.lit("hidden")), instructions.scan(F.col("metadata_text"), F.lit("metadata")),
        instructions.scan(F.col("visible_text"), F.lit("visible")), F.filter(F.array(provenance(source).cast(FINDING)), lambda x: x.isNotNull()),
    ).alias("own"))
    more = hidden_layer(spans).select("document_id", F.lit(0).alias("k"), F.lit(0).alias("i"), "f")
    more = more.union(font_findings(spans).select("document_id", F.lit(1), "i", "f")).union(overlays(spans).select("document_id", F.lit(2), "i", "f"))
    # bounded by the spans of one document
    more = more.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("k", "i", F.col("f.code").alias("code"), F.to_json("f").alias("j")))).alias("more"))
    parsed = F.transform("more", lambda x: F.from_json(x["j"], FINDING))
    out = own.join(more, "document_id", "left").select("document_id", F.concat("own", F.coalesce(parsed, none())).alias("all"))
    out = out.withColumn("document_findings", by_severity_and_code(F.col("all")))
    return out.select("document_id", verdict(F.col("document_findings")).alias("document_verdict"), headline(F.col("document_findings")).alias("document_headline"), "document_findings")


