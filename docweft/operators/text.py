"""Quality, routing and triage of texts; blocks, sections and chunk hints. All over whole tables, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T

#: Phrases that suggest an attempt to take over instructions.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"system\s+override",
    r"you\s+are\s+now\s+a\s+different\s+ai",
    r"you\s+must\s+bypass\s+all\s+safety\s+checks",
    r"new\s+role:\s*",
    r"bypass\s+restrictions",
)
#: Words that are no keywords.
STOP_WORDS = ("about", "above", "after", "again", "against", "along", "could", "would", "should", "their", "there", "these", "those", "under", "which", "while")
LINES_A_PAGE = 5


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, printable_ratio, avg_word_length, whitespace_ratio, score: 100, less 30, 35 and 35 for each one out of bounds."""
    text = T.text_of("text")
    n = F.length(text)
    words = T.n_tokens(text)
    blank = F.regexp_replace(text, T.SPACE, "") == ""
    parts = docs.select(
        "doc_id",
        F.when(blank, 0.0).otherwise(1.0 - T.share(T.removed(text, T.UNPRINTABLE), n)).alias("printable_ratio"),
        F.when(blank, 0.0).otherwise(T.share(n - T.removed(text, T.SPACE), words)).alias("avg_word_length"),
        F.when(blank, 0.0).otherwise(T.share(T.removed(text, T.SPACE), n)).alias("whitespace_ratio"),
        blank.alias("blank"),
    )
    score = F.lit(100.0) - F.when(F.col("printable_ratio") < 0.8, 30.0).otherwise(0.0) - F.when(F.col("avg_word_length").between(3.0, 12.0), 0.0).otherwise(35.0) - F.when(F.col("whitespace_ratio") < 0.1, 35.0).otherwise(0.0)
    return parts.withColumn("score", F.when(F.col("blank"), 0.0).otherwise(F.greatest(score, F.lit(0.0)))).drop("blank")


def quality_gate(docs: DataFrame, least: float = 50.0) -> DataFrame:
    """Scores a sample of each text (first 2000 characters, 2000 from the middle of long ones, last 1000); under 10 characters: rejected."""
    text = T.text_of("text")
    n = F.length(text)
    middle = F.when(n > 4000, F.substring(text, F.floor(n / 2).cast("int") - F.lit(999), F.lit(2000))).otherwise("")
    last = F.when(n > 2000, F.substring(text, F.greatest(n - 999, F.lit(1)), F.lit(1000))).otherwise("")
    scored = quality(docs.select("doc_id", F.concat(F.substring(text, 1, 2000), middle, last).alias("text")))
    sizes = docs.select(F.col("doc_id"), F.length(F.trim(text)).alias("n"))
    verdict = F.when(F.col("n") < 10, "rejected").when(F.col("score") < least, "warning").otherwise("passed")
    return scored.join(sizes, "doc_id").select("doc_id", "score", verdict.alias("verdict"))


def coherence(col: Column | str) -> Column:
    """0 to 100: 0.4 for word length near 6, 0.3 for the share of letters, 0.3 for lines with two words."""
    text = T.text_of(col)
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), F.lit(0))
    letters = F.length(F.array_join(words, ""))
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    good = F.size(F.filter(full, lambda x: F.regexp_count(x, F.lit("[a-zA-Z]{2,}")) >= 2))
    length = F.when(F.size(words) > 0, F.greatest(F.lit(0.0), 100.0 - F.abs(letters / F.size(words) - 6.0) * 15.0)).otherwise(0.0)
    alpha = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (letters / F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1)) - 0.35) / 0.5 * 100.0))
    lines = T.share(good * 100.0, F.size(full))
    return F.when(F.length(F.trim(text)) < 20, 0.0).otherwise(F.round((length * 40.0 + alpha * 30.0 + lines * 30.0) / 100.0, 1))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, page, text, is_heading of each line with text; a page is LINES_A_PAGE lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(T.text_of("text"), "\n")).alias("pos", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    heading = (F.length("text") < 100) & ((F.upper("text") == F.col("text")) | F.col("text").rlike("^(#|Section|Chapter|Introduction)"))
    return lines.select("doc_id", "pos", (F.floor(F.col("pos") / LINES_A_PAGE) + 1).cast("int").alias("page"), "text", heading.alias("is_heading"))


def sections(blocks: DataFrame) -> DataFrame:
    """One row for each heading, numbered in order."""
    return blocks.filter("is_heading").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("section"), "pos", F.col("text").alias("title"))


def route(docs: DataFrame) -> DataFrame:
    """DIGITAL or SCANNED, from the first five pages: characters a page, share of pages without text (over 40 %: scanned), coherence of their text."""
    text = T.text_of("text")
    lines = F.split(text, "\n")
    first = F.array_join(F.slice(lines, 1, 5 * LINES_A_PAGE), "\n")
    pages = F.least(F.lit(5), F.ceil(F.size(lines) / LINES_A_PAGE).cast("int"))
    chars = F.length(F.regexp_replace(first, r"\s", "")) / pages
    blank = F.filter(F.sequence(F.lit(1), pages), lambda k: F.regexp_replace(F.array_join(F.slice(lines, (k - 1) * LINES_A_PAGE + 1, LINES_A_PAGE), ""), r"\s", "") == "")
    measured = docs.select("doc_id", pages.alias("pages"), chars.alias("chars_a_page"), F.round(F.size(blank) / pages, 4).alias("empty_share"), coherence(first).alias("coherence"))
    reason = F.when(F.col("chars_a_page") < 30, "few characters").when(F.col("empty_share") > 0.4, "empty pages").when(F.col("coherence") < 50, "incoherent text").otherwise("text layer")
    return measured.withColumn("reason", reason).withColumn("route", F.when(F.col("reason") == "text layer", "DIGITAL").otherwise("SCANNED"))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """How often each prediction meets each truth. predicted: doc_id, predicted; truth: doc_id, expected."""
    return predicted.join(truth, "doc_id").groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def triage(docs: DataFrame) -> DataFrame:
    """Lines that name an error, a warning or a failure: how many, and the first five."""
    lines = F.filter(F.transform(F.split(T.text_of("text"), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & x.rlike("(?i)(error|warn|fail|critical)"))
    return docs.select("doc_id", F.size(lines).alias("n_flagged"), F.array_join(F.slice(lines, 1, 5), "\n").alias("first_flagged")).filter("n_flagged > 0")


def flag_injection(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("flagged", T.text_of(col).rlike("(?i)(" + "|".join(INJECTION) + ")"))


def sanitize(col: Column | str, most: int = 2000) -> Column:
    """Without tags and line breaks, `most` characters."""
    plain = F.regexp_replace(T.text_of(col), "<[^>]*>", "")
    return F.trim(F.substring(F.translate(F.regexp_replace(plain, "\n", " "), "\r", ""), 1, most))


def keywords(col: Column | str, n: int = 8) -> Column:
    """The first n in order of the different words of five letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(T.text_of(col)), F.lit("[a-z]{5,}"), F.lit(0))
    return F.slice(F.sort_array(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))), 1, n)


def summary(col: Column | str) -> Column:
    """The first two sentences, 200 characters at most."""
    return F.substring(F.array_join(F.slice(T.sentences(col), 1, 2), " "), 1, 200)


def chunks(docs: DataFrame) -> DataFrame:
    """Section chunks: a heading begins one; chunk 0 is what stands before the first heading.

    doc_id, chunk_no, chunk_id, text (blocks joined by \\n), n_blocks, first_page, last_page, previous_chunk, next_chunk.
    """
    own = Window.partitionBy("doc_id").orderBy("pos")
    marked = blocks(docs).withColumn("chunk_no", F.sum(F.col("is_heading").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy("doc_id", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    grouped = grouped.withColumn("chunk_id", F.concat_ws("_", F.lit("chunk"), "doc_id", "chunk_no"))
    order = Window.partitionBy("doc_id").orderBy("chunk_no")
    return grouped.withColumn("previous_chunk", F.lag("chunk_id").over(order)).withColumn("next_chunk", F.lead("chunk_id").over(order))


def chunk_hints(chunks: DataFrame) -> DataFrame:
    """chunk_id, type, keywords, summary, references, n_tokens of each chunk."""
    references = F.array_distinct(F.regexp_extract_all(T.text_of("text"), F.lit(r"(?:Table|Figure)\s+\d+"), F.lit(0)))
    return chunks.select("chunk_id", T.content_type("text").alias("type"), F.array_join(keywords("text"), " ").alias("keywords"), summary("text").alias("summary"), F.array_join(references, ",").alias("refs"), T.n_tokens("text").alias("n_tokens"))


def lead_summary(chunks: DataFrame) -> DataFrame:
    """The first two chunks of each document, joined by a blank line."""
    first = chunks.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no"))).filter("_r <= 2")
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "\n\n").alias("summary"))


def contract_report(docs: DataFrame) -> DataFrame:
    """doc_id, reason of every document that breaks the contract: no text, or a text that another document has too."""
    empty = docs.filter(F.trim(T.text_of("text")) == "").select("doc_id", F.lit("empty_text").alias("reason"))
    hashed = docs.filter(F.trim(T.text_of("text")) != "").select("doc_id", F.sha2("text", 256).alias("h"))
    twice = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return empty.unionByName(hashed.join(twice, "h").select("doc_id", F.lit("duplicate_content").alias("reason")))


def parent_child(docs: DataFrame, child: int = 300, overlap: int = 50, parent: int = 1200) -> DataFrame:
    """doc_id, parent_no, child_no, n_words, text: windows of `child` words, each beginning `overlap` before the last one's end."""
    words = F.filter(F.split(T.text_of("text"), r"\s+"), lambda x: x != "")
    each = docs.select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    step = child - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - overlap - 1, F.lit(0)), F.lit(step))
    each = each.select("doc_id", "words", F.posexplode(starts).alias("child_no", "start"))
    part = F.slice("words", F.col("start") + 1, child)
    return each.select("doc_id", F.floor(F.col("start") / parent).cast("int").alias("parent_no"), "child_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))
