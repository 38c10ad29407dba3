"""Chunks from layout nodes: section headers, headings, continued paragraphs, packing within pages, chunk records and texts to embed.

Nodes are as from graph.nodes: doc_id, node_id, page, pos, type, text. Whatever a document's own order decides is done in
windows by document or in a fold over one document's column, all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T

#: Names of sections; names that stand for a section in capitals; names that page 1 may have in capitals.
SECTION_NAMES = (
    "introduction", "methodology", "results", "conclusion", "abstract", "references", "summary", "objective", "education", "experience",
    "technical skills", "skills", "projects", "motivation", "problem statement", "objectives", "literature survey", "system design",
    "testing and optimization", "ml workflow checklist", "workflow checklist", "claims", "description", "detailed description", "background",
)
CAPITAL_NAMES = ("abstract", "introduction", "conclusion", "references", "summary", "objective", "overview", "background")
FIRST_PAGE_NAMES = ("abstract", "synopsis", "summary", "introduction", "table of contents", "objectives")
#: How a header can begin, and up to how many words it then has.
BEGINNINGS = (
    (r"^#{1,3}\s", 6),
    (r"(?i)^(Education|Experience|Technical Skills|Skills|Projects|Summary|Objective|References)", 6),
    (r"(?i)^(Introduction|Methodology|Results|Conclusion|Abstract|References)", 6),
    (r"(?i)^(Chapter|Section|Part|Phase)\s+\d+", 10),
)
#: Types that are never merged with others.
ALONE = ("table", "figure", "caption", "code_block", "equation")


def is_section_header(line: Column, page: Column) -> Column:
    """Whether a line is the header of a section, by its length, known names, capitals, numbering and page. The first rule that applies decides."""
    s = F.trim(line)
    low, n = F.lower(s), T.n_tokens(s)
    no, yes = F.lit(False), F.lit(True)
    short_name = F.exists(F.array(*[F.lit(x) for x in SECTION_NAMES]), lambda x: low.startswith(x)) & (n <= 5)
    capitals = lambda k: s.rlike(rf"^[A-Z][A-Z\s&\-/,]{{{k},}}$")
    glue = low.rlike(r"\b(by|at|on|for|the|of|in|and|a|an)\b")
    begins = F.lit(None).cast("boolean")
    for pattern, most in reversed(BEGINNINGS):
        begins = F.when(s.rlike(pattern) & (n <= most), page > 1).otherwise(begins)
    return (
        F.when((s == "") | (F.length(s) > 120) | (n > 12) | (s.endswith(".") & (n > 4)), no)
        .when(s.rlike(r"(?i)^Phase\s+\d+") & (n <= 10), yes)
        .when(low.isin(*SECTION_NAMES) | short_name, yes)
        .when((page == 1) & capitals(2) & ~low.isin(*FIRST_PAGE_NAMES), no)
        .when(capitals(3) & (n > 1) & ~glue, page > 1)
        .when(capitals(3) & (n == 1) & low.isin(*CAPITAL_NAMES), yes)
        .when(s.rlike(r"^\d+\.\s+[A-Z]") & (n <= 6), yes)
        .otherwise(F.coalesce(begins, no))
    )


def section_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, header, section, text: each block with the section that it stands in (`unknown` before the first header)."""
    marked = blocks.select("doc_id", "pos", is_section_header(F.col("text"), F.col("page")).alias("header"), "text")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("header"), F.col("text")), ignorenulls=True).over(before)
    return marked.select("doc_id", "pos", "header", F.coalesce(section, F.lit("unknown")).alias("section"), "text")


def section_paragraphs(blocks: DataFrame) -> DataFrame:
    """doc_id, run, section, type, n_words, text: the lines of a section between two headers, by content type, with the section's name before them."""
    own = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = section_lines(blocks).withColumn("run", F.sum(F.col("header").cast("int")).over(own)).filter("not header")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    runs = lines.groupBy("doc_id", "run", "section").agg(text.alias("text"))
    named = F.when(F.col("section") == "unknown", F.col("text")).otherwise(F.concat(F.lit("[Section: "), "section", F.lit("]\n"), "text"))
    return runs.select("doc_id", "run", "section", T.content_type("text").alias("type"), T.n_tokens("text").alias("n_words"), named.alias("text"))


def collapse_headings(nodes: DataFrame) -> DataFrame:
    """The nodes without headings whose text is that of the heading right before."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    again = (F.col("type") == "heading") & (F.lag("type").over(own) == "heading") & (F.trim("text") == F.trim(F.lag("text").over(own)))
    return nodes.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again")


def merge_continued(nodes: DataFrame) -> DataFrame:
    """doc_id, first_node, n_nodes, page, page_end, type, text: neighbours of one type under one heading, on one page or (column continues) across pages, are one.

    Headings, tables and figures stay alone. nodes may have continues (boolean): the node goes on with what stood on the page before.
    """
    own = Window.partitionBy("doc_id").orderBy("pos")
    until = own.rowsBetween(Window.unboundedPreceding, 0)
    more = F.coalesce(F.col("continues"), F.lit(False)) if "continues" in nodes.columns else F.lit(False)
    under = nodes.withColumn("parent", F.sum((F.col("type") == "heading").cast("int")).over(until)).withColumn("_more", more)
    joins = ~F.col("type").isin("heading", "table", "figure") & (F.col("type") == F.lag("type").over(own)) & (F.col("parent") == F.lag("parent").over(own)) & ((F.col("page") == F.lag("page").over(own)) | F.col("_more"))
    grouped = under.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(until))
    parts = F.sort_array(F.collect_list(F.struct("pos", "node_id", "text")))
    merged = grouped.groupBy("doc_id", "run", "type").agg(parts.alias("p"), F.min("page").alias("page"), F.max("page").alias("page_end"))
    return merged.select("doc_id", F.col("p")[0]["node_id"].alias("first_node"), F.size("p").alias("n_nodes"), "page", "page_end", "type", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def chunk_id(doc: Column, nodes: Column) -> Column:
    """The id of a chunk: it depends on its document and nodes only, not on their order or pages."""
    return F.substring(F.sha2(F.concat(doc, F.lit("|"), F.array_join(F.sort_array(nodes), "|")), 256), 1, 16)


def section_chunks(nodes: DataFrame) -> DataFrame:
    """doc_id, section, heading, chunk_id, n_nodes, first_page, last_page: the nodes under a heading as one chunk, headings collapsed first."""
    until = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = collapse_headings(nodes).withColumn("section", F.sum((F.col("type") == "heading").cast("int")).over(until))
    marked = marked.withColumn("heading", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(until)).filter("type <> 'heading'")
    found = marked.groupBy("doc_id", "section", "heading").agg(F.collect_list("node_id").alias("ids"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return found.select("doc_id", "section", "heading", chunk_id(F.col("doc_id").cast("string"), F.col("ids")).alias("chunk_id"), F.size("ids").alias("n_nodes"), "first_page", "last_page")


def spatial_chunks(nodes: DataFrame, most: int = 512) -> DataFrame:
    """doc_id, chunk_no, page, heading, n_nodes, n_words, text: headings and tables alone, other nodes packed in reading order up to `most` words.

    Nothing is packed across pages or headings. A node of more than `most` words is a chunk of its own. The packing is a fold
    over the nodes between two breaks, which are never more than a page has.
    """
    own = Window.partitionBy("doc_id").orderBy("page", "pos")
    until = own.rowsBetween(Window.unboundedPreceding, 0)
    alone = F.col("type").isin("heading", "section", *ALONE)
    breaks = alone | F.coalesce(F.lag(alone).over(own), F.lit(True)) | (F.col("page") != F.lag("page").over(own))
    heading = F.last(F.when(F.col("type").isin("heading", "section"), F.col("text")), ignorenulls=True).over(until)
    runs = nodes.withColumn("heading", F.coalesce(heading, F.lit(""))).withColumn("_new", breaks.cast("int")).withColumn("run", F.sum("_new").over(until))
    runs = runs.groupBy("doc_id", "run", "page", "heading").agg(F.sort_array(F.collect_list(F.struct("pos", "text", T.n_tokens("text").alias("n")))).alias("p"))
    kind = "array<struct<pos:int,text:string,n:int>>"
    words = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["n"])

    def add(acc, x):
        full = (F.size(acc["now"]) > 0) & (words(acc["now"]) + x["n"] > most)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, F.array(x)).otherwise(F.array_append(acc["now"], x)).alias("now"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("now"))
    packed = F.aggregate(F.col("p").cast(kind), start, add, lambda acc: F.array_append(acc["done"], acc["now"]))
    each = runs.select("doc_id", "run", "page", "heading", F.posexplode(packed).alias("k", "c"))
    each = each.withColumn("chunk_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "k")))
    return each.select("doc_id", "chunk_no", "page", "heading", F.size("c").alias("n_nodes"), words("c").alias("n_words"), F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("text"))


def embedding_text(chunks: DataFrame) -> DataFrame:
    """chunk_id, text to embed: the section twice, then type, keywords, the content and what it refers to, each on a line; empty parts are left out.

    chunks: chunk_id, section, type, keywords, text, refs.
    """
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    body = F.concat_ws("\n", part("Section", "section"), part("Section", "section"), part("Type", "type"), part("Keywords", "keywords"), F.when(F.trim("text") != "", F.trim("text")), part("References", "refs"))
    return chunks.select("chunk_id", body.alias("text"))


def collections(chunks: DataFrame) -> DataFrame:
    """chunk_id, collection: each chunk in `unified`, and in `tables` or `paragraphs` by its type."""
    own = F.when(F.col("type") == "table", "tables").otherwise("paragraphs")
    return chunks.select("chunk_id", F.explode(F.array(F.lit("unified"), own)).alias("collection"))


def layout(nodes: DataFrame) -> DataFrame:
    """doc_id, reading_order (node ids in order, by spaces), n_headings, n_visual: tables and figures."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), " ")
    return nodes.groupBy("doc_id").agg(ids.alias("reading_order"), F.count_if(F.col("type") == "heading").alias("n_headings"), F.count_if(F.col("type").isin("table", "figure")).alias("n_visual"))


def page_graph(blocks: DataFrame) -> DataFrame:
    """doc_id, page, node_id, next_node, n_words: one node a page, linked to the next page's."""
    pages = blocks.groupBy("doc_id", "page").agg(F.sum(T.n_tokens("text")).alias("n_words"))
    name = F.format_string("p%d_n_0", "page")
    return pages.select("doc_id", "page", name.alias("node_id"), F.lead(name).over(Window.partitionBy("doc_id").orderBy("page")).alias("next_node"), "n_words")


def document_metadata(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, title, language, origin, page_count, each with a default: the first block (100 characters), `en`, `unknown`, 0."""
    first = blocks.groupBy("doc_id").agg(F.min_by("text", "pos").alias("first"), F.max("page").alias("pages"))
    given = lambda c, other: F.coalesce(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))), F.lit(other))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce(F.substring("first", 1, 100), F.lit("Untitled")).alias("title"), given("lang", "en").alias("language"), given("source", "unknown").alias("origin"), F.coalesce("pages", F.lit(0)).alias("page_count"))
