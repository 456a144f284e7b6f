"""Licence rows from crawled register pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.functions import text, urls
from licensum.operators import councils as C
from licensum.operators import pages as P
from licensum.operators import responses as R
from licensum.operators.resolve import drop_exact_copies
from licensum.session import kept


def table_licences(pages: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """Licences of the register tables of all pages."""
    return P.licences_of_rows(P.table_rows(pages, max_rows=max_rows))


def read_pages(pages: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """Tables, else cards and text of every page; to be stored once and read by all later steps."""
    return P.page_items(P.readable_pages(pages), max_rows=max_rows)


def items_licences(items: DataFrame) -> DataFrame:
    """Licences of the table rows in stored page items."""
    return P.licences_of_rows(P.rows_of_items(items.filter("step = 'table'")))


def items_cards(items: DataFrame) -> DataFrame:
    """Texts for a reader of single licences: ``(page_id, item, text)`` for each card of a page without table licences."""
    return P.cards_of_items(items.filter("step = 'card'")).select("page_id", F.col("card").alias("item"), "text")


def items_texts(items: DataFrame) -> DataFrame:
    """Texts for a reader of licence lists: ``(page_id, text)`` for each page without table licences."""
    return items.filter("step <> 'table'").select("page_id", "text")


def _answered(items: DataFrame, parsed: DataFrame, step: str) -> DataFrame:
    """Accepted licences of answers about ``items``, with the address of their page."""
    found = R.accepted(parsed).drop("licence_id", "council_name")
    return found.join(items.select("page_id", "url"), "page_id").withColumns({"step": F.lit(step), "table_no": F.lit(0)}).withColumnRenamed("item", "row_no")


def cascade_licences(items: DataFrame, card_answers: DataFrame | None = None, text_answers: DataFrame | None = None) -> DataFrame:
    """Licences of stored page items, each page by the first step that gives any, which ``step`` names.

    The steps are the page's tables, else the answers about its cards, else the answer about its text.
    ``card_answers(page_id, item, response)`` and ``text_answers(page_id, response)`` come from a reader that was given
    ``items_cards`` and ``items_texts``. Answers that a page does not need are not parsed: an anti-join by page leaves
    out those of earlier steps.
    """
    left, council = items.filter("step <> 'table'"), F.lit(None).cast("string").alias("council_name")
    out = items_licences(items).withColumn("step", F.lit("table"))
    if card_answers is not None:
        asked = left.filter("step = 'card'")
        wanted = card_answers.join(asked.select("page_id"), "page_id", "left_semi").select("page_id", "item", "response", council)
        cards = kept(_answered(asked, R.parse_object_responses(wanted), "card"))
        out, left = out.unionByName(cards, allowMissingColumns=True), left.join(cards.select("page_id"), "page_id", "left_anti")
    if text_answers is not None:
        wanted = text_answers.join(left.select("page_id"), "page_id", "left_semi").select("page_id", "response", council)
        out = out.unionByName(_answered(left, R.parse_array_responses(wanted), "text"), allowMissingColumns=True)
    return out


def council_addresses(councils: DataFrame, analyses: DataFrame, *, extra_pages: int | None = None) -> DataFrame:
    """(council_name, council_seq, strategy, rank, source_url, page_key): the register page of a council, rank 0, and its linked pages."""
    routed = C.with_strategy(C.join_analyses(C.with_register(councils), analyses))
    further = F.coalesce("analysis.potential_licence_urls", F.array().cast("array<string>"))
    wanted = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("licence_register_url").alias("source_url"))),
        F.transform(
            F.slice(further, 1, extra_pages) if extra_pages else further,
            lambda u, i: F.struct((i + 1).alias("rank"), u.alias("source_url")),
        ),
    )
    edges = routed.select(
        F.col("name").alias("council_name"), F.col("seq").alias("council_seq"), "strategy", F.explode(wanted).alias("e")
    ).select("council_name", "council_seq", "strategy", "e.*")
    return edges.withColumn("page_key", urls.normalize_url(F.col("source_url")))


def licences_of_addresses(edges: DataFrame, items: DataFrame, *, card_answers: DataFrame | None = None, text_answers: DataFrame | None = None) -> DataFrame:
    """Licences of the councils whose addresses lead to stored page items; ``step`` names what gave a row."""
    licences = cascade_licences(items, card_answers, text_answers).withColumn("page_key", urls.normalize_url(F.col("url"))).drop("url")
    # Of a linked page only tables and cards are asked for.
    found = edges.join(licences, "page_key").drop("page_key").filter("rank = 0 OR step <> 'text'")
    first = drop_exact_copies(found.withColumn("seq", F.struct("rank", "page_id", "table_no", "row_no")))
    return first.withColumns(
        {
            "seq": F.struct("council_seq", "rank", "page_id", "table_no", "row_no"),
            "licence_id": text.surrogate_id(
                F.col("council_name"), F.lower("premises_name"), F.lower("premises_address")
            ),
        }
    ).drop("council_seq", "rank", "table_no", "row_no")


def extract_licences(councils: DataFrame, analyses: DataFrame, pages: DataFrame, *, card_answers: DataFrame | None = None, text_answers: DataFrame | None = None, extra_pages: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Licences of every council: from its register page and from its linked pages, or the first ``extra_pages`` of them.

    Only pages that could be read and that some council wants are parsed, each once, whoever links to it; councils are
    joined to the extracted rows (see ``cascade_licences``). ``seq`` orders rows by council, page, table and row, as a
    struct of these numbers.
    """
    edges = council_addresses(councils, analyses, extra_pages=extra_pages)
    chosen = P.readable_pages(pages).withColumn("page_key", urls.normalize_url(F.col("url"))).join(edges.select("page_key"), "page_key", "left_semi")
    items = kept(read_pages(chosen.drop("page_key", "council_name"), max_rows=max_rows))
    return licences_of_addresses(edges, items, card_answers=card_answers, text_answers=text_answers)


def extraction_results(councils: DataFrame, licences: DataFrame) -> DataFrame:
    """Outcome per council with a register."""
    return R.results_per_council(C.with_register(councils), licences)
