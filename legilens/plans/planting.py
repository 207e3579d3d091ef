"""Inputs of the registered queries: the given tables with planted credentials, and the tokens of their texts.

Planted values are made from md5 of an identifier, the same in both dialects; one row in sixteen stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.functions.dialect import Dialect, Duck, Spark
from legilens.sources.events import spread

#: Row numbers of `conversations` as identifiers: a conversation has fewer turns than this.
TURNS = 100


def planted(text: str, ident: str, d: Dialect) -> str:
    """text with one more line, a credential or a look-alike that ident chooses."""
    h = f"md5(cast({ident} as {d.text}))"
    m = f"translate({h}, 'abc', 'XyZ')"
    glue = lambda *parts: "concat(" + ", ".join(parts) + ")"
    lines = [
        glue("'export OPENAI_API_KEY=sk-proj-'", m),
        glue("'5k-pr0j-'", m),
        glue("'AKIA'", f"upper(substr({h}, 1, 16))"),
        glue("'ghp_'", m),
        glue("'AIza'", m, f"substr({m}, 1, 3)"),
        glue("'pk_live_'", m),
        glue("'STRIPE_API_KEY=pk_live_'", m),
        glue("'DATABASE_URL=postgres://admin:'", m, "'@db.internal:5432/app'"),
        # Each header in turn, with S misread.
        "case " + d.idiv(ident, "16") + f" % {len(known.PEM_HEADERS)} " + " ".join(f"when {k} then {d.lit(header.replace('S', '5'))}" for k, header in enumerate(known.PEM_HEADERS)) + " end",
        glue("'Authorization: Bearer '", m),
        glue("'sk- proj - '", m),
        glue("'AC'", h),
        glue("'commit '", h, f"substr({h}, 1, 8)"),
        glue("'id '", h),
        "'sk-your-api-key-here'",
    ]
    cases = " ".join(f"when {k} then concat(chr(10), {line})" for k, line in enumerate(lines))
    return f"concat(coalesce({text}, ''), case {ident} % 16 {cases} else '' end)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents, planted."""
    rows = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.expr(planted("text", "doc_id", Spark)).alias("text"))


DOCUMENTS_SQL = f"select doc_id, {planted('text', 'doc_id', Duck)} as text from documents"


def events_of(d: Dialect) -> dict[str, str]:
    """Columns of the frame events made from conversations: the assistant's turns are skipped frames."""
    ident = f"(conv_id * {TURNS} + turn)"
    return {
        "recording_id": f"cast(conv_id as {d.text})",
        "frame_index": f"cast(turn as {d.long})",
        "timestamp_ms": f"cast(turn * 1000 as {d.long})",
        "text": f"case when role = 'assistant' then null else {planted('text', ident, d)} end",
        "skipped": "coalesce(role = 'assistant', false)",
    }


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn as a frame of the recording that its conversation is."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(*[F.expr(v).alias(k) for k, v in events_of(Spark).items()])


EVENTS_SQL = "select " + ", ".join(f"{v} as {k}" for k, v in events_of(Duck).items()) + " from conversations"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens between white space of all planted documents, as (token_key, token)."""
    words = documents(spark, sf_dir).select(F.explode(F.expr(Spark.words("text"))).alias("token")).filter("token <> ''").distinct()
    return words.select(F.md5("token").alias("token_key"), "token")


TOKENS_SQL = (
    f"select md5(token) as token_key, token from (select distinct unnest({Duck.words('text')}) as token from ({DOCUMENTS_SQL})) where token <> ''"
)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html) of all pages, planted."""
    rows = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", F.expr(planted("html", "page_id", Spark)).alias("html"))


PAGES_SQL = f"select page_id, {planted('html', 'page_id', Duck)} as html from pages"
