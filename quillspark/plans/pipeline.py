"""The five stages from landed pages to a backtest, each resumable and joined to the next by tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PAGE_MARKERS, SECTORS, SignalConfig
from ..functions import text as t
from ..operators import backtest, returns, scoring, signals, turns
from ..operators.boundaries import Boundaries, split
from ..sources import commits, errors, pages, tables
from ..sources.stage import scope, staged
from ..sources.transcripts import read_transcripts

KEYS = ("ticker", "date", "quarter")


def land(raw: DataFrame, urls: DataFrame, markers: tuple[str, ...] = PAGE_MARKERS, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pages (ticker, url, html) that pass the gate, with the date in their address and their word count.

    ``urls`` (ticker, urls: array) says whose pages they are; ``start`` and ``end`` keep addresses whose date is known and between.
    """
    catalogue = urls.select("ticker", F.explode("urls").alias("url"))
    own = pages.gate(raw.join(catalogue, "url"), markers).withColumn("date", t.url_date(F.col("url")))
    kept = own if start is None else own.where(F.col("date") >= start)
    return kept if end is None else kept.where(F.col("date") <= end)


def not_landed(raw: DataFrame, urls: DataFrame, markers: tuple[str, ...] = PAGE_MARKERS) -> DataFrame:
    """(ticker, url, error) of every address in ``urls`` without a page that passes the gate, and of tickers without an address."""
    catalogue = urls.select("ticker", F.explode_outer("urls").alias("url"))
    text = pages.visible_text(F.col("html"))
    known = raw.select("url", F.lit(True).alias("_there"), F.col("html").isNotNull().alias("_page"), F.coalesce(t.has_any(text, markers), F.lit(False)).alias("_marked"))
    best = known.groupBy("url").agg(*[F.max(c).alias(c) for c in ("_there", "_page", "_marked")])
    faults = {"no address": F.col("url").isNull(), "not fetched": F.col("_there").isNull(), "empty page": ~F.col("_page"), "no transcript": ~F.col("_marked")}
    return errors.divided(catalogue.join(best, "url", "left"), faults)[1].select("ticker", "url", "error")


def parse(raw: DataFrame, metadata: DataFrame | None = None, suffix: str = "", source: str = "", boundaries: Boundaries | None = None, **tags: str) -> DataFrame:
    """Transcripts from (name, html); fields come from the file name, address and source from ``metadata`` (name, url, and
    perhaps source), which the name's fields go before.

    A page that cannot be read is left out; ``parse_or_errors`` says which. Sentences are split by rule, or by learnt ``boundaries``.
    """
    return parse_or_errors(raw, metadata, suffix, source, boundaries, **tags)[0]


def parse_or_errors(raw: DataFrame, metadata: DataFrame | None = None, suffix: str = "", source: str = "", boundaries: Boundaries | None = None, **tags: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts as ``parse`` gives them, with the page's name, and (name, error) of the pages that cannot be read."""
    named = raw.select(F.col("name").alias("doc_id"), "html", t.file_name_fields(F.col("name"), suffix).alias("f"))
    if metadata is not None:
        own_source = F.col("source") if "source" in metadata.columns else F.lit(None).cast("string")
        saved = metadata.select(F.col("name").alias("doc_id"), *[F.lit("").alias(k) for k in KEYS], F.col("url").alias("source_url"), own_source.alias("own_source"))
        merged = pages.merge_metadata(saved, named.select("doc_id", "f.*"))
        named = named.drop("f").join(merged, "doc_id").withColumn("f", F.struct(*KEYS)).drop(*KEYS)
    else:
        named = named.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "own_source")})
    every = staged(pages.page_parts(named, **tags).select("doc_id", "source_url", "own_source", "f.*", "parts.*"), "parts")
    found, failed = every.where("error is null").drop("error"), every.where("error is not null").select(F.col("doc_id").alias("name"), "error")
    elements = found.select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*")
    lookup = staged(turns.role_lookup(found.select("doc_id", F.posexplode("participants").alias("pos", "line"))), "roles")
    said = turns.speaker_turns(elements, lookup)
    if boundaries is not None:
        said = split(said, boundaries, "text", "sentences")
    whole = turns.assemble(found, said, lookup)
    done = whole.select(
        *KEYS, F.coalesce("own_source", F.lit(source)).alias("source"), F.coalesce("source_url", F.lit("")).alias("source_url"), "word_count", "sentence_count", "prepared_remarks", "qa_ceo", "qa_analyst",
        "guidance_sentences", "speaker_turns", F.col("participants").alias("call_participants"), "parse_errors",
    )
    return done, failed


def load(spark: SparkSession, path: str, suffix: str = "", **tags: str) -> DataFrame:
    """Transcripts from a path by its kind: a page is parsed, metadata stands for the page beside it, other JSON is read."""
    if path.endswith("_meta.json"):
        path = path.removesuffix("_meta.json") + ".html"
    if not path.endswith((".html", ".htm")):
        return read_transcripts(spark, path)
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("html"))
    return parse(rows, suffix=suffix, **tags)


def parse_all(raw: DataFrame, path: str, overwrite: bool = False, errors_path: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Parse pages whose transcript the table at ``path`` lacks, commit them at once, and return the table.

    Of several pages for one transcript the first by name counts. Pages that cannot be read go to the table at ``errors_path`` (name,
    error), each once; the rest goes on.
    """
    spark = raw.sparkSession
    done = None if overwrite else commits.read_table(spark, path)
    fields = raw.withColumn("_f", t.file_name_fields(F.col("name"), options.get("suffix", "")))
    keys = fields.withColumns({k: F.col(f"_f.{k}") for k in KEYS})
    new = tables.not_done(keys, done, KEYS)
    # of repeated rows of a name one counts, one that has a page if any has
    first = new.groupBy(*KEYS).agg(F.min_by(F.struct("name", "html"), F.struct(F.col("html").isNull(), F.col("name"))).alias("r"))
    with scope():
        parsed, failed = parse_or_errors(first.select("r.*"), **options)
        table = commits.replace(parsed, path) if overwrite else commits.append(parsed, path, KEYS)
        if errors_path is not None:
            commits.append(failed, errors_path, ["name"])
    return table


def export_json(transcripts: DataFrame, path: str) -> None:
    """Transcripts as JSON lines, in a folder for each company."""
    transcripts.write.mode("overwrite").partitionBy("ticker").json(path)


def score_all(transcripts: DataFrame, scorer: Callable[[Column], Column], path: str, errors_path: str | None = None) -> DataFrame:
    """Score transcripts whose (ticker, date) the table at ``path`` lacks, commit them at once, and return the table.

    Transcripts without a key or a section cannot be scored; they go to the table at ``errors_path`` (ticker, date, error).
    """
    spark = transcripts.sparkSession
    new = tables.not_done(transcripts, commits.read_table(spark, path), ["ticker", "date"])
    good, bad = errors.divided(new, errors.missing(["ticker", "date", *scoring.SECTIONS.values()]))
    table = commits.append(scoring.score_transcripts(good, scorer), path, ["ticker", "date"])
    if errors_path is not None:
        commits.append(bad.select("ticker", "date", "error"), errors_path, ["ticker", "date", "error"])
    return table


def prices_table(spark: SparkSession, make: Callable[[], DataFrame], path: str, overwrite: bool = False) -> DataFrame:
    """The prices at ``path``; ``make`` gives them where there are none yet or with ``overwrite``."""
    known = None if overwrite else commits.read_table(spark, path)
    return commits.replace(make(), path) if known is None else known


def signals_table(spark: SparkSession, scores: DataFrame, prices: DataFrame, path: str, overwrite: bool = False, config: SignalConfig | None = None, sectors: dict[str, str] | DataFrame = SECTORS, days: DataFrame | None = None) -> DataFrame:
    """The signals at ``path``; built and written where there are none yet or with ``overwrite``.

    ``days`` as in ``returns.fill_forward``. Score dates are strings: unreadable ones become null and have no returns.
    """
    known = None if overwrite else commits.read_table(spark, path)
    if known is not None:
        return known
    dated = scores.withColumn("date", returns.call_date(F.col("date"))) if dict(scores.dtypes)["date"] == "string" else scores
    with scope():
        return commits.replace(signals.build_signals(dated, returns.fill_forward(prices, days), config, sectors), path)


def evaluate_all(table: DataFrame, horizons: Sequence[str] = ("fwd_1d", "fwd_5d", "fwd_20d")) -> dict[str, DataFrame]:
    """Result lines and the tables behind the charts."""
    rows = backtest.tertiles(table)
    return {
        "results": backtest.horizon_sweep(table, horizons), "decay": backtest.factor_decay(rows, horizons), "distribution": backtest.bucket_distribution(rows), "quarters": backtest.quarters_by_ticker(table),
    } | {f"buckets_{c}": backtest.bucket_returns(rows, c) for c in horizons} | {f"ic_{c}": backtest.ic_by_quarter(rows, c) for c in horizons}
