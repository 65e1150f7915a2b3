"""Landed transcript pages: reading, the content gate, and the parts of a page that need its tree."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..config import PAGE_MARKERS
from ..functions import text as t
from .stage import staged

# Element names by their role.
_VOID = "area base br col embed hr img input link meta source track wbr".split()
_ENDS_P = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_AGAIN = "li tr td th dd dt".split()
_CONTAINERS = "ul ol table div section article".split()
_WRAPPERS = ("div", "section", "article")
# Lengths of participants' lines, of a speaker's element and label, and full stops in a label.
LINE, SPOKEN, LABEL, STOPS = (4, 149), 200, 120, 1
#: Comments, scripts and styles whole, tags, and what is between them.
_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*>|\z)|<[/!?a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|<[/!?a-z][^>]*+>|(?:[^<]++|<(?![/!?a-z]))++|<"""


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(path, name, html) of every file; order is not kept."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.select(F.input_file_name().alias("path"), name.alias("name"), F.col("value").alias("html"))


def read_metadata(spark: SparkSession, path: str, glob: str = "*_meta.json") -> DataFrame:
    return spark.read.schema(schemas.PAGE_META).option("multiLine", True).option("pathGlobFilter", glob).json(path)


def visible_text(html: F.Column) -> F.Column:
    """Text without scripts, styles and tags; enough for the gate and word counts."""
    return t.clean(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->|<[^>]*>", " "))


def gate(pages: DataFrame, markers: tuple[str, ...] = PAGE_MARKERS) -> DataFrame:
    """Pages whose text has a marker, with their word count; null pages go."""
    own = pages.withColumn("_text", visible_text(F.col("html")))
    return own.where(t.has_any(F.col("_text"), markers)).withColumn("word_count", F.size(t.tokens(F.col("_text")))).drop("_text")


def merge_metadata(saved: DataFrame, from_name: DataFrame) -> DataFrame:
    """Saved metadata with the fields that the file name gives: these win, also when they are empty.

    Both have ``doc_id``; rows that only one side has are kept.
    """
    a, b = saved.alias("a"), from_name.alias("b")
    joined = a.join(b, "doc_id", "full").withColumn("_named", F.expr("b.ticker is not null"))
    cols = [F.when(F.col("_named"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in from_name.columns else F.col(f"a.{c}") for c in saved.columns if c != "doc_id"]
    return joined.select("doc_id", *cols)


def unescape(c: Column) -> Column:
    """Text with its character references decoded: numbers, and names that end in a semicolon; others stay as they are."""
    names = F.from_json(F.lit(json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";")})), "map<string,string>")
    digits = lambda x, base: F.conv(F.regexp_extract(x, r"([0-9a-fA-F]+);$", 1), base, 10).cast("int")
    point = lambda x: F.when(x.rlike(r"^&#[xX]"), digits(x, 16)).when(x.rlike(r"^&#"), digits(x, 10))
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    one = lambda x: F.when(~x.startswith("&"), x).when(valid(point(x)), char(point(x))).otherwise(F.coalesce(F.try_element_at(names, x), x))
    pieces = F.regexp_extract_all(c, F.lit(r"(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});|[^&]++|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def page_tokens(pages: DataFrame) -> DataFrame:
    """(h1, h2, pos, kind, name, text) of distinct (h1, h2, html), and a last token at each page's end.

    Kinds: open, close, void (an element without content), text.
    """
    raw = F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0))
    rows = pages.select("h1", "h2", F.posexplode(F.concat(raw, F.array(F.lit("</#end>")))).alias("pos", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^</?([a-zA-Z#][^\s/>]*)", 1))
    rows = rows.withColumn("name", F.when(F.col("raw").startswith("<"), name).otherwise(""))
    kind = (
        F.when(F.col("raw").startswith("</") & (F.col("name") != ""), "close").when(F.col("name").isin("script", "style", *_VOID), "void")
        .when(F.col("name") != "", "open").when(~F.col("raw").rlike(r"^<[!?/]"), "text")
    )
    text = F.regexp_replace(unescape(F.col("raw")), r"^(?U)[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return rows.select("h1", "h2", "pos", kind.alias("kind"), "name", F.when(kind == "text", text).alias("text")).where("kind is not null and (kind <> 'text' or text <> '')")


def page_elements(tokens: DataFrame) -> DataFrame:
    """(h1, h2, start, end, name) of all elements, from scans in page order.

    An element ends with the next end tag of its name at its own level; a paragraph also with the next tag that no paragraph
    may hold, items, rows and cells with the next of their name in the same container. Nothing lasts longer than the
    element around it. Tags belong together by name and level alone: an inline element that was begun in a paragraph and
    ends after blocks that ended the paragraph is around these blocks.
    """
    page = ("h1", "h2")
    to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows is what precedes in the other direction, whose running minimum takes one step a row
    ahead = lambda *by: Window.partitionBy(*page, *by).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)

    def levels(df: DataFrame, out: str, step: Column, *by: str) -> DataFrame:
        """How many are open at each tag, itself included; end tags of nothing count for nothing."""
        w = to_here(Window.partitionBy(*page, *by).orderBy("pos"))
        summed = df.withColumn("_s", F.sum(step).over(w))
        level = F.col("_s") - F.least(F.min("_s").over(w), F.lit(0))
        return summed.withColumn(out, level + F.when(step == -1, 1).otherwise(0)).drop("_s")

    holds = F.when(F.col("name").isin(*_CONTAINERS), step).otherwise(0)
    # one exchange by page serves all scans
    many = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tags = tokens.where("kind <> 'text'").repartition(many, *page)
    rows = levels(levels(tags, "level", step, "name"), "inside", holds)
    match = Window.partitionBy(*page, "name", "level").orderBy("pos")
    after = lambda c, *by: F.min(F.when(c, F.col("pos"))).over(ahead(*by))
    opened, named = F.col("kind") == "open", F.col("name")
    again, is_container = opened & named.isin(*_AGAIN), opened & named.isin(*_CONTAINERS)
    # pairs of tags that belong together give the depth at each tag, before it is counted itself
    pair = ~named.isin("p", *_AGAIN) & ((opened & (F.lead("kind").over(match) == "close")) | ((F.col("kind") == "close") & (F.lag("kind").over(match) == "open")))
    paired = rows.withColumn("pair", F.coalesce(pair, F.lit(False)))
    own_step = F.when(F.col("pair"), step).otherwise(0)
    deep = paired.withColumn("around", F.sum(own_step).over(to_here(Window.partitionBy(*page).orderBy("pos"))) - own_step)
    begins = F.col("kind").isin("open", "void")
    own = deep.withColumns({
        "_close": after(F.col("kind") == "close", "name", "level"), "_block": after(begins & named.isin(*_ENDS_P)), "_p": after((F.col("kind") == "close") & (named == "p")),
        "_again": after(begins & named.isin(*_AGAIN), "name", "inside"), "_parent": after(F.col("pair") & (F.col("kind") == "close"), "around"), "_last": F.max("pos").over(Window.partitionBy(*page)),
    })
    implied = F.when(named == "p", F.least("_block", "_p")).when(named.isin(*_AGAIN), F.least("_again", "_close")).otherwise(F.col("_close"))
    ended = own.withColumn("end", F.least(implied, "_parent", "_last")).withColumn("level", F.col("inside") - F.when(is_container, 1).otherwise(0))
    # a paragraph, item, row or cell that ends without an end tag ends what is in it
    before = Window.partitionBy(*page, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    around = {"_cell": again, "_text": opened & (named == "p")}
    held = ended.withColumns({c: F.last(F.when(k, F.col("end")), ignorenulls=True).over(before) for c, k in around.items()}).where(begins)
    end = F.least("end", *[F.when(F.col(c) > F.col("pos"), F.col(c)) for c in around])
    return held.select(*page, F.col("pos").alias("start"), F.when(F.col("kind") == "void", F.col("pos") + 1).otherwise(end).alias("end"), "name")


def page_arrays(pages: DataFrame) -> DataFrame:
    """(h1, h2, texts, elements) of distinct (h1, h2, html): pieces of text in order, and elements by their start.

    An element has its name, its depth, its number and that of the first element after it, and the same for pieces of text.
    """
    page = ["h1", "h2"]
    tokens = staged(page_tokens(pages), "tokens")
    found = staged(page_elements(tokens), "elements")
    ends = found.groupBy(*page, F.col("end").alias("pos")).agg(F.count(F.lit(1)).alias("ended"))
    upto = Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.sum(c.cast("int")).over(upto) - c.cast("int")
    # a void element ends at the place after it, where there may be no token
    places = tokens.select(*page, "pos", F.col("kind").isin("open", "void").alias("o"), (F.col("kind") == "text").alias("t")).join(ends, [*page, "pos"], "full")
    known = places.select(*page, "pos", before(F.coalesce("o", F.lit(False))).alias("k"), before(F.coalesce("t", F.lit(False))).alias("i"), F.sum(F.coalesce("ended", F.lit(0))).over(upto).alias("done"))
    start = found.join(known.withColumnRenamed("pos", "start"), [*page, "start"]).withColumn("depth", F.col("k") - F.col("done")).drop("done")
    whole = start.join(known.select(*page, F.col("pos").alias("end"), F.col("k").alias("k2"), F.col("i").alias("i2")), [*page, "end"])
    elements = whole.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name", "depth", "k", "k2", "i", "i2"))).alias("elements"))
    texts = tokens.where("kind = 'text'").groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
    return elements.join(texts, page, "full")


def page_parts(pages: DataFrame, prepared: str = "Prepared Remarks", qa: str = "Question", participants: str = "Call participant", header_tag: str = "h2", label_tag: str = "strong") -> DataFrame:
    """``pages`` with ``parts``: participant lines, which sections there are, and their labelled elements.

    Equal pages are walked once. A null page has an error and nothing else.
    """
    h1, h2 = F.xxhash64("html"), F.xxhash64(F.col("html"), F.lit(1))
    mine = ["_h1", "_h2", "_walked"]
    while {c.lower() for c in pages.columns} & set(mine):
        mine = [f"{c}_" for c in mine]
    distinct = pages.where(F.col("html").isNotNull()).select(h1.alias("h1"), h2.alias("h2"), "html").dropDuplicates(["h1", "h2"])
    none = F.array().cast("array<string>")
    arrays = page_arrays(distinct)
    kind = arrays.schema["elements"].dataType
    arrays = arrays.withColumns({"texts": F.coalesce("texts", none), "elements": F.coalesce("elements", F.array().cast(kind))})
    text = lambda e: F.array_join(F.slice("texts", (e["i"] + 1).cast("int"), (e["i2"] - e["i"]).cast("int")), "")
    below = lambda e: F.slice("elements", (e["k"] + 2).cast("int"), F.greatest(e["k2"] - e["k"] - 1, F.lit(0)).cast("int"))

    def section(header: str) -> Column:
        """Elements after the first header that contains the text, up to the next header beside it."""
        heads = F.filter("elements", lambda e: (e["name"] == header_tag) & F.contains(F.lower(text(e)), F.lit(header.lower())))

        def beside(h: Column) -> Column:
            later = F.slice("elements", (h["k2"] + 1).cast("int"), F.size("elements"))
            ends = F.filter(later, lambda e: (e["depth"] < h["depth"]) | ((e["depth"] == h["depth"]) & (e["name"] == header_tag)))
            stop = F.coalesce(F.get(ends, F.lit(0))["start"], F.lit(1 << 30))
            return t.let(stop, lambda at: F.filter(later, lambda e: (e["depth"] == h["depth"]) & (e["start"] < at)))

        return F.flatten(F.transform(F.slice(heads, 1, 1), beside))

    found = arrays.select("h1", "h2", "texts", "elements", section(prepared).alias("said"), section(qa).alias("asked"), section(participants).alias("listed"))

    def labelled(of: str, name: str) -> Column:
        """Labels and texts in order; wrappers are opened one level. What follows a label in its own element is a text after it."""
        opened = lambda e: F.when(e["name"].isin(*_WRAPPERS), F.filter(below(e), lambda x: x["depth"] == e["depth"] + 1)).otherwise(F.array(e))
        bold = lambda e: F.get(F.filter(below(e), lambda x: x["name"] == label_tag), F.lit(0))
        flat = F.transform(F.flatten(F.transform(of, opened)), lambda e: F.struct(e["name"].alias("name"), text(e).alias("text"), F.when(bold(e).isNotNull(), text(bold(e))).alias("bold")))
        flat = F.filter(flat, lambda x: x["text"] != "")

        def one(x: Column, k: Column) -> Column:
            own = F.coalesce(x["bold"], x["text"])
            speaks = (x["bold"].isNotNull() & (F.length(x["text"]) < SPOKEN) & x["name"].isin("p", "div")) | (x["name"] == label_tag)
            is_label = speaks & (own != "") & (F.length(own) < LABEL) & (F.length(own) - F.length(F.replace(own, F.lit("."), F.lit(""))) <= STOPS)
            rest = F.when(x["bold"].isNotNull(), F.trim(F.replace(x["text"], own, F.lit("")))).otherwise("")
            return F.struct(F.lit(name).alias("section"), k.cast("int").alias("pos"), is_label.alias("is_label"), F.when(is_label, own).alias("label"), F.when(is_label, rest).otherwise(x["text"]).alias("text"))

        return F.transform(flat, one)

    fits = lambda x: F.length(x).between(*LINE)

    def more_lines(lines: Column, e: Column) -> Column:
        """Texts of paragraphs, items and bold parts of an element, then of itself if it is new."""
        inner = F.filter(below(e), lambda x: x["name"].isin("p", "li", "strong"))
        own = F.when(F.size(inner) > 0, F.transform(inner, text)).otherwise(F.array(text(e)))
        every = F.concat(lines, F.filter(own, fits))
        return F.when(fits(text(e)) & ~F.array_contains(every, text(e)), F.concat(every, F.array(text(e)))).otherwise(every)

    columns = {
        "participants": F.aggregate("listed", none, more_lines), "has_prepared": F.size("said") > 0, "has_qa": F.size("asked") > 0,
        "elements": F.concat(labelled("said", "prepared_remarks"), labelled("asked", "qa")),
    }
    walked = found.select(F.col("h1").alias(mine[0]), F.col("h2").alias(mine[1]), F.struct(*[c.alias(name) for name, c in columns.items()]).alias(mine[2]))
    joined = pages.join(walked, (h1 == F.col(mine[0])) & (h2 == F.col(mine[1])) & F.col("html").isNotNull(), "left")
    empty = {"participants": none, "has_prepared": F.lit(False), "has_qa": F.lit(False), "elements": F.array().cast(schemas.PAGE_PARTS["elements"].dataType)}
    fields = [F.coalesce(F.col(mine[2])[c], default).alias(c) for c, default in empty.items()]
    parts = F.struct(*fields, F.when(F.col("html").isNull(), "no page").alias("error"))
    return joined.withColumn("parts", parts).select(*pages.columns, "parts")
