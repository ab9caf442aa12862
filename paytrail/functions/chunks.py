"""How texts are taken apart: sentences, chunks, tables, lettered sections, bullet lists. All of it is expressions over a text,
or rows of its parts with windows over them; what an order carries along is a fold over the parts of one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.plans.cut import cut

from .text import ABBREVIATIONS, HEADING_WORDS, MAX_CHARS, MIN_CHARS, MIN_SENTENCES, PERCENTILE, ROMAN, adjacent_distance, tidy

#: A mark that no text has.
MARK = "\x00"
CLOSERS = r"[.!?]{1,6}[\"')\]]{0,6}"


def _boundary() -> str:
    """White space between two sentences: behind a word that ends in a stop, before a capital or an opening mark; the word is no
    abbreviation and no initial, read from its last opening bracket on."""
    short = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=lambda a: (-len(a), a)))
    word = rf"(?:^|[\s(\[\x00])(?:{short}|\p{{L}})"
    return rf"(?U)(?<={CLOSERS})(?<!(?i:{word}){CLOSERS})\s+(?=[\p{{Lu}}(‘“\"'])"


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentence_list(text: Column) -> Column:
    """Sentences in order. A line never joins the next."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]*\n\s*", MARK), _boundary(), MARK), MARK)
    return F.filter(F.transform(parts, bare), lambda s: s != "")


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``ordinal`` (from 0), ``piece``: the sentences of every text; a null text has none."""
    return docs.select(key, F.posexplode(sentence_list(F.col(text))).alias("ordinal", "piece"))


def _fill(parts: Column, most: Column, mark: str = " ", least: int | None = None) -> Column:
    """Neighbouring parts joined by ``mark`` as long as they have ``most`` characters; a longer part stands alone. With ``least``, parts are
    (piece, starts), and one that starts something ends the text before it, if that has ``least``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, x: Column) -> Column:
        piece = x if least is None else x["piece"]
        full = F.length(acc["cur"]) + len(mark) + F.length(piece) > most
        new = full if least is None else full | (x["starts"] & (F.length(acc["cur"]) >= least))
        done = F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        opened = F.struct(done.alias("done"), piece.alias("cur"))
        return F.when(acc["cur"].isNull() | new, opened).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(mark), piece).alias("cur")))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def wrap_list(text: Column, most: Column | int) -> Column:
    """Pieces of at most ``most`` characters, cut at spaces."""
    return _fill(F.filter(F.split(text, " "), lambda w: w != ""), F.lit(most) if isinstance(most, int) else most)


def glue_list(parts: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Chunks of sentences (``piece``, ``starts``): a new one at a boundary once ``least`` is reached, or where ``most`` would be passed; a
    short last chunk joins the one before if they fit."""
    filled = F.flatten(F.transform(_fill(parts, F.lit(most), least=least), lambda c: F.when(F.length(c) > most, wrap_list(c, most)).otherwise(F.array(c))))

    def tail(chunks: Column) -> Column:
        last, other = F.try_element_at(chunks, F.lit(-1)), F.try_element_at(chunks, F.lit(-2))
        joined = F.concat(F.slice(chunks, 1, F.greatest(F.size(chunks) - 2, F.lit(0))), F.array(F.concat(other, F.lit(" "), last)))
        return F.when((F.size(chunks) > 1) & (F.length(last) < least) & (F.length(other) + 1 + F.length(last) <= most), joined).otherwise(chunks)

    return F.transform(F.array(filled), tail)[0]


TABLE = r"(?s)^(.*?)/Table Start\n(.*?)\n/Table End"


def table_list(text: Column, most: int = MAX_CHARS) -> Column:
    """Rows of a table region in chunks that each repeat the header; what stands before it comes first."""
    clean = lambda x: bare(F.regexp_replace(F.replace(x, F.lit("\t"), F.lit(" | ")), "[  ]+", " "))
    before = clean(F.regexp_extract(text, TABLE, 1))
    lines = F.transform(F.filter(F.split(F.regexp_extract(text, TABLE, 2), "\n"), lambda x: bare(x) != ""), clean)

    def rows(own: Column) -> Column:
        head = F.coalesce(F.get(own, F.lit(0)), F.lit(""))
        room = most - F.length(head) - 1
        cells = F.flatten(F.transform(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda row: wrap_list(row, room)))
        return F.transform(_fill(cells, room, "\n"), lambda c: F.concat(head, F.lit("\n"), c))

    return F.concat(wrap_list(before, most), F.transform(F.array(lines), rows)[0])


def hashed_words(text: Column, dims: int = 64) -> Column:
    """A stand-in for an embedding model that needs none: hashed words as a map from bucket to sum, zeros left out."""
    # a word's code is twice its bucket, and one more for a word that adds; codes are counted by what is left without them
    code = lambda h: h % dims * 2 + F.shiftright(h, 16) % 2
    each = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: code(F.crc32(w.cast("binary"))))
    total = lambda own, i: (F.size(F.array_remove(own, i * 2)) - F.size(F.array_remove(own, i * 2 + 1))).cast("double")
    sums = lambda own: F.transform(F.array_distinct(F.transform(own, lambda c: F.shiftright(c, 1))), lambda i: F.struct(i.alias("i"), total(own, i).alias("x")))
    return F.map_from_entries(F.transform(F.array(each), sums)[0])


def _hashed_distance(rows: DataFrame) -> DataFrame:
    """``k``, ``ordinal``, ``distance`` of each sentence's hashed words from those of the one before it."""
    order = Window.partitionBy("k").orderBy("ordinal")
    # dealt by text first, so that the words are hashed by all tasks
    pairs = rows.repartition("k").withColumn("v", hashed_words(F.col("piece"))).withColumn("u", F.lag("v").over(order))
    dot = lambda a, b: F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    cosine = F.try_divide(dot(F.col("v"), F.col("u")), F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("u"), F.col("u"))))
    return pairs.select("k", "ordinal", F.when(F.col("u").isNotNull(), 1 - F.coalesce(cosine, F.lit(0.0))).alias("distance"))


def chunk(docs: DataFrame, key: str, text: str = "text", encode: Callable[[DataFrame], DataFrame] | None = None, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """``key``, ``ordinal`` (from 0), ``piece``: chunks of normalised texts. Tables go by rows, short texts whole, others are cut where
    neighbouring sentences differ most. ``encode`` adds ``vector`` to rows of ``key``, ``ordinal``, ``piece``; without one, hashed words are
    compared. Keys tell texts apart; a null text has no chunk."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    region, body = F.rlike("t", F.lit(TABLE)), F.col("t")
    # split once, used three times; nulls go behind the cut, as a filter before it would make the texts twice
    own = cut(own.withColumn("s", F.when(~region & (F.length("t") > most), sentence_list(body))), "sentences").where("t is not null")
    alone = F.when(region, table_list(body, most)).when(F.length("t") <= most, F.filter(F.array(body), lambda t: t != "")).when(F.size("s") < 2, wrap_list(body, most))
    whole = own.where(F.col("s").isNull() | (F.size("s") < 2)).select("k", alone.alias("c"))
    rows = own.where(F.size("s") >= 2).select("k", F.size("s").alias("n"), F.posexplode("s").alias("ordinal", "piece"))
    many = rows.where(F.col("n") >= MIN_SENTENCES)
    if encode is None:
        away = _hashed_distance(many)
    else:
        vectors = encode(many.select(F.col("k").alias(key), "ordinal", "piece")).select(F.col(key).alias("k"), "ordinal", "vector")
        away = adjacent_distance(vectors, "k", "ordinal", "vector")
    away = away.select("k", "ordinal", F.coalesce("distance", F.lit(0.0)).alias("d"))
    bar = F.percentile(F.when(F.col("ordinal") > 0, F.col("d")), PERCENTILE).over(Window.partitionBy("k"))
    starts = away.withColumn("starts", (F.col("ordinal") > 0) & (F.col("d") > bar)).where("starts").select("k", "ordinal", "starts")
    marked = rows.join(starts, ["k", "ordinal"], "left").withColumn("starts", F.coalesce("starts", F.lit(False)))
    listed = marked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece", "starts"))).alias("p"))
    glued = listed.select("k", glue_list(F.transform("p", lambda x: F.struct(x["piece"].alias("piece"), x["starts"].alias("starts"))), least, most).alias("c"))
    return whole.unionByName(glued).select(F.col("k").alias(key), F.posexplode("c").alias("ordinal", "piece"))


#: A paragraph's label.
LABEL = r"^\(([A-Za-z0-9]{1,4})\)"


def _place(label: Column) -> Column:
    """(series, ordinal): numbers, roman numbers, letters of one case; a label of several letters has no ordinal."""
    roman = F.array_position(F.array(*map(F.lit, ROMAN)), F.lower(label)).cast("int")
    upper = F.upper(label) == label
    return (
        F.when(F.rlike(label, F.lit(r"^\d+$")), F.struct(F.lit("number").alias("series"), label.cast("int").alias("ordinal")))
        .when((roman > 0) & ~upper, F.struct(F.lit("roman").alias("series"), roman.alias("ordinal")))
        .otherwise(F.struct(F.when(upper, "upper").otherwise("lower").alias("series"), F.when(F.length(label) == 1, F.ascii(label)).alias("ordinal")))
    )


def section_list(body: Column, stem: Column) -> Column:
    """(``ref``, ``text``) of lettered paragraphs. A label takes the place of the deepest open one that it follows in its series, else it
    opens a level; a paragraph without a label belongs to the one before, or to the section itself."""
    read = F.transform(F.filter(F.transform(F.split(body, "\n\n"), bare), lambda p: p != ""), lambda p: F.struct(p.alias("p"), F.nullif(F.regexp_extract(p, LABEL, 1), F.lit("")).alias("label")))
    level = "array<struct<label:string,series:string,ordinal:int>>"
    start = F.struct(F.array().cast(level).alias("open"), F.array().cast("array<struct<ref:string,text:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = F.transform(F.array(_place(x["label"])), lambda place: F.struct(place.alias("place"), F.array_max(F.transform(acc["open"], lambda o, i: F.when((o["series"] == place["series"]) & (o["ordinal"] + 1 == place["ordinal"]), i + 1))).alias("level")))[0]
        depth = F.coalesce(at["level"] - 1, F.size(acc["open"]))
        entry = F.struct(x["label"].alias("label"), at["place"]["series"].alias("series"), at["place"]["ordinal"].alias("ordinal"))
        opened = F.when(x["label"].isNull(), acc["open"]).otherwise(F.concat(F.slice(acc["open"], F.lit(1), depth), F.array(entry)).cast(level))
        ref = F.concat(stem, F.array_join(F.transform(opened, lambda o: F.concat(F.lit("("), o["label"], F.lit(")"))), ""))
        last = F.try_element_at(acc["out"], F.lit(-1))
        goes_on = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["ref"].alias("ref"), F.concat(last["text"], F.lit("\n"), x["p"]).alias("text"))))
        new = F.concat(acc["out"], F.array(F.struct(ref.alias("ref"), x["p"].alias("text"))))
        return F.struct(opened.alias("open"), F.when(x["label"].isNull() & (F.size(acc["out"]) > 0), goes_on).otherwise(new).alias("out"))

    return F.aggregate(read, start, add, lambda acc: acc["out"])


def cfr_sections(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """``key``, ``section_ref``, ``text`` of the paragraphs of eCFR XML sections."""
    number = F.regexp_extract(xml, r'<DIV8[^>]*\sN="([^"]+)"', 1)
    paragraphs = F.transform(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<P>(.*?)</P>"), F.lit(1)), lambda p: tidy(F.regexp_replace(p, r"<[^>]+>", "")))
    flat = docs.select(key, bare(F.concat(F.lit("§ "), number)).alias("stem"), F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n").alias("body"))
    return flat.select(key, F.explode(section_list(F.col("body"), F.col("stem"))).alias("s")).select(key, F.col("s.ref").alias("section_ref"), "s.text")


BULLET = r"^\s*[•●▪·*-]\s+"


def guidance(docs: DataFrame, key: str, text: str = "text", heading: str = "Guidance") -> tuple[DataFrame, DataFrame]:
    """(indicators: ``key``, ``section_ref``, ``text``; prose: ``key``, ``text``) of documents with bullet lists; lines that come back in their
    document, numbers aside, are left out. A bullet goes on over the lines behind it until one closes it or a title comes; a title
    starts the numbers again."""
    rows = docs.select(F.col(key).alias("k"), F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("ln", "line"))
    rows = rows.withColumns({"bullet": F.rlike("line", F.lit(BULLET)), "bared": bare(F.col("line"))}).where("bared <> ''")
    shape = F.when(~F.col("bullet"), F.regexp_replace("bared", r"\d+", "#"))
    rows = rows.withColumn("shape", shape).withColumn("times", F.count("shape").over(Window.partitionBy("k", "shape"))).where("times < 2")
    words = F.split("bared", r"(?U)\s+")
    title = ~F.col("bullet") & (F.size(words) <= HEADING_WORDS) & F.rlike("bared", F.lit(r"^\p{Lu}")) & ~F.rlike("bared", F.lit(r"[.;:]$")) & ~F.contains("line", F.lit(","))
    before = Window.partitionBy("k").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("title", title).withColumn("stops", F.col("title") | F.rlike("bared", F.lit(r"[.;!?]$")))
    rows = rows.withColumn("stopped", F.coalesce(F.count_if("stops").over(before), F.lit(0)))
    rows = rows.withColumns({
        "item": F.last(F.when(F.col("bullet"), F.struct("ln", "stopped")), ignorenulls=True).over(so_far), "head": F.last(F.when(F.col("title"), F.struct("ln", "bared")), ignorenulls=True).over(so_far),
    })
    rows = rows.withColumn("number", F.count_if("bullet").over(Window.partitionBy("k", F.col("head.ln")).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)))
    owned = F.col("bullet") | (~F.col("title") & F.coalesce(F.col("stopped") == F.col("item.stopped"), F.lit(False)))
    said = F.when(F.col("bullet"), bare(F.regexp_replace("line", BULLET, ""))).otherwise(F.col("bared"))
    ref = F.concat_ws(" ¶ ", F.coalesce("head.bared", F.lit(heading)), F.col("number").cast("string"))
    joined = lambda mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "said"))), lambda x: x["said"]), mark)
    items = rows.where(owned).withColumns({"said": said, "first": F.col("item.ln"), "ref": F.when(F.col("bullet"), ref)}).groupBy("k", "first").agg(F.max("ref").alias("section_ref"), bare(joined(" ")).alias("text"))
    prose = rows.where(~owned).withColumn("said", F.col("bared")).groupBy("k").agg(joined("\n").alias("text"))
    return items.where("text <> ''").select(F.col("k").alias(key), F.col("first").alias("ln"), "section_ref", "text"), prose.select(F.col("k").alias(key), "text")
