"""Driver tables and the corpus tables Spark derives from them.

Nothing is grouped here: each input row becomes one part, page, box or cell
row, so a hot key costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.cellref import make_ref
from folioscope.functions.text import object_id
from folioscope.functions.xml import elements, not_blank, xml_escape, xml_unescape


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Partitions for each core where short rows become long parts.
DEAL = 4


def by_key(df: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Rows for parsing: where they lie, or over all cores if the input is one or two splits.

    Markup is parsed row by row, so no exchange is needed below the parser: a table of a cluster has
    far more splits than cores and is read in place. Only a file that cannot be split, such as one row
    group, is dealt out first, by the document, into as many partitions as there are cores. Where the key is ``unique``, no
    key can fill a partition, and short rows that become long parts are dealt out unless there are several splits for each core:
    a split of 128 MB holds millions of them.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if unique:
        return df.repartition(DEAL * cores, key) if splits < DEAL * cores else df
    return df.repartition(cores, key) if 2 * splits < cores else df


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markup part per page."""
    return by_key(table(spark, sf_dir, "pages"), "page_id").select(
        F.col("page_id").alias("doc_id"),
        F.lit("html").alias("format"),
        F.col("url").alias("part"),
        F.lit(0).alias("ord"),
        F.col("html").alias("xml"),
    )


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of ``p``, ``h1``, ``a`` and ``li`` elements, numbered before blanks drop."""
    nodes = F.posexplode(elements("xml", "p", "h1", "a", "li")).alias("idx", "raw")
    return (
        page_parts(spark, sf_dir)
        .select("doc_id", "part", nodes)
        .select("doc_id", "part", "idx", xml_unescape("raw").alias("text"))
        .filter(not_blank("text"))
        .withColumn("object_id", object_id(F.lit("html"), F.col("part"), F.col("idx")))
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of a document as paragraph objects."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
        .filter(not_blank("text"))
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit("docx").alias("format"),
        F.octet_length("text").cast("bigint").alias("byte_len"),
        F.sha2("text", 256).alias("sha256"),
    )


def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two versions of the corpus: ``before`` and ``after`` differ by id rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    if which == "before":
        return docs.filter(F.col("doc_id") % 7 != 0)
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs.filter(F.col("doc_id") % 11 != 0).withColumn("text", edited)


def snapshot_parts(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Part rows (digest and size only) of a snapshot; the language plays the package."""
    return snapshot(spark, sf_dir, which).select(
        F.col("lang").alias("doc_id"),
        F.concat(F.lit("word/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("part"),
        F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on a slide; the order is the slide, all values are whole."""
    li = table(spark, sf_dir, "lineitem")
    ident = F.concat_ws(
        "-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("slide"),
        ident.alias("object_id"),
        F.when(F.col("l_linenumber") == 1, "title").when(F.col("l_returnflag") == "R", "image")
        .otherwise("shape").alias("kind"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_quantity") * 20).alias("x"),
        F.round(F.col("l_tax") * 4000).alias("y"),
        (F.col("l_linenumber") * 30).cast("double").alias("w"),
        (F.round(F.col("l_discount") * 400) + 20).alias("h"),
    )


ORDER_COLUMNS = ("quantity", "price", "discount", "flag", "status")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as worksheet rows: sheet = line number, row by supplier, five values as text."""
    values = (F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("int"),
              F.col("l_returnflag"), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sheet_idx"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("row"),
        *[v.cast("string").alias(name) for name, v in zip(ORDER_COLUMNS, values)])


def as_cells(rows: DataFrame, columns: tuple[str, ...] = ORDER_COLUMNS) -> DataFrame:
    """Cells of the ``columns`` of ``order_rows``; other columns stay as they are."""
    values = F.array(*[F.struct(F.lit(ORDER_COLUMNS.index(c) + 1).alias("col"), F.col(c).alias("value")) for c in columns])
    return (
        rows.select(*[c for c in rows.columns if c not in ORDER_COLUMNS], F.inline(values))
        .withColumn("sheet_name", F.concat(F.lit("Line "), F.col("sheet_idx").cast("string")))
        .withColumn("ref", make_ref("col", "row"))
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as worksheet cells: columns A-E of ``order_rows``."""
    return as_cells(order_rows(spark, sf_dir))


# --- office packages derived from the driver tables -------------------------


def _part(doc: Column, fmt: str, name, order, xml: Column):
    return [
        doc.alias("doc_id"),
        F.lit(fmt).alias("format"),
        (F.lit(name) if isinstance(name, str) else name).alias("part"),
        (F.lit(order) if isinstance(order, int) else order).cast("int").alias("ord"),
        xml.alias("xml"),
    ]


CONTENT_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>'


def _parts(df: DataFrame, fmt: str, doc: str, main: str, named: dict[str, Column]) -> DataFrame:
    """The two package-level parts every office file carries and the ``named`` ones, from one scan."""
    root = (
        '<?xml version="1.0"?><Relationships><Relationship Id="rId1" '
        f'Type="officeDocument" Target="{main}"/></Relationships>'
    )
    bodies = {"[Content_Types].xml": F.lit(CONTENT_TYPES), "_rels/.rels": F.lit(root), **named}
    # Names first, bodies by name: after a filter on the part only the bodies that are left get built.
    body = F.coalesce(*[F.when(F.col("part") == name, xml) for name, xml in bodies.items()])
    return df.withColumns({"_names": F.array(*map(F.lit, bodies))}).select("*", F.posexplode("_names").alias("ord", "part")).select(
        F.col(doc).alias("doc_id"), F.lit(fmt).alias("format"), "part", "ord", body.alias("xml"))


def docx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-processing package per document: a paragraph per line, a run per sentence."""
    docs = by_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    run, para = "<w:r><w:t>", "</w:t></w:r>"
    inner = F.replace(xml_escape("text"), F.lit(". "), F.lit(f". {para}{run}"))
    inner = F.replace(inner, F.lit("\n"), F.lit(f"{para}</w:p><w:p>{run}"))
    body = F.concat(F.lit(f"<w:document><w:body><w:p>{run}"), inner, F.lit(f"{para}</w:p><w:sectPr/></w:body></w:document>"))
    return _parts(docs, "docx", "doc_id", "word/document.xml", {"word/document.xml": body})


def slide_xml() -> Column:
    """A slide with the role as title and one bulleted paragraph per line of the turn."""
    lines = F.split("text", "\n")
    paragraph = lambda line, i: F.concat(
        F.lit('<a:p><a:pPr lvl="'), F.pmod(i, F.lit(3)).cast("string"),
        F.lit('"><a:buChar char="-"/></a:pPr><a:r><a:rPr lang="'),
        F.lit("en"), F.lit('" b="'), F.when(i == 0, "1").otherwise("0"), F.lit('" sz="'),
        (F.lit(800) + F.pmod(i, F.lit(5)) * 200).cast("string"),
        F.lit('"><a:latin typeface="Arial"/></a:rPr><a:t>'), xml_escape(line), F.lit("</a:t></a:r></a:p>"),
    )
    return F.concat(
        F.lit('<p:sld><p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr>'
              '<p:spPr><a:xfrm><a:off x="457200" y="274638"/><a:ext cx="8229600" cy="1143000"/></a:xfrm></p:spPr>'
              "<p:txBody><a:p><a:r><a:t>"),
        xml_escape("role"),
        F.lit("</a:t></a:r></a:p></p:txBody></p:sp>"
              '<p:sp><p:nvSpPr><p:cNvPr id="3" name="Body"/><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr>'
              '<p:spPr><a:xfrm><a:off x="457200" y="1600200"/><a:ext cx="8229600" cy="4525963"/></a:xfrm></p:spPr>'
              "<p:txBody>"),
        F.array_join(F.transform(lines, paragraph), ""),
        F.lit("</p:txBody></p:sp></p:sld>"),
    )


def pptx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation per conversation, one slide part per turn."""
    turns = by_key(table(spark, sf_dir, "conversations"), "conv_id")
    number = (F.col("turn") + 1).cast("string")
    slides = turns.select(
        *_part(
            F.col("conv_id"), "pptx", F.concat(F.lit("ppt/slides/slide"), number, F.lit(".xml")),
            F.col("turn") + 4, slide_xml(),
        )
    )
    convs = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ids = F.sequence(F.lit(0).cast("bigint"), F.col("last"))
    deck = F.concat(
        F.lit("<p:presentation><p:sldIdLst>"),
        F.array_join(F.transform(ids, lambda i: F.concat(
            F.lit('<p:sldId id="'), (i + 256).cast("string"), F.lit('" r:id="rId'), (i + 1).cast("string"), F.lit('"/>')
        )), ""),
        F.lit("</p:sldIdLst></p:presentation>"),
    )
    rels = F.concat(
        F.lit("<Relationships>"),
        F.array_join(F.transform(ids, lambda i: F.concat(
            F.lit('<Relationship Id="rId'), (i + 1).cast("string"),
            F.lit('" Type="slide" Target="slides/slide'), (i + 1).cast("string"), F.lit('.xml"/>')
        )), ""),
        F.lit("</Relationships>"),
    )
    named = {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels}
    return _parts(convs, "pptx", "conv_id", "ppt/presentation.xml", named).unionByName(slides)


def grouped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation per conversation whose slides hold groups within groups, listed last turn first.

    Per turn: a group at twice the size of what it holds, in it the role as a shape and a second group with a shape per
    line of the text, then a picture and a connector from the role to the first line.
    """
    turns = by_key(table(spark, sf_dir, "conversations"), "conv_id")

    def box(x, y, w, h, name: str = "") -> Column:
        put = lambda v: v if isinstance(v, Column) else F.lit(str(v))
        c = name and "ch"
        return F.concat(F.lit(f"<a:{c}{'O' if c else 'o'}ff x=\""), put(x), F.lit('" y="'), put(y), F.lit(f'"/><a:{c}{"E" if c else "e"}xt cx="'),
                        put(w), F.lit('" cy="'), put(h), F.lit('"/>'))

    def shape(number: Column, text: Column, frame: Column) -> Column:
        return F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="'), number, F.lit('" name="S'), number, F.lit('"/></p:nvSpPr><p:spPr><a:xfrm>'), frame,
                        F.lit("</a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>"), xml_escape(text), F.lit("</a:t></a:r></a:p></p:txBody></p:sp>"))

    def group(number: int, frame: Column, inner: Column, *content: Column) -> Column:
        return F.concat(F.lit(f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="{number}" name="G{number}"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm>'), frame, inner,
                        F.lit("</a:xfrm></p:grpSpPr>"), *content, F.lit("</p:grpSp>"))

    px = lambda value: (value * 9525).cast("string")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: shape(
        (i + 30).cast("string"), line, box(px(10 * (i + 1)), px(20 * (i + 1)), 95250, 190500))), "")
    left = px(F.col("turn") * 8 + 100)
    xml = F.concat(
        F.lit("<p:sld><!-- <p:sp><p:nvSpPr/></p:sp> -->"),
        group(10, box(left, 952500, 3810000, 1905000), box(0, 0, 1905000, 952500, "ch"),
              shape(F.lit("11"), F.col("role"), box(190500, 95250, 381000, 190500)),
              group(20, box(95250, 285750, 952500, 476250), box(47625, 95250, 952500, 476250, "ch"), lines)),
        F.lit('<p:pic><p:nvPicPr><p:cNvPr id="12" name="P"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId7"/></p:blipFill><p:spPr><a:xfrm>'),
        box(952500, 0, 952500, 952500), F.lit("</a:xfrm></p:spPr></p:pic>"),
        F.lit('<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="13" name="C"/><p:cNvCxnSpPr><a:stCxn id="11" idx="0"/><a:endCxn id="30" idx="0"/></p:cNvCxnSpPr>'
              "</p:nvCxnSpPr></p:cxnSp></p:sld>"))
    number = (F.col("turn") + 1).cast("string")
    slide = F.concat(F.lit("ppt/slides/slide"), number, F.lit(".xml"))
    link = F.concat(F.lit('<Relationships><Relationship Id="rId7" Type="image" Target="../media/image'), number, F.lit('.png"/></Relationships>'))
    slides = turns.select(*_part(F.col("conv_id"), "pptx", slide, F.col("turn").cast("int") + 4, xml)).unionByName(
        turns.select(*_part(F.col("conv_id"), "pptx", F.concat(F.lit("ppt/slides/_rels/slide"), number, F.lit(".xml.rels")), F.col("turn").cast("int") + 4, link)))
    # Two levels: the deck lists its turns in falling order, so that slide numbers differ from those in part names.
    convs = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    ids = F.reverse(F.sequence(F.lit(0).cast("bigint"), F.col("last")))
    deck = F.concat(F.lit("<p:presentation><p:sldIdLst>"), F.array_join(F.transform(ids, lambda i: F.concat(
        F.lit('<p:sldId id="'), (i + 256).cast("string"), F.lit('" r:id="rId'), (i + 1).cast("string"), F.lit('"/>'))), ""), F.lit("</p:sldIdLst></p:presentation>"))
    rels = F.concat(F.lit("<Relationships>"), F.array_join(F.transform(ids, lambda i: F.concat(
        F.lit('<Relationship Id="rId'), (i + 1).cast("string"), F.lit('" Type="slide" Target="slides/slide'), (i + 1).cast("string"), F.lit('.xml"/>'))), ""),
        F.lit("</Relationships>"))
    return _parts(convs, "pptx", "conv_id", "ppt/presentation.xml", {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels}).unionByName(slides)


def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-processing part per order: a table of one row and two cells, the second of which holds a table with a row per line item number up to the order's priority."""
    orders = by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", unique=True)
    text = lambda value: F.concat(F.lit("<w:tc><w:p><w:r><w:t>"), xml_escape(value), F.lit("</w:t></w:r></w:p>"))
    many = F.substring("o_orderpriority", 1, 1).cast("int")
    inner = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda i: F.concat(
        F.lit("<w:tr>"), text(i.cast("string")), F.lit("</w:tc>"), text(F.col("o_orderpriority")), F.lit("</w:tc></w:tr>"))), "")
    xml = F.concat(F.lit("<w:document><w:body><w:tbl><w:tr>"), text(F.col("o_orderstatus")), F.lit("</w:tc>"), text(F.lit("outer")), F.lit("<w:tbl>"), inner,
                   F.lit("</w:tbl><w:p><w:r><w:t>after</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"))
    return orders.select(*_part(F.col("o_orderkey"), "docx", "word/document.xml", 2, xml))


def xlsx_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per order. Every line item is a worksheet part of one row.

    Columns: quantity, price in cents, a formula, and two shared strings (order
    status and priority) taken from the order's own shared-string part.
    """
    orders = by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", unique=True)
    li = by_key(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"), "l_orderkey")
    # The same seven sheets in every order's workbook: fixed text.
    workbook = F.lit("<workbook><sheets>" + "".join(
        f'<sheet name="Line {i}" sheetId="{i}{chr(34) + " state=" + chr(34) + "hidden" if i == 7 else ""}" r:id="rId{i}"/>' for i in range(1, 8)
    ) + """</sheets><definedNames><definedName name="TaxRate">'Line 1'!$A$1</definedName></definedNames></workbook>""")
    rels = F.lit("<Relationships>" + "".join(
        f'<Relationship Id="rId{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, 8)) + "</Relationships>")
    strings = F.concat(
        F.lit("<sst><si><t>"), xml_escape("o_orderstatus"), F.lit("</t></si><si><t>"),
        xml_escape("o_orderpriority"), F.lit("</t></si></sst>"),
    )
    row = (F.col("l_suppkey") % 50 + 1).cast("int").cast("string")
    cell = lambda col, attrs, body: F.concat(
        F.lit(f'<c r="{col}'), row, F.lit(f'"{attrs}>'), *body, F.lit("</c>")
    )
    sheet = F.concat(
        F.lit('<worksheet><sheetData><row r="'), row, F.lit('">'),
        cell("A", "", [F.lit("<v>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</v>")]),
        cell("B", "", [F.lit("<v>"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit("</v>")]),
        cell("C", "", [F.lit("<f>A"), row, F.lit("*B"), row, F.lit("</f><v>0</v>")]),
        cell("D", ' t="s"', [F.lit("<v>0</v>")]),
        cell("E", ' t="s"', [F.lit("<v>1</v>")]),
        cell("F", ' t="inlineStr"', [F.lit("<is><t>"), F.col("l_returnflag"), F.lit("</t></is>")]),
        F.lit("</row></sheetData></worksheet>"),
    )
    name = F.concat(F.lit("xl/worksheets/sheet"), F.col("l_linenumber").cast("string"), F.lit(".xml"))
    sheets = li.select(*_part(F.col("l_orderkey"), "xlsx", name, F.col("l_linenumber") + 5, sheet))
    named = {"xl/workbook.xml": workbook, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": strings}
    return _parts(orders, "xlsx", "o_orderkey", "xl/workbook.xml", named).unionByName(sheets)


def review_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks per order that differ in what reviews look at.

    Rows are repeated 50 times in every eleventh order; orders without returned items have no formula; every fifth one has an
    external link, every third one no defined name, every second customer's a chart, urgent ones a table, and the sheets of line 4 are protected.
    """
    orders = by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    li = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey")
    key = F.col("o_orderkey")
    book = F.concat(F.lit('<workbook><sheets><sheet name="Line 1" sheetId="1" r:id="rId1"/></sheets>'),
                    F.when(key % 3 != 0, '<definedNames><definedName name="TaxRate">1</definedName></definedNames>').otherwise(""), F.lit("</workbook>"))
    extra = lambda when, name: F.when(when, F.lit(name))
    named = _parts(orders, "xlsx", "o_orderkey", "xl/workbook.xml", {"xl/workbook.xml": book})
    others = F.array_compact(F.array(
        extra(key % 5 == 0, "xl/externalLinks/externalLink1.xml"), extra(F.col("o_custkey") % 2 == 0, "xl/charts/chart1.xml"),
        extra(F.col("o_orderpriority").startswith("1"), "xl/tables/table1.xml")))
    objects = orders.select(key.alias("doc_id"), F.lit("xlsx").alias("format"), F.explode(others).alias("part"), F.lit(9).alias("ord"), F.lit("<x/>").alias("xml"))
    row = F.concat(F.lit('<row><c r="A1"><v>'), F.col("l_quantity").cast("int").cast("string"), F.lit("</v></c>"),
                   F.when(F.col("l_returnflag") == "R", '<c r="B1"><f>A1*2</f><v>0</v></c>').otherwise('<c r="B1"><v>0</v></c>'), F.lit("</row>"))
    sheet = F.concat(F.lit("<worksheet>"), F.when(F.col("l_linenumber") == 4, '<sheetProtection sheet="1"/>').otherwise(""), F.lit("<sheetData>"),
                     F.when(F.col("l_orderkey") % 11 == 0, F.repeat(row, 50)).otherwise(row), F.lit("</sheetData></worksheet>"))
    name = F.concat(F.lit("xl/worksheets/sheet"), F.col("l_linenumber").cast("string"), F.lit(".xml"))
    sheets = li.join(orders.select(key.alias("l_orderkey")), "l_orderkey", "left_semi")
    return named.unionByName(objects).unionByName(sheets.select(*_part(F.col("l_orderkey"), "xlsx", name, F.col("l_linenumber") + 9, sheet)))


def review_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-processing packages per conversation: a heading per turn; level and text change every second turn.

    Every seventh has no paragraph and every fifth a table; even ones have a header part, and the number of styles is the id by 3.
    """
    turns = by_key(table(spark, sf_dir, "conversations"), "conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))  # one row a conversation
    head = lambda i: F.concat(
        F.lit('<w:p><w:pPr><w:pStyle w:val="Heading'), (F.floor(i / 2) % 2 * 2 + 1).cast("string"), F.lit('"/></w:pPr><w:r><w:t>part '),
        F.floor(i / 2).cast("string"), F.lit("</w:t></w:r></w:p>"))
    key = F.col("conv_id")
    body = F.concat(
        F.lit("<w:document><w:body>"), F.when(key % 7 != 3, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), head), "")).otherwise(""),
        F.when(key % 5 == 1, "<w:tbl><w:tr><w:tc><w:r><w:t>x</w:t></w:r></w:tc></w:tr></w:tbl>").otherwise(""), F.lit("<w:sectPr/></w:body></w:document>"))
    styles = F.concat(F.lit("<w:styles>"), F.repeat(F.lit('<w:style w:type="paragraph" w:styleId="S"></w:style>'), (key % 3).cast("int")), F.lit("</w:styles>"))
    named = _parts(convs, "docx", "conv_id", "word/document.xml", {"word/document.xml": body, "word/styles.xml": styles})
    header = convs.filter(key % 2 == 0).select(*_part(key, "docx", "word/header1.xml", 9, F.lit("<w:hdr/>")))
    return named.unionByName(header)


def pdf_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small PDF per benchmark passage and per conversation turn, one text operator per line."""
    text = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text"
    )
    literal = lambda line: F.concat(
        F.lit("("), F.replace(F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")),
                              F.lit(")"), F.lit("\\)")), F.lit(") Tj\n")
    )
    body = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\nBT\n"),
        F.array_join(F.transform(F.split("text", "\n"), literal), ""),
        F.lit("ET\nendstream\nendobj\nxref\n0 1\ntrailer\n<<>>\nstartxref\n0\n%%EOF\n"),
    )
    return text.select("doc_id", F.lit("pdf").alias("format"), F.encode(body, "UTF-8").alias("content"))
