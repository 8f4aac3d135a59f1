"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (tag and class) below the root. For every
node the tree counts its distinct pages, the styles in which its children come (their sequence of tags), and the texts
of its blocks. Entropy measures these counts: a node shown in one style on m pages measures 0 in presentation, one
that differs from page to page 1; a text on c of m pages measures 1 - log(c) / log(m) in content. GAMMA of a text's
content and the rest of its node's presentation are its measure; a node's measure is the mean over its words.

Importance decides on every branch, in log-odds: a prior by the names of elements and classes (PRIOR), plus STEEP times
the measure less a pivot, the more the more pages have the node (not at all below FEW). A node's pivot is the host's own
mean measure if its names say nothing, so that texts that rotate over some pages stand out from a host's unique ones; else, and for
single texts, it is a half. The prior of a furniture region (what lies under one furniture element and under no further one) is
that of unnamed nodes where the region, on FEW pages, has at least as many important words (measure times words, over
all pages) as all that is outside furniture on its host: then it holds the main text.

The model is what the tree removes: nodes (host, path) with an importance below a half, and single texts
(host, path, text) of nodes that stay. The second pass over the pages looks blocks up there, and knows no other rule. Up to MAX_MODEL
entries the model is broadcast; beyond, it is joined with the pages' block hashes, salted by page as a block may stand on
every page of a host, and only the numbers of the blocks to remove return to the pages. Both ways give the same texts.
Counting shuffles hashes, never texts, and writes its counts, so that pages are parsed once for them and once for their
texts (twice, beyond MAX_MODEL).

Pages are read by one scanner, in time linear in their length, however deep or broken their markup. Defined cases: null
or empty html gives an empty text; a null url is a host of its own (empty); malformed markup is read much as browsers
do: unclosed elements end with their parents, a block ends an open paragraph, a ``<`` that opens no tag is text, a quote
that is never closed is none, and once a tag's quotes leave it without an end, quotes are no longer minded in the page; comments, scripts, styles and
the like are no content, unclosed ones to the end; nor is the head, which ends at the first thing that can't stand in it, or a drawing, which ends at the
first HTML block or its own ``/>``; very long pages are read whole; repeated pages are each extracted, but counted once for their host; empty
tables give no rows; only page_id, url and html are read, so other columns' names do no harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import release, small_batches, stored

GAMMA = 0.9
#: Log-odds by name: inside furniture, without a name that tells, inside an article or main element.
PRIOR = {-1: -4.0, 0: 1.0, 1: 2.3}
STEEP = 5.0
#: Pages with a node from which its measure is heard at all, and those that give it a trust of 1; trust grows with their logarithm to the most.
FEW, SURE, MOST_TRUST = 4, 30, 1.5
MAX_MODEL = 200_000
SALTS = 16

#: Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("button datalist head iframe noscript object option script select style svg template textarea title".split())
RAW = frozenset("script style noscript template textarea title select iframe".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
MIDDLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
#: Elements that an element of the same kind ends.
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Parts of class and id names of page furniture; and such as mean it, inside articles and on headings, only as a whole name.
FURNITURE_PART = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|popup|modal|overlay|share|sharing|social|comments?|replies|disqus|respond|newsletter|subscribe|signup|login|pagination|toolbar)(?:$|[\s_-])", re.I)
VAGUE = "banner|promo\\w*|header|notices?|related|recommended|search|widget"
VAGUE_PART, VAGUE_NAME = re.compile(rf"(?:^|[\s_-])(?:{VAGUE})(?:$|[\s_-])", re.I), re.compile(rf"(?:^|\s)(?:{VAGUE})(?:$|\s)", re.I)
#: Elements that end a drawing, and those that don't end the head.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section nav footer header aside".split())
IN_HEAD = frozenset("base basefont bgsound html link meta".split())
_BARRIER, _TABLES = ("table", "td", "th", "button", "object"), ("ul", "ol", "dl", "table")

_OPEN = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def tags_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag in lower case or empty, whole tag) in page order; what holds no content stands as a blank."""
    at, n, minded = 0, len(page), True
    drawings = 0  # open ones
    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        before, at, mark = "" if drawings else page[at:i], i, page[i + 1 : i + 2]
        if mark in ("!", "?"):
            j = page.find("-->", i + 4) + 3 if page.startswith("<!--", i) else page.find(">", i) + 1
            at = j if j > i + 1 else n
            yield before, "", ""
            continue
        name = _OPEN.match(page, i)
        if name is None:
            yield before + ("" if drawings else "<"), "", ""
            at = i + 1
            continue
        rest = _REST.match(page, name.end()) if minded else None
        minded = rest is not None
        end = rest.end() if rest else page.find(">", name.end()) + 1
        if not end:
            at = i if not drawings else n
            yield before, "", ""
            break
        at, tag, token = end, name[1].lower(), page[i:end]
        if tag in RAW and mark != "/" and not (drawings and token.endswith("/>")):
            close = _RAW_END[tag].search(page, end)
            at = close.end() if close else n
            yield before + " ", "", ""
        elif tag == "svg":
            drawings = max(0, drawings - 1) if mark == "/" else drawings + (not token.endswith("/>"))
            yield before + " ", "", ""
        elif drawings and tag not in BREAKOUT:
            yield "", "", ""
        else:
            drawings = 0
            yield before, tag, token
    if at < n and not drawings:
        yield page[at:], "", ""


def kind_of(kind: int, tag: str, names: str) -> int:
    """What an element's own names say, inside one of ``kind``: -1 furniture, 1 an article, 0 nothing."""
    if tag in MIDDLE:
        return 1 if kind >= 0 else -1
    if tag in ("html", "body"):
        return kind
    if tag in FURNITURE or tag in HIDDEN or (tag == "header" and kind < 1):
        return -1
    if names and (FURNITURE_PART.search(names) or (VAGUE_NAME if kind == 1 or tag in HEADINGS else VAGUE_PART).search(names)) and not (kind == 1 and tag in HEADINGS):
        return -1
    return kind


def blocks_of(page: str | None) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """Blocks (path, kind, region, text) in page order, and each node's style (path, tags of its children).

    Paths are hashes, made step by step; kind: -1 inside furniture, 1 inside an article or main element, 0 elsewhere;
    region: the path of the innermost furniture element around the block, or 0.
    """
    root: tuple[str, int, int, int, list[str]] = ("", 0, 0, 0, [])
    stack, nodes = [root], [root]
    where: dict[str, list[int]] = {}  # open elements by tag, as places in the stack
    blocks: list[tuple[int, int, int, str]] = []
    text: list[str] = []

    def end_block() -> None:
        if text:
            if words := html.unescape("".join(text)).split():
                blocks.append((*stack[-1][1:4], " ".join(words)))
            text.clear()

    def close(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        top = max((where[t][-1] for t in tags if where.get(t)), default=0)
        if top > max((where[t][-1] for t in within if where.get(t)), default=0):
            end_block()
            for gone in stack[top:]:
                where[gone[0]].pop()
            del stack[top:]

    head = False
    for before, tag, token in tags_of(page or ""):
        if before:
            text.append(before)
            head = head and not before.strip()
        if not tag:
            continue
        if tag == "head":
            head = token[1] != "/"
            continue
        if head and tag in IN_HEAD:
            continue
        head = False
        if tag in INLINE:
            continue
        if tag == "br":
            text.append("\n")
            continue
        if token[1] == "/":
            close((tag,))
            continue
        if tag in CLOSES_P:
            close(("p",), _BARRIER)
        if tag in SAME_ENDS:
            close(SAME_ENDS[tag], _TABLES)
        end_block()
        parent = stack[-1]
        parent[4].append(tag)
        if tag in VOID or token.endswith("/>"):
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(token)).lower() if " " in token or "\n" in token or "\t" in token else ""
        path, kind = _hash(f"{parent[1]}/{tag}.{names}"), kind_of(parent[2], tag, names)
        furniture = kind < 0 and (parent[2] >= 0 or kind_of(0, tag, names) < 0)
        node = (tag, path, kind, path if furniture else parent[3], [])
        nodes.append(node)
        where.setdefault(tag, []).append(len(stack))
        stack.append(node)
    end_block()
    return blocks, [(n[1], " ".join(n[4])) for n in nodes if n[4]]


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, what, value, kind, region, words, n_pages, firsts): on how many of a host's pages a node has a text (what 0) or a style (what 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entries: list[tuple] = []
                blocks, styles = blocks_of(page)
                seen: set = set()
                for what, items in ((0, blocks), (1, [(p, 0, 0, s) for p, s in styles])):
                    for path, kind, region, value in items:
                        key = (what, path, _hash(value))
                        if key not in seen:
                            first = (what, path) not in seen
                            seen |= {key, (what, path)}
                            entries.append((path, what, key[2], kind, region, value.count(" ") + 1, int(first)))
                for column, x in zip(columns, (host_of(url), _hash(page or ""), entries), strict=True):
                    column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(entry)), strict=True)], names=["host", "page", "entries"])

    entry = pa.struct([("path", pa.int64()), ("what", pa.int32()), ("value", pa.int64()), ("kind", pa.int32()), ("region", pa.int64()), ("words", pa.int64()), ("first", pa.int64())])
    read = pages.select("url", "html").mapInArrow(run, "host string, page long, entries array<struct<path: long, what: int, value: long, kind: int, region: long, words: long, first: long>>")
    # Equal pages of a host have equal entries: one of them counts.
    seen = read.groupBy("host", "page").agg(F.first("entries").alias("entries")).select("host", F.inline("entries"))
    return seen.groupBy("host", "path", "what", "value", "kind").agg(F.max("region").alias("region"), F.max("words").alias("words"), F.count("*").alias("n_pages"), F.sum("first").alias("firsts"))


def _salted(rows: DataFrame) -> DataFrame:
    """Texts and counts dealt out by their value: a host, or a node, may hold a third of all."""
    return rows.withColumn("salt", F.pmod("value", F.lit(SALTS)).cast("int"))


def _copies(rows: DataFrame) -> DataFrame:
    """What is known of hosts or nodes, once for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def measured(counts: DataFrame) -> DataFrame:
    """(host, path, value, kind, region, m, measure, mass) of every text of every node; mass: its words on all pages."""
    nodes = counts.groupBy("host", "path", "what").agg(F.sum("firsts").alias("m"), F.sum(F.col("n_pages") * F.log("n_pages")).alias("nlogn"))
    m, many = F.col("m").cast("double"), F.col("m") > 1
    texts = nodes.where("what = 0").select("host", "path", "m")
    # -sum(p * log_m(p)) with p = n / m, as all of a page's children make one style.
    styles = nodes.where("what = 1").select("host", "path", F.when(many, (F.log(m) - F.col("nlogn") / m) / F.log(m)).otherwise(1.0).alias("shape"))
    about = texts.join(styles.hint("merge"), ["host", "path"], "left")
    met = _salted(counts.where("what = 0")).join(_copies(about), ["host", "path", "salt"])
    content = F.when(many, 1 - F.log("n_pages") / F.log(m)).otherwise(1.0)
    return met.select("host", "path", "value", "kind", "region", "m", (GAMMA * content + (1 - GAMMA) * F.coalesce("shape", content)).alias("measure"), (F.col("words") * F.col("n_pages")).alias("mass"))


def importance(texts: DataFrame) -> DataFrame:
    """Adds of_node and of_text, the importance of the node and of the single text, as log-odds."""
    weight = F.sum(F.col("measure") * F.col("mass"))
    inside = texts.where("kind < 0").groupBy("host", "region").agg(F.max("m").alias("pages"), weight.alias("held")).where(F.col("pages") >= FEW)
    rest = texts.where("kind >= 0").groupBy("host").agg(weight.alias("rest"), (weight / F.sum("mass")).alias("level"))
    main = inside.join(rest.hint("merge"), "host", "left").where(F.col("held") >= F.coalesce("rest", F.lit(0.0))).select("host", "region", F.lit(True).alias("main"))
    nodes = texts.groupBy("host", "path").agg((weight / F.sum("mass")).alias("mean"))
    known = _salted(texts).join(_copies(nodes), ["host", "path", "salt"]).join(_copies(main), ["host", "region", "salt"], "left").join(_copies(rest.select("host", "level")), ["host", "salt"], "left")
    prior = F.when((F.col("kind") < 0) & F.col("main").isNull(), PRIOR[-1]).when(F.col("kind") > 0, PRIOR[1]).otherwise(PRIOR[0])
    trust = STEEP * F.when(F.col("m") < FEW, 0.0).otherwise(F.least(F.lit(MOST_TRUST), F.log("m") / F.log(F.lit(float(SURE)))))
    pivot = F.when(F.col("kind") == 0, F.greatest(F.lit(0.5), F.coalesce("level", F.lit(0.5)))).otherwise(0.5)
    return known.select(*texts.columns, (prior + trust * (F.col("mean") - pivot)).alias("of_node"), (prior + trust * (F.col("measure") - 0.5)).alias("of_text"))


def removed(judged: DataFrame) -> DataFrame:
    """(host, path, value): the model; a null value stands for all texts of the node."""
    nodes = judged.where("of_node < 0").select("host", "path", F.lit(None).cast("long").alias("value")).distinct()
    return nodes.union(judged.where("of_node >= 0 and of_text < 0").select("host", "path", "value"))


def _text(blocks: list[tuple[int, int, int, str]], gone) -> str:
    return " ".join(t for k, (path, _, _, t) in enumerate(blocks) if not gone(k, path, t))


def tree(pages: DataFrame) -> DataFrame:
    """The model of the pages' hosts, written."""
    small_batches(pages.sparkSession)
    counts = stored(style_counts(pages), "html-counts")  # the branches of measured() read them
    texts = stored(measured(counts), "html-measured")
    model = stored(removed(importance(texts)), "html-model")
    release(counts, texts)
    return model


def extract(pages: DataFrame, max_model: int = MAX_MODEL, model: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page, by ``model`` or that of the pages themselves."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select("page_id", "url", "html")
    model = tree(rows) if model is None else model
    schema = rows.select("page_id", "url").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def out(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if model.count() <= max_model:
        sent = spark.sparkContext.broadcast({tuple(r) for r in model.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                texts = []
                for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    host = host_of(url)
                    texts.append(_text(blocks_of(page)[0], lambda k, path, t, host=host: (host, path, None) in known or (host, path, _hash(t)) in known))
                yield out(batch, texts)

        return rows.mapInArrow(run, schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, url, content in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html")), strict=True):
                found += [(page, host_of(url), path, _hash(t), k) for k, (path, _, _, t) in enumerate(blocks_of(content)[0])]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * 5, types, strict=True)], names=["page", "host", "path", "value", "k"])

    keyed = rows.withColumn("page", F.xxhash64("page_id", "url", "html"))  # equal pages lose equal blocks
    salted = _copies(model)
    placed = keyed.select("page", "url", "html").mapInArrow(number, "page long, host string, path long, value long, k int").withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    by_node = salted.where("value is null").drop("value")
    entries = [placed.join(by_node, ["host", "path", "salt"]), placed.join(salted.where("value is not null"), ["host", "path", "value", "salt"])]
    gone = entries[0].select("page", "k").union(entries[1].select("page", "k")).groupBy("page").agg(F.collect_set("k").alias("gone"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, lost in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                known = frozenset(lost or ())
                texts.append(_text(blocks_of(page)[0], lambda k, path, t, known=known: k in known))
            yield out(batch, texts)

    return keyed.join(gone, "page", "left").select("page_id", "url", "html", "gone").mapInArrow(drop, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLE_SQL: dict[str, str] = {}
