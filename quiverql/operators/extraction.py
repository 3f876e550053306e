"""Documents to a graph of sections, passages and keyword concepts, for a whole corpus at once.

Everything that a document's statistics depend on is counted by document, so a corpus gives each document the
graph it would have alone; concepts are shared, since their id depends on the term only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from .analytics import kept, tidy

#: Words that are no concepts.
STOP_WORDS = """
a about above after again against all also am an and any are aren't as at be because been before being below
between both but by can cannot could did do does doing don't down during each few for from further get gets
got had has have having he her here hers herself him himself his how however i if in into is isn't it its
itself just may me might more most much must my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up us use used using uses very via was we were what when
where which while who whom why will with within without would you your yours yourself yourselves also one two
three example examples include includes including following new many well across document section table figure
page need needs provide provides based make makes made different every first second third often together
information can’t don’t doesn’t isn’t it’s that's that’s
""".split()
#: A word, in Java's and RE2's classes; a label's length; blocks of a document.
WORD = r"[\p{L}\p{Nl}\p{No}][\p{L}\p{N}_]*(?:[-'][\p{L}\p{Nl}\p{No}][\p{L}\p{N}_]*)*"
LABEL, MOST_BLOCKS = 75, 10_000
#: Hashes that repeated texts are told apart by before texts move: what is sent to all tasks has that many at most.
HASHES = 1 << 21
NODE_FIELDS = {"filename": "string", "sha256": "string", "text": "string", "kind": "string", "position": "bigint", "document_id": "string", "level": "bigint", "table": "bigint", "row": "bigint", "normalized": "string", "occurrences": "bigint", "passage_count": "bigint", "extraction": "string"}
EDGE_FIELDS = {"occurrences": "bigint", "weight": "bigint", "evidence": "array<string>"}
#: The types of nodes that edges of a type lead from and to.
BETWEEN = {"CONTAINS": (("Document", "Section"), ("Section", "Passage")), "MENTIONS": (("Section", "Passage"), ("Concept",)), "CO_OCCURS_WITH": (("Concept",), ("Concept",))}


def stable_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(value, 256), 1, 20))


def block_id(digest: Column, position: Column, section: Column) -> Column:
    key = F.concat_ws(":", digest, position.cast("string"))
    return F.when(section, stable_id("section", key)).otherwise(stable_id("passage", key))


def texts_of(documents: DataFrame) -> DataFrame:
    """digest, filename (the least doc_id) and text of a documents table, one row for rows with equal texts.

    Only texts that may be there more than once are moved: rows whose text has a hash of those. The others stay where they were read.
    """
    rows = documents.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    hashed = F.pmod(F.col("hash"), F.lit(HASHES)).alias("part")
    repeated = F.broadcast(rows.groupBy("hash").count().where("count > 1").select(hashed).distinct())
    rows = rows.select("doc_id", F.sha2("text", 256).alias("digest"), "text", hashed)
    once = rows.join(repeated, "part", "left_anti").select("digest", F.col("doc_id").cast("string").alias("filename"), "text")
    several = rows.join(repeated, "part", "left_semi").groupBy("digest").agg(F.min("doc_id").cast("string").alias("filename"), F.first("text").alias("text"))
    return once.unionByName(several)


def gathered_of(documents: DataFrame) -> DataFrame:
    """A row for each document of a documents table: digest, filename and its blocks, the lines of its text that aren't blank, as paragraphs. Rows with equal texts are one document."""
    none = F.lit(None).cast("bigint")
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, k: F.struct((k + 1).cast("bigint").alias("position"), F.trim(x).alias("text"), F.lit("paragraph").alias("kind"), none.alias("level"), none.alias("table"), none.alias("row")))
    return texts_of(documents).where(F.trim(F.translate("text", "\n", "")) != "").select("digest", "filename", lines.alias("blocks"))


def passages_of(documents: DataFrame) -> DataFrame:
    """The blocks of gathered_of, a row each."""
    return blocks_of(gathered_of(documents))


def blocks_of(documents: DataFrame) -> DataFrame:
    return documents.select("filename", "digest", F.explode("blocks").alias("b")).select("filename", "digest", "b.*")


def gathered(blocks: DataFrame) -> DataFrame:
    """Blocks that are rows as gathered_of has them."""
    own = F.collect_list(F.struct("position", "text", "kind", "level", "table", "row")).alias("blocks")
    return blocks.groupBy("digest").agg(F.min("filename").alias("filename"), own)


def placed(blocks: DataFrame) -> DataFrame:
    """blocks with document_id, node_id, type and parent: the heading above, for a heading the last of a lower level, else the document."""
    of = Window.partitionBy("digest").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("document_id", stable_id("document", F.col("digest")))
    out = out.withColumn("type", F.when(F.col("level") > 0, "Section").otherwise("Passage"))
    out = out.withColumn("node_id", block_id(F.col("digest"), F.col("position"), F.col("level") > 0))
    above = F.when(F.col("level") <= F.lit(1), F.lit(None).cast("string"))
    for level in range(2, 10):
        above = above.when(F.col("level") == level, F.last(F.when(F.col("level") < level, F.col("node_id")), ignorenulls=True).over(of))
    above = above.otherwise(F.last(F.when(F.col("level") > 0, F.col("node_id")), ignorenulls=True).over(of))
    return out.withColumn("parent", F.coalesce(above, "document_id"))


@cache
def folding() -> tuple[dict[str, str], dict[str, str]]:
    """Full case folding as Python's Unicode data has it: letters that fold to one letter, and those that fold to several."""
    both = {c: f for c in map(chr, range(0x110000)) if (f := c.casefold()) != c}
    return {c: f for c, f in both.items() if len(f) == 1}, {c: f for c, f in both.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """Case folded, each letter by itself: one translation, and where there are letters that fold to several, a replacement for each of them. ASCII, whose code points are as many as its bytes, is folded as lower case."""
    one, several = folding()
    out = F.translate(text, "".join(one), "".join(one.values()))
    many = out
    for letter, letters in several.items():
        many = F.replace(many, F.lit(letter), F.lit(letters))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).when(out.rlike("[" + "".join(several) + "]"), many).otherwise(out)


def normalized(word: Column) -> Column:
    """Case folded; hyphens and quotes at the ends go."""
    return F.btrim(folded(word), F.lit("-'"))


# what is counted of a document stands in arrays of its one row, so that no word is a row of its own


def ends(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The last item of each run in a sorted array, as item and upto, its place from 1."""
    placed_ = F.transform(items, lambda x, k: F.struct(x.alias("item"), (k + 1).alias("upto")))
    marked = F.zip_with(placed_, following(items), lambda x, after: F.when(after.isNull() | ~same(x["item"], after), x))
    return F.filter(marked, lambda x: x.isNotNull())


def following(items: Column, by: int = 1) -> Column:
    """The items but the first ones."""
    return F.slice(items, F.lit(1 + by), F.size(items))


def preceding(items: Column, by: int = 1) -> Column:
    """For each item the one so many places before, else null."""
    return F.slice(F.concat(F.array_repeat(F.lit(None), by), items), F.lit(1), F.size(items))


def item_rows(frame: DataFrame, items: Column, *keys: str) -> DataFrame:
    """keys and x, a row for each item. The optimizer would push the condition that there are items down to where the words are, and compute all steps again for each use."""
    return frame.select(*keys, F.explode_outer(items).alias("x")).where("x is not null")


def term_counts(blocks: DataFrame) -> DataFrame:
    """A row for each document: digest, n (its passages, sections too), counted (term, position, section, tf, and shown, its first spelling there) and terms (term, total, df, first (its place in counted), label and score), both by term.

    A term is shown as first spelled in the last passage that has it, if there is a capital after the first letter.
    """
    return counted_in(blocks.groupBy("digest").agg(F.collect_list(F.struct("position", "text", "level")).alias("blocks")))


def counted_in(documents: DataFrame, *keep: str) -> DataFrame:
    """term_counts of documents with their blocks in a list, and the columns to keep."""
    # of equal terms of a passage the first one comes last
    words = F.transform("blocks", lambda p: F.transform(F.regexp_extract_all(F.coalesce(p["text"], F.lit("")), F.lit(WORD), F.lit(0)), lambda w, k: F.struct(normalized(w).alias("term"), p["position"].alias("position"), (-k).alias("back"), F.coalesce(p["level"] > 0, F.lit(False)).alias("section"), w.alias("word"))))
    known = F.sort_array(F.filter(F.flatten(words), lambda w: (F.length(w["term"]) >= 3) & ~w["term"].isin(*STOP_WORDS)))
    out = documents.select("digest", *keep, F.size("blocks").cast("bigint").alias("n"), known.alias("words"))
    out = out.select("digest", *keep, "n", ends(F.col("words"), lambda x, y: (x["term"] == y["term"]) & (x["position"] == y["position"])).alias("e"))
    out = out.select("digest", *keep, "n", F.zip_with("e", preceding(F.col("e")), lambda x, before: F.struct(x["item"]["term"].alias("term"), x["item"]["position"].alias("position"), x["item"]["section"].alias("section"), (x["upto"] - F.coalesce(before["upto"], F.lit(0))).cast("bigint").alias("tf"), x["upto"].alias("upto"), x["item"]["word"].alias("shown"))).alias("counted"))
    out = out.select("digest", *keep, "n", "counted", ends(F.col("counted"), lambda x, y: x["term"] == y["term"]).alias("e"))

    def term(x: Column, before: Column) -> Column:
        of, later = x["item"], F.substring(x["item"]["shown"], 2, 1 << 30)
        label = F.when(later != F.lower(later), of["shown"]).otherwise(of["term"])
        first = F.coalesce(before["upto"], F.lit(0))
        return F.struct(of["term"].alias("term"), (of["upto"] - F.coalesce(before["item"]["upto"], F.lit(0))).cast("bigint").alias("total"), (x["upto"] - first).cast("bigint").alias("df"), (first + 1).alias("first"), label.alias("label"))

    out = out.select("digest", *keep, "n", "counted", F.zip_with("e", preceding(F.col("e")), term).alias("terms"))
    return out.withColumn("terms", F.transform("terms", lambda t: F.struct(t["term"], t["total"], t["df"], t["first"], t["label"], weight(t["total"], F.col("n"), t["df"]).alias("score"))))


def scored(counts: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """digest, term, total, df, n (passages of the document), label and score of each document's terms. counts has all of it, and blocks aren't read."""
    return item_rows(counts, F.col("terms"), "digest", "n").select("digest", "x.term", "x.total", "x.df", "x.label", "n", "x.score")


def weight(frequency: Column, n: Column, df: Column) -> Column:
    return (1 + F.log(frequency.cast("double"))) * (1 + F.log((1 + n) / (1 + df)))


def found_in(counts: DataFrame, concepts: int = 80, per_passage: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: digest, the columns to keep and found, the terms that its passages mention: of the document's best ones each passage's own best, by score and term."""
    if concepts < 1 or per_passage < 1:
        raise ValueError("The numbers of concepts are 1 or more.")
    ranked = F.sort_array(F.transform("terms", lambda t: F.struct((-t["score"]).alias("less"), t["term"], t["total"], t["df"], t["first"], t["label"])))
    own = lambda t, c: F.struct(c["position"], (-weight(c["tf"], F.col("n"), t["df"])).alias("less"), t["term"], c["section"], c["tf"], t["total"], t["label"])
    places = F.flatten(F.transform(F.slice(ranked, 1, concepts), lambda t: F.transform(F.slice("counted", t["first"], t["df"].cast("int")), lambda c: own(t, c))))
    # the terms of a passage stand together, the best first
    out = counts.select("digest", *keep, F.sort_array(places).alias("p"))
    best = F.zip_with("p", preceding(F.col("p"), per_passage), lambda x, before: F.when(before.isNull() | (before["position"] != x["position"]), x))
    return out.select("digest", *keep, F.filter(best, lambda x: x.isNotNull()).alias("found"))


def found_rows(documents: DataFrame) -> DataFrame:
    """What found_in has as rows: digest, position, node_id, term, tf and score."""
    node = block_id(F.col("digest"), F.col("x.position"), F.col("x.section"))
    return item_rows(documents, F.col("found"), "digest").select("digest", "x.position", node.alias("node_id"), "x.term", "x.tf", (-F.col("x.less")).alias("score"))


def mentions(counts: DataFrame, terms: DataFrame | None = None, concepts: int = 80, per_passage: int = 6) -> DataFrame:
    """found_in as rows; counts has the terms too, and terms aren't read."""
    return found_rows(found_in(counts, concepts, per_passage))


def pairs_in(found: Column, per_passage: int) -> Column:
    """one, two (terms in order), position and section of each passage with both: items of found that stand near one another, in one passage."""
    pairs = [F.zip_with(found, following(found, by), lambda x, y: F.when(x["position"] == y["position"], F.struct(F.least(x["term"], y["term"]).alias("one"), F.greatest(x["term"], y["term"]).alias("two"), x["position"].alias("position"), x["section"].alias("section")))) for by in range(1, per_passage)]
    return F.filter(F.concat(*pairs), lambda x: x.isNotNull()) if pairs else F.filter(F.transform(found, lambda x: F.struct(x["term"].alias("one"), x["term"].alias("two"), x["position"], x["section"])), lambda x: F.lit(False))


def pairs_of(documents: DataFrame, per_passage: int = 6) -> DataFrame:
    """digest, one, two, position and section of each passage with both terms, of the rows of found_in."""
    return item_rows(documents, pairs_in(F.col("found"), per_passage), "digest").select("digest", "x.*")


def co_occurrences(documents: DataFrame, per_passage: int = 6) -> DataFrame:
    """digest, one, two and weight (passages with both), of the rows of found_in."""
    sorted_ = documents.select("digest", F.sort_array(F.transform(pairs_in(F.col("found"), per_passage), lambda p: F.struct(p["one"], p["two"]))).alias("p"))
    out = sorted_.select("digest", ends(F.col("p"), lambda x, y: x == y).alias("e"))
    weighed = F.zip_with("e", preceding(F.col("e")), lambda x, before: F.struct(x["item"], (x["upto"] - F.coalesce(before["upto"], F.lit(0))).cast("bigint").alias("weight")))
    return item_rows(out, weighed, "digest").select("digest", "x.item.one", "x.item.two", "x.weight")


def evidence_of(found: DataFrame) -> DataFrame:
    """The passages behind each link as a table of its own, a row each: edge_id, digest, position and node_id. A link of any number of passages stays spread over tasks. found: rows of mentions or of found_in."""
    if "found" in found.columns:
        pairs = pairs_of(found).withColumn("node_id", block_id(F.col("digest"), F.col("position"), F.col("section")))
    else:
        lists = found.groupBy("digest", "position", "node_id").agg(F.array_sort(F.collect_list("term")).alias("t"))
        both = F.flatten(F.transform("t", lambda a, k: F.transform(F.slice("t", k + 2, F.size("t")), lambda b: F.struct(a.alias("one"), b.alias("two")))))
        pairs = lists.select("digest", "position", "node_id", F.explode(both).alias("p")).select("digest", "position", "node_id", "p.*")
    return pairs.select(link_id(concept_id("one"), concept_id("two")).alias("edge_id"), "digest", "position", "node_id")


def concept_id(term: str) -> Column:
    return stable_id("concept", F.col(term))


def link_id(one: Column, two: Column, kind: str = "CO_OCCURS_WITH") -> Column:
    return stable_id("edge", F.concat_ws(":", one, F.lit(kind), two))


def mentioned(blocks: DataFrame, concepts: int = 80, per_passage: int = 6) -> tuple[DataFrame, DataFrame]:
    """scored terms and mentions of placed blocks."""
    counts = term_counts(blocks)
    return scored(counts), mentions(counts, None, concepts, per_passage)


def short_label(text: Column) -> Column:
    return F.when(F.length(text) <= LABEL, text).otherwise(F.concat(F.substring(text, 1, LABEL - 3), F.lit("…")))


def extracted(documents: DataFrame, concepts: int = 80, per_passage: int = 6, most_blocks: int | None = MOST_BLOCKS, texts: bool = True) -> DataFrame:
    """The rows of gathered_of with what their passages mention: written once, read for each type of nodes and edges. A document with more than most_blocks blocks is an error (None: none is). Without texts those of the blocks are left out."""
    if most_blocks is not None and not documents.where(F.size("blocks") > most_blocks).isEmpty():
        raise ValueError(f"A document may have {most_blocks:,} blocks.")
    keep = ("filename", "blocks")
    found = found_in(counted_in(documents, *keep), concepts, per_passage, keep)
    if not texts:
        found = found.withColumn("blocks", F.transform("blocks", lambda b: b.dropFields("text")))
    # the graph has no scores of mentions
    out = kept(found.withColumn("found", F.transform("found", lambda x: x.withField("less", F.lit(None).cast("double")))))
    tidy(out.sparkSession)
    return out


def build_graph(blocks: DataFrame, concepts: int = 80, per_passage: int = 6, most_blocks: int | None = MOST_BLOCKS, lists: bool = True, texts: bool = True) -> PropertyGraph:
    """The graph of all documents in blocks (rows, or those of gathered_of). A document with more than most_blocks blocks is an error (None: none is).

    lists: links have their evidence as a property, one list each, which is for some documents; for a corpus leave
    it out and take evidence_of. texts: the blocks' texts are written with the graph; else they are read from
    blocks again, by a join, if a text or a passage's label is asked for, and nothing of them is written or moved if none is.
    """
    documents = blocks if "blocks" in blocks.columns else gathered(blocks)
    return graph_of(extracted(documents, concepts, per_passage, most_blocks, texts), concepts, per_passage, lists, None if texts else documents)


def with_texts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """blocks with the texts of documents. Each block's text is one by its grouping, so the optimizer leaves the join out where no text is asked for."""
    own = blocks_of(documents).groupBy("digest", "position").agg(F.first("text").alias("text"))
    return blocks.join(own, ["digest", "position"], "left")


def graph_of(documents: DataFrame, concepts: int = 80, per_passage: int = 6, lists: bool = True, texts: DataFrame | None = None) -> PropertyGraph:
    """The graph of the rows of extracted; texts: the documents with their texts, if those rows have none."""
    blocks = placed(blocks_of(documents))
    if texts is not None:
        blocks = with_texts(blocks, texts)
    found = found_rows(documents)

    def rows(frame: DataFrame, fields: dict[str, str], own: dict[str, Column], order: Column, **columns: Column) -> DataFrame:
        properties = F.struct(*((own[k] if k in own else F.lit(None)).cast(t).alias(k) for k, t in fields.items()))
        apart = F.pmod(F.xxhash64(columns["id"]), F.lit(1 << 40))
        return frame.select(*(c.alias(k) for k, c in columns.items()), properties.alias("properties"), (F.shiftleft(order, 41) + apart).alias("ord"))

    edge_id = lambda s, kind, t: link_id(F.col(s) if isinstance(s, str) else s, F.col(t) if isinstance(t, str) else t, kind)
    # documents come first, then blocks in place, then concepts and links; equal places are told apart by hash
    first, last = F.lit(0).cast("bigint"), F.lit(1 << 21).cast("bigint")
    docs = documents.select("digest", stable_id("document", F.col("digest")).alias("document_id"), "filename")
    # a term of several documents is one concept, its counts are summed
    by_term = documents.select("digest", F.sort_array(F.transform("found", lambda f: F.struct(f["term"], f["total"], f["label"]))).alias("t"))
    once = by_term.select("digest", ends(F.col("t"), lambda x, y: x["term"] == y["term"]).alias("e"))
    once = item_rows(once, F.zip_with("e", preceding(F.col("e")), lambda x, before: F.struct(x["item"], (x["upto"] - F.coalesce(before["upto"], F.lit(0))).alias("passages"))), "digest")
    concept = once.groupBy(F.col("x.item.term").alias("term")).agg(F.sum("x.item.total").alias("total"), F.max_by("x.item.label", "digest").alias("label"), F.sum("x.passages").alias("passages"))
    nodes = [
        rows(docs, NODE_FIELDS, {"filename": F.col("filename"), "sha256": F.col("digest")}, first, id=F.col("document_id"), label=F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""), type=F.lit("Document")),
        rows(blocks, NODE_FIELDS, {k: F.col(k) for k in ("text", "kind", "position", "document_id", "level", "table", "row")}, F.col("position"), id=F.col("node_id"), label=short_label(F.col("text")), type=F.col("type")),
        rows(concept, NODE_FIELDS, {"normalized": F.col("term"), "occurrences": F.col("total"), "passage_count": F.col("passages"), "extraction": F.lit("keyword")}, last, id=stable_id("concept", F.col("term")), label=F.col("label"), type=F.lit("Concept")),
    ]
    pairs = pairs_of(documents, per_passage)
    if lists:
        node = block_id(F.col("digest"), F.col("position"), F.col("section"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("digest", "position", node.alias("node_id")))), lambda x: x["node_id"])
        links = pairs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("weight"), listed.alias("evidence"))
    else:
        links = pairs.groupBy("one", "two").agg(F.count(F.lit(1)).alias("weight")).withColumn("evidence", F.lit(None))
    one, two = concept_id("one"), concept_id("two")
    edges = [
        rows(blocks, EDGE_FIELDS, {}, F.col("position"), id=edge_id("parent", "CONTAINS", "node_id"), source=F.col("parent"), target=F.col("node_id"), type=F.lit("CONTAINS")),
        rows(found, EDGE_FIELDS, {"occurrences": F.col("tf")}, F.lit(1 << 20) + F.col("position"), id=edge_id("node_id", "MENTIONS", stable_id("concept", F.col("term"))), source=F.col("node_id"), target=stable_id("concept", F.col("term")), type=F.lit("MENTIONS")),
        rows(links, EDGE_FIELDS, {"weight": F.col("weight"), "evidence": F.col("evidence")}, last, id=edge_id(one, "CO_OCCURS_WITH", two), source=one, target=two, type=F.lit("CO_OCCURS_WITH")),
    ]
    settings = {"max_concepts": concepts, "concepts_per_passage": per_passage}
    return PropertyGraph(nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), edges[0].unionByName(edges[1]).unionByName(edges[2]), {"extraction": "offline-keyword-cooccurrence", "settings": settings}, between=BETWEEN)
