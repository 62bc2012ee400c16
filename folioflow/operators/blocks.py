"""Document token trees as a node table, and their text.

A tree (``{"tokens": [...]}`` as JSON) is flattened in one pass: a task walks each tree once and writes a row
per node, table rows and cells among them. Text is assembled bottom-up in Spark, one depth after the other:
the nodes of a depth are read when their children are ready, get their text, and go to their parents, so each
node is grouped twice, as itself and as a child. All steps group by (doc, node), so after a shuffle by ``doc``
they run in place. Trees of any depth are taken whole: every ``PLAN_LEVELS`` depths the rows are stored.
For rendering, cells and texts without children can stay inside their parents, see ``token_nodes``.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.functions import text as T
from folioflow.session import materialise, materialise_by

TRANSPARENT_TYPES = ("document", "group")

# The node types with a rendering of their own.
KNOWN_TYPES = (
    "title", "author", "abstract", "section", "paragraph", "list", "figure", "table", "equation", "citation",
    "footnote", "bibliography", "text", "command", "document", "group", "ref", "math_env",
)

# Lines and headings of the rendered text.
_AS_JSON = "Following table is represented in JSON:\n```json\n"
_AUTHORS, _ABSTRACT, _REFERENCES = "## Authors\n", "## Abstract\n", "## References\n"
_UNKNOWN = "<!-- Unknown token type: "

# Types whose content is read from the node itself.
_LEAF_TYPES = ("text", "equation", "citation", "ref", "author", "command")

# Structural children that carry text for their parent and have no rendering of their own.
_CARRIER_PARENTS = ("list", "bibliography", "figure", "table", "row")

# Path steps of title tokens come before those of content tokens, table rows after them.
_TITLE_STEP = -(1 << 30)
_ROW_STEP = 1 << 29

# Depths that one plan folds before its rows are stored; no depth is left out.
PLAN_LEVELS = 8

# Nodes, and pieces inside them, that a task holds before it hands them on, beside those of the tree at hand.
_NODE_ROWS = 20_000

_FIELDS = {
    "path": pa.list_(pa.int32()),
    "slot": pa.string(),
    "parent_type": pa.string(),
    "block": pa.bool_(),
    "shown": pa.bool_(),
    "leaf": pa.bool_(),
    "type": pa.string(),
    "text": pa.string(),
    "styles": pa.list_(pa.string()),
    "level": pa.int32(),
    "numbering": pa.string(),
    "name": pa.string(),
    "indent": pa.int32(),
    "display": pa.string(),
    "cite_key": pa.string(),
    "title_text": pa.string(),
    "strings": pa.list_(pa.string()),
    "is_grid": pa.bool_(),
    "title_tokens": pa.list_(pa.struct([("content", pa.string()), ("styles", pa.list_(pa.string()))])),
    "raw": pa.string(),
}
_FIELD_TYPES = (
    "path array<int>, slot string, parent_type string, block boolean, shown boolean, leaf boolean, type string, text string, "
    "styles array<string>, level int, numbering string, name string, indent int, display string, cite_key string, "
    "title_text string, strings array<string>, is_grid boolean, "
    "title_tokens array<struct<content string, styles array<string>>>, raw string"
)

# A child that stays inside its parent, with its text.
_PIECE = {"step": pa.int32(), "slot": pa.string(), "type": pa.string(), "md": pa.string()}
_PIECES_TYPE = "array<struct<step int, slot string, type string, md string>>"


def _tokens(tree: str | None) -> list | None:
    """The top tokens of a tree; None if it is no JSON object or its ``tokens`` are no list."""
    try:
        parsed = json.loads(tree) if tree else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(parsed, dict):
        return None
    tokens = parsed.get("tokens")
    return [] if tokens is None else tokens if isinstance(tokens, list) else None


def _as_text(value: object) -> str | None:
    if value is None or isinstance(value, (str, list, dict)):
        return value if isinstance(value, str) else None
    return json.dumps(value)


def _as_list(value: object) -> list | None:
    return [_as_text(v) for v in value] if isinstance(value, list) else None


def _as_int(value: object) -> int | None:
    try:
        return int(value) if isinstance(value, (int, float, str)) else None
    except (ValueError, OverflowError):
        return None


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _grid(node: dict) -> list | None:
    """Rows of a table node that can be drawn: it has some, and no cell covers several."""
    content = node.get("content")
    first = content[0] if isinstance(content, list) and content else None
    rows = first.get("tabular") if isinstance(first, dict) else None
    if not isinstance(rows, list) or not rows or not all(isinstance(r, list) for r in rows):
        return None
    spans = any(isinstance(c, dict) and (c.get("rowspan") or c.get("colspan")) for r in rows for c in r)
    return None if spans else rows


def _cell_text(content: object) -> str | None:
    if content is None or isinstance(content, (str, dict)):
        return content if isinstance(content, str) else None
    return str(content)


def _styled(text: str | None, styles: object) -> str:
    """``functions.text.style_text`` of a piece; no text is empty, whatever its styles."""
    if text is None or not isinstance(styles, list):
        return text or ""
    for style, mark in (("italic", "i"), ("bold", "b")):
        text = f"<{mark}>{text}</{mark}>" if style in styles else text
    return text


def _pieces(below: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Children whose text is their own content, as pieces, and the others."""
    pieces, others = [], []
    for child in below:
        step, node, of, at, _ = child
        if at == "cell":
            content = node.get("content") if isinstance(node, dict) else node
            if not isinstance(content, list):
                pieces.append((step, at, None, _cell_text(content) or ""))
                continue
        elif at != "row" and of not in _CARRIER_PARENTS and isinstance(node, dict) and node.get("type") == "text":
            pieces.append((step, at, "text", _styled(_as_text(node.get("content")), node.get("styles"))))
            continue
        others.append(child)
    return pieces, others


def _walk(tokens: list, fold: bool = False) -> Iterator[dict]:
    """Every node of a tree in reading order, as a dict of the fields that it has.

    ``shown`` is false below what no rendering reaches: unknown types and all captions but the first. With
    ``fold``, cells and texts that have no nodes below them and are no blocks are ``pieces`` of their parent.
    """
    waiting = [([i], t, "", "content", True, True) for i, t in enumerate(tokens)][::-1]
    while waiting:
        path, node, parent, slot, block, shown = waiting.pop()
        out = {"path": path, "slot": slot, "parent_type": parent, "block": block, "shown": shown}
        below: list[tuple] = []
        if slot == "row":
            below = [(j, c, "row", "cell", shown) for j, c in enumerate(node)]
        elif slot == "cell":
            content = node.get("content") if isinstance(node, dict) else node
            if isinstance(content, list):
                below = [(j, t, "cell", "content", shown) for j, t in enumerate(content)]
            else:
                out["text"] = _cell_text(content)
        elif isinstance(node, dict):
            kind = _as_text(node.get("type"))
            content, title = node.get("content"), node.get("title")
            out |= {"type": kind, "text": _as_text(content)}
            if kind == "text":
                out["styles"] = _as_list(node.get("styles"))
            else:
                out |= {
                    "level": _as_int(node.get("level")),
                    "indent": _as_int(node.get("depth")),
                    "title_text": _as_text(title),
                    **{f: _as_text(node.get(f)) for f in ("numbering", "name", "display", "cite_key")},
                }
            if kind in ("citation", "ref"):
                out["strings"] = _as_list(content)
            elif kind == "author":
                out["raw"] = _compact(node)
            elif kind == "title" and isinstance(content, list):
                out["raw"] = _compact(content)
                if all(isinstance(t, dict) and t.get("type") == "text" for t in content):
                    out["title_tokens"] = [{"content": _as_text(t.get("content")), "styles": _as_list(t.get("styles"))} for t in content]
            rows = _grid(node) if kind == "table" else None
            if kind == "table":
                out["is_grid"] = rows is not None
                if rows is None:
                    out["raw"] = _compact(node)
            rendered = shown and (kind in KNOWN_TYPES or kind == "caption" or parent in _CARRIER_PARENTS)
            if kind in ("section", "citation") and isinstance(title, list):
                below = [(_TITLE_STEP + i, t, kind, "title", rendered) for i, t in enumerate(title)]
            if kind not in _LEAF_TYPES and isinstance(content, list):
                captions = [i for i, t in enumerate(content) if isinstance(t, dict) and t.get("type") == "caption"][:1]
                only = captions if kind in ("figure", "table") else range(len(content))
                below += [(i, t, kind or "", "content", rendered and i in only) for i, t in enumerate(content)]
            below += [(_ROW_STEP + i, r, "table", "row", rendered) for i, r in enumerate(rows or [])]
            block = block and kind in TRANSPARENT_TYPES
        inside = block and isinstance(node, dict)
        if fold and below and not inside:
            pieces, below = _pieces(below)
            if pieces:
                out["pieces"] = pieces
        out["leaf"] = not below
        yield out
        waiting += [([*path, step], t, of, at, inside, seen) for step, t, of, at, seen in reversed(below)]


def token_nodes(trees: DataFrame, fold: bool = False) -> DataFrame:
    """Every node of the trees (``doc, tree``), however deep. ``block`` marks nodes with only wrappers above them.

    Rows and cells of a table that is drawn as a grid are nodes in the slots ``row`` and ``cell``, their
    tokens hang below them. Each tree is walked once where it lies. Trees that cannot be read give no
    nodes; ``unreadable_trees`` lists them. With ``fold``, which is meant for ``render_blocks``, plain cells
    and texts are no rows of their own but ``pieces`` of their parent.
    """
    fields = _FIELD_TYPES + (f", pieces {_PIECES_TYPE}" if fold else "")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here is cyclic, and passes over the parts of trees are slow
        try:
            yield from walked(batches)
        finally:
            gc.enable()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, found, held = batch.column("doc"), [], [], 0

            def taken() -> pa.RecordBatch:
                columns = [pa.array([n.get(f) for n in found], kind) for f, kind in _FIELDS.items()]
                names = ["doc", *_FIELDS]
                if fold:
                    columns.append(_piece_lists([n.get("pieces", ()) for n in found]))
                    names.append("pieces")
                return pa.RecordBatch.from_arrays([docs.take(pa.array(rows, pa.int64())), *columns], names=names)

            for row, tree in enumerate(batch.column("tree")):
                for node in _walk(_tokens(tree.as_py()) or [], fold):
                    rows.append(row)
                    found.append(node)
                    held += 1 + len(node.get("pieces", ()))
                    if held >= _NODE_ROWS:
                        yield taken()
                        rows, found, held = [], [], 0
            yield taken()

    doc_type = trees.schema["doc"].dataType.simpleString()
    found = trees.select("doc", F.col("tree").cast("string").alias("tree")).mapInArrow(walk, f"doc {doc_type}, {fields}")
    kind = F.col("type")
    is_wrapper = F.coalesce(kind.isin(*TRANSPARENT_TYPES), F.lit(False))
    return found.withColumns(
        {
            "depth": F.size("path") - 1,
            "block": F.col("block") & ~is_wrapper,
            "wrapper": F.col("block") & is_wrapper,
            "authors": F.when(kind == "author", render_authors(F.try_parse_json("raw"))),
            "title_key": F.when(kind == "title", F.coalesce("text", _plain(F.col("title_tokens")), "raw")),
        }
    ).drop("title_tokens")


def _piece_lists(pieces: list) -> pa.Array:
    offsets = [0]
    for some in pieces:
        offsets.append(offsets[-1] + len(some))
    columns = list(zip(*(p for some in pieces for p in some), strict=True)) or [()] * len(_PIECE)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, _PIECE.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=list(_PIECE)))


def _readable(tree: str) -> Column:
    """Whether a tree is a JSON object whose ``tokens``, if any, are a list."""

    @F.pandas_udf("boolean")
    def readable(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: _tokens(t) is not None).astype(bool)

    return readable(F.coalesce(F.col(tree).cast("string"), F.lit("")))


def unreadable_trees(trees: DataFrame) -> DataFrame:
    """``doc, tree`` of trees that are no JSON object or whose ``tokens`` are no list."""
    return trees.where(~_readable("tree")).select("doc", "tree")


def token_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes that count as blocks: wrappers are transparent; commands and text at the top level are dropped."""
    top_text = (F.col("type") == "text") & (F.col("depth") == 0)
    kept = ~F.coalesce(F.col("type").isin(*TRANSPARENT_TYPES, "command"), F.lit(False)) & ~F.coalesce(top_text, F.lit(False))
    return nodes.where(kept)


def token_census(nodes: DataFrame) -> DataFrame:
    """Nodes per type and whether the type has a rendering. Structural children without a type are left out."""
    typed = nodes.where(F.col("type").isNotNull() | ~F.col("parent_type").isin(*_CARRIER_PARENTS))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("nodes")).withColumn(
        "known", F.coalesce(F.col("type").isin(*KNOWN_TYPES), F.lit(False))
    )


def title_places(titles: DataFrame, key: str = "title", order: str = "path", place: str = "place") -> DataFrame:
    """Each block's place, from 1, among those of its document with the same title."""
    return titles.withColumn(place, F.row_number().over(Window.partitionBy("doc", key).orderBy(order)))


def first_seen_title(titles: DataFrame, key: str = "title", order: str = "path") -> DataFrame:
    """Only the first block with a given title per document."""
    return title_places(titles, key, order, "_place").where("_place = 1").drop("_place")


def footnote_numbers(footnotes: DataFrame, order: str = "path", number: str = "number") -> DataFrame:
    """Footnotes numbered per document in reading order."""
    return footnotes.withColumn(number, F.row_number().over(Window.partitionBy("doc").orderBy(order)).cast("bigint"))


# --- pieces of text --------------------------------------------------------------------------


_TEXT_TOKENS = "array<struct<type string, content string, styles array<string>>>"


def _string_at(node: Column, field: str) -> Column:
    """The field when it is a string; lists and objects would otherwise come back as JSON text."""
    listed = F.try_variant_get(node, f"$.{field}", "array<variant>")
    return F.when(listed.isNull(), F.try_variant_get(node, f"$.{field}", "string"))


def _plain(tokens: Column) -> Column:
    """Text tokens with their styles, side by side."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(T.style_text(t["content"], t["styles"]), F.lit(""))), "")


def table_line(cells: Column) -> Column:
    """One row of a table from the texts of its cells."""
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def render_table(lines: Column, is_grid: Column, raw: Column, numbering: Column, caption: Column) -> Column:
    """Pipe table with a header line; spans or a missing grid keep the JSON; one row alone gives nothing."""
    head = F.concat(F.lit("[Table "), F.coalesce(numbering, F.lit("")), F.lit("]: "), F.coalesce(caption, F.lit("")), F.lit("\n"))
    # A bar inside a cell of the first row counts as a column border too.
    bars = F.length(F.get(lines, F.lit(0))) - F.length(F.replace(F.get(lines, F.lit(0)), F.lit("|"), F.lit("")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), bars - 1))
    table = F.concat(
        head,
        F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 2147483646)), "\n"),
        F.lit("\n"),
    )
    as_json = F.concat(head, F.lit(_AS_JSON), raw, F.lit("\n```\n"))
    return F.when(~is_grid, as_json).when(F.size(lines) > 1, table).otherwise(F.lit(""))


def author_items(node: Column) -> Column:
    """Names, superscripts and links of an author node in order, with a mark after each group."""
    groups = F.try_variant_get(node, "$.content", "array<variant>")

    def item(m: Column) -> Column:
        kind = F.try_variant_get(m, "$.type", "string")
        text = F.trim(F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit("")))
        styles = F.try_variant_get(m, "$.styles", "array<string>")
        raised = F.coalesce(F.array_contains(styles, "superscript"), F.lit(False))
        title = F.coalesce(_plain(F.try_variant_get(m, "$.title", _TEXT_TOKENS)), _string_at(m, "title"), F.lit(""))
        return F.struct(
            F.when(kind == "url", F.lit("link"))
            .when((kind == "text") & raised, F.lit("mark"))
            .when(kind == "text", F.lit("name"))
            .otherwise(F.lit("skip"))
            .alias("kind"),
            F.when(kind == "url", F.concat(F.lit("["), title, F.lit("]("), text, F.lit(")")))
            .otherwise(F.trim(F.regexp_replace(text, "^,+", "")))
            .alias("text"),
            ((kind == "text") & text.startswith(",")).alias("closes"),
        )

    end = F.array(F.struct(F.lit("end").alias("kind"), F.lit("").alias("text"), F.lit(True).alias("closes")))
    return F.flatten(
        F.transform(
            groups,
            lambda g: F.concat(F.transform(F.coalesce(F.try_variant_get(g, "$", "array<variant>"), F.array(g)), item), end),
        )
    )


def author_line(items: Column) -> Column:
    """Names in bold, their marks raised, authors joined by commas."""

    def marks(raised: Column) -> Column:
        return F.when(F.size(raised) > 0, F.concat(F.lit("<sup>"), F.array_join(raised, ","), F.lit("</sup>"))).otherwise("")

    empty = F.array().cast("array<string>")

    def step(state: Column, item: Column) -> Column:
        open_author = F.concat(state["author"], marks(state["raised"]))
        closes = item["closes"] & (open_author != "")
        done = F.when(closes, F.concat(state["done"], F.array(open_author))).otherwise(state["done"])
        author = F.when(closes, F.lit("")).otherwise(state["author"])
        raised = F.when(closes, empty).otherwise(state["raised"])
        blank = item["text"].isin("", ",", ";") | item["kind"].isin("end", "skip")
        is_name = ~blank & (item["kind"] == "name")
        is_mark = ~blank & (item["kind"] == "mark")
        is_link = item["kind"] == "link"
        named = F.concat(author, marks(raised), F.lit("<b>"), item["text"], F.lit("</b>"))
        return F.struct(
            done.alias("done"),
            F.when(is_name, named).when(is_link, F.concat(author, item["text"])).otherwise(author).alias("author"),
            F.when(is_name, empty)
            .when(is_mark, F.concat(raised, F.array(item["text"])))
            .otherwise(raised)
            .alias("raised"),
        )

    start = F.struct(empty.alias("done"), F.lit("").alias("author"), empty.alias("raised"))
    return F.aggregate(items, start, step, lambda state: F.array_join(state["done"], ", "))


def render_authors(node: Column) -> Column:
    line = author_line(author_items(node))
    return F.when(line != "", F.concat(F.lit(_AUTHORS), line, F.lit("\n"))).otherwise(F.lit(""))


# --- rendering -------------------------------------------------------------------------------

_NODE = (
    "type", "parent_type", "slot", "text", "styles", "level", "numbering", "name", "indent", "display", "cite_key",
    "title_text", "strings", "is_grid", "raw", "authors", "note", "first_title", "depth", "block", "wrapper", "pieces",
)


def _node_text(with_kids: bool, ignore_reference: bool, clean_equations: bool) -> Column:
    """Text of a node from its fields and, if it has any, the texts of its children (``kids``, in order)."""

    def of_kids(slot: str, value=lambda k: k["md"], separator: str = "") -> Column:
        if not with_kids:
            return F.lit("")
        return F.array_join(F.transform(F.filter("kids", lambda k: k["slot"] == slot), value), separator)

    body = F.coalesce(F.col("text"), of_kids("content"))
    title = F.coalesce(F.col("title_text"), of_kids("title"))
    no_lines = F.array().cast("array<string>")
    rows = F.transform(F.filter("kids", lambda k: k["slot"] == "row"), lambda k: k["md"]) if with_kids else no_lines
    cells = F.transform(F.filter("kids", lambda k: k["slot"] == "cell"), lambda k: k["md"]) if with_kids else no_lines
    captions = F.filter("kids", lambda k: (k["slot"] == "content") & (k["type"] == "caption")) if with_kids else None
    caption = F.coalesce(F.get(captions, F.lit(0))["md"], F.lit("")) if with_kids else F.lit("")
    has_kids = F.exists("kids", lambda k: k["slot"] == "content") if with_kids else F.lit(False)
    kind = F.col("type")

    def unless_empty(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.lit(""))

    def lines(prefixed, before: str = "") -> Column:
        return unless_empty(has_kids, F.concat(F.lit(before), of_kids("content", prefixed, "\n"), F.lit("\n")))

    has_numbering = F.coalesce(F.col("numbering"), F.lit("")) != ""
    heading = F.when(has_numbering, F.concat(F.col("numbering"), F.lit(". "), title)).otherwise(title)
    mark = F.when(F.col("name") == "enumerate", "1. ").otherwise("- ")
    indent = F.repeat(F.lit("  "), F.coalesce(F.col("indent"), F.lit(0)))
    formula = F.regexp_replace(body, r"^\s+|\s+$", "")
    named = F.concat_ws(", ", F.coalesce(F.col("strings"), F.array().cast("array<string>")), F.when(title != "", title))
    unknown = F.concat(F.lit(_UNKNOWN), F.coalesce(kind, F.lit("None")), F.lit(" -->"))

    cases: list[tuple[Column, Column]] = [
        (F.col("slot") == "cell", body),
        (F.col("slot") == "row", table_line(cells)),
        (F.col("parent_type").isin("list", "bibliography") & (F.col("slot") == "content"), body),
        (F.col("parent_type").isin("figure", "table") & (F.col("slot") == "content"), body),
        (kind == "title", unless_empty(F.col("first_title"), F.concat(F.lit("# "), body, F.lit("\n")))),
        (kind == "author", F.col("authors")),
        (kind == "abstract", unless_empty(body != "", F.concat(F.lit(_ABSTRACT), body, F.lit("\n")))),
        (
            kind == "section",
            unless_empty(
                (heading != "") | (body != ""),
                F.concat(
                    F.repeat(F.lit("#"), F.coalesce(F.col("level"), F.lit(1)) + 1),
                    F.lit(" "),
                    heading,
                    F.lit("\n"),
                    body,
                    F.lit("\n"),
                ),
            ),
        ),
        (kind == "paragraph", unless_empty(body != "", F.concat(body, F.lit("\n\n")))),
        (kind == "list", lines(lambda k: F.concat(indent, mark, k["md"]))),
        (
            kind == "figure",
            unless_empty(
                caption != "",
                F.concat(F.lit("[Figure "), F.coalesce(F.col("numbering"), F.lit("")), F.lit("]: "), caption, F.lit("\n")),
            ),
        ),
        (kind == "table", render_table(rows, F.col("is_grid"), F.col("raw"), F.col("numbering"), caption)),
        (
            kind == "equation",
            T.clean_equation(
                F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("display") == "block", F.lit(False)), clean_equations
            ),
        ),
        (kind == "citation", F.lit("") if ignore_reference else F.concat(F.lit("["), named, F.lit("]"))),
        (kind == "footnote", F.concat(F.lit("[^"), F.col("note").cast("string"), F.lit("]"))),
        (
            kind == "bibliography",
            unknown
            if ignore_reference
            else lines(lambda k: F.concat(F.lit("["), F.coalesce(k["cite_key"], F.lit("")), F.lit("]: "), k["md"]), _REFERENCES),
        ),
        (
            kind == "text",
            F.when((F.col("depth") == 0), F.lit("")).otherwise(
                F.coalesce(T.style_text(F.col("text"), F.col("styles")), F.lit(""))
            ),
        ),
        (kind == "command", F.lit("")),
        (kind.isin(*TRANSPARENT_TYPES), body),
        (kind == "ref", F.concat(F.lit("["), F.coalesce(F.get("strings", F.lit(0)), F.lit("")), F.lit("]"))),
        (
            kind == "math_env",
            F.when(formula == "", F.lit(""))
            .when(formula.startswith("\\begin{"), F.concat(F.lit("$$ "), formula, F.lit(" $$\n")))
            .otherwise(F.concat(formula, F.lit("\n"))),
        ),
    ]
    chain = F
    for condition, value in cases:
        chain = chain.when(F.coalesce(condition, F.lit(False)), value)
    return chain.otherwise(unknown)


def render_blocks(nodes: DataFrame, ignore_reference: bool = False, clean_equations: bool = False) -> DataFrame:
    """Text of each block: ``doc, path, type, md`` and ``notes``, the footnotes inside it.

    Wrappers have no text of their own; the nodes below them are the blocks. Footnotes that no rendering
    reaches have no number. Nodes without children but pieces, most of all, get their text where they lie and
    go to their parents; the others are grouped with their children first.
    """
    folded = "pieces" in nodes.columns
    if not folded:
        nodes = nodes.withColumn("pieces", F.lit(None).cast(_PIECES_TYPE))
    found = materialise_by(nodes, "depth", "nodes")
    deepest = found.agg(F.max("depth")).head()[0] or 0
    # Only titles and footnotes are sorted and stored again.
    is_marked = F.coalesce((F.col("type") == "title") | (F.col("type") == "footnote") & F.col("shown"), F.lit(False))
    notes = footnote_numbers(found.where("type = 'footnote' AND shown"), number="note")
    titles = title_places(found.where("type = 'title'"), "title_key").withColumn("first_title", F.col("place") == 1).drop("place")
    marked = materialise_by(notes.unionByName(titles, allowMissingColumns=True), "depth", "marked")

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node_fields = [F.col(f"node.{c}").alias(c) for c in _NODE]
    no_node = F.lit(None).cast(found.unionByName(marked, True).select(F.struct(*_NODE).alias("n")).schema["n"].dataType)
    of_leaf, of_parent = (_node_columns(kids, ignore_reference, clean_equations) for kids in (False, True))
    with_pieces = F.coalesce(F.size("pieces") > 0, F.lit(False))
    ready: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        level = found.where((F.col("depth") == depth) & ~is_marked).unionByName(marked.where(F.col("depth") == depth), True)
        level = level.where(~F.col("wrapper"))
        leaves = level.where("leaf").select("doc", "path", F.lit(None).cast(_BLOCK).alias("ready"), *_NODE)
        out = _to_parents(leaves.where(~with_pieces), *of_leaf)
        if folded:
            out = out.unionByName(_to_parents(leaves.where(with_pieces).withColumn("kids", _piece_kids()), *of_parent))
        out = out.repartition(parts, "doc")
        if ready is not None:
            inner = level.where("NOT leaf").select("doc", "path", F.struct(*_NODE).alias("node")).repartition(parts, "doc")
            rows = inner.withColumns({"kid": F.lit(None).cast(_KID), "block": F.lit(None).cast(_BLOCK)})
            rows = rows.unionByName(ready.withColumn("node", no_node)).groupBy("doc", "path")
            rows = rows.agg(
                F.first("node", ignorenulls=True).alias("node"),
                F.collect_list("kid").alias("kids"),
                F.first("block", ignorenulls=True).alias("ready"),
            )
            rows = rows.select("doc", "path", "kids", "ready", *node_fields)
            kids = F.concat("kids", _piece_kids()) if folded else F.col("kids")
            rows = rows.withColumn("kids", F.array_sort(kids))
            out = _to_parents(rows, *of_parent).unionByName(out)
        ready = out
        if (deepest - depth + 1) % PLAN_LEVELS == 0 and depth > 0:
            ready = materialise(ready, "folded").repartition(parts, "doc")
    return ready.select("doc", "path", "block.type", "block.md", "block.notes")


_NOTES = "array<struct<path array<int>, md string>>"
_KID = f"struct<step int, slot string, type string, cite_key string, md string, notes {_NOTES}>"
_BLOCK = f"struct<type string, md string, notes {_NOTES}>"


def _piece_kids() -> Column:
    """The pieces of a node as children whose text is ready."""
    kids = F.transform(
        "pieces",
        lambda p: F.struct(
            p["step"].alias("step"),
            p["slot"].alias("slot"),
            p["type"].alias("type"),
            F.lit(None).cast("string").alias("cite_key"),
            p["md"].alias("md"),
            F.array().cast(_NOTES).alias("notes"),
        ),
    )
    return F.coalesce(kids, F.array().cast(f"array<{_KID}>"))


def _node_columns(with_kids: bool, ignore_reference: bool, clean_equations: bool) -> tuple[Column, Column]:
    """Text and footnotes of a node, as expressions over its fields."""
    body = F.coalesce("text", F.lit(""))
    if with_kids:
        content = F.filter("kids", lambda k: k["slot"] == "content")
        body = F.coalesce("text", F.array_join(F.transform(content, lambda k: k["md"]), ""))
    own = F.struct(F.col("path"), F.concat(F.lit("[^"), F.col("note").cast("string"), F.lit("]: "), body).alias("md"))
    notes = F.when(F.col("type") == "footnote", F.array(own)).otherwise(F.array().cast(_NOTES))
    if with_kids:
        notes = F.concat(notes, F.flatten(F.transform("kids", lambda k: k["notes"])))
    return _node_text(with_kids, ignore_reference, clean_equations), notes


def _to_parents(rows: DataFrame, md: Column, notes: Column) -> DataFrame:
    """``doc, path, kid, block``: what is ready stays as it is, a block becomes ready, any other node a child of its parent."""
    rows = rows.select("doc", "path", "ready", "slot", "type", "cite_key", "block", md.alias("md"), notes.alias("notes"))
    inner = F.col("ready").isNull() & ~F.col("block")
    return rows.select(
        "doc",
        F.when(inner, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path")).alias("path"),
        F.when(inner, F.struct(F.element_at("path", -1).alias("step"), "slot", "type", "cite_key", "md", "notes")).alias("kid"),
        F.when(~inner, F.coalesce("ready", F.struct("type", "md", "notes"))).alias("block"),
    )


def assemble_document(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """Blocks in reading order, then the footnotes: one text per readable document of ``trees``.

    Trees without blocks give an empty text; ``unreadable_trees`` lists the rest. The row is the text of one
    document, so gathering its blocks is bounded by the document.
    """
    ordered = F.array_sort(F.collect_list(F.struct("path", "md", "notes")))
    docs = blocks.groupBy("doc").agg(ordered.alias("b"))
    notes = F.transform(F.array_sort(F.flatten(F.transform("b", lambda b: b["notes"]))), lambda n: n["md"])
    body = F.array_join(F.transform("b", lambda b: b["md"]), "")
    texts = docs.select(
        "doc",
        F.when(F.size(notes) > 0, F.concat(body, F.lit("\n\n"), F.array_join(notes, "\n"))).otherwise(body).alias("text"),
    )
    readable = trees.where(_readable("tree")).select("doc")
    return readable.join(texts, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))
