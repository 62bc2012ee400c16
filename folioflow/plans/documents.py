"""Token trees of whole documents: flattened, counted and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.operators import blocks
from folioflow.plans.bindings import Bound, with_ctes
from folioflow.plans.registry import query


def _text_token(content: Column, styles: str = "") -> Column:
    extra = f', "styles": [{styles}]' if styles else ""
    return F.concat(F.lit('{"type": "text", "content": '), T.json_scalar(content), F.lit(extra + "}"))


def document_trees(b: Bound) -> DataFrame:
    """A tree per document: title (twice), abstract, a section per further line, a list of all lines, a table and the rest."""
    lines = F.split("text", "\n")
    first = F.get(lines, F.lit(0))

    def section(line: Column, i: Column) -> Column:
        number = i.cast("string")
        styled = (
            F.when(i % 4 == 0, _text_token(line, '"bold", "italic"'))
            .when(i % 4 == 1, _text_token(line, '"bold"'))
            .when(i % 4 == 2, _text_token(line, '"italic"'))
            .otherwise(_text_token(line))
        )
        return F.concat(
            F.lit('{"type": "section", "level": '),
            (i % 3 + 1).cast("string"),
            F.lit(', "numbering": "'),
            number,
            F.lit('", "title": [{"type": "text", "content": "Part '),
            number,
            F.lit('"}], "content": [{"type": "paragraph", "content": ['),
            styled,
            F.lit(', {"type": "citation", "content": ["k '),
            number,
            F.lit('", "x"]}, {"type": "footnote", "content": [{"type": "text", "content": "note '),
            number,
            F.lit('"}]}]}]}, '),
        )

    sections = F.transform(lines, lambda line, i: F.when(i > 0, section(line, i)).otherwise(F.lit("")))
    items = F.transform(lines, lambda line: F.concat(F.lit('{"type": "item", "content": ['), _text_token(line), F.lit("]}")))
    title = F.concat(F.lit('{"type": "title", "content": ['), _text_token(first), F.lit("]}, "))
    n = F.size(lines).cast("string")
    tree = F.concat(
        F.lit('{"tokens": [{"type": "command", "content": "maketitle"}, {"type": "document", "content": ['),
        title,
        title,
        F.lit('{"type": "abstract", "content": '),
        T.json_scalar(first),
        F.lit("}, "),
        F.array_join(sections, ""),
        F.lit('{"type": "list", "depth": 1, "name": "'),
        F.when(F.col("lang") == "en", "enumerate").otherwise("itemize"),
        F.lit('", "content": ['),
        F.array_join(items, ", "),
        F.lit(']}, {"type": "figure", "numbering": "1", "content": [{"type": "graphic"}, {"type": "caption", "content": ['),
        _text_token(first),
        F.lit(']}]}, {"type": "equation", "display": "block", "content": " x + '),
        n,
        F.lit(' "}, {"type": "ref", "content": ["sec:'),
        n,
        F.lit('"]}, {"type": "bibliography", "content": [{"cite_key": "k1", "content": ['),
        _text_token(F.col("source")),
        F.lit(']}]}, {"type": "widget"}, {"type": "table", "numbering": "7", "content": [{"tabular": [[{"content": ['),
        _text_token(first),
        F.lit(', {"type": "citation", "content": ["k1"]}, {"type": "group", "content": [{"type": "text", "content": " in "}]}, '),
        F.lit('{"type": "ref", "content": ["tab:1"]}]}, ['),
        _text_token(F.col("source"), '"bold"'),
        F.lit('], null], [{"content": [{"type": "footnote", "content": [{"type": "text", "content": "cell"}]}]}, "plain", '),
        F.lit('{"content": "str"}]]}, {"type": "caption", "content": ['),
        _text_token(first),
        F.lit("]}]}]}]}"),
    )
    return b.spread_documents.select(F.col("id").alias("doc"), tree.alias("tree"))


PARTS_SQL = with_ctes("docs") + ", parts AS (SELECT id AS doc, lang, source, string_split(text, chr(10)) AS lines FROM docs)"

_STYLED = """CASE i % 4 WHEN 0 THEN '<b><i>' || x || '</i></b>' WHEN 1 THEN '<b>' || x || '</b>' WHEN 2 THEN '<i>' || x || '</i>' ELSE x END"""

# Text of each block as (position, type, text); list indexes are one-based.
BLOCKS_SQL = (
    PARTS_SQL
    + f""", numbered AS (SELECT doc, lang, source, lines, len(lines) AS n, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM parts),
    blocks AS (SELECT doc, '0' AS path, 0 AS pos, 'command' AS type, '' AS md FROM parts
        UNION ALL SELECT doc, '1/0', 1, 'title', '# ' || lines[1] || chr(10) FROM parts
        UNION ALL SELECT doc, '1/1', 2, 'title', '' FROM parts
        UNION ALL SELECT doc, '1/2', 3, 'abstract', CASE WHEN lines[1] <> '' THEN '## Abstract' || chr(10) || lines[1] || chr(10) ELSE '' END FROM parts
        UNION ALL SELECT doc, '1/' || (2 + i), 3 + i, 'section', repeat('#', (i % 3 + 2)::INT) || ' ' || i || '. Part ' || i || chr(10) || {_STYLED} || '[k ' || i || ', x][^' || i || ']'
            || chr(10) || chr(10) || chr(10) FROM numbered WHERE i > 0
        UNION ALL SELECT doc, '1/' || (2 + len(lines)), 3 + len(lines), 'list', array_to_string(list_transform(lines, lambda x: '  ' || CASE WHEN lang = 'en' THEN '1. ' ELSE '- ' END || x), chr(10)) || chr(10) FROM parts
        UNION ALL SELECT doc, '1/' || (3 + len(lines)), 4 + len(lines), 'figure', CASE WHEN lines[1] <> '' THEN '[Figure 1]: ' || lines[1] || chr(10) ELSE '' END FROM parts
        UNION ALL SELECT doc, '1/' || (4 + len(lines)), 5 + len(lines), 'equation', '$$ x + ' || len(lines) || ' $$' || chr(10) FROM parts
        UNION ALL SELECT doc, '1/' || (5 + len(lines)), 6 + len(lines), 'ref', '[sec:' || len(lines) || ']' FROM parts
        UNION ALL SELECT doc, '1/' || (6 + len(lines)), 7 + len(lines), 'bibliography', '## References' || chr(10) || '[k1]: ' || source || chr(10) FROM parts
        UNION ALL SELECT doc, '1/' || (7 + len(lines)), 8 + len(lines), 'widget', '<!-- Unknown token type: widget -->' FROM parts
        UNION ALL SELECT doc, '1/' || (8 + n), 9 + n, 'table', '[Table 7]: ' || first || chr(10) || head || chr(10) || '|'
            || repeat('---|', length(head) - length(replace(head, '|', '')) - 1) || chr(10) || '| [^' || n || '] | plain | str |' || chr(10)
            FROM (SELECT doc, len(lines) AS n, lines[1] AS first, '| ' || lines[1] || '[k1] in [tab:1] | <b>' || source || '</b> |  |' AS head FROM parts))"""
)


def _path(path: str = "path") -> Column:
    return F.array_join(F.transform(path, lambda p: p.cast("string")), "/")


@query(
    "token_blocks",
    PARTS_SQL
    + """, numbered AS (SELECT doc, lang, source, lines, len(lines) AS n, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM parts),
    flat AS (SELECT doc, unnest([{'type': 'title', 'path': '1/0', 'text': NULL}, {'type': 'text', 'path': '1/0/0', 'text': lines[1]},
            {'type': 'title', 'path': '1/1', 'text': NULL}, {'type': 'text', 'path': '1/1/0', 'text': lines[1]}, {'type': 'abstract', 'path': '1/2', 'text': lines[1]},
            {'type': 'list', 'path': '1/' || (2 + len(lines)), 'text': NULL}, {'type': 'figure', 'path': '1/' || (3 + len(lines)), 'text': NULL},
            {'type': 'graphic', 'path': '1/' || (3 + len(lines)) || '/0', 'text': NULL}, {'type': 'caption', 'path': '1/' || (3 + len(lines)) || '/1', 'text': NULL},
            {'type': 'text', 'path': '1/' || (3 + len(lines)) || '/1/0', 'text': lines[1]}, {'type': 'equation', 'path': '1/' || (4 + len(lines)), 'text': ' x + ' || len(lines) || ' '},
            {'type': 'ref', 'path': '1/' || (5 + len(lines)), 'text': NULL}, {'type': 'bibliography', 'path': '1/' || (6 + len(lines)), 'text': NULL},
            {'type': NULL, 'path': '1/' || (6 + len(lines)) || '/0', 'text': NULL}, {'type': 'text', 'path': '1/' || (6 + len(lines)) || '/0/0', 'text': source},
            {'type': 'widget', 'path': '1/' || (7 + len(lines)), 'text': NULL}]) AS b FROM parts
        UNION ALL SELECT doc, unnest([{'type': 'table', 'path': t, 'text': NULL}, {'type': NULL, 'path': t || '/0', 'text': NULL}, {'type': 'caption', 'path': t || '/1', 'text': NULL},
            {'type': 'text', 'path': t || '/1/0', 'text': lines[1]}, {'type': NULL, 'path': r0, 'text': NULL}, {'type': NULL, 'path': r0 || '/0', 'text': NULL},
            {'type': 'text', 'path': r0 || '/0/0', 'text': lines[1]}, {'type': 'citation', 'path': r0 || '/0/1', 'text': NULL}, {'type': 'text', 'path': r0 || '/0/2/0', 'text': ' in '},
            {'type': 'ref', 'path': r0 || '/0/3', 'text': NULL}, {'type': NULL, 'path': r0 || '/1', 'text': NULL}, {'type': 'text', 'path': r0 || '/1/0', 'text': source},
            {'type': NULL, 'path': r0 || '/2', 'text': NULL}, {'type': NULL, 'path': r1, 'text': NULL}, {'type': NULL, 'path': r1 || '/0', 'text': NULL},
            {'type': 'footnote', 'path': r1 || '/0/0', 'text': NULL}, {'type': 'text', 'path': r1 || '/0/0/0', 'text': 'cell'}, {'type': NULL, 'path': r1 || '/1', 'text': 'plain'},
            {'type': NULL, 'path': r1 || '/2', 'text': 'str'}])
            FROM (SELECT doc, lines, source, '1/' || (8 + len(lines)) AS t, t || '/536870912' AS r0, t || '/536870913' AS r1 FROM parts)
        UNION ALL SELECT doc, unnest([{'type': 'item', 'path': '1/' || (2 + n) || '/' || i, 'text': NULL}, {'type': 'text', 'path': '1/' || (2 + n) || '/' || i || '/0', 'text': x}]) FROM numbered
        UNION ALL SELECT doc, unnest([{'type': 'section', 'path': '1/' || (2 + i), 'text': NULL}, {'type': 'text', 'path': '1/' || (2 + i) || '/-1073741824', 'text': 'Part ' || i},
            {'type': 'paragraph', 'path': '1/' || (2 + i) || '/0', 'text': NULL}, {'type': 'text', 'path': '1/' || (2 + i) || '/0/0', 'text': x},
            {'type': 'citation', 'path': '1/' || (2 + i) || '/0/1', 'text': NULL}, {'type': 'footnote', 'path': '1/' || (2 + i) || '/0/2', 'text': NULL},
            {'type': 'text', 'path': '1/' || (2 + i) || '/0/2/0', 'text': 'note ' || i}]) FROM numbered WHERE i > 0)
    SELECT doc, b.path AS path, len(string_split(b.path, '/')) - 1 AS depth, b.type AS type, md5(b.text) AS text_md5 FROM flat""",
)
def token_blocks(b: Bound) -> DataFrame:
    found = blocks.token_blocks(blocks.token_nodes(document_trees(b)))
    return found.select("doc", _path().alias("path"), F.col("depth").cast("bigint").alias("depth"), "type", F.md5("text").alias("text_md5"))


@query(
    "token_census",
    PARTS_SQL
    + """, sizes AS (SELECT count(*) AS docs, sum(len(lines))::BIGINT AS lines FROM parts)
    SELECT unnest(['command', 'document', 'title', 'abstract', 'list', 'figure', 'graphic', 'caption', 'equation', 'ref', 'bibliography', 'widget', 'item', 'section', 'paragraph', 'citation', 'footnote', 'text', 'table', 'group']) AS type,
        unnest([docs, docs, 2 * docs, docs, docs, docs, docs, 2 * docs, docs, 2 * docs, docs, docs, lines, lines - docs, lines - docs, lines, lines, 9 * docs + lines + 3 * (lines - docs), docs, docs]) AS nodes,
        unnest([true, true, true, true, true, true, false, false, true, true, true, false, false, true, true, true, true, true, true, true]) AS known FROM sizes""",
)
def token_census(b: Bound) -> DataFrame:
    return blocks.token_census(blocks.token_nodes(document_trees(b)))


@query("render_blocks", BLOCKS_SQL + " SELECT doc, path, type, md FROM blocks")
def render_blocks(b: Bound) -> DataFrame:
    rendered = blocks.render_blocks(blocks.token_nodes(document_trees(b), fold=True))
    return rendered.select("doc", _path().alias("path"), "type", "md")


@query(
    "assemble_document",
    BLOCKS_SQL
    + """, bodies AS (SELECT doc, string_agg(md, '' ORDER BY pos) AS body FROM blocks GROUP BY doc),
    notes AS (SELECT doc, string_agg('[^' || i || ']: ' || CASE WHEN i = n THEN 'cell' ELSE 'note ' || i END, chr(10) ORDER BY i) AS notes
        FROM (SELECT doc, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i FROM parts) GROUP BY doc)
    SELECT b.doc, md5(b.body || coalesce(chr(10) || chr(10) || n.notes, '')) AS text_md5, length(b.body || coalesce(chr(10) || chr(10) || n.notes, '')) AS text_length
    FROM bodies b LEFT JOIN notes n ON b.doc = n.doc""",
)
def assemble_document(b: Bound) -> DataFrame:
    trees = document_trees(b)
    texts = blocks.assemble_document(blocks.render_blocks(blocks.token_nodes(trees, fold=True)), trees)
    return texts.select("doc", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_length"))


@query(
    "first_seen_title",
    """SELECT conv_id AS doc, role AS title, min(turn) AS path FROM conversations GROUP BY conv_id, role""",
)
def first_seen_title(b: Bound) -> DataFrame:
    """Turns as blocks titled by their role."""
    rows = b.table("conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("title"), F.col("turn").alias("path"))
    return blocks.first_seen_title(rows)


@query(
    "footnote_numbers",
    """SELECT conv_id AS doc, turn AS path, md5(text) AS text_md5, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number
    FROM conversations WHERE role = 'assistant'""",
)
def footnote_numbers(b: Bound) -> DataFrame:
    """Answers as the footnotes of their conversation."""
    notes = b.table("conversations").where("role = 'assistant'")
    rows = notes.select(F.col("conv_id").alias("doc"), F.col("turn").alias("path"), F.md5("text").alias("text_md5"))
    return blocks.footnote_numbers(rows)


# The last cell of each row holds tokens.
_TOKEN_CELL = (
    '{"content":[{"type":"text","content":"x"},{"type":"citation","content":["k1"]},'
    '{"type":"group","content":[{"type":"text","content":"in group"}]},{"type":"ref","content":["tab:1"]}]}'
)


def table_trees(b: Bound) -> DataFrame:
    """A table per document: a row per line, a cell per word and one of tokens; German tables have spanning cells."""
    span = F.when(F.col("lang") == "de", ',"rowspan":2').otherwise("")
    rows = F.transform(
        F.split("text", "\n"),
        lambda line: F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    F.split(line, " "), lambda w: F.concat(F.lit('{"content":'), T.json_scalar(w), span, F.lit("}"))
                ),
                ",",
            ),
            F.lit(f",{_TOKEN_CELL}]"),
        ),
    )
    token = F.concat(
        F.lit('{"content":[{"tabular":['), F.array_join(rows, ","), F.lit(']}],"numbering":"'), "n_chars", F.lit('","type":"table"}')
    )
    return b.spread_documents.select(F.col("id").alias("doc"), F.concat(F.lit('{"tokens":['), token, F.lit("]}")).alias("tree"))


@query(
    "render_tables",
    with_ctes("docs")
    + f""", t AS (SELECT id, lang, n_chars, '[Table ' || n_chars || ']: ' || chr(10) AS head,
            list_transform(string_split(text, chr(10)), lambda x: '| ' || array_to_string(string_split(x, ' '), ' | ') || ' | x[k1]in group[tab:1] |') AS rows,
        '{{"content":[{{"tabular":[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '[' || array_to_string(list_transform(string_split(x, ' '), lambda w: '{{"content":' || to_json(w)::VARCHAR || ',"rowspan":2}}'), ',') || ',{_TOKEN_CELL}]'), ',')
        || ']}}],"numbering":"' || n_chars || '","type":"table"}}' AS raw FROM docs)
    SELECT id, md5(CASE WHEN lang = 'de' THEN head || 'Following table is represented in JSON:' || chr(10) || '```json' || chr(10) || raw || chr(10) || '```' || chr(10)
        WHEN len(rows) > 1 THEN head || rows[1] || chr(10) || '|' || repeat('---|', length(rows[1]) - length(replace(rows[1], '|', '')) - 1) || chr(10) || array_to_string(rows[2:], chr(10)) || chr(10)
        ELSE '' END) AS md_md5 FROM t""",
)
def render_tables(b: Bound) -> DataFrame:
    tables = blocks.render_blocks(blocks.token_nodes(table_trees(b), fold=True))
    return tables.select(F.col("doc").alias("id"), F.md5("md").alias("md_md5"))


@query(
    "render_authors",
    with_ctes("docs")
    + """ SELECT id, '## Authors' || chr(10) || '<b>Ann ' || source || '</b><sup>1,2</sup>, <b>' || title || '</b>[home](http://x/' || id || '), <b>Last ' || lang || '</b>' || chr(10) AS md FROM docs""",
)
def render_authors(b: Bound) -> DataFrame:
    """Two authors in one group, told apart by a comma, and one by itself."""
    token = F.concat(
        F.lit('{"type": "author", "content": [[{"type": "text", "content": "Ann '),
        "source",
        F.lit('"}, {"type": "text", "content": "1", "styles": ["superscript"]}, {"type": "text", "content": "2", "styles": ["superscript"]}, '),
        _text_token(F.concat(F.lit(", "), "title")),
        F.lit(', {"type": "url", "content": "http://x/'),
        "id",
        F.lit('", "title": [{"type": "text", "content": "home"}]}], {"type": "text", "content": "Last '),
        "lang",
        F.lit('"}]}'),
    )
    return b.documents.select("id", blocks.render_authors(F.parse_json(token)).alias("md"))
