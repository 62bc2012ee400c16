import json

from pyspark.sql import functions as F

from folioflow.operators import blocks
from tests.conftest import rows


def text(content, *styles):
    return {"type": "text", "content": content, **({"styles": list(styles)} if styles else {})}


def nodes(spark, *tokens):
    trees = spark.createDataFrame([("d", json.dumps({"tokens": list(tokens)}))], "doc string, tree string")
    return blocks.token_nodes(trees)


def rendered_all(spark, cases, **options):
    """Text of each list of tokens; all of them in one job."""
    trees = spark.createDataFrame([(str(i), json.dumps({"tokens": c})) for i, c in enumerate(cases)], "doc string, tree string")
    found = blocks.assemble_document(blocks.render_blocks(blocks.token_nodes(trees), **options), trees).collect()
    texts = {r["doc"]: r["text"] for r in found}
    return [texts.get(str(i)) for i in range(len(cases))]


def rendered(spark, *tokens, **options):
    return rendered_all(spark, [list(tokens)], **options)[0]


def test_wrappers_are_transparent_and_unknown_types_are_reported(spark):
    tree = [
        {"type": "document", "content": [{"type": "group", "content": [{"type": "title", "content": "A"}]}, {"type": "odd"}]},
        {"type": "command", "content": "x"},
        text("dropped"),
    ]
    found = blocks.token_blocks(nodes(spark, *tree))
    assert [(r["type"], list(r["path"])) for r in found.orderBy("path").collect()] == [("title", [0, 0, 0]), ("odd", [0, 1])]
    assert rows(blocks.token_census(nodes(spark, *tree)).where("NOT known"), "type", "nodes") == [("odd", 1)]
    assert rendered(spark, *tree) == "# A\n<!-- Unknown token type: odd -->"


def test_every_level_of_a_deep_tree_is_taken(spark):
    deep = text("x")
    for _ in range(20):
        deep = {"type": "group", "content": [deep, text("y")]}
    found = nodes(spark, deep)
    assert found.count() == 41
    assert rows(found.where("type = 'text'"), "depth", "text") == sorted([(20, "x"), *[(d, "y") for d in range(1, 21)]], key=repr)
    paragraph = {"type": "paragraph", "content": [deep]}
    assert rendered(spark, {"type": "title", "content": "T"}, paragraph) == "# T\nx" + "y" * 20 + "\n\n"


def test_empty_trees_have_empty_texts_and_unreadable_ones_are_reported(spark):
    cases = [("empty", '{"tokens": []}'), ("none", "{}"), ("broken", '{"tokens": ['), ("list", "[]"), ("null", None), ("odd", '{"tokens": 1}')]
    trees = spark.createDataFrame(cases, "doc string, tree string")
    texts = blocks.assemble_document(blocks.render_blocks(blocks.token_nodes(trees)), trees)
    assert rows(texts, "doc", "text") == [("empty", ""), ("none", "")]
    assert rows(blocks.unreadable_trees(trees), "doc") == [("broken",), ("list",), ("null",), ("odd",)]


def test_sections_lists_and_notes(spark):
    note = {"type": "footnote", "content": [text("n", "italic")]}
    section = {
        "type": "section", "level": 2, "numbering": "1.1", "title": [text("T"), note],
        "content": [
            {"type": "paragraph", "content": [text("p"), note, {"type": "citation", "content": ["a", "b"], "title": [text("c")]}]},
            {"type": "list", "name": "enumerate", "depth": 1, "content": [{"type": "item", "content": [text("i")]}, {"content": [text("j")]}]},
        ],
    }
    expected = "### 1.1. T[^1]\np[^2][a, b, c]\n\n  1. i\n  1. j\n\n\n\n[^1]: <i>n</i>\n[^2]: <i>n</i>"
    assert rendered(spark, section) == expected
    assert "[a, b" not in rendered(spark, section, ignore_reference=True)


def test_small_pieces(spark):
    caption = {"type": "caption", "content": [text("c", "bold")]}
    book = {"type": "bibliography", "content": [{"cite_key": "k", "content": [text("b")]}]}
    cases = {
        "[Figure 3]: <b>c</b>\n": [{"type": "figure", "numbering": "3", "content": [{"type": "g"}, caption]}],
        "": [{"type": "figure", "content": [{"type": "g"}]}, {"type": "abstract", "content": []}],
        "$$ \\begin{x} $$\ny\n": [{"type": "math_env", "content": " \\begin{x} "}, {"type": "math_env", "content": [text(" y ")]}],
        "## References\n[k]: b\n": [book],
        "[sec]$x$": [{"type": "ref", "content": ["sec"]}, {"type": "equation", "content": "x"}],
        "# A\n# B\n": [{"type": "title", "content": "A"}, {"type": "title", "content": [text("A")]}, {"type": "title", "content": "B"}],
    }
    assert rendered_all(spark, list(cases.values())) == list(cases)
    assert rendered(spark, book, ignore_reference=True) == "<!-- Unknown token type: bibliography -->"


def test_tables(spark):
    def table(grid, **extra):
        return {"type": "table", "numbering": "1", "content": [{"type": "tabular", "tabular": grid}, {"type": "caption", "content": [text("cap")]}], **extra}

    grid = [[{"content": [text("a", "bold"), {"type": "equation", "content": "x"}]}, None], [{"content": "c"}, [text("d")]], ["e", 5]]
    spanning = table([[{"content": "a", "rowspan": 2}], ["b"]])
    plain, single, barred, spanned, empty = rendered_all(
        spark, [[table(grid)], [table(grid[:1])], [table([["a|b"], ["c"]])], [spanning], [{"type": "table", "content": []}]]
    )
    assert plain == "[Table 1]: cap\n| <b>a</b>$x$ |  |\n|---|---|\n| c | d |\n| e | 5 |\n"
    assert single == ""
    assert barred == "[Table 1]: cap\n| a|b |\n|---|---|\n| c |\n"
    assert spanned.startswith("[Table 1]: cap\nFollowing table is represented in JSON:\n```json\n{") and '"rowspan":2' in spanned
    assert "```json" in empty


def test_cells_hold_any_token(spark):
    citation = {"type": "citation", "content": ["k1"]}
    group = {"type": "group", "content": [text(" in"), {"type": "group", "content": [text("group", "bold")]}]}
    ref = {"type": "ref", "content": ["tab:1"]}

    def note(of):
        return {"type": "footnote", "content": [text(of)]}

    grid = [
        [{"content": [text("x"), citation, group, ref]}, [note("cell"), {"type": "equation", "content": "y"}], {"content": "s"}, None],
        [True, 1.5, [], {"content": []}],
        [{"content": [{"type": "footnote", "content": [note("deep"), text(" end")]}]}],
    ]
    table = {"type": "table", "content": [{"tabular": grid}, {"type": "caption", "content": [note("cap")]}, {"type": "caption", "content": [note("gone")]}]}
    paragraph = {"type": "paragraph", "content": [note("after")]}
    lines = "| x[k1] in<b>group</b>[tab:1] | [^2]$y$ | s |  |\n|---|---|---|---|\n| True | 1.5 |  |  |\n| [^3] |"
    notes = "\n\n[^1]: cap\n[^2]: cell\n[^3]: [^4] end\n[^4]: deep\n[^5]: after"
    spanning = {"type": "table", "content": [{"tabular": [[{"content": [note("lost")], "colspan": 2}]]}]}
    odd = {"type": "odd", "content": [note("lost")]}
    shown, dropped = rendered_all(spark, [[table, paragraph], [spanning, odd, paragraph]])
    assert shown == "[Table ]: [^1]\n" + lines + "\n[^5]\n\n" + notes
    assert dropped.endswith("<!-- Unknown token type: odd -->[^1]\n\n\n\n[^1]: after")
    assert "x in" in rendered(spark, table, ignore_reference=True)
    found = nodes(spark, table)
    assert found.where("slot = 'row'").count() == 3 and found.where("slot = 'cell'").count() == 9
    assert found.where("type IS NULL AND parent_type IN ('table', 'row')").count() == 13  # the grid's own token too
    assert blocks.token_census(found).where("type IS NULL").count() == 0


AUTHORS = [
    ([[text("A"), text("1", "superscript"), text("2", "superscript"), text(", B"), text("3", "superscript")]], "<b>A</b><sup>1,2</sup>, <b>B</b><sup>3</sup>"),
    ([text("A"), text("B")], "<b>A</b>, <b>B</b>"),
    ([[text("A"), text(","), text("B"), text(";")]], "<b>A</b>, <b>B</b>"),
    ([[text("A"), {"type": "url", "content": "u", "title": [text("t")]}]], "<b>A</b>[t](u)"),
    ([[text("1", "superscript"), text("A")]], "<sup>1</sup><b>A</b>"),
    ([], ""),
]


def test_authors(spark):
    made = rendered_all(spark, [[{"type": "author", "content": content}] for content, _ in AUTHORS])
    assert made == [f"## Authors\n{line}\n" if line else "" for _, line in AUTHORS]


def test_footnotes_of_one_large_document(spark):
    df = spark.range(500).select(F.lit("d").alias("doc"), (F.lit(1000) - F.col("id")).alias("path"))
    found = blocks.footnote_numbers(df)
    assert found.where(F.col("number") != F.col("path") - 500).count() == 0


def test_folded_nodes_have_the_same_text_and_fewer_rows(spark):
    """Plain cells and texts stay in their parents; blocks, carriers' children and unreadable pieces as they are."""
    note = {"type": "footnote", "content": [text("n", "italic")]}
    grid = [[f"w{i}" for i in range(30)] + [{"content": [text("x", "bold"), note]}, None, 5, {"content": {"a": 1}}]] * 2
    cases = [
        [{"type": "table", "content": [{"tabular": grid}, {"type": "caption", "content": [text("c")]}]}],
        [{"type": "document", "content": [text("top"), {"type": "group", "content": [text("in")]}]}, text("dropped")],
        [{"type": "list", "content": [{"type": "item", "content": [text("i", "bold")]}, text("raw", "bold"), {"type": "item"}]}],
        [{"type": "section", "title": [text("T", "bold", "italic"), note], "content": [text("a"), note, text("b", "bold")]}],
        [{"type": "figure", "content": [{"type": "caption", "content": [text(None, "bold"), text(["l"]), text("c")]}, text("f")]}],
        [{"type": "title", "content": [text("t", "bold")]}, {"type": "odd", "content": [text("x")]}],
        [{"type": "citation", "content": ["k"], "title": [text("see")]}, {"type": "bibliography", "content": [{"cite_key": "k", "content": [text("b")]}]}],
    ]
    trees = spark.createDataFrame([(str(i), json.dumps({"tokens": c})) for i, c in enumerate(cases)], "doc string, tree string")
    plain, folded = blocks.token_nodes(trees), blocks.token_nodes(trees, fold=True)
    columns = ["doc", "path", "type", "md", "notes"]
    assert rows(blocks.render_blocks(folded), *columns) == rows(blocks.render_blocks(plain), *columns)
    assert plain.where("doc = '0'").count() > 70 and folded.where("doc = '0'").count() < 12
