"""Text, list and page expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Letters that have no accent-free base letter of their own, and their spelling.
LETTER_SPELLING = {
    "Æ": "Ae", "æ": "ae", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "Th", "þ": "th", "ß": "ss",
    "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "IJ", "ĳ": "ij", "ĸ": "k", "Ł": "L", "ł": "l",
    "Ŋ": "N", "ŋ": "n", "Œ": "Oe", "œ": "oe", "Ŧ": "T", "ŧ": "t", "ŉ": "n", "ſ": "s",
}

# Where a paper can be found, by kind of link.
PAPER_URLS = {
    "abs": "https://arxiv.org/abs/{id}",
    "pdf": "https://arxiv.org/pdf/{id}",
    "source": "https://arxiv.org/e-print/{id}",
}

# Fixed value: the separator used for lists inside a text column.
UNIT_SEPARATOR = "\x1f"

REFERENCE_HEADING = "# Reference"
OMISSION_MARKER = "\n\n[...content too long, middle part omitted...]\n\n"

_WORD = r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\d+"
_TOKEN = r"\S+"
_TOKEN_WITH_SPACE = r"(?:^\s+)?\S+\s*"


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents (Latin-1 supplement and Latin extended-A)."""
    single_from, single_to = [], []
    for code in range(0xC0, 0x180):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter:
            single_from.append(letter)
            single_to.append(base)
    for letter, spelling in LETTER_SPELLING.items():
        if len(spelling) == 1:
            single_from.append(letter)
            single_to.append(spelling)
        else:
            text = F.replace(text, F.lit(letter), F.lit(spelling))
    return F.translate(text, "".join(single_from), "".join(single_to))


def slugify(text: Column) -> Column:
    """Words split at case, digit and symbol borders, lower case, joined by a hyphen."""
    plain = F.regexp_replace(strip_accents(text), "['\u2019]", "")
    return F.lower(F.array_join(F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0)), "-"))


def post_path(post_id: Column, file_path: Column, content_root: str, include_base: bool = True) -> Column:
    """``/posts/<slugged folders>/<last id segment>``; folders starting with ``_`` are left out."""
    segments = F.filter(
        F.split(F.replace(file_path, F.lit(content_root), F.lit("")), "/"),
        lambda s: (s != "") & ~s.startswith("_"),
    )
    folders = F.transform(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))), slugify)
    folders = F.coalesce(folders, F.array().cast("array<string>"))
    base = F.lit("/posts" if include_base else "")
    last = F.element_at(F.split(post_id, "/"), -1)
    return F.array_join(F.concat(F.array(base), folders, F.array(last)), "/")


def paper_url(paper_id: Column, kind: str = "abs") -> Column:
    prefix, suffix = PAPER_URLS[kind].split("{id}")
    return F.concat(F.lit(prefix), paper_id, F.lit(suffix))


def strip_references(text: Column) -> Column:
    """The body before the first reference heading."""
    return F.substring_index(text, REFERENCE_HEADING, 1)


def count_tokens(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).cast("bigint")


def truncate_middle(
    text: Column,
    max_tokens: int,
    head_share: float = 0.4,
    tail_share: float = 0.3,
    marker: str = OMISSION_MARKER,
) -> Column:
    """Texts above ``max_tokens`` keep their head and tail around a marker."""
    head, tail = int(max_tokens * head_share), int(max_tokens * tail_share)
    room = max_tokens - head - tail - len(marker.split())
    if room < 0:
        cut = -room // 2 + 1
        head = head - cut if head > cut else head
        tail = tail - cut if tail > cut else tail
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN_WITH_SPACE), F.lit(0))
    size = F.size(tokens)
    first = F.array_join(F.slice(tokens, 1, head), "") if head else F.lit("")
    last = F.array_join(F.slice(tokens, F.greatest(size - F.lit(tail - 1), F.lit(1)), F.lit(tail)), "") if tail else F.lit("")
    return F.when(size <= max_tokens, text).otherwise(F.concat(first, F.lit(marker), last))


def paper_token_budget(system_tokens: int, budget: int = 50000, reserve: int = 2000) -> int:
    """Tokens left for the paper beside the instruction and the safety reserve."""
    return budget - system_tokens - reserve


def list_join(items: Column, separator: str = UNIT_SEPARATOR) -> Column:
    return F.array_join(items, separator)


def list_split(text: Column, separator: str = UNIT_SEPARATOR) -> Column:
    return F.split(text, "\\Q" + separator + "\\E")


def float_text(value: Column) -> Column:
    """Six decimals as plain digits."""
    return F.round(value, 6).cast("decimal(18,6)").cast("string")


def once(value: Column) -> Column:
    """A generated column with the one value, for parsing that later filters look at.

    Spark pushes a filter below a projection by repeating the expression in it; it does not push it
    below a generator, so each row is parsed once.
    """
    return F.explode(F.array(value))


def json_scalar(value: Column) -> Column:
    """JSON text of one value; null gives ``null``."""
    wrapped = F.to_json(F.array(value))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)


def draft_flag(preference: Column) -> Column:
    return F.coalesce(preference == "dislike", F.lit(False))


def front_matter() -> Column:
    """Header of a published page; reads the columns of the published table."""
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), json_scalar(F.col("title"))),
        F.concat(F.lit("slug: "), json_scalar(F.col("id"))),
        F.concat(F.lit('description: "'), F.replace(_text("one_sentence_summary"), F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.concat(F.lit("tags: "), F.coalesce(F.to_json("keywords"), F.lit("null"))),
        F.concat(F.lit("author: "), json_scalar(F.col("model"))),
        F.concat(F.lit("pubDatetime: "), _text("summary_time")),
        F.concat(F.lit("preference: "), json_scalar(F.col("preference"))),
        F.concat(F.lit("score: "), F.coalesce(float_text(F.col("score")), F.lit("null"))),
        F.lit("featured: false"),
        F.concat(F.lit("draft: "), draft_flag(F.col("preference")).cast("string")),
        F.lit("---"),
    ]
    return F.concat_ws("\n", *lines)


def render_page() -> Column:
    """Whole page: header, quoted facts and the four sections."""

    def quoted(value: Column) -> Column:
        return F.concat(F.lit("> "), value)

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.col(name), ", "), F.lit(""))

    def section(heading: str, name: str) -> Column:
        return F.concat(F.lit(f"## {heading}\n\n"), _text(name))

    return F.concat_ws(
        "\n\n",
        front_matter(),
        quoted(_text("one_sentence_summary")),
        quoted(joined("keywords")),
        quoted(joined("authors")),
        quoted(joined("institution")),
        F.concat(F.lit("> Generated by "), _text("model")),
        section("Background Problem", "problem_background"),
        section("Method", "method"),
        section("Experiment", "experiment"),
        section("Further Thoughts", "further_thoughts"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def build_prompt_request(
    paper: Column,
    instruction: str,
    temperature: float = 0.1,
    top_p: float = 0.8,
    response_schema: str = "",
) -> Column:
    """Request struct for one paper; its JSON is one line for the external summariser."""
    prompt = F.concat(F.lit(instruction + "\n\nThe content of the paper is as follows:\n\n\n"), paper)
    return F.struct(
        F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"), F.lit("user").alias("role"))).alias("contents"),
        F.struct(
            F.lit(temperature).alias("temperature"),
            F.lit(top_p).alias("top_p"),
            F.lit("application/json").alias("response_mime_type"),
            F.lit(response_schema).alias("response_schema"),
        ).alias("config"),
    )


# Field names and types of a summary, as asked from the external summariser.
SUMMARY_SCHEMA = (
    "institution array<string>, reasoning_step string, problem_background string, method string, "
    "experiment string, one_sentence_summary string, slug string, keywords array<string>, further_thoughts string"
)
SUMMARY_FIELDS = tuple(part.split()[0] for part in SUMMARY_SCHEMA.split(", "))
RESPONSE_TEXT_PATH = "$.response.candidates[0].content.parts[0].text"


def response_text(line: Column) -> Column:
    return F.get_json_object(line, RESPONSE_TEXT_PATH)


def parse_summary(payload: Column) -> Column:
    """Typed summary struct with ``_corrupt_record`` set when the text does not fit."""
    return F.from_json(payload, SUMMARY_SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE"})


def clean_equation(content: Column, block: Column, clean: bool = False) -> Column:
    """Wrap an equation; with ``clean`` odd commands and inner dollar signs go first."""
    body = F.trim(F.regexp_replace(content, r"^\s+|\s+$", ""))
    if clean:
        body = F.regexp_replace(body, r"\\[a-zA-Z]+\[.*?\]\{.*?\}\{.*?\}", "")
        body = F.replace(body, F.lit("$"), F.lit(""))
    return F.when(block, F.concat(F.lit("$$ "), body, F.lit(" $$\n"))).otherwise(F.concat(F.lit("$"), body, F.lit("$")))


def style_text(text: Column, styles: Column) -> Column:
    bold = F.coalesce(F.array_contains(styles, "bold"), F.lit(False))
    italic = F.coalesce(F.array_contains(styles, "italic"), F.lit(False))
    return (
        F.when(bold & italic, F.concat(F.lit("<b><i>"), text, F.lit("</i></b>")))
        .when(bold, F.concat(F.lit("<b>"), text, F.lit("</b>")))
        .when(italic, F.concat(F.lit("<i>"), text, F.lit("</i>")))
        .otherwise(text)
    )


def keyword_vocabulary_map(groups: dict[str, Sequence[str]]) -> Column:
    """The grouped vocabulary as a map literal."""
    pairs: list[Column] = []
    for group, words in groups.items():
        pairs += [F.lit(group), F.array(*[F.lit(w) for w in words])]
    return F.create_map(*pairs)
