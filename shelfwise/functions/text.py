"""Text expressions: markup removal, name casing, fixed-decimal text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: longest description kept.
DESCRIPTION_CHARS = 500

# Markup that carries no text, replaced by a mark first so that a run of it gives one blank.
SILENT_BLOCKS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
COMMENTS = r"(?s)<!--.*?-->"
# A ">" inside a quoted value does not end a tag.
TAGS = r"""<[!/?a-zA-Z](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
MARK = "\u0001"


def _named_entities() -> Column:
    """Map of all named characters, from the table of the standard library."""
    names = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _entities(text: Column) -> Column:
    """Decode ``&eacute;``, ``&#233;`` and ``&#xe9;`` once, by splitting at the marker; no per-row Python."""
    pieces, known = F.split(text, "&"), _named_entities()

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", 1)
        number = F.when(
            F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)
        ).otherwise(F.substring(name, 2, 7)).try_cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(
            F.startswith(name, F.lit("#")), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        ).when(name != "", F.try_element_at(known, name))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(name) + 2)), F.concat(F.lit("&"), piece))

    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    joined = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def strip_blank(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def html_to_text(html: Column, limit: int | None = DESCRIPTION_CHARS) -> Column:
    """Text of a page, text nodes joined by one blank, trimmed, cut; empty gives ``""``.

    White space inside a text node is kept as it is.
    """
    text = html
    for pattern in (SILENT_BLOCKS, COMMENTS, TAGS):
        text = F.regexp_replace(text, pattern, MARK)
    text = F.regexp_replace(text, MARK + "+", " ")
    text = strip_blank(_entities(text))
    if limit is not None:
        text = F.substring(text, 1, limit)
    return F.coalesce(text, F.lit(""))


def title_case(name: Column) -> Column:
    """Capital after every non-letter, the rest lower; ``initcap`` looks at blanks only."""
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_name(name: Column) -> Column:
    """Trim, title case, runs of white space to one blank; null stays null."""
    return F.regexp_replace(title_case(strip_blank(name)), r"[\s ]+", " ")


def names_joined(items: Column) -> Column:
    """Names of nested items joined by a comma."""
    return F.coalesce(
        F.array_join(F.transform(items, lambda c: F.coalesce(c["name"], F.lit(""))), ", "),
        F.lit(""),
    )


def fixed(value: Column, decimals: int) -> Column:
    """Fixed decimals as text, half-even on the exact value, no grouping."""
    pattern = "0" + ("." + "0" * decimals if decimals else "")
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def trimmed(text: Column) -> Column:
    return F.coalesce(strip_blank(text), F.lit(""))
